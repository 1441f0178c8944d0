"""Personal data (operator 9), with DataFrame functions only.

A regular expression for each kind proposes spans, leftmost and not overlapping; a validator confirms them: the range of an
address's parts, Luhn's sum, the rest modulo 97, the number of digits. Words near a span change its score. The four base
kinds are kept whatever their score; the added kinds need ``THRESHOLD``.

Places come from one split: the pieces between the matches and the matches themselves alternate, so running sums of their
lengths are the places. All loops of the expressions are possessive or over single characters, which neither recurse nor
try again, and are worded so that they find what the plain patterns find.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import fresh

THRESHOLD = 0.7
#: Characters before a span that are searched for context words.
NEAR = 40
_BLOCK = 128


#: Characters of an international account number, and the countries that use so many.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    hint: str  # a cheap test that every text with a match passes: a substring, or an expression if ``hint_is_pattern``
    valid: Callable[[Column], Column]
    score: float
    context: str
    base: bool = True
    hint_is_pattern: bool = False


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether Luhn's sum is a multiple of ten: every second digit from the right counts twice, less nine above nine."""
    each = F.split(F.reverse(digits), "")
    parts = F.transform(F.filter(each, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x) % 10 == 0


def _mod97(span: Column) -> Column:
    """Whether the first four characters behind the rest, letters as numbers from 10, leave 1 modulo 97."""
    plain = F.regexp_replace(span, " ", "")
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97) == 1


def _at_most_255(part: Column) -> Column:
    value = F.ltrim(part, F.lit("0"))
    return (F.length(value) < 3) | ((F.length(value) == 3) & (value <= "255"))


def _iban() -> str:
    """A number of its country's length, in one or with single spaces; what stands behind it does not run into it."""
    each = "|".join(f"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}+" for n, codes in IBAN_LENGTHS.items())
    return f"(?<![A-Za-z0-9])(?:{each})(?![A-Za-z0-9])"


def _between(low: int, high: int) -> Callable[[Column], Column]:
    return lambda span: F.length(_digits(span)).between(low, high)


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         lambda s: F.lit(True), 0.9, r"mail|write|contact|kontakt|contacto|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".",
         lambda s: F.forall(F.split(s, r"\."), _at_most_255), 0.6, r"\bip\b|address|server|host|adresse|dirección"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9]){15,}+", r"[0-9][\x20-]?[0-9]",
         lambda s: _between(16, 19)(s) & _luhn(_digits(s)), 0.9, r"card|karte|carte|tarjeta|visa|master", hint_is_pattern=True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+",
         _between(8, 15), 0.7, r"phone|call|tel|mobile|fax|telefon|téléphone|teléfono"),
    Kind("iban", _iban(), "[A-Z]{2}[0-9]{2}",
         _mod97, 0.9, r"iban|account|konto|compte|cuenta|bank", base=False, hint_is_pattern=True),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-",
         lambda s: ~s.rlike("^(000|666|9..)|-00-|-0000$"), 0.5, r"ssn|social|security|insurance", base=False),
)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _blocks(lengths: Column) -> Column:
    last = F.floor((F.size(lengths) - 1) / _BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))


def _block_bases(blocks: Column) -> Column:
    return F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda acc, b: F.array_append(acc, F.element_at(acc, -1) + _total(b)))


def _running(blocks: Column, bases: Column) -> Column:
    """Sum of all numbers before each place. Sums of blocks first, so the work is near linear in the number of matches."""
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("own"), F.slice(bases, F.lit(1), F.size(blocks)).alias("base")), lambda z: F.transform(
        z["own"], lambda _, j: z["base"] + _total(F.slice(z["own"], F.lit(1), j)))))


def _possible(kind: Kind, text: Column) -> Column:
    return text.rlike(kind.hint) if kind.hint_is_pattern else text.contains(kind.hint)


def found(docs: DataFrame, text: str, kinds: tuple[Kind, ...] = KINDS) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with a column of confirmed spans for each kind, array of ``start, end, score``; their names."""
    keep = list(docs.columns)
    names = {k.name: fresh(f"spans_{k.name}", docs) for k in kinds}
    matches = {k.name: fresh(f"matches_{k.name}", docs) for k in kinds}
    gaps = {k.name: fresh(f"gaps_{k.name}", docs) for k in kinds}
    body = F.coalesce(docs[text], F.lit(""))
    # Each step is a projection of its own, so that nothing is computed twice.
    step = docs.select(*[docs[c] for c in keep], *[
        F.when(_possible(k, body), F.regexp_extract_all(body, F.lit(k.pattern), F.lit(0))).otherwise(F.array().cast("array<string>")).alias(matches[k.name])
        for k in kinds])
    body = F.coalesce(F.col(text), F.lit(""))
    gap = lambda g: F.struct(F.length(g).cast("long").alias("n"), F.lower(F.substring(g, -NEAR, NEAR)).alias("tail"))
    step = step.select(*keep, *matches.values(), *[
        F.when(F.size(matches[k.name]) > 0, F.transform(F.split(body, k.pattern, -1), gap)).alias(gaps[k.name]) for k in kinds])
    pair = lambda z: F.array(z["g"], F.coalesce(F.length(z["m"]), F.lit(0)).cast("long"))
    lengths = {k.name: fresh(f"lengths_{k.name}", docs) for k in kinds}
    blocks = {k.name: fresh(f"blocks_{k.name}", docs) for k in kinds}
    bases = {k.name: fresh(f"bases_{k.name}", docs) for k in kinds}
    starts = {k.name: fresh(f"starts_{k.name}", docs) for k in kinds}
    some = {k.name: F.size(matches[k.name]) > 0 for k in kinds}
    held = [*keep, *matches.values(), *gaps.values()]
    step = step.select(*held, *[F.when(some[k.name], F.flatten(F.transform(F.arrays_zip(
        F.transform(gaps[k.name], lambda g: g["n"]).alias("g"), F.col(matches[k.name]).alias("m")), pair))).alias(lengths[k.name]) for k in kinds])
    step = step.select(*held, *[F.when(some[k.name], _blocks(F.col(lengths[k.name]))).alias(blocks[k.name]) for k in kinds])
    step = step.select("*", *[F.when(some[k.name], _block_bases(F.col(blocks[k.name]))).alias(bases[k.name]) for k in kinds])
    step = step.select(*held, *[
        F.when(some[k.name], _running(F.col(blocks[k.name]), F.col(bases[k.name]))).alias(starts[k.name]) for k in kinds])

    def spans(k: Kind) -> Column:
        def span(m: Column, i: Column) -> Column:
            start = F.element_at(F.col(starts[k.name]), 2 * i + 2)
            near = F.element_at(F.col(gaps[k.name]), i + 1)["tail"].rlike(k.context)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"),
                            F.when(k.valid(m), F.least(F.lit(k.score) + F.when(near, 0.25).otherwise(0.0), F.lit(1.0))).alias("score"))

        keeps = (lambda s: s["score"].isNotNull()) if k.base else (lambda s: s["score"] >= THRESHOLD)
        return F.when(F.size(matches[k.name]) > 0, F.filter(F.transform(F.col(matches[k.name]), span), keeps)).otherwise(
            F.array().cast("array<struct<start:bigint,end:bigint,score:double>>"))

    return step.select(*keep, *[spans(k).alias(names[k.name]) for k in kinds]), names


def _joined(names: dict[str, str], kinds: list[Kind]) -> Column:
    def texts(k: Kind) -> Column:
        return F.transform(F.col(names[k.name]), lambda s: F.concat_ws(":", F.lit(k.name), s["start"].cast("string"), s["end"].cast("string")))

    return F.concat_ws(",", F.concat(*map(texts, kinds)))


def spans_of(docs: DataFrame) -> DataFrame:
    """Personal data of every text: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores``.

    Places are code points, ends exclusive; ``spans`` and ``scores`` stand by kind, then start. The counts are those of the base
    kinds. A null or empty text has none. Every row gives one row, repeated ones and those without an id too; other columns are not read.
    """
    base = [k for k in KINDS if k.base]
    rows, names = found(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), "text")
    scores = F.concat_ws(",", F.concat(*[F.transform(F.col(names[k.name]), lambda s: F.format_number(s["score"], 2)) for k in KINDS]))
    return rows.select("doc_id", *[F.size(names[k.name]).cast("long").alias(f"n_{k.name}") for k in base],
                       F.sha2(_joined(names, base), 256).alias("base_sha256"), _joined(names, list(KINDS)).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every confirmed span replaced by its kind in brackets, kind after kind; columns and rows stay.

    ``n_chars``, if there, is the new number of code points. A later kind is searched in what the earlier ones have left, so of
    overlapping spans the first kind wins. A null text stays null.
    """
    out = docs
    for kind in KINDS:
        out = _redact_kind(out, kind)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _redact_kind(docs: DataFrame, kind: Kind) -> DataFrame:
    matches, gaps = fresh("redact_matches", docs), fresh("redact_gaps", docs)
    body = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumn(matches, F.when(_possible(kind, body), F.regexp_extract_all(body, F.lit(kind.pattern), F.lit(0))))
    out = out.withColumn(gaps, F.when(F.size(matches) > 0, F.split(F.col("text"), kind.pattern, -1)))

    def piece(gap: Column, i: Column) -> Column:
        match = F.get(F.col(matches), i)
        near = F.lower(F.substring(gap, -NEAR, NEAR)).rlike(kind.context)
        sure = kind.valid(match)
        if not kind.base:
            sure = sure & (F.lit(kind.score) + F.when(near, 0.25).otherwise(0.0) >= THRESHOLD)
        return F.when(match.isNull(), gap).otherwise(F.concat(gap, F.when(sure, F.lit(f"[{kind.name.upper()}]")).otherwise(match)))

    text = F.when(F.size(matches) > 0, F.array_join(F.transform(F.col(gaps), piece), "")).otherwise(F.col("text"))
    return out.withColumn("text", text).drop(matches, gaps)
