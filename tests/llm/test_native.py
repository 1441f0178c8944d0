"""Source mixing and personal data against plain Python."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing, pii
from tidemark.llm.common import prepare

BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        total += int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10))
    return total % 10 == 0


def base_spans(text):
    def passes(kind, match):
        digits = re.sub("[^0-9]", "", match)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE for m in re.finditer(p, text) if passes(k, m[0])]


def test_base_spans_of_random_texts(spark):
    prepare(spark)
    rng = random.Random(3)
    bits = ["4111111111111111", "a@b.c", "1.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111", "255.0.256.1", "😀", "GB82WEST12345698765432"]
    texts = ["".join(rng.choice("a1.@+- ()9_%é4") for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    texts += ["".join(rng.choice([*bits, *"a1. -@"]) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    texts += ["1" * 30_000, "a." * 20_000 + "@", "a@" + "a." * 20_000, "1 " * 20_000, "a@b.c " * 2_000, "+1 (" * 5_000]
    rows = pii.spans_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id][:80]
        assert r.spans.split(",")[:len(want)] == (want or r.spans.split(",")[:0])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k, _ in BASE]


def test_cards_whose_digits_all_stand_apart(spark):
    spaced, dashed = " ".join("4111111111111111"), "-".join("4111111111111111")
    mixed, wrong = "4 1 1 1-1 1 1 1 1 1 1 1 1 1 1 1", " ".join("4111111111111112")
    texts = [spaced, dashed, mixed, wrong, f"a@b.c {mixed}, 1.2.3.4", f"u12@b.c {dashed}", f"ip 10.20.30.40, {spaced}", "1 2", "4 1 1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.spans_of(df).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and r.n_card == (r.doc_id in (0, 1, 2, 4, 5, 6)), texts[r.doc_id]
    # The other kinds' digits are gone when cards are searched.
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert [got[i] for i in range(9)] == ["[CARD]"] * 3 + [wrong, "[EMAIL] [CARD], [IP]", "[EMAIL] [CARD]", "ip [IP], [CARD]", "1 2", "4 1 1"]


def test_added_kinds_need_check_sum_or_context(spark):
    rows = [(1, "pay GB82 WEST 1234 5698 7654 32 now"), (2, "pay GB83 WEST 1234 5698 7654 32 now"), (3, "social security 123-45-6789"), (4, "part 123-45-6789"), (5, "ssn 000-45-6789")]
    got = {r.doc_id: r.spans for r in pii.spans_of(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "iban:4:31", 2: "", 3: "ssn:16:27", 4: "", 5: ""}


def test_account_numbers_end_at_their_length(spark):
    def number(country: str, length: int) -> str:
        body = ("10020030040050060070080090" * 2)[: length - 4]
        digits = "".join(str(int(c, 36)) for c in body + country)
        return f"{country}{98 - int(digits + '00') % 97:02d}{body}"

    numbers = [number(c, n) for n, codes in pii.IBAN_LENGTHS.items() for c in codes.split()]
    spaced = [" ".join(n[i : i + 4] for i in range(0, len(n), 4)) for n in numbers]
    texts = [f"IBAN {n} BIC COBADEFFXXX 12" for n in numbers + spaced] + ["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.spans_of(df).collect():
        want = (numbers + spaced + ["DE89 3704 0044 0532 0130 00"])[r.doc_id]
        assert f"iban:5:{5 + len(want)}" in r.spans.split(","), texts[r.doc_id]
    cut = spark.createDataFrame([(1, f"IBAN {number('DE', 22)}7"), (2, f"IBAN {number('DE', 22)[:-1]}"), (3, f"IBAN {number('ZZ', 22)}")], "doc_id long, text string")
    assert all("iban" not in r.spans for r in pii.spans_of(cut).collect())


def test_redaction(spark):
    rows = [(1, "é a@b.cd, 1.2.3.4!", 18), (2, None, 0), (3, "nothing", 7), (4, "4111 1111 1111 1111 and 4111 1111 1111 1112", 43)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").withColumn("redact_gaps", F.lit(1))
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "é [EMAIL], [IP]!" and got[1].n_chars == len(got[1].text) and pii.redact(df).schema == df.schema
    assert got[2].text is None and got[3].text == "nothing" and got[4].text == "[CARD] and 4111 1111 1111 1112"


def test_personal_data_of_awkward_rows(awkward, empty):
    assert pii.spans_of(awkward).count() == awkward.count() and pii.spans_of(empty).count() == 0
    assert pii.redact(awkward).columns == awkward.columns and pii.redact(empty).count() == 0


def plain_targets(sizes):
    """Targets by pouring again and again."""
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = sum(w for s, w in weight.items() if s not in capped)
        got = {s: 3.0 * sizes[s] if s in capped else weight[s] * rest / free for s in sizes}
        above = {s for s in sizes if s not in capped and got[s] > 3 * sizes[s]}
        if not above:
            return got
        capped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 500, "c": 3, None: 40}, {"a": 0, "b": 10}, {"x": 0}, {"b": 7},
    {f"s{i:02}": (i * i * 37) % 101 for i in range(23)} | {None: 5}, {"Z": 1000, "a": 10, "é": 1}])
def test_targets_are_those_of_repeated_pouring(spark, sizes):
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_of_the_documents(documents):
    rows = mixing.mix(documents).collect()
    assert len(rows) == documents.count()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(documents.repartition(7)).collect()))
    for r in rows:
        rate = r.target / r.source_size
        assert r.taken in (r.size * int(rate), r.size * (int(rate) + 1)) and r.taken <= 3 * r.size
    copies = {r.doc_id: r.taken // r.size for r in rows if r.size}
    own = {r.doc_id: r["count"] for r in mixing.mixed(documents).groupBy("doc_id").count().collect()}
    assert own == {k: n for k, n in copies.items() if n}


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "word " * (1 + i % 7), "abc"[i % 10 % 3]) for i in range(30_000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(r.taken == pytest.approx(r.target, rel=0.03) for r in got)


def test_many_sources_are_joined_not_broadcast(documents, monkeypatch):
    want = sorted(map(tuple, mixing.mix(documents).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(documents).collect())) == want


def test_mix_of_awkward_rows(awkward, empty):
    got = mixing.mix(awkward).collect()
    assert len(got) == awkward.count() and mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert len({r.taken for r in got if r.doc_id == 5 and r.size == 7}) == 1
    assert mixing.mixed(awkward).columns == awkward.columns


def test_mix_matches_its_sql(documents):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(con.execute(mixing.ORACLE).fetchall()) == sorted(map(tuple, mixing.mix(documents).collect()))
