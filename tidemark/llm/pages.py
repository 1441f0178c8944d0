"""Main text of web pages (operator 10): a linear-chain conditional random field over the leaf blocks of the document tree.

A page is read into leaf blocks: runs of text between block-level tags, each with its open ancestors. Features are the
ancestors' tags, words of their class, id and role, and measures of the text. The field has two labels, article and the
rest, is trained by stochastic gradient descent on its likelihood, and is decoded by Viterbi.

No labelled pages come with the data, so ``labelled_pages`` composes them: site furniture of many kinds around an article, with
words drawn at random so that no word is learned, sound and sloppy markup, marked only with what each block is.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame

from tidemark.llm.common import map_texts

SCHEMA = "page_id long, url string, text string, n_chars long"
_BUCKETS = 1 << 15
#: Tags that end a block of text.
_BLOCKS = frozenset((
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section "
    "select summary table tbody td template tfoot th thead title tr ul").split())
#: Elements whose content is not markup and not text of the page.
_HIDDEN = frozenset("script style textarea iframe noembed noframes xmp".split())
#: Inside ``svg`` these are labels, apart from each other but not blocks.
_LABELS = frozenset("title desc text".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag ends these open elements, up to the given borders.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_BORDER = frozenset("ul ol menu dl select table article aside section div body main nav footer header form".split())
_START = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
_NAMED = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Weights are summed as multiples of this, so that a sum does not depend on the order in which ancestors come and go.
_GRAIN = 2.0**-40


@dataclass(frozen=True, eq=False, slots=True)
class Ancestor:
    """An open block-level element; blocks below it share it."""

    tag: str
    names: str  # its class, id, role and the like
    outer: Ancestor | None
    depth: int


@dataclass
class Leaf:
    text: str
    inside: Ancestor | None  # the innermost
    linked: int  # characters inside links

    @property
    def path(self) -> tuple[tuple[str, str], ...]:
        """Tags and names of the ancestors, the outermost first."""
        found, at = [], self.inside
        while at:
            found.append((at.tag, at.names))
            at = at.outer
        return tuple(reversed(found))


class _Tags:
    """Tags of a page: ``start, end, slash, name, attributes``; comments and declarations have no name.

    A ``>`` in quotes does not end a tag, unless none outside follows. Quotes opened on a way that led to no end are remembered, so
    that no way is gone twice and the time is linear in the page.
    """

    def __init__(self, page: str) -> None:
        self.page, self.last, self.lost = page, page.rfind(">"), set()

    def _end(self, at: int) -> int:
        if at > self.last:
            return -1
        opened, here = [], at
        while stop := _STOP.search(self.page, here):
            if stop[0] == ">":
                return stop.start()
            if stop.start() in self.lost:
                break
            opened.append(stop.start())
            here = self.page.find(stop[0], stop.end()) + 1
            if not here:
                break
        self.lost.update(opened)
        return self.page.find(">", at)

    def after(self, at: int) -> tuple[int, int, str, str, str] | None:
        """The first tag that starts at ``at`` or later."""
        while found := _START.search(self.page, at):
            at = found.end()
            if found[2]:
                end = self._end(at)
                if end >= 0:
                    return found.start(), end + 1, found[1], found[2].lower(), self.page[at:end]
            else:
                close = "-->" if found[0] == "<!--" else ">"
                end = self.page.find(close, at)
                return found.start(), end + len(close) if end >= 0 else len(self.page), "", "", ""
        return None


def leaves(page: str | None) -> list[Leaf]:
    """Leaf blocks with text, in page order. Unclosed and stray tags are taken as browsers do, roughly; a cut page ends its blocks.

    What ``math``, ``svg`` and ``object`` hold is text of the block around them. All ancestors of a block are known, however deep.
    """
    out: list[Leaf] = []
    if not page:
        return out
    stack: list[Ancestor] = []
    where: dict[str, list[int]] = {}  # places of a tag in the stack
    borders: list[int] = []
    parts: list[str] = []
    linked, link, drawing = 0, False, 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Leaf(text, stack[-1] if stack else None, linked))
            parts = []
        linked = 0

    def close(names: tuple[str, ...], bordered: bool) -> None:
        at = max((where[n][-1] for n in names if where.get(n)), default=-1)
        if at < 0 or bordered and borders and borders[-1] > at:
            return
        while len(stack) > at:
            tag = stack.pop().tag
            where[tag].pop()
            if tag in _BORDER:
                borders.pop()

    tags, at = _Tags(page), 0
    while at < len(page):
        found = tags.after(at)
        start = found[0] if found else len(page)
        if start > at:
            parts.append(page[at:start])
            if link:
                linked += start - at
        if not found:
            break
        _, at, slash, tag, attributes = found
        if not tag:
            continue
        if drawing and tag in _LABELS:
            parts.append(" ")
            continue
        if tag == "svg" and not attributes.endswith("/"):
            drawing = max(0, drawing + (-1 if slash else 1))
        if slash:
            if tag == "a":
                link = False
            elif tag in _BLOCKS:
                flush()
                close((tag,), False)
            continue
        if tag in _HIDDEN:
            if not attributes.endswith("/"):
                stop = re.compile(f"</{tag}", re.I).search(page, at)
                stop = page.find(">", stop.start()) if stop else -1
                at = stop + 1 if stop >= 0 else len(page)
            continue
        if tag == "a":
            link = True
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCKS:
            flush()
            if tag in _ENDS:
                close(_ENDS[tag], True)
            elif tag != "button":
                close(("p", "h1", "h2", "h3", "h4", "h5", "h6"), True)
            if tag == "body":
                close(("head",), False)
            if tag not in _VOID:
                names = " ".join(next(x for x in m[1:] if x is not None) for m in (n.groups() for n in _NAMED.finditer(attributes))) if attributes else ""
                where.setdefault(tag, []).append(len(stack))
                if tag in _BORDER:
                    borders.append(len(stack))
                stack.append(Ancestor(tag, names, stack[-1] if stack else None, len(stack)))
    flush()
    return out


@lru_cache(maxsize=50_000)
def _bucket(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % _BUCKETS


@lru_cache(maxsize=20_000)
def own_features(tag: str, names: str) -> frozenset[str]:
    """What one ancestor says: its tag and the words of its names."""
    found = {f"tag:{tag}"}
    for word in _PART.findall(names):
        found.add(f"name:{word.lower()}")
        if len(word) > 5:
            found.add(f"stem:{word[:5].lower()}")
    if names:
        found.add(f"named:{tag}")
    return frozenset(found)


def _near(inside: Ancestor | None) -> list[str]:
    """What the order of the two innermost ancestors says."""
    if inside is None:
        return []
    return [f"in:{inside.tag}", f"last:{f'{inside.outer.tag} ' if inside.outer else ''}{inside.tag}"]


def _outside(tags: Iterable[str]) -> list[str]:
    return [f"outside:{tag}" for tag in ("article", "main") if f"tag:{tag}" not in tags]


def path_features(leaf: Leaf) -> tuple[int, ...]:
    """Buckets of what the ancestors say: tags, innermost tags, words of names. A feature counts once."""
    found = set().union(*(own_features(*a) for a in leaf.path))
    return tuple(sorted(_bucket(f) for f in (*found, *_outside(found), *_near(leaf.inside))))


def text_features(leaf: Leaf, place: int, count: int) -> tuple[int, ...]:
    """Buckets of measures of the text: length, share of links, ending, marks of notices."""
    text, n = leaf.text, len(leaf.text)
    words = text.count(" ") + 1
    share = min(4, 4 * leaf.linked // max(n, 1))
    found = ["always", f"words:{min(8, words.bit_length())}", f"linked:{share}", f"end:{text[-1] if text[-1] in '.!?:;' else 'x'}",
             f"place:{0 if place < 2 else 2 if place >= count - 2 else 1}"]
    if text[0] in "©®™»›|" or "©" in text[:20]:
        found.append("mark")
    if share == 4 and words <= 4:
        found.append("menu")
    return tuple(_bucket(f) for f in found)


@dataclass
class Field:
    weights: np.ndarray  # bucket x label
    steps: np.ndarray  # label x label

    @cached_property
    def _grains(self) -> list[list[int]]:
        return np.rint(self.weights / _GRAIN).astype(np.int64).tolist()

    def _paths(self, blocks: Sequence[Leaf]) -> Iterator[tuple[int, int]]:
        """Sums over ``path_features`` in grains; ancestors that two neighbouring blocks share are not looked at again."""
        grains, open_, counts = self._grains, [], Counter()
        sums = [0, 0]

        def enter(one: Ancestor) -> None:
            open_.append(one)
            for f in own_features(one.tag, one.names):
                counts[f] += 1
                if counts[f] == 1:
                    a, b = grains[_bucket(f)]
                    sums[0] += a
                    sums[1] += b

        def leave() -> None:
            one = open_.pop()
            for f in own_features(one.tag, one.names):
                counts[f] -= 1
                if not counts[f]:
                    del counts[f]
                    a, b = grains[_bucket(f)]
                    sums[0] -= a
                    sums[1] -= b

        for block in blocks:
            entered, at = [], block.inside
            depth = at.depth if at else -1
            while len(open_) > depth + 1:
                leave()
            while at and (at.depth >= len(open_) or open_[at.depth] is not at):
                entered.append(at)
                at = at.outer
                while len(open_) > entered[-1].depth:
                    leave()
            for one in reversed(entered):
                enter(one)
            extra = [grains[_bucket(f)] for f in (*_outside(counts), *_near(block.inside))]
            yield sums[0] + sum(e[0] for e in extra), sums[1] + sum(e[1] for e in extra)

    def emissions(self, blocks: Sequence[Leaf]) -> np.ndarray:
        """Scores of the labels of every block, in time linear in the page."""
        paths = np.array(list(self._paths(blocks)), dtype=np.float64).reshape(-1, 2) * _GRAIN
        texts = np.array([self.weights[list(text_features(b, i, len(blocks)))].sum(axis=0) for i, b in enumerate(blocks)]).reshape(-1, 2)
        return paths + texts

    def decode(self, blocks: Sequence[Leaf]) -> list[bool]:
        """Viterbi: whether each block belongs to the article on the best path; of equal paths the one with the rest earlier."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.steps.tolist()
        scores = self.emissions(blocks).tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            from_a, from_b = (a + aa >= b + ba), (a + ab >= b + bb)
            a, b, last = (a + aa if from_a else b + ba) + x, (a + ab if from_b else b + bb) + y, (from_a, from_b)
            back.append(last)
        label = 1 if b > a else 0
        labels = [label]
        for from_a, from_b in reversed(back):
            label = 0 if (from_a if label == 0 else from_b) else 1
            labels.append(label)
        return [bool(x) for x in reversed(labels)]


def train(pages: Sequence[tuple[Sequence[Leaf], Sequence[bool]]], epochs: int = 6, rate: float = 0.3, seed: int = 3) -> Field:
    """Maximum likelihood by adaptive gradient descent, page by page; gradients from the forward-backward sums."""
    field = Field(np.zeros((_BUCKETS, 2)), np.zeros((2, 2)))
    square, square_steps = np.full((_BUCKETS, 2), 1e-2), np.full((2, 2), 1e-2)
    rng = np.random.default_rng(seed)
    ready = [([path_features(b) + text_features(b, i, len(blocks)) for i, b in enumerate(blocks)], np.array(labels, dtype=int))
             for blocks, labels in pages if len(blocks)]
    for _ in range(epochs):
        for p in rng.permutation(len(ready)).tolist():
            features, y = ready[p]
            n = len(y)
            flat = np.concatenate([np.array(f) for f in features])
            owner = np.repeat(np.arange(n), [len(f) for f in features])
            scores = np.zeros((n, 2))
            np.add.at(scores, owner, field.weights[flat])
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = scores[0]
            for t in range(1, n):
                forward[t] = scores[t] + np.logaddexp(forward[t - 1, 0] + field.steps[0], forward[t - 1, 1] + field.steps[1])
            for t in range(n - 2, -1, -1):
                ahead = scores[t + 1] + backward[t + 1]
                backward[t] = np.logaddexp(field.steps[:, 0] + ahead[0], field.steps[:, 1] + ahead[1])
            total = np.logaddexp(*forward[-1])
            error = np.exp(forward + backward - total)
            error[np.arange(n), y] -= 1
            if n > 1:
                both = np.exp(forward[:-1, :, None] + field.steps[None] + (scores[1:] + backward[1:])[:, None, :] - total).sum(axis=0)
                np.subtract.at(both, (y[:-1], y[1:]), 1)
                square_steps += both**2
                field.steps -= rate * both / np.sqrt(square_steps)
            used, where = np.unique(flat, return_inverse=True)
            gradient = np.stack([np.bincount(where, error[owner, k], len(used)) for k in range(2)], axis=1) + 1e-3 * field.weights[used]
            square[used] += gradient**2
            field.weights[used] -= rate * gradient / np.sqrt(square[used])
    return field


# What surrounds articles, as (opening tag, kind); a page draws from these. Names are those in common use on the web.
_FURNITURE = (
    ("nav", "menu"), ('nav class="breadcrumb"', "menu"), ('div class="menu"', "menu"), ('div id="nav"', "menu"), ('ul class="navbar"', "items"),
    ('div class="breadcrumbs"', "menu"), ('div role="navigation"', "menu"), ('div class="site-navigation"', "menu"), ('div class="toc"', "menu"),
    ("header", "line"), ('div id="header"', "line"), ('div class="site-header"', "line"), ('div class="masthead"', "line"), ('div class="topbar"', "line"),
    ("aside", "box"), ('div class="sidebar"', "box"), ('aside class="widget"', "box"), ('div class="related"', "menu"), ('section class="related-posts"', "menu"),
    ('div class="recommended"', "menu"), ('div class="popular"', "menu"), ('div class="tags"', "menu"), ('div class="pagination"', "menu"),
    ('div class="ad"', "prose"), ('div class="ads"', "prose"), ('div class="advert"', "prose"), ('div class="advertisement"', "prose"), ('div class="banner"', "prose"),
    ('div class="promo"', "prose"), ('div class="sponsored"', "prose"), ('div id="ad-slot"', "prose"), ('aside class="ad-box"', "prose"), ('ins class="adsbygoogle"', "prose"),
    ('div class="cookie"', "prose"), ('div class="cookie-notice"', "prose"), ('div id="cookie-banner"', "prose"), ('div class="consent"', "prose"), ('div class="notice"', "prose"),
    ('div role="alert"', "prose"), ('div class="alert"', "prose"), ('div class="popup"', "prose"), ('div class="modal"', "prose"), ('div class="disclaimer"', "prose"),
    ('div class="gdpr"', "prose"), ('div class="paywall"', "prose"), ("dialog", "prose"),
    ("form", "form"), ('form class="search"', "form"), ('div class="newsletter"', "form"), ('div class="subscribe"', "form"), ('div class="signup"', "form"), ('div class="login"', "form"),
    ('section class="comments"', "talk"), ('div id="comments"', "talk"), ('div class="comments"', "talk"), ('div class="comment"', "prose"), ('ol class="comment-list"', "items"),
    ('div class="responses"', "talk"), ('section id="discussion"', "talk"), ('div class="replies"', "talk"), ('div class="reader-comments"', "talk"),
    ('div class="share"', "menu"), ('div class="social"', "menu"), ('div class="byline-links"', "menu"), ('div class="author-box"', "box"),
    ("footer", "line"), ('div id="footer"', "line"), ('div class="site-footer"', "line"), ('div class="copyright"', "line"), ('div class="legal"', "prose"),
)
_INSIDE = tuple(x for x in _FURNITURE if any(w in x[0] for w in ("ad", "related", "share", "social", "newsletter", "aside", "comment", "promo", "form", "notice", "tags")))
_HOMES = ("article", "main", 'div class="content"', 'div id="content"', 'div class="post"', 'div class="entry-content"', 'div class="article-body"',
          'section class="story"', 'div itemprop="articleBody"', 'article class="post"', 'main id="main"', 'div class="main-content"', 'div role="main"')


def labelled_pages(count: int = 700, seed: int = 1) -> list[tuple[list[Leaf], list[bool]]]:
    """Composed pages as leaf blocks with their labels."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("aeinorstlu"))
    chance = lambda p: bool(rng.random() < p)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    serial = 0

    def line(low: int, high: int, stop: str = "") -> str:
        nonlocal serial
        serial += 1  # makes every text its own
        return " ".join(["".join(rng.choice(letters, int(rng.integers(2, 9)))) for _ in range(int(rng.integers(low, high)))] + [f"k{serial}"]).capitalize() + stop

    def prose(long: int = 60) -> str:
        return " ".join(line(1, max(3, long // 4), pick(".!?..")) for _ in range(int(rng.integers(1, 5))))

    def furniture(opening: str, kind: str) -> str:
        tag = opening.split()[0]
        link = lambda: f'<a href="/{line(1, 2)}">{line(1, 3)}</a>'
        items = lambda item: "".join(f"<li>{item()}</li>" for _ in range(int(rng.integers(2, 8))))
        body = {
            "menu": lambda: f"<ul>{items(link)}</ul>" if chance(0.7) else " | ".join(link() for _ in range(4)),
            "items": lambda: items(link if "nav" in opening else prose),
            "line": lambda: pick((f"&copy; {line(2, 12)}", f"{line(1, 5)} &middot; {prose(20)}", f"<p>{prose(20)}</p>", f"<h2>{line(1, 6)}</h2>")),
            "box": lambda: f"<h3>{line(1, 4)}</h3><p>{prose(30)}</p>" if chance(0.5) else f"<h3>{line(1, 3)}</h3><ul>{items(link)}</ul>",
            "prose": lambda: pick((prose(40), f"<p>{prose(40)}</p>", f"<p>{prose(20)}</p><p>{prose(60)}</p>", f"{prose(30)} {link()}")),
            "form": lambda: f"<label>{line(1, 4)}</label><input><button>{line(1, 3)}</button>" + (f"<p>{prose(20)}</p>" if chance(0.4) else ""),
            "talk": lambda: f"<h3>{line(1, 3)}</h3>" + "".join(
                pick((f'<div class="comment"><b>{line(1, 3)}</b><p>{prose(40)}</p></div>', f"<p>{prose(50)}</p>", f"<ul><li>{prose(30)}</li></ul>")) for _ in range(int(rng.integers(1, 5)))),
        }[kind]()
        return f"<{opening}>{body}</{tag}>"

    def article() -> list[str]:
        def paragraph() -> str:
            text = prose(pick((6, 40, 120)))
            if chance(0.15):
                text = f"<b>{text}" + ("</b>" if chance(0.5) else "")
            if chance(0.15):
                text += f' <a href="/x">{line(1, 4)}</a> {line(1, 9, ".")}'
            if chance(0.1):
                text += f"<br>{prose(20)}"
            return f"<p>{text}" + ("</p>" if chance(0.8) else "")

        other = (lambda: f"<h2>{line(1, 8)}</h2>", lambda: f"<h3>{line(1, 8)}</h3>", lambda: "<ul>" + "".join(f"<li>{line(2, 12)}</li>" for _ in range(3)) + "</ul>",
                 lambda: f"<blockquote>{prose(40)}</blockquote>", lambda: f"<table><tr><td>{line(1, 4)}</td><td>{line(1, 4)}</td></tr></table>",
                 lambda: f"<figure><img><figcaption>{line(2, 12)}</figcaption></figure>", lambda: f"<pre>{line(2, 12)}</pre>", lambda: f"<div>{prose(60)}</div>",
                 lambda: "<ol>" + "".join(f"<li><p>{prose(20)}</p></li>" for _ in range(2)) + "</ol>")
        parts = [pick(other)() if chance(0.2) else paragraph() for _ in range(int(rng.integers(1, 12)))]
        return ([f"<h1>{line(2, 14)}</h1>"] if chance(0.8) else []) + parts

    out = []
    for _ in range(count):
        home = "article" if chance(0.35) else pick(_HOMES)
        wrap = pick(("", "", "div", 'div class="container"', 'div id="page"', 'div class="wrapper"', "section"))
        parts = article()
        article_texts = {b.text for part in parts for b in leaves(part)}
        for _ in range(int(rng.integers(0, 3))):
            if chance(0.4):
                parts.insert(int(rng.integers(0, len(parts) + 1)), furniture(*pick(_INSIDE)))
        # A paragraph left open must not swallow what is put behind it: block tags end it.
        inner = f"<{home}>" + "".join(parts) + f"</{home.split()[0]}>"
        before = "".join(furniture(*pick(_FURNITURE)) for _ in range(int(rng.integers(0, 4))))
        after = "".join(furniture(*pick(_FURNITURE)) for _ in range(int(rng.integers(0, 5))))
        body = before + inner + after
        if wrap:
            body = f"<{wrap}>{body}</{wrap.split()[0]}>"
        page = f"<html><head><title>{line(2, 12)}</title></head><body>{body}" + ("</body></html>" if chance(0.8) else "")
        blocks = leaves(page)
        out.append((blocks, [b.text in article_texts for b in blocks]))
    return out


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field trained on the composed pages; the same in every process."""
    return train(labelled_pages())


def extract(page: str | None, field: Field) -> str:
    blocks = leaves(page)
    return " ".join(b.text for b, kept in zip(blocks, field.decode(blocks)) if kept)


def main_text(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Main text of every page: ``SCHEMA``. A null or empty page, or one without an article, has an empty text.

    Every row gives one row, repeated ones and those without an id too; columns other than ``page_id``, ``url`` and ``html`` are not
    read. Blocks are kept or left whole.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())  # of fixed size

    def run(texts, batch):
        found = [extract(t, shared.value) for t in texts]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": found, "n_chars": [len(t) for t in found]}

    return map_texts(pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html")),
                     run, SCHEMA, "html")
