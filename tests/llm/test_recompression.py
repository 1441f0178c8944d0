"""Removal of repeated windows against a plain count of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import recompression
from tidemark.llm.common import prepare

SCHEMA = "doc_id long, text string"


def plain(rows):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    count = Counter(tuple(w[p:p + 35]) for _, w in words for p in range(len(w) - 34))
    out = []
    for d, w in words:
        gone = {i for p in range(len(w) - 34) if count[tuple(w[p:p + 35])] > 1 for i in range(p, p + 35)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def random_rows(seed, long=False):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rng.choice([1, 2, 3, 50, 1000]))]
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 900 if long else 150))] for _ in range(4)]
    rows = [(0, None), (1, ""), (2, " \n\t\x0b ")]
    for i in range(rng.randint(2, 25)):
        t = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.6:
                q = rng.choice(pool)
                a = rng.randint(0, len(q) - 1) if rng.random() < 0.5 else 0
                t += q[a:a + rng.randint(1, 900 if long else 140)]
            else:
                t += [rng.choice(vocabulary) for _ in range(rng.randint(0, 80))]
            if rng.random() < 0.2:
                t += [rng.choice(vocabulary)] * rng.randint(1, 90)
        rows.append((i + 3, " ".join(t)))
    return rows


def in_blocks(rows, blocks):
    """What the Spark rounds do, with plain counters."""
    parts = [rows[i::blocks] for i in range(blocks)]
    made = [recompression.Block.of([t for _, t in p]) for p in parts]
    parsed = [recompression.Parsed(b) for b in made]
    names, first = Counter(), {}
    for k, p in enumerate(parsed):
        for key, times in zip(zip(p.a.tolist(), p.b.tolist()), p.times.tolist()):
            names[key] += times
            first.setdefault(key, k)
    windows, states = Counter(), []
    for k, (block, p) in enumerate(zip(made, parsed)):
        keys = list(zip(p.a.tolist(), p.b.tolist()))
        again = np.array([names[x] > 1 for x in keys], dtype=bool)
        leads = again & np.array([first[x] == k for x in keys], dtype=bool)
        sure, open_ = recompression.judge(block, p, again, leads)
        at = np.flatnonzero(open_)
        own = list(map(tuple, recompression.window_names(block, at).T.tolist()))
        windows.update(own)
        states.append((block, sure, at, own))
    out = []
    for part, (block, sure, at, own) in zip(parts, states):
        n = len(block.codes)
        start = at[np.array([windows[x] > 1 for x in own], dtype=bool)]
        keep = ~(sure | recompression._ranges(start, start + 35, n))
        for (d, _), a, b in zip(part, block.first[:-1].tolist(), block.first[1:].tolist()):
            kept = [block.words[c] for c in block.codes[a:b][keep[a:b]].tolist()]
            out.append((d, b - a, b - a - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("long", [False, True])
def test_rounds_find_what_a_plain_count_finds(long):
    for seed in range(40):
        rows = random_rows(seed, long)
        want = plain(rows)
        for blocks in (1, 2, 5):
            assert in_blocks(rows, blocks) == want


def test_equal_stretches_have_equal_symbols_inside():
    rng = random.Random(1)
    word = lambda: f"v{rng.randint(0, 400)}"
    shared = [word() for _ in range(300)]
    texts = [" ".join([word() for _ in range(rng.randint(0, 60))] + shared + [word() for _ in range(rng.randint(0, 60))]) for _ in range(6)]
    found = []
    for text in texts:
        words = text.split()
        at = next(i for i in range(len(words)) if words[i:i + 300] == shared)
        p = recompression.Parsed(recompression.Block.of([text]))
        inside = (p.low >= at) & (p.high <= at + 300)
        found.append({(int(a) - at, int(b) - at, int(p.a[k])) for a, b, k in zip(p.low[inside], p.high[inside], p.small_number[inside])})
    assert len(found[0]) > 20 and all(f == found[0] for f in found)


@pytest.mark.parametrize("limit", [500, 20_000, recompression.BLOCK])
def test_documents_in_blocks(spark, documents, limit):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert sorted(map(tuple, recompression.remove_repeats(documents, limit).collect())) == sorted(plain(rows))


def test_large_groups_and_crafted_words(spark):
    """A third of the texts are copies, a passage is in all others; words that differ as Thue-Morse sequences do."""
    prepare(spark)
    rng = random.Random(4)
    word = lambda: f"x{rng.randint(0, 3000)}"
    copy, passage = " ".join(word() for _ in range(400)), " ".join(word() for _ in range(60))
    rows = [(i, copy) for i in range(60)] + [(i, " ".join([*(word() for _ in range(90)), passage, *(word() for _ in range(90))])) for i in range(60, 180)]
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    rows += [(900, " ".join([a] + [f"y{i}" for i in range(34)])), (901, " ".join([b] + [f"y{i}" for i in range(34)]))]
    got = sorted(map(tuple, recompression.remove_repeats(spark.createDataFrame(rows, SCHEMA), 30_000).collect()))
    assert got == sorted(plain(rows)) and got[0][2] == 400 and got[100][2] == 60 and got[-1][2] == 0


def test_awkward_documents(spark, awkward, empty):
    rows = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    got = sorted(map(tuple, recompression.remove_repeats(awkward).collect()), key=order)
    assert got == sorted(plain(rows), key=order)
    assert recompression.remove_repeats(empty).count() == 0
