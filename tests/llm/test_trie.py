"""The prefix trie against a plain walk over prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import turntrie
from tidemark.llm.common import prepare

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, digest), role, text))
    turns = {c: [t[1:] for t in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        paths[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    own_saved = {p: (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) for p, m in nodes.items()}
    children = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved[p]
            leaves[p[:d]] += children[p] == 0
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p)))).encode()).hexdigest())
                  for p, m in nodes.items())


def nodes_of(df, **kw):
    return sorted(map(tuple, turntrie.prefix_trie(df, **kw).collect()), key=lambda r: r[:2])


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        conv = rng.choice([c, c, -c, 10 * c])
        for t in range(rng.choice([1, 1, 2, 4, 9, 12])):
            rows.append((conv, rng.choice([t, t, t, None]), rng.choice(["user", "user", "assistant", None]), rng.choice(["a", "a", "bé", "c" * 9, "", None])))
    return rows


@pytest.mark.parametrize("cells", [1, 60, 500, turntrie.CELLS])
def test_nodes_of_random_conversations(spark, cells):
    prepare(spark)
    rows = random_rows(cells, 90)
    assert nodes_of(spark.createDataFrame(rows, SCHEMA), cells=cells) == plain(rows)


def test_hot_first_turns_copies_and_a_long_conversation(spark):
    """A third of the conversations are copies, a third share their first turn, one is long; shards are small."""
    prepare(spark)
    rows = [(c, t, "user", f"same {t}") for c in range(0, 120) for t in range(3)]
    rows += [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(200, 320) for t in range(2)]
    rows += [(500, t, "user", f"turn {t % 7}") for t in range(700)] + [(501, t, "user", f"turn {t % 7}") for t in range(350)]
    assert nodes_of(spark.createDataFrame(rows, SCHEMA), cells=400) == plain(rows)


def test_awkward_conversations(spark):
    prepare(spark)
    rows = [(None, 1, "user", "no id"), (3, None, None, None), (3, None, None, None), (3, 1, "user", ""), (4, 2, "", "user"), (9, 0, "a", "b"), (9, 0, "a", "b"),
            (11, 5, "user", "long " * 50_000), (-7, 1, "x", "y"), ((1 << 62), 1, "x", "é😀")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit(1) for n in ("ids", "sizes", "base", "depth", "key", "own", "first", "h")})
    assert nodes_of(df) == plain(rows)
    assert turntrie.prefix_trie(df.limit(0)).count() == 0
    assert turntrie.prefix_trie(df.where("conv_id is null")).count() == 0
    one = nodes_of(df.where("conv_id = 9").limit(1))
    assert [r[:7] for r in one][0] == (9, 0, None, 1, 1 if len(one) > 1 else 0, 1, 0)
