"""Prefix trie of conversations (operator 11) from padded matrices of turn ids.

A turn is known by the SHA-256 digest of its role and text. Conversations, as rows of digests, are dealt out in ranges of
their order (turn by turn, shorter first, then by id), so the members of a node stand together. A task takes a shard of
its range at a time: digests become small numbers, the shard a matrix padded with -1, ordered by numpy's ``lexsort``. Where a
column differs from the row before, or any column to its left does (``logical_or.accumulate``), a node starts; one ``reduceat`` for each
column then gives the members, children, leaves and tokens of all nodes of that depth.

Only nodes on the way to the first or last row of a shard can have members in another shard. Their parts are added up in
Spark afterwards, with what they own below them: on each such way, a node's share of the others is a running sum. There are as
many parts as turns in the first and last rows of the shards, however large the nodes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import stage

#: Cells of a shard's padded matrix; a longer conversation is a shard of its own.
CELLS = 2_000_000
#: Rebuilt conversations take their first turns from the conversation whose id is the next lower multiple of this ...
GROUP = 5
#: ... as many as the check sum of the id leaves when divided by this.
HEADS = 9
NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends_sha256 string")
#: A whole node has ``NODES`` (its parent's key if that is a part); a part of a node has its key, place and sums.
PARTS = NODES + ", key binary, parent_key binary, shard long, side int, size long, ends string"
_NOTHING = hashlib.sha256(b"").hexdigest()
_MOST = np.iinfo(np.int64).max


def head_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, ids, sizes``: the digests of the rebuilt turns in order, and the UTF-8 bytes of their texts.

    One shuffle, by the conversation that gives the first turns: its followers, at most nine, meet it in a window.
    """
    c = conversations
    role, text = (F.coalesce(c[n].cast("string"), F.lit("")) for n in ("role", "text"))
    turns = c.select(
        c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), F.octet_length(text).cast("long").alias("size"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("id"),
    ).where(F.col("conv_id").isNotNull()).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    own = turns.repartition("base").groupBy("base", "conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "id", "size"))).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, HEADS - 1))).over(Window.partitionBy("base"))
    empty = F.slice("own", 1, 0)
    with_head = own.withColumn("h", head_turns(F.col("conv_id")).cast("int")).withColumn("first", F.coalesce(first, empty))
    after = F.when(F.size("own") > F.col("h"), F.expr("slice(own, h + 1, size(own))")).otherwise(empty)
    before = F.when(F.col("h") > 0, F.expr("slice(first, 1, greatest(h, 1))")).otherwise(empty)
    return with_head.select("conv_id", F.concat(before, after).alias("all")).select("conv_id", F.col("all.id").alias("ids"), F.col("all.size").alias("sizes"))


class Shard:
    """Nodes of some conversations that stand together in the order; see the module's text."""

    def __init__(self, conv_ids: list[int], ids: list[list[bytes]], sizes: list[list[int]]):
        n = len(ids)
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        width = int(lengths.max(initial=0))
        digests = np.array([d for x in ids for d in x], dtype="S32")
        number = np.unique(digests, return_inverse=True)[1] if len(digests) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(n), lengths)
        column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        turn = np.full((n, width), -1, dtype=np.int32)
        turn[row, column] = number
        weight = np.zeros((n, width), dtype=np.int64)
        weight[row, column] = [s for x in sizes for s in x]
        convs = np.array(conv_ids, dtype=np.int64)
        order = np.lexsort((convs, *turn.T[::-1]))
        self.convs, self.turn, self.weight, self.lengths = convs[order], turn[order], weight[order], lengths[order]
        self.ways = [ids[order[0]], ids[order[-1]]]
        starts = np.ones((n, width), dtype=bool)
        starts[1:] = np.logical_or.accumulate(self.turn[1:] != self.turn[:-1], axis=1)
        self.starts = starts & (self.turn >= 0)

    def rows(self, shard: int) -> Iterator[tuple]:
        """Whole nodes and parts of nodes as rows of ``PARTS``."""
        n, width = self.turn.shape
        ways = [_way(way) for way in self.ways]
        common = next((j for j, (a, b) in enumerate(zip(*self.ways)) if a != b), min(map(len, self.ways)))
        levels = []
        whole = self.starts.copy()  # starts of nodes without members elsewhere
        for j in range(width):
            at = np.flatnonzero(self.starts[:, j])
            side = np.full(len(at), -1)
            if j < len(self.ways[1]):
                side[-1] = 1 if j >= common else 0
            if j < len(self.ways[0]):
                side[0] = 0
            whole[at[side >= 0], j] = False
            here = self.turn[:, j] >= 0
            levels.append((at, side, np.add.reduceat(here.astype(np.int64), at), np.minimum.reduceat(np.where(here, self.convs, _MOST), at),
                           np.add.reduceat((self.lengths == j + 1).astype(np.int64), at)))
        saved, leaf = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
        children = []
        for j, (at, side, count, _, _) in enumerate(levels):
            below = np.add.reduceat(whole[:, j + 1].astype(np.int64), at) if j + 1 < width else np.zeros(len(at), np.int64)
            children.append(below)
            own = at[side < 0]
            saved[own, j] = (count[side < 0] - 1) * self.weight[own, j]
            leaf[own, j] = below[side < 0] == 0
        saved, leaf = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (saved, leaf))
        at_root = int((self.lengths == 0).sum())
        yield (int(self.convs.min()), 0, None, n, int(whole[:, 0].sum()) if width else 0, int(leaf[:, 0].sum()) if width else 0,
               int(saved[:, 0].sum()) if width else 0, None, b"", None, shard, 0, 0, _listed(self.convs[:at_root]))
        for j, (at, side, count, low, ends) in enumerate(levels):
            sums = [x.tolist() for x in (children[j], np.add.reduceat(leaf[:, j], at), np.add.reduceat(saved[:, j], at))]
            if j:
                up_at, up_side, _, up_low, _ = levels[j - 1]
                up = np.searchsorted(up_at, at, side="right") - 1
                parent, parent_side = up_low[up].tolist(), up_side[up].tolist()
            else:
                parent, parent_side = [None] * len(at), [0] * len(at)
            for k, (i, s, members, lowest, ended) in enumerate(zip(at.tolist(), side.tolist(), count.tolist(), low.tolist(), ends.tolist())):
                listed = _listed(self.convs[i:i + ended])
                key = ways[parent_side[k]][j] if parent_side[k] >= 0 else None
                sums_k = (members, sums[0][k], sums[1][k], sums[2][k])
                if s < 0:
                    digest = hashlib.sha256(listed.encode()).hexdigest() if listed else _NOTHING
                    yield lowest, j + 1, parent[k] if key is None else None, *sums_k, digest, None, key, None, None, None, None
                else:
                    yield lowest, j + 1, None, *sums_k, None, ways[s][j + 1], ways[s][j], shard, s, int(self.weight[i, j]), listed
        if common < len(self.ways[1]):  # the second way starts at the root as well; its nodes up to there are counted above
            for j in range(common + 1):
                yield None, j, None, 0, 0, 0, 0, None, ways[1][j], ways[1][j - 1] if j else None, shard, 1, 0, None


def _listed(convs: np.ndarray) -> str | None:
    return ",".join(map(str, convs.tolist())) if len(convs) else None


def _way(ids: list[bytes]) -> list[bytes]:
    """Keys of the nodes on the way to a row, from the root: digests of digests."""
    keys = [b""]
    for x in ids:
        keys.append(hashlib.sha256(keys[-1] + x).digest())
    return keys


def _shards(rows: DataFrame, cells: int) -> DataFrame:
    schema = to_arrow_schema(StructType.fromDDL(PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, convs, ids, sizes, width = TaskContext.get().partitionId() << 32, [], [], [], 0

        def done() -> Iterator[pa.RecordBatch]:
            out = list(Shard(convs, ids, sizes).rows(number))
            for i in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i:i + 50_000]), schema)], schema=schema)

        for batch in batches:
            for conv, own, own_sizes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if convs and (len(convs) + 1) * max(width, len(own), 8) > cells:
                    yield from done()
                    number, convs, ids, sizes, width = number + 1, [], [], [], 0
                convs.append(conv)
                ids.append(own)
                sizes.append(own_sizes)
                width = max(width, len(own))
        if convs:
            yield from done()

    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, "ids", "conv_id").sortWithinPartitions("ids", "conv_id")
    return stage(dealt.select("conv_id", "ids", "sizes").mapInArrow(run, PARTS), "trie-parts")


def _ends(parts: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the nodes in parts: their lists of ended conversations, hashed piece by piece in the order of the shards.

    A hash runs over one list from its start to its end, so a list's pieces go to one task, which holds one piece at a time.
    """
    text = "key binary, ends_sha256 string"
    schema = to_arrow_schema(StructType.fromDDL(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], schema=schema)

        for batch in batches:
            for own, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
                if own != key:
                    if digest is not None:
                        yield done()
                    key, digest = own, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ends.encode())
        if digest is not None:
            yield done()

    pieces = parts.where(F.col("ends").isNotNull()).select("key", "shard", "side", "ends")
    return pieces.repartition("key").sortWithinPartitions("key", "shard", "side").mapInArrow(run, text)


def _recombined(parts: DataFrame) -> DataFrame:
    """Whole nodes, with their keys, from the parts that the shards have of them (``NODES``)."""
    merged = parts.groupBy("key").agg(
        F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("closed"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.max("size").alias("size"),
        F.min(F.when(F.col("n_convs") > 0, F.struct("shard", "side"))).alias("home"))
    merged = stage(merged, "trie-merged")
    open_children = merged.where(F.col("parent_key").isNotNull()).groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("opened"))
    own = merged.join(open_children, "key", "left").withColumn("n_children", F.col("closed") + F.coalesce("opened", F.lit(0)))
    own = own.select("*", ((F.col("n_convs") - 1) * F.col("size")).alias("own_saved"), (F.col("n_children") == 0).cast("long").alias("own_leaf"))
    # Each node counts on one of the ways it lies on; below a node are those that follow it on its ways.
    ways = parts.select("key", "depth", F.struct("shard", "side").alias("way")).join(own.select("key", "home", "own_saved", "own_leaf"), "key")
    deeper = Window.partitionBy("way").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_home = F.col("way") == F.col("home")
    shares = ways.select("key", *[F.sum(F.when(at_home, F.col(c)).otherwise(0)).over(deeper).alias(c) for c in ("own_saved", "own_leaf")])
    below = shares.groupBy("key").agg(F.sum("own_saved").alias("more_saved"), F.sum("own_leaf").alias("more_leaves"))
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return own.join(below, "key").join(parents, "parent_key", "left").join(_ends(parts), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("leaves") + F.col("more_leaves")).alias("n_leaves"),
        (F.col("saved") + F.col("more_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"), "key")


def prefix_trie(conversations: DataFrame, cells: int = CELLS) -> DataFrame:
    """All nodes (``NODES``) of the trie of rebuilt conversations.

    Turns are ordered by number, null first, rows of one number by the digest of role and text; repeated rows are turns of their own.
    A null role or text is empty. Rows without a conversation id take no part; an empty table has no nodes, not even a root. Ids below
    zero take their first turns from the next multiple of five towards zero. A conversation travels as one row, 40 bytes a turn.
    """
    found = _shards(rebuilt(conversations), cells)
    parts = found.where(F.col("key").isNotNull())
    shared = stage(_recombined(parts), "trie-shared")
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("of_key"))
    names = [f.name for f in StructType.fromDDL(NODES)]
    whole = found.where(F.col("key").isNull()).select(*names, "parent_key")
    # The root and first turns that many share are parents of many nodes: the hot side is split, the other one has a row for each part.
    inside = whole.where(F.col("parent_key").isNull()).select(*names)
    at_edge = whole.where(F.col("parent_key").isNotNull()).drop("parent_conv_id").join(parents, "parent_key").withColumnRenamed("of_key", "parent_conv_id")
    return inside.unionByName(at_edge.select(*names)).unionByName(shared.select(*names))


def _crc32(text: str) -> str:
    """DuckDB SQL for the CRC-32 of an ASCII text, bit by bit (the polynomial is a fixed value)."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii({text}[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(x, b) >> 1, 3988292384 * (xor(x, b) & 1))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda x, b: {step}), 4294967295)"


ORACLE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_crc32("CAST(conv_id AS VARCHAR)")} % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
picked AS (
  SELECT c.conv_id, 0 AS part, t.p, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.p <= c.h
  UNION ALL SELECT c.conv_id, 1, t.p, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h),
placed AS (
  SELECT conv_id, strlen(text) AS size, sha256(strlen(role) || ':' || role || text) AS id,
         row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS depth FROM picked),
paths AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS size FROM convs
  UNION ALL SELECT conv_id, depth, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth), size FROM placed),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (
  SELECT depth, path, min(conv_id) AS node, count(*) AS n_convs, max(size) AS size,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = length), '') AS ends
  FROM paths JOIN lengths USING (conv_id) GROUP BY depth, path),
of_conv AS (SELECT p.conv_id, p.depth, n.node FROM paths p JOIN nodes n ON n.depth = p.depth AND n.path = p.path),
up AS (SELECT n.*, o.node AS parent FROM nodes n LEFT JOIN of_conv o ON o.conv_id = n.node AND o.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM up WHERE depth > 0 GROUP BY parent, depth),
own AS (SELECT u.*, coalesce(k.n, 0) AS n_children, (n_convs - 1) * size AS saved FROM up u LEFT JOIN kids k ON k.node = u.node AND k.depth = u.depth),
below AS (
  SELECT o.node, o.depth, sum(own.saved) AS saved, count(*) FILTER (WHERE own.n_children = 0) AS leaves
  FROM own JOIN of_conv o ON o.conv_id = own.node AND o.depth <= own.depth GROUP BY o.node, o.depth)
SELECT own.node AS conv_id, CAST(own.depth AS BIGINT) AS depth, own.parent AS parent_conv_id, CAST(n_convs AS BIGINT) AS n_convs,
       CAST(n_children AS BIGINT) AS n_children, CAST(below.leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens,
       sha256(ends) AS ends_sha256
FROM own JOIN below ON below.node = own.node AND below.depth = own.depth
"""
