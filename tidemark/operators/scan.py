"""Ordered scans and exact quantiles without putting an ordering in one task.

Rows are cut into contiguous ranges of their total order. Each range is reduced
on its own, the (few) range totals are scanned, and the carry is added back
inside each range. Spark's range partitioning draws the edges from a sample: they
decide only where the cuts fall, never what the result is. A range is the partition
a row was written from, so no plan holds an edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark.session import stage

BUCKET = "_range"


def _range_count(df: DataFrame) -> int:
    spark = df.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(2, width, spark.sparkContext.defaultParallelism)


def with_ranges(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Add ``_range``: a number that never decreases along ``order`` (ascending, nulls first).

    There are as many ranges as shuffle partitions, fewer only where there are fewer different keys; equal keys share a range. The
    result is staged with the number of the partition in it, so it is read again as it was cut.
    """
    cut = df.repartitionByRange(ranges or _range_count(df), *order)
    return stage(cut.withColumn(BUCKET, F.spark_partition_id()), "ranged")


_REDUCE = {"sum": F.sum, "product": F.product, "max": F.max}


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "product":
        return F.coalesce(carry, F.lit(1.0)) * F.coalesce(local, F.lit(1.0))
    return F.greatest(carry, local)


def running(ranged: DataFrame, specs: dict[str, tuple[str, str]], order: Sequence[str],
            partition: Sequence[str] = (), *, exclusive: Sequence[str] = (), totals: dict[str, str] | None = None) -> DataFrame:
    """Add running ``sum`` / ``product`` / ``max`` columns over a ranged frame.

    ``specs`` maps output name to ``(kind, input column)``; outputs named in
    ``exclusive`` stop before the current row, and ``totals`` maps further outputs
    to the ``specs`` entry whose whole-partition value they carry. ``order`` must be
    the total order within a partition and ``_range`` must follow (partition, order).
    """
    totals = totals or {}
    cells = [*partition, BUCKET]
    reduced = ranged.groupBy(*cells).agg(*[_REDUCE[k](c).alias(f"_t_{o}") for o, (k, c) in specs.items()])
    before = W.partitionBy(*partition).orderBy(BUCKET).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*partition)
    carries = reduced.select(
        *cells, *[_REDUCE[k](f"_t_{o}").over(before).alias(f"_c_{o}") for o, (k, _) in specs.items()],
        *[_REDUCE[specs[o][0]](f"_t_{o}").over(whole).alias(name) for name, o in totals.items()])
    ordered = W.partitionBy(*cells).orderBy(*order)

    def inside(name: str):
        return ordered.rowsBetween(W.unboundedPreceding, -1 if name in exclusive else W.currentRow)

    local = ranged.withColumns({f"_l_{o}": _REDUCE[k](c).over(inside(o)) for o, (k, c) in specs.items()})
    joined = local.join(carries, cells, "left")
    out = joined.withColumns({o: _combine(k, F.col(f"_c_{o}"), F.col(f"_l_{o}")) for o, (k, _) in specs.items()})
    return out.drop(*[f"_{p}_{o}" for p in "lc" for o in specs])


def exact_quantiles(long: DataFrame, probabilities: Sequence[float], *, key: str = "key", value: str = "value",
                    weight: str | None = None) -> DataFrame:
    """Interpolated quantiles per key: one row per key with an array column ``q``; a row stands for ``weight`` equal ones.

    Equal values are counted first, then ranked by a ranged scan, so neither a
    continuous column nor a dominant key is gathered in one place.
    """
    counted = (
        long.where(F.col(value).isNotNull())
        .groupBy(F.col(key).alias("_key"), F.col(value).cast("double").alias("_value"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    )
    placed = running(
        with_ranges(counted, ["_key", "_value"]), {"_upto": ("sum", "_n")}, ["_value"], ["_key"], totals={"_size": "_upto"},
    ).withColumn("_from", F.col("_upto") - F.col("_n"))

    picks = []
    for i, p in enumerate(probabilities):
        at = F.lit(float(p)) * (F.col("_size") - 1)
        low = F.floor(at)
        high = F.least(low + 1, F.col("_size") - 1)
        for label, rank in (("lo", low), ("hi", high)):
            here = (F.col("_from") <= rank) & (rank < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col("_value"))).alias(f"_{label}{i}"))
    found = placed.groupBy("_key", "_size").agg(*picks)

    def value_at(i: int, p: float) -> Column:
        at = F.lit(float(p)) * (F.col("_size") - 1)
        return F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at))

    return found.select(
        F.col("_key").alias(key), F.col("_size").alias("n"),
        F.array(*[value_at(i, p) for i, p in enumerate(probabilities)]).alias("q"),
    )


def melt(df: DataFrame, columns: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    """(column name, value) rows for several numeric columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias(key), F.col(c).cast("double").alias(value)) for c in columns])
    return df.select(F.explode(pairs).alias("_p")).select("_p.*")


def quantile_bucket(df: DataFrame, col: str, buckets: int, out: str = "bucket") -> DataFrame:
    """Label rows by right-closed interpolated-quantile buckets, repeated edges dropped."""
    rows = df.where(F.col(col).isNotNull())
    long = rows.select(F.lit("x").alias("key"), F.col(col).alias("value"))
    edges = exact_quantiles(long, [i / buckets for i in range(buckets + 1)]).select(F.array_distinct("q").alias("e"))
    tagged = rows.withColumn("_edges", edges.scalar())
    below = F.size(F.filter("_edges", lambda e: e < F.col(col).cast("double")))
    return tagged.withColumn(out, F.greatest(below - 1, F.lit(0))).drop("_edges")
