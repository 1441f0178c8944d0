"""Mixing sources to target weights (operator 6), with DataFrame functions only.

Sizes are summed by source; every source gets a target by its weight, at most ``MOST`` times its size, what is above going to
the others by weight. A source's rate is its target over its size: each of its documents comes floor(rate) times, and once
more if a draw seeded by the hash of its id is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.llm.common import fresh
from tidemark.session import stage

#: Weights by the order of the sources' names, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times the size of its source.
MOST = 3
#: So many sources at most are broadcast, about 10 MB; texts then need not move.
FEW_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words of a text; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """Number in [0, 1) from the hash of the id, of the text where there is no id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), text), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source, source_size, target, rate`` of each source, from rows of ``source, size``.

    Sources stand in the order of their names by code point, null last. In the order of cap over weight, a source is capped
    if the level that is left for it and the later ones is above that ratio; the comparison is exact, in whole numbers. The
    windows run over one row per source. Without any words all targets are 0.
    """
    scale = 1
    for w in weights:
        scale *= w
    whole = "decimal(38,0)"
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    ranked = per_source.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).alias("weight"))
    cap = (F.col("source_size") * MOST).cast(whole)
    ranked = ranked.withColumn("ratio", (cap * (F.lit(scale) / F.col("weight")).cast("long")).cast(whole))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    up_to = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rest = (F.sum("source_size").over(everything).cast(whole) - F.sum(cap).over(up_to).cast(whole) + cap).cast(whole)
    left = (F.sum("weight").over(everything) - F.sum("weight").over(up_to) + F.col("weight")).cast("decimal(18,0)")
    judged = ranked.select("*", ((rest * scale).cast(whole) > (F.col("ratio") * left).cast(whole)).alias("capped"))
    free = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(everything)
    share = F.sum("source_size").over(everything) - F.sum(F.when(F.col("capped"), F.col("source_size") * MOST).otherwise(0)).over(everything)
    target = F.when(F.col("capped"), (F.col("source_size") * MOST).cast("double")).otherwise(
        (F.col("weight") * share).cast("double") / free)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(MOST)))).otherwise(0.0)
    return judged.select("source", "source_size", target.alias("target")).withColumn("rate", rate)


def _beside(per_source: DataFrame) -> DataFrame:
    """The targets to join the documents with: sent to every task if they are few, else left to the planner, which deals by source."""
    per_source = stage(per_source, "targets")
    return F.broadcast(per_source) if per_source.count() <= FEW_SOURCES else per_source


def copies(rate: Column, chance: Column) -> Column:
    return (F.floor(rate) + (chance < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document: ``doc_id, size, source_size, target, taken``.

    Every row gives one row. A null text has size 0; rows with a null source form a source; rows that share an id share their
    draw, so repeated rows are taken alike; rows without an id draw by their text.
    """
    sizes = stage(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"),
                              words(docs["text"]).alias("size"), draw(docs["doc_id"], docs["text"]).alias("chance")), "sizes")
    per_source = _beside(targets(sizes).withColumnRenamed("source", "of_source"))
    return (sizes.join(per_source, sizes["source"].eqNullSafe(per_source["of_source"]))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("chance"))).alias("taken")))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns. Documents of a source without words are not taken."""
    own, rate, times = fresh("mixed_source", docs), fresh("mixed_rate", docs), fresh("mixed_copy", docs)
    sizes = docs.select(docs["source"].cast("string").alias("source"), words(docs["text"]).alias("size"))
    per_source = _beside(targets(sizes).select(F.col("source").alias(own), F.col("rate").alias(rate)))
    met = docs.join(per_source, docs["source"].cast("string").eqNullSafe(per_source[own]))
    n = copies(F.col(rate), draw(docs["doc_id"], docs["text"])).cast("int")
    return met.withColumn(times, F.explode(F.array_repeat(F.lit(1), n))).select(*[docs[c] for c in docs.columns])


ORACLE = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size,
         CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || text, '')), 1, 13) AS BIGINT) / CAST({1 << 52} AS DOUBLE) AS chance
  FROM documents),
per_source AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per_source),
ordered AS (SELECT *, CAST(source_size AS HUGEINT) * 3 * CAST(10 / weight AS BIGINT) AS ratio FROM ranked),
judged AS (
  SELECT *, (sum(source_size) OVER () - sum(CAST(source_size AS HUGEINT) * 3) OVER o + source_size * 3) * 10
            > ratio * (sum(weight) OVER () - sum(weight) OVER o + weight) AS capped
  FROM ordered WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(source_size * 3 AS DOUBLE)
    ELSE CAST(weight * (sum(source_size) OVER () - sum(CASE WHEN capped THEN source_size * 3 ELSE 0 END) OVER ()) AS DOUBLE)
         / CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM judged),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate FROM targets)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN chance < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sizes JOIN rates ON sizes.source IS NOT DISTINCT FROM rates.source
"""
