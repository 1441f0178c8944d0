"""What the operators of this subpackage share: session settings, safe column names, bounded training samples."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.session import configure

#: Folds by the check sum of the id; fold 0 is held out.
FOLDS = 5
#: Small Arrow batches keep a Python worker's memory low when texts are long.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    for key, value in _BATCH.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffled(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is shuffled, however small it looks.

    A broadcast would pass it through the driver, one table for each join of each round, and their pages stay there until garbage is collected.
    """
    return side.hint("merge")


def held_out(doc_id: Column) -> Column:
    """Whether the row belongs to the held-out fold; rows without an id do not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def window(text: Column, longest: int, seed: int = 0) -> Column:
    """The text, or ``longest`` characters of it from a place drawn by a hash of the text."""
    room = F.length(text) - longest
    return F.when(room > 0, F.substring(text, (F.pmod(F.xxhash64(F.lit(seed), text), room + 1) + 1).cast("int"), F.lit(longest))).otherwise(text)


def sample(df: DataFrame, by: str, per_value: int, seed: int = 0, cut: dict[str, int] | None = None) -> pd.DataFrame:
    """About ``per_value`` different rows of each value of ``by``, at most twice as many, as pandas.

    Equal rows count once, so copies neither fill the sample nor are missed with their value. The rows are chosen by a hash of
    their content, after one count of hashes, and every value is cut on its own, lowest hashes first; the choice does not depend
    on partitioning. The number that reaches the driver is about ``per_value`` for each value, by the draw; ``cut`` bounds the
    characters that come of a column (``window``). Columns of ``df`` are hashed whole and returned.
    """
    key, share = fresh("sample_key", df), fresh("sample_share", df)
    keyed = df.withColumn(key, F.xxhash64(F.lit(seed), *[F.col(c) for c in df.columns]))
    different = keyed.groupBy(by, key).agg(F.count(F.lit(1)).alias("n")).groupBy(by).agg(F.count(F.lit(1)).alias("m"))
    shares = [(k, min(1.0, per_value / m)) for k, m in different.orderBy(by).collect()]  # one row for each value
    if not shares:
        return pd.DataFrame(columns=df.columns)
    of_value = df.sparkSession.createDataFrame(shares, f"`{by}` {df.schema[by].dataType.simpleString()}, `{share}` double")
    draw = F.pmod(F.col(key), F.lit(1 << 30)) / float(1 << 30)
    drawn = keyed.join(F.broadcast(of_value), by).where(draw < F.col(share)).select(*df.columns, key).dropDuplicates(df.columns)
    out = drawn.withColumns({c: window(F.col(c), longest, seed) for c, longest in (cut or {}).items()}).toPandas()
    out = out.assign(**{key: out[key] % (1 << 30)}).sort_values([key, *df.columns], kind="stable").groupby(by, sort=False).head(2 * per_value)
    return out[df.columns].sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def map_texts(df: DataFrame, fn: Callable[[Sequence[str | None], pa.RecordBatch], dict[str, Iterable]], schema: str,
              text: str = "text") -> DataFrame:
    """Apply ``fn`` to the texts of each Arrow batch; it returns the columns of ``schema`` as lists or arrays."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.column(text).to_pylist(), batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
