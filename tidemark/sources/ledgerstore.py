"""The ledger as folders of months behind a manifest, written by copy on write.

``<root>/data/<token>/month=<yyyy-MM>`` hold rows; ``<root>/manifest/<version>.json`` lists, for each month, the folder that counts, its
rows and the range of its ids, and who wrote the version. A version becomes visible when its manifest is renamed into place, so readers
see all of it or nothing, and folders of failed attempts are never named. A merge reads and writes only months that its batch
touches; the other folders are carried over by name. ``expire`` deletes what no kept manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import ledger
from tidemark.schemas import LEDGER, align, parse
from tidemark.session import stage

_MONTH = "month"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the stored versions, rising."""
    folder, system = _place(spark, f"{root.rstrip('/')}/manifest")
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> dict | None:
    """A version's manifest, the newest by default: one entry for each month. None if there is no ledger."""
    if version is None:
        stored = versions(spark, root)
        if not stored:
            return None
        version = stored[-1]
    place, system = _place(spark, f"{root.rstrip('/')}/manifest/{version}.json")
    size = system.getFileStatus(place).getLen()
    source = system.open(place)
    try:
        data = spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source, size)
    finally:
        source.close()
    return json.loads(bytes(data).decode())


def _publish(spark: SparkSession, root: str, version: int, writer: str, months: dict[str, dict]) -> None:
    root = root.rstrip("/")
    draft, system = _place(spark, f"{root}/manifest/.{version}-{uuid.uuid4().hex}")
    final, _ = _place(spark, f"{root}/manifest/{version}.json")
    out = system.create(draft, False)
    out.write(bytearray(json.dumps({"version": version, "written_by": writer, "months": months}).encode()))
    out.close()
    if system.exists(final) or not system.rename(draft, final):
        system.delete(draft, False)
        raise FileExistsError(f"ledger version {version} was written by someone else")


def _month(date: Column | str) -> Column:
    return F.coalesce(F.date_format(date, "yyyy-MM"), F.lit("none"))


def _write(rows: DataFrame, root: str) -> dict[str, dict]:
    """Write rows by month below a folder of their own; the manifest entries of what was written."""
    spark, folder = rows.sparkSession, f"{root.rstrip('/')}/data/{uuid.uuid4().hex}"
    filled = align(rows, LEDGER).withColumns({"risk_units": F.coalesce("risk_units", F.lit(1.0)), _MONTH: _month("game_date")})
    filled.hint("rebalance", _MONTH).write.partitionBy(_MONTH).parquet(folder)
    schema = f"{LEDGER}, {_MONTH} string"
    stored = spark.read.schema(parse(schema)).parquet(folder)
    found = stored.groupBy(_MONTH).agg(F.count(F.lit(1)).alias("rows"), F.min("game_id").alias("low"), F.max("game_id").alias("high"))
    return {r[_MONTH]: {"path": f"{folder}/{_MONTH}={r[_MONTH]}", "rows": r["rows"], "low": r["low"], "high": r["high"]}
            for r in found.collect()}  # one row for each month


def _read(spark: SparkSession, entries: list[dict]) -> DataFrame:
    paths = [e["path"] for e in entries]
    return spark.read.schema(parse(LEDGER)).parquet(*paths) if paths else spark.createDataFrame([], parse(LEDGER))


def read_ledger(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The newest ledger (or a version that is kept); empty when there is none. A ledger that cannot be read is an error."""
    manifest = read_manifest(spark, root, version)
    return _read(spark, list(manifest["months"].values()) if manifest else [])


def write_ledger(rows: DataFrame, root: str, writer: str = "") -> int:
    """Write a whole ledger as the next version."""
    spark = rows.sparkSession
    version = (versions(spark, root) or [-1])[-1] + 1
    _publish(spark, root, version, writer, _write(rows, root))
    return version


def merge_slate(slate: DataFrame, root: str, now, writer: str = "") -> int | None:
    """Merge recommendations (``ledger.merge_recommendations``) into the next version; its number, or None if ``writer`` wrote already.

    Months are touched that the batch names, and those that hold a game of the batch under another date: only folders whose range of ids
    meets the batch's are asked, and only for two columns. Bytes read and written follow the touched months.
    """
    spark = slate.sparkSession
    manifest = read_manifest(spark, root) or {"version": -1, "months": {}, "written_by": None}
    if writer and manifest["written_by"] == writer:
        return None
    batch = stage(slate, "ledger-batch")
    new = ledger.tickets(batch, now).select("game_id", _month("game_date").alias(_MONTH))
    span = new.agg(F.min("game_id").alias("low"), F.max("game_id").alias("high"), F.collect_set(_MONTH).alias("months")).first()  # months: bounded by the calendar
    months, touched = manifest["months"], set(span["months"])
    if not touched:
        _publish(spark, root, manifest["version"] + 1, writer, months)
        return manifest["version"] + 1
    near = [e for m, e in months.items() if m not in touched and e["low"] is not None and e["low"] <= span["high"] and e["high"] >= span["low"]]
    if near:
        moved = _read(spark, near).select("game_id", _month("game_date").alias(_MONTH)).join(new.select("game_id"), "game_id", "left_semi")
        touched |= {r[0] for r in moved.select(_MONTH).distinct().collect()}
    old = _read(spark, [e for m, e in months.items() if m in touched])
    merged = ledger.merge_recommendations(old, batch, now).drop("action")
    kept = {m: e for m, e in months.items() if m not in touched}
    _publish(spark, root, manifest["version"] + 1, writer, kept | _write(merged, root))
    return manifest["version"] + 1


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete manifests but the newest ``keep`` and the folders that none of those names; how many folders went.

    Run it while nothing is merged: a merge that is under way has folders that no manifest names yet.
    """
    root = root.rstrip("/")
    stored = versions(spark, root)
    for version in stored[:-keep]:
        place, system = _place(spark, f"{root}/manifest/{version}.json")
        system.delete(place, False)
    named = {e["path"].rsplit("/data/", 1)[1] for v in stored[-keep:] for e in read_manifest(spark, root, v)["months"].values()}
    data, system = _place(spark, f"{root}/data")
    gone = 0
    for token in (s.getPath() for s in (system.listStatus(data) if system.exists(data) else [])):
        months = [s.getPath() for s in system.listStatus(token) if s.getPath().getName().startswith(f"{_MONTH}=")]
        dead = [m for m in months if f"{token.getName()}/{m.getName()}" not in named]
        for place in dead if len(dead) < len(months) else [token]:
            gone += system.delete(place, True)
    return gone
