"""A keyed log whose updates rewrite only the records they touch.

Records live in hash buckets of their key.  A version of the log is a small
manifest that names the folder of every bucket.  An update finds the buckets of
its keys, rewrites these into new folders and then publishes a manifest that
points to them and, for all other buckets, to the folders they had.  Readers
keep the version they opened; a failed update leaves no trace in the manifests.
One writer at a time (the manifest's number must be new)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from healthwatch.sources import offset_log as store


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def _versions(path: str) -> list[dict]:
    return store._load(path, "versions")


def _publish(path: str, version: dict) -> None:
    store._save(path, f"versions/{len(store._children(os.path.join(path, 'versions'))):010d}.json", version, new=True)


def _write(df: DataFrame, path: str) -> tuple[str, list[int]]:
    """Write rows (with ``__bucket``) as one folder per bucket; the folder and
    the buckets it holds."""
    name = os.path.join("data", uuid.uuid4().hex)
    folder = os.path.join(path, name)
    df.repartition("__bucket").write.partitionBy("__bucket").parquet(folder)
    held = [r[0] for r in df.sparkSession.read.parquet(folder).select("__bucket").distinct().collect()] if _has_rows(df.sparkSession, folder) else []
    return name, held


def _has_rows(spark: SparkSession, folder: str) -> bool:
    from healthwatch.streaming.pipeline import _folders
    return any(f.startswith("__bucket=") for f in _folders(spark, folder))


def write_log(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Start a log with the rows of ``df``; records are appended and updated
    by ``key``.  Aim at buckets of 100 MB to 1 GB."""
    name, held = _write(df.withColumn("__bucket", _bucket(key, buckets)), path)
    _publish(path, {"key": key, "buckets": buckets, "schema": df.schema.json(), "folders": {str(b): [os.path.join(name, f"__bucket={b}")] for b in held}})


def _open(spark: SparkSession, path: str, only: list[int] | None = None, version: int | None = None) -> tuple[DataFrame, dict]:
    import json
    versions = _versions(path)
    if not versions:
        raise FileNotFoundError(f"{path} holds no log")
    now = versions[-1 if version is None else version]
    schema = T.StructType.fromJson(json.loads(now["schema"]))
    folders = [os.path.join(path, f) for b, fs in sorted(now["folders"].items()) if only is None or int(b) in only for f in fs]
    return (spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)), now


def read_log(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """All records of the newest (or a given) version."""
    return _open(spark, path, None, version)[0]


def append(df: DataFrame, path: str) -> None:
    """Add records: new files in the buckets of their keys, none rewritten."""
    rows, now = _open(df.sparkSession, path)
    name, held = _write(df.select(*rows.columns).withColumn("__bucket", _bucket(now["key"], now["buckets"])), path)
    folders = {b: list(fs) for b, fs in now["folders"].items()}
    for b in held:
        folders.setdefault(str(b), []).append(os.path.join(name, f"__bucket={b}"))
    _publish(path, now | {"folders": folders})


def update(spark: SparkSession, path: str, changes: DataFrame, columns: list[str]) -> list[int]:
    """Set ``columns`` of every record whose key is in ``changes`` (one row per
    key, else the largest values count; a null leaves the value).  Returns the
    buckets rewritten."""
    _, now = _open(spark, path)
    key, place = now["key"], _bucket(now["key"], now["buckets"])
    merged = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*columns)).alias("__new"))
    touched = sorted(r[0] for r in merged.select(place.alias("b")).distinct().collect() if str(r[0]) in now["folders"])   # at most ``buckets`` rows
    if not touched:
        return []
    rows, _ = _open(spark, path, touched)
    changed = rows.join(merged, key, "left").select(*[
        F.coalesce(F.col(f"__new.{c}"), F.col(c)).cast(rows.schema[c].dataType).alias(c) if c in columns else F.col(c) for c in rows.columns])
    name, held = _write(changed.withColumn("__bucket", place), path)
    folders = now["folders"] | {str(b): [os.path.join(name, f"__bucket={b}")] for b in held}
    _publish(path, now | {"folders": folders})
    return touched
