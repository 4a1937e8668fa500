"""A keyed table that batches of changes are merged into on reading: each batch writes its changes only.

A table is a folder of written changes and of manifests. A manifest names the folders of changes that make up one
version, bucket by bucket; it is written beside and then renamed into place, so a version is there as a whole or not at
all, and a reader that has opened one keeps it while further ones are published. Buckets whose changes have grown
beyond a share of what they are changes to are merged into a new base. What no kept version names is deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

#: Columns of the files beside the table's own: a tombstone, the batch that wrote a row, and its bucket.
GONE, BATCH, BUCKET = "gone_", "batch_", "bucket_"


class Conflict(RuntimeError):
    """Another writer has published the same version."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, table: str) -> list[int]:
    """The versions that are kept, in order."""
    fs, path = _path(spark, f"{table}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, table: str, version: int | None = None) -> dict | None:
    """What makes up a version (the newest one if not named); None for a table without any."""
    if version is None:
        every = versions(spark, table)
        if not every:
            return None
        version = every[-1]
    fs, path = _path(spark, f"{table}/manifests/{version:012d}.json")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, table: str, m: dict) -> int:
    fs, path = _path(spark, f"{table}/manifests/{m['version']:012d}.json")
    _, beside = _path(spark, f"{table}/manifests/{uuid.uuid4().hex}.tmp")
    stream = fs.create(beside)
    stream.write(json.dumps(m).encode())
    stream.close()
    if fs.exists(path) or not fs.rename(beside, path):
        fs.delete(beside, False)
        raise Conflict(f"version {m['version']} of {table} is there already")
    return m["version"]


def _write(rows: DataFrame, table: str, kind: str) -> list[dict]:
    """Write rows by buckets; an entry for each bucket that has any."""
    folder = uuid.uuid4().hex
    # a bucket's rows together: one file for each bucket, whatever the batch's partitions were
    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{table}/data/{folder}")
    fs, path = _path(rows.sparkSession, f"{table}/data/{folder}")
    if not any(s.isDirectory() and s.getPath().getName().startswith(BUCKET) for s in fs.listStatus(path)):
        return []
    count = rows.sparkSession.read.parquet(f"{table}/data/{folder}").groupBy(BUCKET).count().collect()
    return [{"folder": folder, "bucket": r[BUCKET], "rows": r["count"], "kind": kind} for r in count]


def _newest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key: by its order, of equal ones by the batch that brought it; combined map-side."""
    rest = [c for c in rows.columns if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(order, BATCH)).alias("r"))
    return last.select(*key, "r.*").select(*rows.columns)


def commit(changes: DataFrame, table: str, key: list[str], order: str, batch: int, gone: str | None = None, buckets: int = 16) -> int:
    """Publish a version with the changes of a batch and return its number.

    gone names a boolean column of changes that deletes keys. A batch that is published already is left alone, so
    one that runs again after a failure changes nothing. Rows of a key replace each other by the column `order`.
    """
    spark = changes.sparkSession
    now = manifest(spark, table)
    if now and now["batch"] >= batch:
        return now["version"]
    buckets = now["buckets"] if now else buckets
    own = changes.drop(gone) if gone else changes
    rows = changes.withColumn(GONE, F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).withColumn(BATCH, F.lit(batch).cast("long"))
    rows = _newest(rows.select(*own.columns, GONE, BATCH), key, order).withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    entries = (now["entries"] if now else []) + _write(rows, table, "delta")
    return _publish(spark, table, {
        "version": (now["version"] if now else 0) + 1, "batch": batch, "key": key, "order": order, "buckets": buckets,
        "schema": own.schema.jsonValue(), "entries": entries,
    })


def _rows(spark: SparkSession, table: str, m: dict, entries: list[dict]) -> DataFrame:
    schema = StructType.fromJson(m["schema"])
    whole = StructType([*schema.fields]).add(GONE, "boolean").add(BATCH, "long").add(BUCKET, IntegerType())
    if not entries:
        return spark.createDataFrame([], whole)
    paths = [f"{table}/data/{e['folder']}/{BUCKET}={e['bucket']}" for e in entries]
    # entries of different folders can't share a base path, so the bucket is worked out again
    files = StructType(whole.fields[:-1])
    return spark.read.schema(files).parquet(*paths).withColumn(BUCKET, F.pmod(F.xxhash64(*m["key"]), F.lit(m["buckets"])).cast("int"))


def snapshot(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest one if not named. What is published later does not change it."""
    m = manifest(spark, table, version)
    if m is None:
        raise FileNotFoundError(f"no version of {table}")
    columns = [f["name"] for f in m["schema"]["fields"]]
    base = [e for e in m["entries"] if e["kind"] == "base"]
    changed = {e["bucket"] for e in m["entries"] if e["kind"] == "delta"}
    # buckets without changes are read as they are
    still = _rows(spark, table, m, [e for e in base if e["bucket"] not in changed])
    merged = _newest(_rows(spark, table, m, [e for e in m["entries"] if e["bucket"] in changed]), m["key"], m["order"])
    return still.unionByName(merged).filter(~F.col(GONE)).select(*columns)


def compact(spark: SparkSession, table: str, ratio: float = 0.5) -> int | None:
    """Merge the buckets whose changes have more than ratio times the rows of their base; the new version, or None.

    Tombstones stay, so that a change older than a deletion does not bring its key back.
    """
    m = manifest(spark, table)
    if m is None:
        return None
    rows = lambda kind, k: sum(e["rows"] for e in m["entries"] if e["kind"] == kind and e["bucket"] == k)
    due = {k for k in {e["bucket"] for e in m["entries"]} if rows("delta", k) > ratio * rows("base", k)}
    if not due:
        return None
    merged = _newest(_rows(spark, table, m, [e for e in m["entries"] if e["bucket"] in due]), m["key"], m["order"])
    entries = [e for e in m["entries"] if e["bucket"] not in due] + _write(merged, table, "base")
    return _publish(spark, table, m | {"version": m["version"] + 1, "entries": entries})


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> int:
    """Forget all but the last `keep` versions and delete the folders that these do not name; how many were deleted."""
    every = versions(spark, table)
    for v in every[:-keep]:
        fs, path = _path(spark, f"{table}/manifests/{v:012d}.json")
        fs.delete(path, False)
    named = {e["folder"] for v in every[-keep:] for e in manifest(spark, table, v)["entries"]}
    fs, path = _path(spark, f"{table}/data")
    gone = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName() not in named] if fs.exists(path) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)
