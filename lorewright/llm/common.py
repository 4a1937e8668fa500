"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import contextvars
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than space and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only in local mode, as in tests."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    place = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", place)
    return place


#: Folders of tables that stage() has written inside the innermost scratch(), in this thread.
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Inside the block stage() notes its tables; at its end all are deleted but those that the results handed to the
    given function read. Those belong to whoever called: to an outer scratch(), if there is one."""
    outer, own = _written.get(), []
    token, kept = _written.set(own), set()

    def keep(result: DataFrame) -> DataFrame:
        kept.update(f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in result.inputFiles())
        return result

    try:
        yield keep
    finally:
        _written.reset(token)
        stay = [folder for folder in own if folder.rsplit("/", 1)[-1] in kept]
        drop_tables(spark, [folder for folder in own if folder not in stay])
        if outer is not None:
            outer.extend(stay)


def drop_tables(spark: SparkSession, folders: list[str]) -> None:
    """Delete tables that stage() has written."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


#: Whether Spark deletes the shuffle files of a query when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of queries that end inside the block are deleted as they end. Left to garbage collection they
    stay while Python's references are handed over, which takes a second or more."""
    before = spark.conf.get(FREED, None)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)
        else:
            spark.conf.set(FREED, before)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    A lost executor costs only the tasks it ran; nothing before this point is computed again, so its shuffle files go.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with freed(spark):
        df.write.option("compression", "zstd").parquet(path)
    written = _written.get()
    if written is not None:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(staged: DataFrame) -> None:
    """Delete the files of a table that stage() wrote, once nothing that is still to run reads it."""
    jvm, conf = staged.sparkSession._jvm, staged.sparkSession.sparkContext._jsc.hadoopConfiguration()
    shared = jvm.org.apache.hadoop.fs.Path(shared_dir(staged.sparkSession)).getName()
    for folder in {f.rsplit("/", 1)[0] for f in staged.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().getName() == shared:
            path.getFileSystem(conf).delete(path, True)


#: Ids that every executor can hold: some 30 MB.
FEW_IDS = 1_000_000


def with_ids(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is (or is not: left_anti) among ids, a stored table of distinct keys.

    Up to FEW_IDS are broadcast, so that wide rows stay where they are; more are joined by a shuffle.
    """
    return df.join(F.broadcast(ids) if ids.count() <= FEW_IDS else ids, key, how)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """df with `row_no`, its place in the order from 1, and before_<c>: the sum of column c over all rows before it.

    Rows are dealt out by ranges of the order, so no task sees more than a range; only the ranges' totals, one row
    for each shuffle partition, meet in one place. The order must tell all rows apart.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranged")
    total = ranged.groupBy("range_").agg(F.count("*").alias("n_"), *(F.sum(c).alias(f"sum_{c}") for c in sums))
    before = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    total = total.select("range_", so_far("n_", before).alias("n_"), *(so_far(f"sum_{c}", before).alias(f"sum_{c}") for c in sums))
    by = W.partitionBy("range_").orderBy(*order)
    inside = by.rowsBetween(W.unboundedPreceding, -1)
    j = ranged.select("*", F.row_number().over(by).alias("row_"), *(so_far(c, inside).alias(f"in_{c}") for c in sums)).join(F.broadcast(total), "range_")
    return j.select(*df.columns, (F.col("n_") + F.col("row_")).alias("row_no"), *((F.col(f"sum_{c}") + F.col(f"in_{c}")).alias(f"before_{c}") for c in sums))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that are no longer referenced, before more are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """The words of a text as an array; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
