"""Tables written on the way to a result: in the folder that driver and executors share, owned by who asked for them."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


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
    """The shuffle files of queries that end inside the block are deleted as they end."""
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
