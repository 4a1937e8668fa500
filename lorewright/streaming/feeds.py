"""Streaming forms of the collection jobs. Each reads a folder of Parquet files as it grows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.retrieval import _COS, _E, cosine_topk
from ..registry import query, workspace
from . import tables


def feed(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """A growing folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def new_revisions(changes: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (title, revid) once. The watermark bounds the state: a repeat that comes later than delay counts as new."""
    return changes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["title", "revid"])


def upsert(changes: DataFrame, target: str, checkpoint: str, gone: str | None = None, ratio: float = 0.5, keep: int = 2) -> StreamingQuery:
    """Keep the latest revision of each title in a table that is merged on reading (tables.py): a micro-batch writes
    its changes only and publishes a version; one that runs again after a failure publishes nothing new. Buckets are
    merged when their changes outgrow them, and versions before the last `keep` are deleted."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables.commit(batch.select("title", "revid", "kind", *([gone] if gone else [])), target, ["title"], "revid", number, gone)
        tables.compact(spark, target, ratio)
        tables.vacuum(spark, target, keep)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embed(pages: DataFrame, index: str, checkpoint: str, model: Callable[[DataFrame], DataFrame], keep: int = 2) -> StreamingQuery:
    """Embed pages that the index does not hold and add them. model adds the column embedding.

    Every micro-batch opens the newest version of the index, whose number of files compaction bounds, and publishes one.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("key", F.concat("source", F.lit("|h:"), F.md5("text"))).dropDuplicates(["key"])
        if tables.manifest(spark, index):
            fresh = fresh.join(tables.snapshot(spark, index).select("key"), "key", "left_anti")
        tables.commit(model(fresh).withColumn("at", F.lit(number).cast("long")), index, ["key"], "at", number)
        tables.compact(spark, index)
        tables.vacuum(spark, index, keep)

    return pages.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def serve(questions: DataFrame, index: str, target: str, checkpoint: str, answer: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Answer each micro-batch of questions from the version of the index that is the newest when the batch begins.

    answer(questions, index) gives the rows; `version` tells which version they are from. A version that is published
    meanwhile is served from the next batch on. Batches write their own parts, so a repeat adds nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version = tables.versions(spark, index)[-1]
        found = answer(batch, tables.snapshot(spark, index, version)).withColumn("version", F.lit(version).cast("long"))
        found.write.mode("overwrite").parquet(f"{target}/part={number}")

    return questions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_log(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what each micro-batch finds to a log; the sink writes a batch once, also after a failure."""
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table(d: str, name: str) -> str:
    """A table that is one file or a folder of files; as a pattern, since a stream reads a single path as a folder."""
    return f"{d}/{name}.parque[t]"


EVENT = "event_id long, ts timestamp, user_id long, event_type string"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return feed(spark, table(d, "events"), EVENT).select(F.col("user_id").alias("title"), F.col("event_id").alias("revid"), "ts", F.col("event_type").alias("kind"))


@query("stream_latest", "SELECT user_id AS title, max(event_id) AS revid, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    at = workspace(spark)
    upsert(_events(spark, d), f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return tables.snapshot(spark, f"{at}/table")


@query("stream_dedupe", "SELECT DISTINCT user_id AS title, event_id AS revid FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The feed with every change twice, each change once."""
    at, changes = workspace(spark), _events(spark, d)
    append_log(new_revisions(changes.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1)))), "40 days").select("title", "revid"), f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("title long, revid long").parquet(f"{at}/log")


@query("stream_embed", "SELECT source || '|h:' || md5(text) AS key, min(length(text))::INT AS size FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY 1")
def stream_embed(spark: SparkSession, d: str) -> DataFrame:
    """Each page text embedded once (here: by its length), as the index that later batches see."""
    at = workspace(spark)
    pages = feed(spark, table(d, "documents"), "doc_id long, text string, lang string, source string").filter("text is not null and source is not null")
    embed(pages.select("source", "text"), f"{at}/index", f"{at}/checkpoint", lambda df: df.select("key", F.char_length("text").alias("size"))).awaitTermination()
    return tables.snapshot(spark, f"{at}/index").select("key", "size")


@query("stream_issues", "SELECT conv_id, turn, 'has_link' AS issue FROM conversations WHERE contains(text, 'http') UNION ALL SELECT conv_id, turn, 'very_short' FROM conversations WHERE length(text) < 40")
def stream_issues(spark: SparkSession, d: str) -> DataFrame:
    """Issues of each turn, appended to a log batch by batch."""
    at = workspace(spark)
    t = feed(spark, table(d, "conversations"), "conv_id long, turn long, role string, text string")
    found = F.array_compact(F.array(F.when(F.contains("text", F.lit("http")), F.lit("has_link")), F.when(F.char_length("text") < 40, F.lit("very_short"))))
    append_log(t.select("conv_id", "turn", F.explode(found).alias("issue")), f"{at}/log", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("conv_id long, turn long, issue string").parquet(f"{at}/log")


@query("stream_deletes", "SELECT user_id AS title, max(event_id) AS revid, arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id HAVING arg_max(event_id % 5, event_id) <> 0")
def stream_deletes(spark: SparkSession, d: str) -> DataFrame:
    """Titles whose last change is a deletion (here: of an event number that five divides) are gone."""
    at = workspace(spark)
    upsert(_events(spark, d).withColumn("deleted", F.col("revid") % 5 == 0), f"{at}/table", f"{at}/checkpoint", "deleted").awaitTermination()
    return tables.snapshot(spark, f"{at}/table")


@query("stream_serve", f"WITH {_E} SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM e a JOIN e b ON b.vec_id % 3 > 0 WHERE a.vec_id % 100 = 0 QUALIFY rank <= 5")
def stream_serve(spark: SparkSession, d: str) -> DataFrame:
    """A stream of vectors answered from an index that two commits have made: all rows, then the deletion of every third."""
    at = workspace(spark)
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.lit(1).alias("at"), F.lit(False).alias("gone"))
    tables.commit(vectors, f"{at}/index", ["vec_id"], "at", 0, "gone")
    tables.commit(vectors.filter("vec_id % 3 = 0").withColumns({"at": F.lit(2), "gone": F.lit(True)}), f"{at}/index", ["vec_id"], "at", 1, "gone")
    asked = feed(spark, table(d, "embeddings"), "vec_id long, embedding array<float>").filter("vec_id % 100 = 0")
    asked = asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    serve(asked, f"{at}/index", f"{at}/answers", f"{at}/checkpoint", lambda q, rows: cosine_topk(q, rows, 5)).awaitTermination()
    return spark.read.schema("query_id long, vec_id long, score double, rank int").parquet(f"{at}/answers").select("query_id", "vec_id", "score", "rank")
