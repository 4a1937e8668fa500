"""Pages and their sources: which pages to keep by their markup or title, the join of both, label maps, histories, the embedding sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_title
from ..registry import query, read, workspace
from .changes import events, latest

#: Prefixes of titles that stay although they have a colon.
ALLOWED = ("money making guide:", "quest:", "skill:")


def drop_by_markup(title: Column, text: Column) -> Column:
    """Redirects, disambiguations, pages of other namespaces, and pages of fewer than 50 characters."""
    t, low = F.trim(text), F.lower(title)
    other = F.contains(low, F.lit(":")) & ~F.startswith(low, F.lit("category:"))
    sense = F.contains(low, F.lit("disambiguation")) | F.contains(F.lower(text), F.lit("{{disambiguation}}"))
    return F.startswith(t, F.lit("#REDIRECT")) | F.startswith(t, F.lit("#redirect")) | sense | other | (F.char_length(t) < 50)


def include_new(title: Column) -> Column:
    """Whether a new page is collected, by its title."""
    low = F.lower(title)
    allowed = F.lit(False)
    for prefix in ALLOWED:
        allowed |= F.startswith(low, F.lit(prefix))
    return ~F.contains(low, F.lit("(disambiguation)")) & ~F.startswith(low, F.lit("category:")) & (~F.contains(low, F.lit(":")) | allowed) & ~F.contains(low, F.lit("redirect")) & ~F.contains(low, F.lit("moved to"))


_TITLES = "CASE p_partkey % 6 WHEN 0 THEN 'Category:' || p_name WHEN 1 THEN 'User:' || p_name WHEN 2 THEN p_name || ' (disambiguation)' ELSE p_name END"
_TEXTS = "CASE p_partkey % 5 WHEN 0 THEN ' #REDIRECT [[' || p_name || ' of the other kind and its many parts]]' WHEN 1 THEN p_name WHEN 2 THEN '{{Disambiguation}} ' || repeat(p_name || ' ', 3) ELSE repeat(p_name || ' is made. ', 3) END"


@query("wikitext_filter", rf"WITH t AS (SELECT p_partkey, {_TITLES} AS title, trim({_TEXTS}) AS text FROM part) SELECT p_partkey, title FROM t WHERE NOT (starts_with(text, '#REDIRECT') OR starts_with(text, '#redirect') OR contains(lower(title), 'disambiguation') OR contains(lower(text), '{{{{disambiguation}}}}') OR (contains(title, ':') AND NOT starts_with(lower(title), 'category:')) OR length(text) < 50)")
def wikitext_filter(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "part").select("p_partkey", F.expr(_TITLES).alias("title"), F.expr(_TEXTS).alias("text"))
    return t.filter(~drop_by_markup(F.col("title"), F.col("text"))).select("p_partkey", "title")


_NEW = "CASE page_id % 7 WHEN 0 THEN 'Quest:' || page_id WHEN 1 THEN 'Talk:' || page_id WHEN 2 THEN 'Category:' || page_id WHEN 3 THEN 'Page ' || page_id || ' moved to elsewhere' WHEN 4 THEN 'Money making guide:' || page_id WHEN 5 THEN 'Page (disambiguation)' ELSE 'Page ' || page_id END"


@query("new_page_include", f"SELECT page_id, title FROM (SELECT page_id, {_NEW} AS title FROM pages) WHERE page_id % 7 IN (0, 4, 6)")
def new_page_include(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.expr(_NEW).alias("title")).filter(include_new(F.col("title")))


@query("page_wikitext_join", "SELECT 'Part ' || p_partkey AS title, CASE WHEN p_partkey % 3 <> 0 THEN '[[' || p_brand || ']] 2' END AS raw FROM part")
def page_wikitext_join(spark: SparkSession, d: str) -> DataFrame:
    """Pages with the latest source of their title, by normalised titles; a page without one stays."""
    part = read(spark, d, "part")
    key, brand = F.col("p_partkey").cast("string"), F.concat(F.lit("[["), "p_brand", F.lit("]] "))
    page = part.select(F.concat(F.lit("Part "), key).alias("title"))
    raw = part.filter("p_partkey % 3 <> 0").select(F.concat(F.lit(" <i>Part</i> "), key, F.lit(" ")).alias("t"), brand.alias("b"), F.explode(F.array(F.lit(1), F.lit(2))).alias("revid"))
    raw = latest(raw.select(normalize_title(F.col("t")).alias("key"), "revid", F.concat("b", F.col("revid").cast("string")).alias("raw")), "key", "revid")
    return page.join(raw, normalize_title(F.col("title")) == F.col("key"), "left").select("title", "raw")


def parse_label_map(lines: DataFrame) -> DataFrame:
    """(label, id) of lines (value) that each hold a JSON object from labels to ids."""
    return lines.select(F.explode(F.from_json("value", "map<string,bigint>")).alias("label", "id"))


def invert(labels: DataFrame) -> DataFrame:
    """(id, label); of labels with one id the last in the alphabet."""
    return labels.groupBy("id").agg(F.max("label").alias("label"))


@query("label_map_invert", "SELECT c_custkey::BIGINT AS id, 'Customer#' || c_custkey AS label FROM customer")
def label_map_invert(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").withColumn("line", F.floor(F.col("c_custkey") / 50))
    entry = F.struct(F.concat(F.lit("Customer#"), F.col("c_custkey").cast("string")).alias("k"), F.col("c_custkey").cast("long").alias("v"))
    return invert(parse_label_map(c.groupBy("line").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))))


REVISION = "array<struct<id:bigint,user:struct<name:string>,comment:string>>"


def flatten_history(answers: DataFrame) -> DataFrame:
    """(title, pos, revid, author, comment) of answers (title, value) whose revisions stand in `items` or `revisions`."""
    r = F.from_json("value", f"items {REVISION}, revisions {REVISION}")
    rows = answers.select("title", F.posexplode(F.coalesce(r["items"], r["revisions"])).alias("pos", "r"))
    return rows.select("title", "pos", F.col("r.id").alias("revid"), F.coalesce("r.user.name", F.lit("Anonymous")).alias("author"), F.coalesce("r.comment", F.lit("(No edit summary provided)")).alias("comment"))


@query(
    "revision_history_flatten",
    "SELECT user_id AS title, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)::INT - 1 AS pos, event_id AS revid, CASE WHEN event_id % 4 = 0 THEN 'Anonymous' ELSE 'u' || event_id % 9 END AS author, CASE WHEN event_id % 3 = 0 THEN '(No edit summary provided)' ELSE event_type END AS comment FROM events QUALIFY pos < 500",
)
def revision_history_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Histories as an answer lists them, newest first and up to 500 a page, under either name."""
    n = F.row_number().over(W.partitionBy("title").orderBy(F.col("revid").desc()))
    ev = events(spark, d).withColumn("n", n).filter("n <= 500")
    name = F.when(F.col("revid") % 4 != 0, F.struct(F.concat(F.lit("u"), (F.col("revid") % 9).cast("string")).alias("name")))
    item = F.struct(F.col("revid").alias("id"), name.alias("user"), F.when(F.col("revid") % 3 != 0, F.col("kind")).alias("comment"))
    packed = ev.groupBy("title").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("i")))), lambda x: x["i"]).alias("r"))
    value = F.when(F.col("title") % 2 == 0, F.to_json(F.struct(F.col("r").alias("items")))).otherwise(F.to_json(F.struct(F.col("r").alias("revisions"))))
    return flatten_history(packed.select("title", value.alias("value")))


def write_embeddings(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Add rows to the embedding table, or put them in its place."""
    rows.write.mode("overwrite" if overwrite else "append").parquet(path)


@query("embedding_append", "SELECT vec_id, embedding, 'hash' AS embedding_model FROM embeddings WHERE embedding IS NOT NULL")
def embedding_append(spark: SparkSession, d: str) -> DataFrame:
    """A table written over an older one, then appended to with the rows it lacks, and read back."""
    path = f"{workspace(spark)}/index"
    e = read(spark, d, "embeddings").filter("embedding is not null").select("vec_id", "embedding", F.lit("hash").alias("embedding_model"))
    write_embeddings(e.filter("vec_id % 2 = 1"), path)
    write_embeddings(e.filter("vec_id % 2 = 0"), path, overwrite=True)
    held = spark.read.schema(e.schema).parquet(path).select("vec_id")
    write_embeddings(e.join(held, "vec_id", "left_anti"), path)
    return spark.read.schema(e.schema).parquet(path)
