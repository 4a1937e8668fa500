"""Line formats: tolerant JSON lines, triples as CSV, title lists, packed API answers. Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..registry import query, read

TRIPLE = "head string, relation string, tail string, source_title string, revid string"
TURN = "conv_id long, turn long, role string, text string"


def parse_json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Rows of a column `value` of JSON lines; blank, cut off and malformed lines are skipped."""
    row = F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.filter(F.trim("value") != "").select(row.alias("r")).filter("r._bad is null and r is not null").select("r.*").drop("_bad")


def read_json_lines(spark: SparkSession, path: str, schema: str, max_lines: int | None = None) -> DataFrame:
    """max_lines counts the first lines of the files, by path and then by place, before any is skipped."""
    lines = spark.read.text(path)
    if max_lines is not None:
        place = ("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
        lines = lines.select("value", *place).orderBy("file_path", "file_block_start", "n").limit(max_lines).select("value")
    return parse_json_lines(lines, schema)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def clean_triples(rows: DataFrame) -> DataFrame:
    """Head, relation and tail without blanks around them; a row with an empty one goes."""
    parts = [F.trim(c).alias(c) for c in ("head", "relation", "tail")]
    return rows.select(*parts).filter("head <> '' and relation <> '' and tail <> ''")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return clean_triples(spark.read.schema(TRIPLE).csv(path, header=True, escape='"', multiLine=True))


def write_triples(triples: DataFrame, path: str) -> None:
    triples.write.csv(path, header=True, escape='"')


def title_set(lines: DataFrame) -> DataFrame:
    """The distinct lines that are not blank, without blanks around them."""
    return lines.select(F.trim("value").alias("title")).filter("title <> ''").distinct()


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    return title_set(spark.read.text(path))


def write_titles(titles: DataFrame, path: str) -> None:
    titles.select("title").orderBy("title").write.text(path)


@query("jsonl_tolerant_scan", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_tolerant_scan(spark: SparkSession, d: str) -> DataFrame:
    """Each turn as a JSON line among a blank line, one that is cut off and one that is no JSON."""
    row = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    lines = read(spark, d, "conversations").select(F.explode(F.array(row, F.lit("  "), F.substring(row, 1, 12), F.lit("not json"))).alias("value"))
    return parse_json_lines(lines, TURN)


@query("triples_scan_clean", "SELECT 'Nation ' || n_name AS head, 'is_a' AS relation, r_name AS tail FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0")
def triples_scan_clean(spark: SparkSession, d: str) -> DataFrame:
    """CSV lines with blanks around values; every third one lacks its tail."""
    j = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tail = F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), "r_name"))
    lines = j.select(F.concat(F.lit("Nation "), "n_name", F.lit(" ,is_a,"), tail, F.lit(",src,1")).alias("value"))
    return clean_triples(lines.select(F.from_csv("value", TRIPLE).alias("r")).select("r.*"))


@query("title_set_scan", "SELECT DISTINCT trim(url) AS title FROM pages WHERE trim(url) <> ''")
def title_set_scan(spark: SparkSession, d: str) -> DataFrame:
    return title_set(read(spark, d, "pages").select(F.explode(F.array(F.concat(F.lit(" "), "url"), F.lit(""))).alias("value")))


@query("api_pages_flatten", "SELECT page_id, CASE WHEN page_id % 7 IN (0, 1) THEN 'null' ELSE 'kept' END AS status, CASE WHEN page_id % 7 > 1 THEN length(html) END AS n_chars, CASE WHEN page_id % 2 = 0 THEN ['Kind ' || page_id % 3] ELSE [] END AS categories FROM pages")
def api_pages_flatten(spark: SparkSession, d: str) -> DataFrame:
    """API answers, each with one page: the content of its first revision and its categories' names; a page that is
    missing or has no revision is null."""
    revs = F.when(F.col("page_id") % 7 == 0, F.expr("cast(array() as array<struct<content:string>>)")).otherwise(F.array(F.struct(F.col("html").alias("content"))))
    kinds = F.when(F.col("page_id") % 2 == 0, F.array(F.struct(F.concat(F.lit("Category:Kind "), (F.col("page_id") % 3).cast("string")).alias("title"))))
    page = F.struct("page_id", F.when(F.col("page_id") % 7 == 1, True).alias("missing"), revs.alias("revisions"), kinds.alias("categories"))
    packed = read(spark, d, "pages").select(F.to_json(F.struct(F.array(page).alias("pages"))).alias("value"))
    schema = "pages array<struct<page_id:bigint,missing:boolean,revisions:array<struct<content:string>>,categories:array<struct<title:string>>>>"
    p = packed.select(F.explode(F.from_json("value", schema)["pages"]).alias("p"))
    content = F.when(F.coalesce("p.missing", F.lit(False)), None).otherwise(F.get(F.col("p.revisions"), F.lit(0))["content"])
    names = F.coalesce(F.transform("p.categories", lambda c: F.regexp_replace(c["title"], "^Category:", "")), F.array().cast("array<string>"))
    return p.select("p.page_id", F.when(content.isNull(), "null").otherwise("kept").alias("status"), F.char_length(content).cast("long").alias("n_chars"), names.alias("categories"))


@query("log_progress_extract", "SELECT event_id, event_id % 101 AS percent, event_type AS epoch FROM events WHERE event_id % 2 = 0")
def log_progress_extract(spark: SparkSession, d: str) -> DataFrame:
    """Percent and stage of lines like `Training 42%| 42/100 stage=x`; other lines are skipped."""
    e = F.col("event_id")
    line = F.when(e % 2 == 0, F.concat(F.lit("Training "), (e % 101).cast("string"), F.lit("%| stage="), "event_type")).otherwise("started")
    x = read(spark, d, "events").select("event_id", line.alias("line")).filter(F.col("line").rlike(r"[0-9]+%\|"))
    return x.select("event_id", F.regexp_extract("line", r"([0-9]+)%\|", 1).cast("long").alias("percent"), F.regexp_extract("line", r"stage=(\w+)", 1).alias("epoch"))


#: Lines of a service log that tell of a chat request.
CHAT = "contains(line, '/chat') AND (contains(line, 'POST') OR contains(line, 'Processing'))"
_SERVED = "CASE event_id % 3 WHEN 0 THEN ' POST /chat ' || event_id || ' ' WHEN 1 THEN 'Processing /chat for ' || user_id ELSE 'GET /chat/' || event_id END"


def recent_chats(log: DataFrame, most: int = 12) -> DataFrame:
    """(log, n, line) -> the last chat lines of each log, without blanks around. A line's place is n."""
    chats = log.filter(F.expr(CHAT)).withColumn("rank", F.row_number().over(W.partitionBy("log").orderBy(F.col("n").desc())))
    return chats.filter(F.col("rank") <= most).select("log", "n", F.trim("line").alias("line"))


@query("log_recent_chats", f"WITH l AS (SELECT event_type AS log, event_id AS n, {_SERVED} AS line FROM events) SELECT log, n, trim(line) AS line FROM l WHERE {CHAT} QUALIFY row_number() OVER (PARTITION BY log ORDER BY n DESC) <= 12")
def log_recent_chats(spark: SparkSession, d: str) -> DataFrame:
    """The last twelve requests that the log of each kind of event tells of."""
    return recent_chats(read(spark, d, "events").select(F.col("event_type").alias("log"), F.col("event_id").alias("n"), F.expr(_SERVED).alias("line")))
