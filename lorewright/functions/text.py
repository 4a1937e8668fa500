"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query, read

# Named character references.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&ndash;": "–", "&mdash;": "—", "&hellip;": "…"}


def normalize_title(t: Column) -> Column:
    return F.regexp_replace(F.trim(t), "<[^>]*>", "")


def decode_entities(t: Column) -> Column:
    """The named table, then decimal references to printable characters, then the ampersand."""
    for name, char in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    codes = F.array_distinct(F.regexp_extract_all(t, F.lit(r"&#(\d{2,5});"), F.lit(1)))
    printable = F.filter(codes, lambda c: c.cast("int").between(32, 126) | c.cast("int").between(160, 55295) | c.cast("int").between(57344, 65533))
    char = lambda c: F.decode(F.unhex(F.lpad(F.hex(c.cast("int")), 4, "0")), "UTF-16BE")
    t = F.aggregate(printable, t, lambda acc, c: F.replace(acc, F.concat(F.lit("&#"), c, F.lit(";")), char(c)))
    return F.replace(t, F.lit("&amp;"), F.lit("&"))


def strip_tags(t: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), r"[ \t\r\n]+", " "))


def clean_text(t: Column) -> Column:
    """Entities decoded, runs of blanks made one, three or more line breaks made two, ends trimmed."""
    t = F.regexp_replace(decode_entities(t), r"[ \t]+", " ")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def straight_quotes(t: Column) -> Column:
    return F.translate(t, "“”„‘’‚", "\"\"\"'''")


def normalize_snippet(t: Column) -> Column:
    return F.trim(F.regexp_replace(straight_quotes(decode_entities(t)), r"[ \t\r\n]+", " "))


def base_title(t: Column) -> Column:
    """Without a trailing parenthesis, up to the first slash."""
    return F.trim(F.substring_index(F.regexp_replace(t, r" *\([^)]*\)", ""), "/", 1))


def tokens(t: Column) -> Column:
    return F.filter(F.split(F.lower(t), "[^a-z0-9]+"), lambda x: x != "")


def preview(t: Column, n: int) -> Column:
    return F.when(F.char_length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def recency(t: Column) -> Column:
    """By the latest year 20xx in the first 8000 characters, 2013 to 2030 as 0 to 1; 0.05 more with a month's name."""
    head = F.substring(t, 1, 8000)
    year = F.array_max(F.transform(F.regexp_extract_all(head, F.lit(r"\b(20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int")))
    score = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (year - 2013) / 17.0)), F.lit(0.0))
    month = F.lower(head).rlike("january|february|march|april|may|june|july|august|september|october|november|december")
    return F.when(month, F.least(F.lit(1.0), score + 0.05)).otherwise(score)


def page_title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/]+/([^?#]*)", 1)


_SQL_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_SQL_PATH = "regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


def sql_decode(t: str) -> str:
    for name, char in ENTITIES.items():
        quote = char.replace("'", "''")
        t = f"replace({t}, '{name}', '{quote}')"
    return f"replace({t}, '&amp;', '&')"


@query("title_normalize", f"SELECT page_id, regexp_replace(trim(' <i>' || {_SQL_TITLE} || '</i>'), '<[^>]*>', '', 'g') AS title FROM pages")
def title_normalize(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", normalize_title(F.concat(F.lit(" <i>"), page_title(F.col("html")), F.lit("</i>"))).alias("title"))


@query("title_clean", f"SELECT page_id, trim(regexp_replace({sql_decode(_SQL_TITLE)}, '[ \\t\\r\\n]+', ' ', 'g')) AS title FROM pages")
def title_clean(spark: SparkSession, d: str) -> DataFrame:
    t = decode_entities(page_title(F.col("html")))
    return read(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(t, r"[ \t\r\n]+", " ")).alias("title"))


@query("html_entity_decode", f"SELECT page_id, {sql_decode('html')} || ' é7' AS text FROM pages")
def html_entity_decode(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", decode_entities(F.concat(F.col("html"), F.lit(" &#233;&#55;"))).alias("text"))


@query("text_clean", f"SELECT doc_id, trim(regexp_replace(regexp_replace({sql_decode('text')}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text FROM documents")
def text_clean(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


@query("html_strip", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", strip_tags(F.col("html")).alias("text"))


@query("snippet_normalize", f"SELECT doc_id, trim(regexp_replace(translate({sql_decode('text')}, '“”„‘’‚', '\"\"\"'''''''), '[ \\t\\r\\n]+', ' ', 'g')) AS snippet FROM documents")
def snippet_normalize(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", normalize_snippet(F.col("text")).alias("snippet"))


@query(
    "categories_normalize",
    "SELECT p_partkey, [regexp_replace(p_type, '^Category:', ''), p_brand] AS categories FROM part",
)
def categories_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Categories come as plain strings or as objects with a category field; both become plain names."""
    raw = F.array(F.concat(F.lit("Category:"), F.col("p_type")), F.to_json(F.struct(F.col("p_brand").alias("category"))), F.lit(None).cast("string"))
    name = lambda c: F.regexp_replace(F.coalesce(F.get_json_object(c, "$.category"), c), "^Category:", "")
    return read(spark, d, "part").select("p_partkey", F.transform(F.filter(raw, lambda c: c.isNotNull()), name).alias("categories"))


@query("embedding_text", "SELECT doc_id, 'Title: ' || source || chr(10) || CASE WHEN lang <> 'en' THEN 'Categories: ' || lang || chr(10) ELSE '' END || 'Content: ' || text AS text FROM documents")
def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    categories = F.when(F.col("lang") != "en", F.array("lang")).otherwise(F.array().cast("array<string>"))
    line = F.when(F.size(categories) > 0, F.concat(F.lit("Categories: "), F.array_join(categories, ", ")))
    return read(spark, d, "documents").select("doc_id", F.concat_ws("\n", F.concat(F.lit("Title: "), "source"), line, F.concat(F.lit("Content: "), "text")).alias("text"))


@query("rerank_pair_text", "SELECT doc_id, source || chr(10) || chr(10) || substring(text, 1, 4000) AS pair FROM documents")
def rerank_pair_text(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.concat("source", F.lit("\n\n"), F.substring("text", 1, 4000)).alias("pair"))


def page_key(title: Column, revid: Column, text: Column) -> Column:
    return F.concat(title, F.coalesce(F.concat(F.lit("|r:"), revid.cast("string")), F.concat(F.lit("|h:"), F.md5(text))))


@query("page_key", "SELECT doc_id, source || CASE WHEN doc_id % 3 = 0 THEN '|h:' || md5(text) ELSE '|r:' || doc_id END AS key FROM documents")
def page_keys(spark: SparkSession, d: str) -> DataFrame:
    revid = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id"))
    return read(spark, d, "documents").select("doc_id", page_key(F.col("source"), revid, F.col("text")).alias("key"))


@query("snippet_key", "SELECT item_id, 'item ' || item_id || '|' || sha1('item ' || item_id || '|' || text) AS key FROM benchmark")
def snippet_key(spark: SparkSession, d: str) -> DataFrame:
    title = F.lower(F.concat(F.lit("Item "), "item_id"))
    return read(spark, d, "benchmark").select("item_id", F.concat(title, F.lit("|"), F.sha1(F.concat(title, F.lit("|"), "text"))).alias("key"))


@query("base_title", f"SELECT page_id, trim(split_part(regexp_replace({_SQL_PATH} || ' (x)', ' *\\([^)]*\\)', '', 'g'), '/', 1)) AS base FROM pages")
def base_titles(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", base_title(F.concat(url_path(F.col("url")), F.lit(" (x)"))).alias("base"))


@query("page_url", "SELECT p_partkey, 'https://wiki.example.org/w/' || replace(p_name, ' ', '_') AS url, 'https://wiki.example.org/w/?title=' || replace(p_name, ' ', '_') || '&oldid=' || p_partkey AS revision_url FROM part")
def page_url(spark: SparkSession, d: str) -> DataFrame:
    slug = F.url_encode(F.replace("p_name", F.lit(" "), F.lit("_")))
    root = "https://wiki.example.org/w/"
    return read(spark, d, "part").select("p_partkey", F.concat(F.lit(root), slug).alias("url"), F.concat(F.lit(root + "?title="), slug, F.lit("&oldid="), F.col("p_partkey").cast("string")).alias("revision_url"))


@query("tokenize", "SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS tokens FROM documents")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))


@query("levenshtein_pairs", "SELECT p_partkey, levenshtein(split_part(p_name, ' ', 1), split_part(p_name, ' ', 2))::INT AS distance, levenshtein(lower(p_type), lower(p_brand)) <= 6 AS near FROM part")
def levenshtein_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The distance of given pairs, and whether one is within a bound; which words are near each other is spelling_neighbours."""
    one, two = F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    return read(spark, d, "part").select("p_partkey", F.levenshtein(one, two).alias("distance"), (F.levenshtein(F.lower("p_type"), F.lower("p_brand"), 6) >= 0).alias("near"))


@query("text_preview", "SELECT doc_id, " + ", ".join(f"CASE WHEN length(text) > {n} THEN substring(text, 1, {n}) || '...' ELSE text END AS preview_{n}" for n in (200, 600, 900)) + " FROM documents")
def text_preview(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", *(preview(F.col("text"), n).alias(f"preview_{n}") for n in (200, 600, 900)))


@query("token_budget", "SELECT doc_id, n_chars // 4 AS session_tokens, (n_chars * 2) // 7 AS prompt_tokens, least(131072, greatest(8192, (n_chars * 2) // 7)) AS window_size FROM documents")
def token_budget(spark: SparkSession, d: str) -> DataFrame:
    prompt = F.floor(F.col("n_chars") * 2 / 7)
    return read(spark, d, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).alias("session_tokens"), prompt.alias("prompt_tokens"), F.least(F.lit(131072), F.greatest(F.lit(8192), prompt)).alias("window_size"))


_SQL_YEAR = r"list_max(list_transform(regexp_extract_all(substring(text, 1, 8000), '\b(20[0-9]{2})\b', 1), lambda y: y::INT))"
SQL_RECENCY = f"""(SELECT *, CASE WHEN regexp_matches(lower(substring(text, 1, 8000)), 'january|february|march|april|may|june|july|august|september|october|november|december')
    THEN least(1.0, base + 0.05) ELSE base END::DOUBLE AS recency FROM (SELECT *, coalesce(greatest(0.0, least(1.0, ({_SQL_YEAR} - 2013) / 17.0)), 0.0)::DOUBLE AS base FROM
    (SELECT o_orderkey, 'Changed on ' || strftime(o_orderdate::DATE + INTERVAL 20 YEAR, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' in March' ELSE '' END AS text FROM orders)))"""


def dated_texts(spark: SparkSession, d: str) -> DataFrame:
    date = F.date_format(F.add_months(F.col("o_orderdate").cast("date"), 240), "yyyy-MM-dd")
    month = F.when(F.col("o_orderkey") % 2 == 0, F.lit(" in March")).otherwise(F.lit(""))
    return read(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Changed on "), date, month).alias("text"))


@query("recency_score", f"SELECT o_orderkey, recency FROM {SQL_RECENCY}")
def recency_score(spark: SparkSession, d: str) -> DataFrame:
    return dated_texts(spark, d).select("o_orderkey", recency(F.col("text")).alias("recency"))


@query("recency_rank", f"SELECT o_orderkey, recency, row_number() OVER (ORDER BY recency DESC, o_orderkey) AS rank FROM {SQL_RECENCY} ORDER BY rank LIMIT 100")
def recency_rank(spark: SparkSession, d: str) -> DataFrame:
    """The hundred most recent texts, in order."""
    from pyspark.sql import Window as W

    top = dated_texts(spark, d).select("o_orderkey", recency(F.col("text")).alias("recency")).orderBy(F.col("recency").desc(), "o_orderkey").limit(100)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.col("recency").desc(), "o_orderkey")))
