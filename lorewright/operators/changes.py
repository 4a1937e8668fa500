"""Keeping a collection current: set differences, revision diffs, upserts, latest versions, filters and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import base_title, page_title, strip_tags, url_path
from ..registry import query, read

_EV = "SELECT user_id AS title, event_id AS revid, ts, event_type AS kind FROM events"


def events(spark: SparkSession, d: str) -> DataFrame:
    """The change feed: title, revid, ts, kind."""
    return read(spark, d, "events").select(F.col("user_id").alias("title"), F.col("event_id").alias("revid"), "ts", F.col("event_type").alias("kind"))


@query("new_pages_anti", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def new_pages_anti(spark: SparkSession, d: str) -> DataFrame:
    """Listed pages that no tracking set knows."""
    lab = read(spark, d, "labels")
    tracked = lab.filter("quality = 1").select("doc_id").unionByName(lab.filter("quality = 0 or toxic = 1").select("doc_id"))
    return read(spark, d, "documents").select("doc_id").join(tracked, "doc_id", "left_anti")


@query("relevant_changes_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def relevant_changes_semi(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").join(read(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


def latest(df: DataFrame, key: str, *order) -> DataFrame:
    """The last row of each key. A maximum, combined map-side, instead of a sort of every group."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


@query("compact_latest", f"SELECT title, revid, kind FROM ({_EV}) QUALIFY row_number() OVER (PARTITION BY title ORDER BY revid DESC) = 1")
def compact_latest(spark: SparkSession, d: str) -> DataFrame:
    return latest(events(spark, d).select("title", "revid", "kind"), "title", "revid")


@query("last_wins", f"SELECT title, arg_max(kind, (ts, revid)) AS kind FROM ({_EV}) GROUP BY title")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("title").agg(F.max_by("kind", F.struct("ts", "revid")).alias("kind"))


@query("first_wins", "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM pages GROUP BY 1")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.min("page_id").alias("page_id"), F.min_by("url", "page_id").alias("url"))


_CUT = "TIMESTAMP '2024-01-15 00:00:00'"
_DIFF = f"""ev AS ({_EV}), old AS (SELECT title, max(revid) AS old_revid FROM ev WHERE ts < {_CUT} GROUP BY title), cur AS (SELECT title, max(revid) AS new_revid FROM ev WHERE title % 7 <> 0 GROUP BY title)"""


def _two_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ev = events(spark, d)
    old = ev.filter(F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp")).groupBy("title").agg(F.max("revid").alias("old_revid"))
    return old, ev.filter("title % 7 <> 0").groupBy("title").agg(F.max("revid").alias("new_revid"))


@query("revision_diff", f"WITH {_DIFF} SELECT title, old_revid, new_revid, CASE WHEN old_revid IS NULL THEN 'new' ELSE 'edit' END AS change FROM cur LEFT JOIN old USING (title) WHERE old_revid IS DISTINCT FROM new_revid")
def revision_diff(spark: SparkSession, d: str) -> DataFrame:
    old, cur = _two_states(spark, d)
    j = cur.join(old, "title", "left").filter(~F.col("old_revid").eqNullSafe(F.col("new_revid")))
    return j.select("title", "old_revid", "new_revid", F.when(F.col("old_revid").isNull(), "new").otherwise("edit").alias("change"))


@query("apply_changes", f"WITH {_DIFF} SELECT title, coalesce(new_revid, old_revid) AS revid, CASE WHEN old_revid IS NULL THEN 'added' WHEN new_revid IS NULL THEN 'kept' WHEN new_revid > old_revid THEN 'updated' ELSE 'same' END AS state FROM cur FULL JOIN old USING (title) WHERE new_revid IS NOT NULL OR title % 2 = 0")
def apply_changes(spark: SparkSession, d: str) -> DataFrame:
    """Upsert new and edited pages, delete those that are gone unless on the allow-list (here: even titles)."""
    old, cur = _two_states(spark, d)
    j = cur.join(old, "title", "full").filter(F.col("new_revid").isNotNull() | (F.col("title") % 2 == 0))
    state = F.when(F.col("old_revid").isNull(), "added").when(F.col("new_revid").isNull(), "kept").when(F.col("new_revid") > F.col("old_revid"), "updated").otherwise("same")
    return j.select("title", F.coalesce("new_revid", "old_revid").alias("revid"), state.alias("state"))


@query("revision_log_append", f"WITH ev AS ({_EV}) SELECT DISTINCT title, revid FROM ev WHERE ts >= {_CUT} AND (title, revid) NOT IN (SELECT (title, revid) FROM ev WHERE ts < {_CUT})")
def revision_log_append(spark: SparkSession, d: str) -> DataFrame:
    """The (title, revid) pairs that the log does not hold yet."""
    ev, cut = events(spark, d), F.lit("2024-01-15 00:00:00").cast("timestamp")
    return ev.filter(F.col("ts") >= cut).select("title", "revid").distinct().join(ev.filter(F.col("ts") < cut), ["title", "revid"], "left_anti")


@query("recent_changes_since", f"SELECT title, revid, kind FROM ({_EV}) WHERE ts > {_CUT} AND kind IN ('click', 'view') AND title % 4 IN (0, 1)")
def recent_changes_since(spark: SparkSession, d: str) -> DataFrame:
    """Changes after a cursor, of some kinds and namespaces (here the title's remainder by four)."""
    return events(spark, d).filter((F.col("ts") > F.lit("2024-01-15 00:00:00").cast("timestamp")) & F.col("kind").isin("click", "view") & (F.col("title") % 4).isin(0, 1)).select("title", "revid", "kind")


@query("embed_select_incremental", "SELECT doc_id, source || '|h:' || md5(text) AS key FROM documents WHERE source || '|h:' || md5(text) NOT IN (SELECT source || '|h:' || md5(text) FROM documents JOIN labels USING (doc_id))")
def embed_select_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose key is absent from the index, which holds the labelled ones."""
    key = F.concat("source", F.lit("|h:"), F.md5("text"))
    docs = read(spark, d, "documents").select("doc_id", key.alias("key"))
    return docs.join(docs.join(read(spark, d, "labels"), "doc_id").select("key"), "key", "left_anti").select("doc_id", "key")


@query("reconcile_presence", "SELECT CASE WHEN l.doc_id IS NULL THEN 'titles only' WHEN d.doc_id IS NULL THEN 'content only' ELSE 'both' END AS presence, count(*) AS n FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id GROUP BY 1")
def reconcile_presence(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "documents").filter("doc_id % 3 <> 0").select("doc_id").distinct().withColumn("a", F.lit(1))
    b = read(spark, d, "labels").select("doc_id").distinct().withColumn("b", F.lit(1))
    presence = F.when(F.col("b").isNull(), "titles only").when(F.col("a").isNull(), "content only").otherwise("both")
    return a.join(b, "doc_id", "full").groupBy(presence.alias("presence")).agg(F.count("*").alias("n"))


@query("reconcile_missing", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) ORDER BY doc_id LIMIT 1000")
def reconcile_missing(spark: SparkSession, d: str) -> DataFrame:
    """Titles without content, the first thousand in order."""
    content = read(spark, d, "documents").filter("doc_id % 3 <> 0").select("doc_id")
    return read(spark, d, "labels").select("doc_id").join(content, "doc_id", "left_anti").orderBy("doc_id").limit(1000)


@query(
    "collection_diff",
    """WITH col AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0), lis AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 5 <> 0),
    lab AS (SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'null list' WHEN min(quality) = 0 THEN 'filtered list' ELSE 'content list' END AS place FROM labels GROUP BY doc_id)
    SELECT doc_id, 'missing from collection' AS side, coalesce(place, 'nowhere') AS place FROM lis LEFT JOIN lab USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM col)
    UNION ALL SELECT doc_id, 'missing from listing', coalesce(place, 'nowhere') FROM col LEFT JOIN lab USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM lis)""",
)
def collection_diff(spark: SparkSession, d: str) -> DataFrame:
    """What the collection lacks of the listing and the listing of the collection, and which list holds it."""
    docs = read(spark, d, "documents").select("doc_id").distinct()
    has, listed = docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 5 <> 0")
    both = listed.join(has, "doc_id", "left_anti").withColumn("side", F.lit("missing from collection"))
    both = both.unionByName(has.join(listed, "doc_id", "left_anti").withColumn("side", F.lit("missing from listing")))
    place = F.when(F.max("toxic") == 1, "null list").when(F.min("quality") == 0, "filtered list").otherwise("content list")
    lists = read(spark, d, "labels").groupBy("doc_id").agg(place.alias("place"))
    return both.join(lists, "doc_id", "left").withColumn("place", F.coalesce("place", F.lit("nowhere")))


@query("titles_sync", "SELECT DISTINCT regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def titles_sync(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select(page_title(F.col("html")).alias("title")).distinct()


@query("purge_count", "SELECT count(*) AS before, count(*) FILTER (url LIKE '%utm_source%') AS purged, count(*) FILTER (url NOT LIKE '%utm_source%') AS after FROM pages")
def purge_count(spark: SparkSession, d: str) -> DataFrame:
    gone = F.contains("url", F.lit("utm_source"))
    return read(spark, d, "pages").agg(F.count("*").alias("before"), F.count_if(gone).alias("purged"), F.count_if(~gone).alias("after"))


@query("union_distinct", "SELECT s_nationkey AS nationkey FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey")).union(read(spark, d, "customer").select("c_nationkey")).distinct()


@query("cache_validate", f"WITH ev AS ({_EV}), cache AS (SELECT title, max(revid) AS top FROM ev WHERE ts < {_CUT} GROUP BY title), cur AS (SELECT title, max(revid) AS top FROM ev GROUP BY title) SELECT title, cache.top AS cached, cache.top = cur.top AS valid FROM cache JOIN cur USING (title)")
def cache_validate(spark: SparkSession, d: str) -> DataFrame:
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    g = events(spark, d).groupBy("title").agg(F.max(F.when(F.col("ts") < cut, F.col("revid"))).alias("cached"), F.max("revid").alias("top"))
    return g.filter("cached is not null").select("title", "cached", (F.col("cached") == F.col("top")).alias("valid"))


# filters


@query("page_status", "SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN 'null' WHEN length(trim(text)) < 50 THEN 'filtered' ELSE 'kept' END AS status FROM documents")
def page_status(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", F.when(t.isNull() | (t == ""), "null").when(F.char_length(F.trim(t)) < 50, "filtered").otherwise("kept").alias("status"))


_TITLE = "CASE page_id % 8 WHEN 0 THEN 'User:a' WHEN 1 THEN 'Talk:b' WHEN 2 THEN 'X (disambiguation)' WHEN 3 THEN 'A stub' WHEN 4 THEN 'Redirected' WHEN 5 THEN 'Page/sub' WHEN 6 THEN 'Sandbox' ELSE 'Page ' || page_id END"
# What titles of pages that are not collected hold, and of changes that are not looked at.
NO_PAGE = "disambiguation|redirect|stub|^user:|^talk:"
NO_CHANGE = "^(user|talk|file|category|template|help|special|mediawiki):|redirect|disambiguation|^sandbox|^test|^archive:|/"
# Redirects, pages that only tell names apart, and content of passing kinds.
REDIRECT = r"(?i)class=\"mw-redirect\"|#REDIRECT|^.{1,100}\s+redirects here\."
SENSES = r"(?i)This is a disambiguation page|This page is used to distinguish between articles|If an internal link led you to this disambiguation page"
PASSING_TITLE = "shattered relics|trailblazer|twisted league|league|leagues|deadman|tournament|dmm|deadman mode|beta|testing|seasonal|limited time"
PASSING_TEXT = "league|deadman|tournament|seasonal event"
PASSING_ASKED = "league|leagues|shattered relics|trailblazer|twisted league|deadman|dmm|tournament|seasonal|beta"


@query("page_include", f"SELECT page_id FROM pages WHERE NOT regexp_matches(lower({_TITLE}), '{NO_PAGE}')")
def page_include(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").filter(~F.lower(F.expr(_TITLE)).rlike(NO_PAGE)).select("page_id")


@query("title_skip", f"SELECT page_id, regexp_matches(lower({_TITLE}), '{NO_CHANGE}') OR page_id % 9 = 0 AS skip FROM pages")
def title_skip(spark: SparkSession, d: str) -> DataFrame:
    """Changes to skip: by title, or new without a revision (here every ninth)."""
    p = read(spark, d, "pages").select("page_id", F.expr(_TITLE).alias("title"), F.when(F.col("page_id") % 3 == 0, "new").otherwise("edit").alias("kind"), F.when(F.col("page_id") % 9 != 0, F.col("page_id")).alias("revid"))
    return p.select("page_id", (F.lower("title").rlike(NO_CHANGE) | ((F.col("kind") == "new") & F.col("revid").isNull())).alias("skip"))


def only_names(title: Column, html: Column) -> Column:
    """Redirects, and pages that tell names apart and say little else."""
    short = F.char_length(strip_tags(html)) < 500
    return html.rlike(REDIRECT) | (short & (html.rlike(SENSES) | (F.contains(title, F.lit("(disambiguation)")) & F.contains(html, F.lit("may refer to:")))))


_MARKED = "CASE page_id % 5 WHEN 0 THEN html || '<a class=\"mw-redirect\">x</a>' WHEN 1 THEN '<p>This is a  disambiguation page</p><p>This page is used to distinguish between articles</p>' WHEN 2 THEN '<b>It</b> may refer to: this' ELSE html || 'This is a disambiguation page' END"
_PLAIN = f"length(trim(regexp_replace(regexp_replace({_MARKED}, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) < 500"


@query("disambiguation_filter", f"SELECT page_id FROM pages WHERE NOT (contains(html, 'mw-redirect') OR contains(upper(html), '#REDIRECT') OR page_id % 5 = 0 OR page_id % 5 = 1 OR (page_id % 5 = 2 AND page_id % 8 = 2) OR (page_id % 5 > 2 AND {_PLAIN}))")
def disambiguation_filter(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", F.expr(_TITLE).alias("title"), F.expr(_MARKED).alias("html"))
    return p.filter(~only_names(F.col("title"), F.col("html"))).select("page_id")


@query("allowlist_semi", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS allowed FROM documents")
def allowlist_semi(spark: SparkSession, d: str) -> DataFrame:
    allowed = read(spark, d, "labels").filter("toxic = 1").select("doc_id").distinct().withColumn("allowed", F.lit(True))
    return read(spark, d, "documents").select("doc_id").join(allowed, "doc_id", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def passing(title: Column, text: Column) -> Column:
    """Content that stays for a time only: by its title, or by its first 500 characters."""
    return F.lower(title).rlike(PASSING_TITLE) | F.lower(F.substring(text, 1, 500)).rlike(PASSING_TEXT)


_OF = "source || CASE doc_id % 7 WHEN 0 THEN ' Beta' ELSE '' END"
_SAYS = "CASE doc_id % 10 WHEN 0 THEN 'A Seasonal event. ' || text WHEN 1 THEN repeat('x ', 300) || 'league' ELSE text END"
_QUESTION = "CASE doc_id % 3 WHEN 0 THEN 'What is new in the Beta?' ELSE 'What is new?' END"


@query("temporary_content", f"SELECT doc_id, regexp_matches(lower({_OF}), '{PASSING_TITLE}') OR regexp_matches(lower(substring({_SAYS}, 1, 500)), '{PASSING_TEXT}') AS passing, regexp_matches(lower({_QUESTION}), '{PASSING_ASKED}') AS asked FROM documents WHERE text IS NOT NULL")
def temporary_content(spark: SparkSession, d: str) -> DataFrame:
    """Whether a page is of a passing kind, and whether a question asks for such; one that does is shown them."""
    t = read(spark, d, "documents").filter("text is not null")
    return t.select("doc_id", passing(F.expr(_OF), F.expr(_SAYS)).alias("passing"), F.lower(F.expr(_QUESTION)).rlike(PASSING_ASKED).alias("asked"))


# aggregates


@query("title_lexicon", "SELECT token, count(*) AS freq FROM (SELECT unnest(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM part) GROUP BY token")
def title_lexicon(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.text import tokens

    return read(spark, d, "part").select(F.explode(tokens(F.col("p_name"))).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


@query("base_title_counts", "SELECT trim(split_part(regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), ' *\\([^)]*\\)', '', 'g'), '/', 1)) AS base, count(*) AS n FROM pages GROUP BY 1")
def base_title_counts(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").groupBy(base_title(url_path(F.col("url"))).alias("base")).agg(F.count("*").alias("n"))


@query("first_char_histogram", "SELECT upper(substring(text, 1, 1)) AS ch, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM documents GROUP BY 1 ORDER BY n DESC, ch LIMIT 20")
def first_char_histogram(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "documents").groupBy(F.upper(F.substring("text", 1, 1)).alias("ch")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6)).orderBy(F.col("n").desc(), "ch").limit(20)


_PATTERNS = {"colon": ":", "parenthesis": "\\(", "apostrophe": "'", "hyphen": "-", "number_start": "^[0-9]", "special_start": "^[^A-Za-z0-9]"}
_PATHS = "CASE page_id % 5 WHEN 0 THEN '(x) ' || page_id WHEN 1 THEN page_id || ': it''s' ELSE url END"


@query("special_pattern_counts", " UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) FILTER (regexp_matches(t, '{v.replace(chr(39), chr(39) * 2)}')) AS n, round(100.0 * count(*) FILTER (regexp_matches(t, '{v.replace(chr(39), chr(39) * 2)}')) / count(*), 1)::DOUBLE AS percent FROM (SELECT {_PATHS} AS t FROM pages)" for k, v in _PATTERNS.items()))
def special_pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    titles = read(spark, d, "pages").select(F.expr(_PATHS).alias("t"))
    wide = titles.agg(F.count("*").alias("all"), *(F.count_if(F.col("t").rlike(v)).alias(k) for k, v in _PATTERNS.items()))
    return wide.unpivot(["all"], list(_PATTERNS), "pattern", "n").select("pattern", "n", F.round(100.0 * F.col("n") / F.col("all"), 1).alias("percent"))


@query("namespace_census", "SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS n, list_sort(list(regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)))[1:10] AS first_titles FROM pages GROUP BY 1")
def namespace_census(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each host with the first ten paths. Only the ten are kept of a host, however many it has."""
    p = read(spark, d, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), url_path(F.col("url")).alias("path"))
    n = p.groupBy("host").agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("host").orderBy("path"))
    top = p.withColumn("r", rank).filter("r <= 10").groupBy("host").agg(F.array_sort(F.collect_list("path")).alias("first_titles"))
    return n.join(top, "host")


@query("index_stats", "SELECT count(*) AS rows, max(len(embedding)) AS dimension, count(DISTINCT label) AS models FROM embeddings")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").agg(F.count("*").alias("rows"), F.max(F.size("embedding")).alias("dimension"), F.countDistinct("label").alias("models"))


@query("battery_summary", "SELECT event_type AS mode, count(*) AS ran, count(*) FILTER (value IS NOT NULL) AS ok, round(avg(value), 6) AS mean_elapsed, min(value) AS min_elapsed, max(value) AS max_elapsed FROM events GROUP BY 1")
def battery_summary(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return read(spark, d, "events").groupBy(F.col("event_type").alias("mode")).agg(F.count("*").alias("ran"), F.count(v).alias("ok"), F.round(F.avg(v), 6).alias("mean_elapsed"), F.min(v).alias("min_elapsed"), F.max(v).alias("max_elapsed"))


@query("run_metadata", "SELECT (SELECT count(*) FROM pages) AS total_pages, (SELECT max(page_id) FROM pages) AS last_id, (SELECT count(DISTINCT regexp_extract(url, '^[a-z]+://([^/]+)', 1)) FROM pages) AS sources")
def run_metadata(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").agg(F.count("*").alias("total_pages"), F.max("page_id").alias("last_id"), F.countDistinct(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)).alias("sources"))


@query("collection_sorted", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages WHERE regexp_extract(html, '<title>([^<]*)</title>', 1) <> ''")
def collection_sorted(spark: SparkSession, d: str) -> DataFrame:
    t = page_title(F.col("html"))
    return read(spark, d, "pages").select("page_id", t.alias("title")).filter("title <> ''").orderBy(F.lower("title"), "title")


@query("recent_contributors", f"SELECT title, revid, kind FROM ({_EV}) QUALIFY row_number() OVER (PARTITION BY title ORDER BY ts DESC, revid DESC) <= 3")
def recent_contributors(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("title").orderBy(F.col("ts").desc(), F.col("revid").desc()))
    return events(spark, d).withColumn("rank", rank).filter("rank <= 3").select("title", "revid", "kind")


@query("history_cap", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history_cap(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    return read(spark, d, "conversations").withColumn("rank", rank).filter("rank <= 3").select("conv_id", "turn", "role")


@query("context_usage", "SELECT conv_id, count(*) AS entries, sum(length(text))::BIGINT AS chars, sum(length(text))::BIGINT // 4 AS tokens, least(100.0, round(100.0 * (sum(length(text))::BIGINT // 4) / 8192, 6))::DOUBLE AS percent FROM conversations GROUP BY conv_id")
def context_usage(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("entries"), F.sum(F.char_length("text")).alias("chars"))
    t = g.withColumn("tokens", F.floor(F.col("chars") / 4))
    return t.withColumn("percent", F.least(F.lit(100.0), F.round(100.0 * F.col("tokens") / 8192, 6)))
