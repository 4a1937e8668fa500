"""The retrieval chain for a table of questions: pools over sub-queries, neighbours, two-pass ranking, sources, attribution.

The fixture names each row of `embeddings` by its label, so that titles have variants, categories and marks, and
asks a question about foes or about things with each query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import base_title, tokens
from ..registry import query, read
from .intents import FOE_PLACES, FOE_TITLES, FOE_WORDS, INTENTS, ITEM_MARKS, ITEM_TITLES, ITEM_WORDS, about_foes, keep_by_intent
from .retrieval import _E, _topk_sql, corpus, cosine_topk, few_queries

_SUFFIX = ["' dust'", "' (monster)'", "' ore'", "' cave'", "' (version ' || vec_id % 2 || ')'", "'/drops'", "''", "''", "''", "''"]
_NAMED = f"""nam AS (SELECT vec_id, label, 'Row ' || vec_id // 5 || CASE label {" ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(_SUFFIX))} ELSE '' END AS title,
    CASE WHEN label = 4 THEN ['Slayer monsters'] WHEN label = 5 THEN ['Tradeable items'] WHEN label = 7 THEN ['Caves'] ELSE [] END::VARCHAR[] AS categories FROM embeddings)"""
_ASKS = "CASE WHEN query_id % 300 = 0 THEN 'How to kill the boss' WHEN query_id % 300 = 100 THEN 'Where to buy runes' ELSE 'Which monster is it' END"


def named(spark: SparkSession, d: str) -> DataFrame:
    """(vec_id, label, title, categories)."""
    e = read(spark, d, "embeddings")
    suffix = F.coalesce(*(F.when(F.col("label") == i, F.expr(s)) for i, s in enumerate(_SUFFIX)), F.lit(""))
    title = F.concat(F.lit("Row "), F.floor(F.col("vec_id") / 5).cast("string"), suffix)
    none = F.array().cast("array<string>")
    cats = F.when(F.col("label") == 4, F.array(F.lit("Slayer monsters"))).when(F.col("label") == 5, F.array(F.lit("Tradeable items"))).when(F.col("label") == 7, F.array(F.lit("Caves"))).otherwise(none)
    return e.select("vec_id", "label", title.alias("title"), cats.alias("categories"))


def candidates(spark: SparkSession, d: str, k: int) -> DataFrame:
    """The k nearest rows of each query with their titles and categories, and the question."""
    rows = corpus(spark, d)
    return cosine_topk(few_queries(rows), rows, k).join(named(spark, d), "vec_id").withColumn("q", F.expr(_ASKS))


def _candidates_sql(k: int) -> str:
    return f"{_E}, {_NAMED}, can AS (SELECT query_id, vec_id, score, rank, title, categories, {_ASKS} AS q FROM ({_topk_sql(k)}) JOIN nam USING (vec_id))"


_BASE = r"trim(split_part(regexp_replace(title, ' *\([^)]*\)', '', 'g'), '/', 1))"


@query("dedupe_base_title", f"WITH {_candidates_sql(30)}, bas AS (SELECT *, {_BASE} AS base FROM can QUALIFY row_number() OVER (PARTITION BY query_id, {_BASE} ORDER BY rank) = 1) SELECT query_id, base, vec_id, score FROM bas QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 10")
def dedupe_base_title(spark: SparkSession, d: str) -> DataFrame:
    """Of the pages of one base title the best; of these the ten best of a query."""
    best = candidates(spark, d, 30).groupBy("query_id", base_title(F.col("title")).alias("base")).agg(F.min(F.struct("rank", "vec_id", "score")).alias("b"))
    best = best.select("query_id", "base", "b.*")
    return best.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("rank"))).filter("n <= 10").select("query_id", "base", "vec_id", "score")


_FOES = f"(regexp_matches(lower(q), '{FOE_WORDS}') OR regexp_matches(lower(q), '{INTENTS['strategy']}') OR regexp_matches(lower(q), '{INTENTS['location']}')) AND NOT regexp_matches(lower(q), '{ITEM_WORDS}')"
_CATS = "array_to_string(list_transform(categories, lambda c: lower(c)), chr(10))"


@query(
    "intent_filter",
    f"""WITH {_candidates_sql(20)}, cla AS (SELECT *, {_FOES} AS foes, regexp_matches(lower(title), '{ITEM_TITLES}') OR regexp_matches({_CATS}, '{ITEM_MARKS}') AS item FROM can),
    pag AS (SELECT *, regexp_matches(lower(title), '{FOE_TITLES}') OR contains({_CATS}, 'monsters') OR (regexp_matches(lower(title), '{FOE_PLACES}') AND NOT item) AS foe FROM cla WHERE NOT (foes AND item)),
    kep AS (SELECT *, bool_or(foe) OVER (PARTITION BY query_id) AS kept FROM pag) SELECT query_id, vec_id, title, score FROM kep WHERE NOT foes OR foe OR NOT kept""",
)
def intent_filter(spark: SparkSession, d: str) -> DataFrame:
    return keep_by_intent(candidates(spark, d, 20)).select("query_id", "vec_id", "title", "score")


@query(
    "source_list",
    f"""WITH {_candidates_sql(8)} SELECT query_id, vec_id, rank, title, categories, least(0.999, greatest(0.0, score)) AS similarity, 'https://wiki.example.org/w/' || replace(title, ' ', '_') AS url FROM can
    WHERE NOT (regexp_matches(lower(q), '{FOE_WORDS}') AND NOT regexp_matches(lower(q), '{ITEM_WORDS}') AND NOT contains({_CATS}, 'monster')
      AND (contains({_CATS}, 'item') OR contains({_CATS}, 'grand exchange') OR ends_with(lower(title), ' dust')))""",
)
def source_list(spark: SparkSession, d: str) -> DataFrame:
    """What an answer rests on; pages on things are left out where the question is about foes."""
    c = candidates(spark, d, 8)
    cats = F.lower(F.array_join("categories", "\n"))
    thing = (F.contains(cats, F.lit("item")) | F.contains(cats, F.lit("grand exchange")) | F.endswith(F.lower("title"), F.lit(" dust"))) & ~F.contains(cats, F.lit("monster"))
    url = F.concat(F.lit("https://wiki.example.org/w/"), F.replace("title", F.lit(" "), F.lit("_")))
    kept = c.filter(~(about_foes(F.col("q"))[0] & thing))
    return kept.select("query_id", "vec_id", "rank", "title", "categories", F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.col("score"))).alias("similarity"), url.alias("url"))


def tool_search(found: DataFrame, used: DataFrame, cut: float = 0.7, terms: int = 5, most: int = 8) -> DataFrame:
    """(asker, title, vec_id, n): found (asker, term, rank, vec_id, title, score) for the first `terms` terms of an asker: rows
    above the cut whose title the asker has not used (asker, title), each title once, as its earliest term found it, and
    the first `most`. An asker's rows are bounded by its terms and what each finds."""
    first = found.filter((F.col("score") > cut) & (F.col("term") <= terms)).join(used, ["asker", "title"], "left_anti")
    first = first.groupBy("asker", "title").agg(F.min(F.struct("term", "rank", "vec_id")).alias("o"))
    n = F.row_number().over(W.partitionBy("asker").orderBy("o"))
    return first.withColumn("n", n).filter(F.col("n") <= most).select("asker", "title", "o.vec_id", "n")


@query(
    "semantic_tools",
    f"""WITH {_E}, {_NAMED}, f AS (SELECT query_id // 1000 AS asker, query_id // 100 % 10 + 1 AS term, rank, vec_id, title, score FROM ({_topk_sql(6)}) JOIN nam USING (vec_id)),
    u AS (SELECT title, min((term, rank, vec_id)) AS o, asker FROM f WHERE score > 0.2 AND term <= 5 AND (asker, title) NOT IN (SELECT vec_id // 1000, title FROM nam WHERE vec_id % 200 = 0) GROUP BY asker, title)
    SELECT asker, title, o[3] AS vec_id, row_number() OVER (PARTITION BY asker ORDER BY o) AS n FROM u QUALIFY n <= 8""",
)
def semantic_tools(spark: SparkSession, d: str) -> DataFrame:
    """Terms are the queries of one run of 1000 ids; every other term's own title is used already. Random vectors are far
    from each other, so the cut is 0.2 here."""
    found = candidates(spark, d, 6).select(F.floor(F.col("query_id") / 1000).alias("asker"), (F.floor(F.col("query_id") / 100) % 10 + 1).alias("term"), "rank", "vec_id", "title", "score")
    used = named(spark, d).filter("vec_id % 200 = 0").select(F.floor(F.col("vec_id") / 1000).alias("asker"), "title")
    return tool_search(found, used, 0.2)


def pool(found: DataFrame, bonus: Column, most: int) -> DataFrame:
    """(query_id, base, vec_id, score, hits): found (query_id, sub, vec_id, score, title) by base title: the best row, more
    for each further hit, and of these the best `most` of a query. Combined map-side by query and base title."""
    g = found.withColumn("score", F.round(F.col("score") + bonus, 9)).groupBy("query_id", base_title(F.col("title")).alias("base"))
    g = g.agg(F.max(F.struct("score", (-F.col("vec_id")).alias("m"))).alias("b"), F.count("*").alias("hits"))
    g = g.select("query_id", "base", (-F.col("b.m")).alias("vec_id"), F.round(F.col("b.score") + 0.01 * F.least(F.lit(5), F.col("hits") - 1), 9).alias("score"), "hits")
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "base"))
    return g.withColumn("n", n).filter(F.col("n") <= most).drop("n")


@query(
    "self_research",
    f"""WITH {_candidates_sql(3)}, sub AS (SELECT vec_id * 10 AS sub, v FROM e WHERE vec_id % 100 = 0 UNION ALL
      SELECT query_id * 10 + rank, list_transform(list_zip(a.v, b.v), lambda x: 0.7 * x[1] + 0.3 * x[2]) FROM can JOIN e a ON a.vec_id = query_id JOIN e b ON b.vec_id = can.vec_id),
    near AS (SELECT a.sub, b.vec_id, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 9) AS score FROM sub a, e b
      QUALIFY row_number() OVER (PARTITION BY a.sub ORDER BY score DESC, b.vec_id) <= 12),
    bon AS (SELECT sub // 10 AS query_id, {_BASE} AS base, vec_id, round(score + CASE WHEN label = 4 THEN 0.04 WHEN label = 7 THEN 0.03 ELSE 0 END, 9) AS score FROM near JOIN nam USING (vec_id)),
    agg AS (SELECT query_id, base, arg_max(vec_id, (score, -vec_id)) AS vec_id, round(max(score) + 0.01 * least(5, count(*) - 1), 9) AS score, count(*) AS hits FROM bon GROUP BY ALL)
    SELECT * FROM agg QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, base) <= 10""",
)
def self_research(spark: SparkSession, d: str) -> DataFrame:
    """Searches by each query and by it with its three nearest rows mixed in; twelve rows each, pooled by base title."""
    rows = corpus(spark, d)
    q = few_queries(rows)
    first = cosine_topk(q, rows, 3).select("query_id", "vec_id", "rank").join(q, "query_id").join(rows.select("vec_id", "v"), "vec_id")
    more = first.select((F.col("query_id") * 10 + F.col("rank")).alias("query_id"), F.zip_with("q", "v", lambda x, y: 0.7 * x + 0.3 * y).alias("q"))
    sub = q.select((F.col("query_id") * 10).alias("query_id"), "q").unionByName(more)
    found = cosine_topk(sub, rows, 12).withColumn("query_id", F.floor(F.col("query_id") / 10)).join(named(spark, d), "vec_id")
    return pool(found, F.when(F.col("label") == 4, 0.04).when(F.col("label") == 7, 0.03).otherwise(0.0), 10)


_LINKS = "lin AS (SELECT 'N' || vec_id AS head, pos, 'N' || (vec_id + 3 * pos) AS tail FROM e, (SELECT unnest([1, 2, 3]) AS pos))"


@query(
    "neighbor_expand",
    f"""WITH {_E}, {_LINKS}, top AS ({_topk_sql(5)}), see AS (SELECT query_id, rank, t.vec_id AS seed FROM top t),
    near AS (SELECT seed, b.vec_id, row_number() OVER (PARTITION BY seed ORDER BY s DESC, b.vec_id) AS n FROM (SELECT DISTINCT seed FROM see) JOIN e a ON a.vec_id = seed, LATERAL (SELECT b.vec_id,
      round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 9) AS s FROM e b WHERE b.vec_id <> a.vec_id) b QUALIFY n <= 3),
    al AS (SELECT query_id, seed AS vec_id, 0 AS kind, rank, 0 AS n FROM see UNION ALL
      SELECT query_id, r.vec_id, 1, rank, pos FROM see JOIN lin ON head = 'N' || seed JOIN e r ON 'N' || r.vec_id = tail UNION ALL
      SELECT query_id, near.vec_id, 2, rank, n FROM see JOIN near USING (seed)),
    one AS (SELECT query_id, vec_id, min((kind, rank, n)) AS o FROM al GROUP BY ALL)
    SELECT query_id, vec_id, CASE o[1] WHEN 0 THEN 'base' WHEN 1 THEN 'link' ELSE 'vector' END AS via FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY o, vec_id) <= 5 + 5 * 3 + 10""",
)
def neighbor_expand(spark: SparkSession, d: str, top: int = 5, each: int = 3) -> DataFrame:
    """The best rows of each query, what the graph links to them (titles looked up among the rows; others have no row)
    and their nearest rows. A row stands once, by the first way; the number of rows of a query is bounded."""
    rows = corpus(spark, d)
    seeds = cosine_topk(few_queries(rows), rows, top).select("query_id", F.col("vec_id").alias("seed"), "rank")
    titled = rows.select(F.concat(F.lit("N"), F.col("vec_id").cast("string")).alias("tail"), "vec_id")
    links = rows.select(F.col("vec_id").alias("seed"), F.explode(F.sequence(F.lit(1), F.lit(each))).alias("n")).withColumn("tail", F.concat(F.lit("N"), (F.col("seed") + 3 * F.col("n")).cast("string")))
    q = rows.join(seeds.select(F.col("seed").alias("vec_id")).distinct(), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    near = cosine_topk(q, rows, each, exclude_self=True).select(F.col("query_id").alias("seed"), "vec_id", F.col("rank").alias("n"))
    way = lambda df, kind, n: df.select("query_id", "vec_id", F.struct(F.lit(kind).alias("kind"), F.col("rank").alias("rank"), n.cast("int").alias("n")).alias("o"))
    every = way(seeds.withColumn("vec_id", F.col("seed")), 0, F.lit(0))
    every = every.unionByName(way(seeds.join(links, "seed").join(titled, "tail"), 1, F.col("n"))).unionByName(way(seeds.join(near, "seed"), 2, F.col("n")))
    one = every.groupBy("query_id", "vec_id").agg(F.min("o").alias("o"))
    n = F.row_number().over(W.partitionBy("query_id").orderBy("o", "vec_id"))
    via = F.element_at(F.array(F.lit("base"), F.lit("link"), F.lit("vector")), F.col("o.kind") + 1)
    return one.withColumn("n", n).filter(F.col("n") <= top + top * each + 10).select("query_id", "vec_id", via.alias("via"))


def overlap(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, score): how many distinct words of a question (item_id, word) a document (doc_id, word) holds."""
    return docs.join(questions, "word").groupBy("item_id", "doc_id").agg(F.count("*").alias("score"))


_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: length(x) > 4))"


@query(
    "rerank_two_pass",
    f"""WITH qw AS (SELECT item_id, {_WORDS.format("text")} AS qw FROM benchmark), dw AS (SELECT doc_id, source, {_WORDS.format("text")} AS dw, lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS nxt FROM documents),
    sc AS (SELECT item_id, doc_id, nxt, len(list_intersect(qw, dw))::BIGINT AS score FROM qw, dw),
    one AS (SELECT * FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 5),
    ex AS (SELECT item_id, doc_id FROM one UNION SELECT item_id, nxt FROM one WHERE nxt IS NOT NULL)
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ex JOIN sc USING (item_id, doc_id) QUALIFY rank <= 5""",
)
def rerank_two_pass(spark: SparkSession, d: str) -> DataFrame:
    """The five best documents by shared words, then these and the next of their source ranked again.

    Documents meet questions by their words only; counts are combined before they are sent. A document without any
    word of the question scores zero in the second pass.
    """
    distinct = lambda t: F.explode(F.array_distinct(F.filter(tokens(t), lambda x: F.char_length(x) > 4))).alias("word")
    docs = read(spark, d, "documents")
    shared = overlap(read(spark, d, "benchmark").select("item_id", distinct(F.col("text"))), docs.select("doc_id", distinct(F.col("text"))))
    best = lambda df: df.withColumn("rank", F.row_number().over(W.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id"))).filter("rank <= 5")
    follows = docs.select("doc_id", F.lead("doc_id").over(W.partitionBy("source").orderBy("doc_id")).alias("next"))
    first = best(shared).join(follows, "doc_id")
    wide = first.select("item_id", F.explode(F.array_compact(F.array("doc_id", "next"))).alias("doc_id")).distinct()
    return best(wide.join(shared, ["item_id", "doc_id"], "left").select("item_id", "doc_id", F.coalesce("score", F.lit(0)).alias("score")))


_FLAT = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'))"


@query(
    "attribution",
    rf"""WITH his AS (SELECT source, doc_id, lang, {_FLAT.format("text")} AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS n FROM documents QUALIFY n <= 21),
    sni AS (SELECT source, n AS asked, substring(t, 1, 80) AS s FROM his WHERE n IN (1, 5, 12, 13, 20) AND length(t) > 0),
    hit AS (SELECT s.source, asked, min(h.n) AS n FROM sni s JOIN his h ON h.source = s.source AND h.n <= 12 AND contains(h.t, s.s) GROUP BY ALL)
    SELECT s.source, s.asked, hit.n IS NOT NULL AS found, h.doc_id AS revid, h.lang AS author, CASE WHEN hit.n IS NOT NULL THEN NOT coalesce(contains(p.t, s.s), FALSE) END AS original,
      coalesce(hit.n, (SELECT count(*) FROM his x WHERE x.source = s.source AND x.n <= 12)) AS checks
    FROM sni s LEFT JOIN hit ON hit.source = s.source AND hit.asked = s.asked LEFT JOIN his h ON h.source = s.source AND h.n = hit.n LEFT JOIN his p ON p.source = s.source AND p.n = hit.n + 1""",
)
def attribution(spark: SparkSession, d: str, max_checks: int = 12) -> DataFrame:
    """For snippets of each title the newest of its last revisions that holds them, who wrote it, and whether the
    revision before lacks them. Here a title is a source, a revision a document, and a snippet the first 80 characters
    of some of the newest. Snippets meet their own title's last revisions only: a bounded number for each."""
    n = F.row_number().over(W.partitionBy("source").orderBy(F.col("doc_id").desc()))
    flat = F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " "))
    last = read(spark, d, "documents").select("source", "doc_id", "lang", "text", n.alias("n")).filter(F.col("n") <= 21).select("source", "doc_id", "lang", "n", flat.alias("t"))
    asked = last.filter(F.col("n").isin(1, 5, 12, 13, 20) & (F.col("t") != "")).select("source", F.col("n").alias("asked"), F.substring("t", 1, 80).alias("s"))
    before = F.lead("t").over(W.partitionBy("source").orderBy("n"))
    history = last.withColumn("p", before).filter(F.col("n") <= max_checks)
    j = asked.join(history, "source")
    held = F.contains("t", F.col("s"))
    hit = F.struct("n", "doc_id", "lang", (~F.coalesce(F.contains("p", F.col("s")), F.lit(False))).alias("original"))
    g = j.groupBy("source", "asked").agg(F.min(F.when(held, hit)).alias("h"), F.count("*").alias("all"))
    return g.select("source", "asked", F.col("h").isNotNull().alias("found"), F.col("h.doc_id").alias("revid"), F.col("h.lang").alias("author"), "h.original", F.coalesce("h.n", "all").cast("long").alias("checks"))
