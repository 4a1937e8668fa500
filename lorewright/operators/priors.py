"""Ranking by rules: what a page's form, title and text say about a question, added to its score step by step and kept
within -1 and 1, and what is then left out of an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import base_title
from ..registry import query, read
from .changes import PASSING_ASKED, PASSING_TEXT, PASSING_TITLE, passing
from .intents import INTENTS
from .retrieval import _E, _topk_sql, corpus, cosine_topk, few_queries

_NAMESPACES = ["guide:", "user:", "talk:", "blog:"]
# In order, where a rule looks, the words it looks for, the intents it is for (none: all), and what it adds
# if it finds one of the words and the question has one of the intents, has none of them, and if it has but finds none.
RULES = [
    ("variant", [], [], -0.06, 0.0, 0.0),
    ("short", [], [], -0.08, 0.0, 0.0),
    ("long", [], [], 0.02, 0.0, 0.0),
    ("headings", [], [], 0.03, 0.0, 0.0),
    ("start", _NAMESPACES, [], -0.12, 0.0, 0.0),
    ("title", ["money making guide/"], ["economy"], 0.08, -0.10, 0.0),
    ("title", ["/strateg"], ["strategy", "damage_modality"], 0.05, -0.03, 0.0),
    ("title", ["/drops", "/drop rates", "/drop table"], ["drops"], 0.07, -0.02, 0.0),
    ("title", ["/location"], ["location"], 0.06, 0.0, 0.0),
    ("title", ["/bestiary", "/stats", "/combat info"], ["stats"], 0.06, 0.0, 0.0),
    ("text", ["requirement", "level req", "completion"], ["requirements"], 0.06, 0.0, -0.03),
    ("text", ["drop table", "drops", "unique", "rare drop", "loot"], ["drops"], 0.05, 0.0, 0.0),
    ("text", ["located in", "located at", "found in", "near ", "north of", "south of", "east of", "west of", "island", "dungeon", "cave"], ["location"], 0.05, 0.0, 0.0),
    ("text", ["hitpoints", "hp", "max hit", "combat level", "attack speed", "defence level", "defense level", "accuracy"], ["stats"], 0.05, 0.0, 0.0),
    ("text", ["mechanics", "strategy", "phase", "attack cycle", "avoid", "dodge", "safe spot"], ["strategy"], 0.04, 0.0, 0.0),
    ("text", ["price", "grand exchange", "market", "value"], ["economy"], 0.05, 0.0, 0.0),
]
# Marks of pages that answer nothing, in titles and in categories.
EMPTY_TITLES, EMPTY_CATEGORIES = ["disambiguation", "(interface item"], ["disambiguation", "interface item"]
#: Characters of a short and of a long page, and headings of one that has many.
SHORT, LONG, HEADINGS = 400, 3000, 3


def steps(q: Column, title: Column, text: Column, variants: Column) -> Column:
    """What each rule adds, in order. variants: how many pages have the title's base title."""
    t, x = F.lower(title), F.lower(text)
    found = {
        "variant": (variants > 1) & (title != base_title(title)), "short": F.char_length(text) < SHORT, "long": F.char_length(text) > LONG,
        "headings": F.regexp_count(text, F.lit(r"(?m)^[ \t]*=")) >= HEADINGS,
    }
    test = {"start": lambda w: F.startswith(t, F.lit(w)), "title": lambda w: F.contains(t, F.lit(w)), "text": lambda w: F.contains(x, F.lit(w))}
    either = lambda cs: F.exists(F.array(*cs), lambda c: c)
    out = []
    for place, words, intents, asked, other, missing in RULES:
        hit = found[place] if place in found else either([test[place](w) for w in words])
        wants = either([F.lower(q).rlike(INTENTS[i]) for i in intents]) if intents else F.lit(True)
        out.append(F.when(hit & wants, asked).when(hit, other).when(wants, missing).otherwise(0.0))
    return F.array(*out)


def with_priors(score: Column, added: Column) -> Column:
    """The score with each step added in turn, kept within -1 and 1 after each."""
    return F.aggregate(added, score, lambda x, d: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x + d)))


def answers_nothing(title: Column, categories: Column) -> Column:
    """Pages that only tell titles apart, or stand for a part of an interface."""
    either = lambda c, ws: F.exists(F.array(*(F.contains(c, F.lit(w)) for w in ws)), lambda b: b)
    return either(F.lower(title), EMPTY_TITLES) | F.exists(categories, lambda c: either(F.lower(c), EMPTY_CATEGORIES))


def ranked_pages(found: DataFrame, pages: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, vec_id, title, score, rank): found (query_id, vec_id, score, q) with the pages (vec_id, title, text,
    categories) ranked by rules, without passing pages that are not asked for and those that answer nothing, one for
    each base title, the best `most` of a question."""
    # how many pages have a base title: only those of pages found are asked for
    bases = pages.select(base_title(F.col("title")).alias("base"))
    j = found.join(pages, "vec_id").withColumn("base", base_title(F.col("title")))
    counts = bases.join(j.select("base").distinct(), "base", "left_semi").groupBy("base").agg(F.count("*").alias("variants"))
    j = j.join(counts, "base", "left").withColumn("score", F.round(with_priors(F.col("score"), steps(F.col("q"), F.col("title"), F.col("text"), F.col("variants"))), 9))
    shown = ~passing(F.col("title"), F.col("text")) | F.lower("q").rlike(PASSING_ASKED)
    j = j.filter(shown & ~answers_nothing(F.col("title"), F.col("categories")))
    best = j.groupBy("query_id", "base").agg(F.min(F.struct((-F.col("score")).alias("minus"), "vec_id", "title")).alias("b"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("b.minus", "b.vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most).select("query_id", "b.vec_id", "b.title", (-F.col("b.minus")).alias("score"), "rank")


#: Pages made of vectors and documents: titles and texts that the rules know, read alike by both engines.
_TITLE = """CASE WHEN vec_id % 11 = 3 THEN 'Guide:' WHEN vec_id % 13 = 5 THEN 'Money making guide/' ELSE '' END || 'Row ' || CAST(floor(vec_id / 4) AS BIGINT) ||
    CASE vec_id % 12 WHEN 1 THEN '/Strategies' WHEN 2 THEN '/Drops' WHEN 3 THEN '/Locations' WHEN 4 THEN '/Stats' WHEN 5 THEN ' (interface item)' WHEN 6 THEN ' (disambiguation)' WHEN 7 THEN ' (small)' ELSE '' END"""
_TEXT = """coalesce(text, '') || CASE vec_id % 6 WHEN 0 THEN ' Requirements: none' WHEN 1 THEN ' Drop table' WHEN 2 THEN ' located in a CAVE' WHEN 3 THEN ' max hit' WHEN 4 THEN ' avoid it' ELSE ' market' END ||
    CASE WHEN vec_id % 7 = 0 THEN repeat(chr(10) || ' == H', 3) ELSE '' END"""
_CATEGORY = "CASE WHEN vec_id % 17 = 0 THEN 'Interface items' ELSE 'Rows' END"
_Q = "CASE CAST(query_id / 100 AS BIGINT) % 6 WHEN 0 THEN 'What are the Requirements' WHEN 1 THEN 'Which drops' WHEN 2 THEN 'Where is it located' WHEN 3 THEN 'max hit' WHEN 4 THEN 'how to avoid it' ELSE 'market price' END"


def pages_of(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    e = read(spark, d, "embeddings").select("vec_id").join(docs, "vec_id", "left")
    return e.select("vec_id", F.expr(_TITLE).alias("title"), F.expr(_TEXT).alias("text"), F.array(F.expr(_CATEGORY)).alias("categories"))


def found_by(spark: SparkSession, d: str, k: int, with_rank: bool = False) -> DataFrame:
    rows = corpus(spark, d)
    return cosine_topk(few_queries(rows), rows, k).select("query_id", "vec_id", "score", *(["rank"] if with_rank else []), F.expr(_Q).alias("q"))


def _step_sql(k: int) -> str:
    place, words, intents, asked, other, missing = RULES[k]
    found = {"variant": "variants > 1 AND title <> base", "short": f"length(text) < {SHORT}", "long": f"length(text) > {LONG}", "headings": f"len(regexp_extract_all(text, '(?m)^[ \\t]*=')) >= {HEADINGS}"}
    on = {"start": "starts_with(lower(title), '{}')", "title": "contains(lower(title), '{}')", "text": "contains(lower(text), '{}')"}
    hit = found.get(place) or " OR ".join(on[place].format(w) for w in words)
    wants = " OR ".join(f"regexp_matches(lower(q), '{INTENTS[i]}')" for i in intents) or "TRUE"
    return f"s{k + 1} AS (SELECT * REPLACE (greatest(-1, least(1, score + CASE WHEN ({hit}) AND ({wants}) THEN {asked} WHEN {hit} THEN {other} WHEN {wants} THEN {missing} ELSE 0 END::DOUBLE)) AS score) FROM s{k})"


_BASE = r"trim(split_part(regexp_replace(title, ' *\([^)]*\)', '', 'g'), '/', 1))"
_EMPTY = " OR ".join([*(f"contains(lower(title), '{w}')" for w in EMPTY_TITLES), *(f"contains(lower(category), '{w}')" for w in EMPTY_CATEGORIES)])
_PAGES = f"pag AS (SELECT vec_id, {_TITLE} AS title, {_TEXT} AS text, {_CATEGORY} AS category FROM embeddings LEFT JOIN (SELECT doc_id AS vec_id, text FROM documents) USING (vec_id))"
_FOUND = f"{_E}, {_PAGES}, bas AS (SELECT {_BASE} AS base, count(*) AS variants FROM pag GROUP BY 1), fou AS (SELECT query_id, vec_id, score, {_Q} AS q, title, text, category, {_BASE} AS base FROM ({_topk_sql(30)}) JOIN pag USING (vec_id))"


@query(
    "answer_rank",
    f"""WITH {_FOUND}, s0 AS (SELECT * FROM fou JOIN bas USING (base)), {", ".join(_step_sql(k) for k in range(len(RULES)))},
    o AS (SELECT * REPLACE (round(score, 9) AS score) FROM s{len(RULES)} WHERE NOT ({_EMPTY}) AND (regexp_matches(lower(q), '{PASSING_ASKED}') OR NOT (regexp_matches(lower(title), '{PASSING_TITLE}') OR regexp_matches(lower(substring(text, 1, 500)), '{PASSING_TEXT}')))),
    u AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, base ORDER BY score DESC, vec_id) = 1)
    SELECT query_id, vec_id, title, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM u QUALIFY rank <= 10""",
)
def answer_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranked_pages(found_by(spark, d, 30), pages_of(spark, d))


@query("ranking_drop", f"WITH {_FOUND} SELECT query_id, vec_id, title FROM fou WHERE {_EMPTY}")
def ranking_drop(spark: SparkSession, d: str) -> DataFrame:
    """What is found and yet left out, as it answers nothing."""
    j = found_by(spark, d, 30).join(pages_of(spark, d), "vec_id")
    return j.filter(answers_nothing(F.col("title"), F.col("categories"))).select("query_id", "vec_id", "title")
