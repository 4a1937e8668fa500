"""Quality rules with adaptive thresholds.

Every document gets a few integer measures. For each language and source a mergeable quantile
sketch of every measure is kept: a histogram over logarithmic buckets (relative error 2 %), whose
merge is the addition of counts, so that Spark combines it map-side and any grouping of the rows
gives the same sketch. Fences read off the sketches replace fixed cut-offs, and one join of the
documents with the fences decides. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import WORD, read, stage, words

#: Rules: measure, slack added above (or below) the fence. All measures are whole numbers.
#: sym: symbols per 1000 words; rep: words in repeated windows per 1000 words; dup: repeated
#: lines per 1000 lines; length: characters per 100 words.
HIGH = {"sym": 50, "rep": 150, "dup": 250, "length": 150}
LOW = {"length": 100}
#: A fence lies so many interquartile ranges beyond the quartile.
REACH = 3
#: The quartiles of a language and source are drawn to those of the language, as by so many documents of it.
PRIOR = 100
GAMMA = 1.02


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs as struct `rec`, with the measures beside it.

    Null text counts as no words. Columns of docs may have any names, as they stay inside `rec`.
    """
    t = F.coalesce(F.col(f"rec.{text}"), F.lit(""))
    d = docs.select(F.struct("*").alias("rec")).select("rec", words(t).alias("w"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("rec", "w", lines.alias("lines"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    # three-word windows, each with its place; equal ones stand side by side after sorting
    windows = F.when(
        F.size("w") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
    )
    d = d.select(
        "rec", "n_symbols", windows.alias("g"),
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    plain = ["rec", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    again = F.size(F.array_distinct("g")) < F.size("g")
    d = d.select(*plain, F.when(again, F.array_sort(F.transform("g", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))).alias("s"))
    same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
    twice = F.filter("s", lambda x, i: F.when(i > 0, same(x, F.get("s", i - 1))).otherwise(False) | same(x, F.get("s", i + 1)))
    d = d.select(*plain, F.sort_array(F.transform(twice, lambda x: x["i"])).alias("p"))
    covered = F.transform("p", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("p", i + 1) - x, F.lit(3))))
    d = d.select(*plain, F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def _measures() -> dict[str, Column]:
    per = lambda x, k, n: F.when(F.col(n) > 0, F.floor(F.col(x) * k / F.col(n))).otherwise(0).cast("long")
    return {"sym": per("n_symbols", 1000, "n_words"), "rep": per("n_repeat_words", 1000, "n_words"), "dup": per("n_dup_lines", 1000, "n_lines"), "length": per("word_chars", 100, "n_words")}


def sketches(measured: DataFrame, lang: Column, source: Column) -> DataFrame:
    """(lang, source, rule, bucket, n): the sketch of each rule. Rows that failed the base rules take no part."""
    x = _measures()
    rows = measured.filter(~F.col("base_failed")).select(lang.alias("lang"), source.alias("source"), *(v.alias(k) for k, v in x.items()))
    each = rows.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("x")) for k in x))).alias("m"))
    bucket = F.when(F.col("m.x") > 0, 1 + F.floor(F.log(F.col("m.x").cast("double")) / F.log(F.lit(GAMMA)))).otherwise(0)
    return each.groupBy("lang", "source", F.col("m.rule").alias("rule"), bucket.cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """First and third quartile by the upper edge of the bucket that holds them."""
    by = W.partitionBy(*keys, "rule")
    upto = F.sum("n").over(by.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    edge = F.when(F.col("bucket") > 0, F.pow(F.lit(GAMMA), F.col("bucket").cast("double"))).otherwise(0.0)
    c = sketch.withColumn("upto", upto).withColumn("total", F.sum("n").over(by)).withColumn("edge", edge)
    q = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("edge")))
    return c.groupBy(*keys, "rule").agg(q(1).alias("q1"), q(3).alias("q3"), F.max("total").alias("docs"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per language and source: the upper (hi_*) and lower (lo_*) fence of each rule.

    One rule for groups of all sizes: the mean of the group's quartile and that of its language, by the group's
    documents and PRIOR.
    """
    own = _quartiles(sketch, ["lang", "source"])
    merged = sketch.groupBy("lang", "rule", "bucket").agg(F.sum("n").alias("n"))
    wide = _quartiles(merged, ["lang"]).select(F.col("lang").alias("l2"), F.col("rule").alias("r2"), F.col("q1").alias("w1"), F.col("q3").alias("w3"))
    j = own.join(wide, F.col("lang").eqNullSafe(F.col("l2")) & (F.col("rule") == F.col("r2")))
    drawn = lambda a, b: (F.col("docs") * F.col(a) + PRIOR * F.col(b)) / (F.col("docs") + PRIOR)
    j = j.select("lang", "source", "rule", drawn("q1", "w1").alias("q1"), drawn("q3", "w3").alias("q3"))
    at = lambda rule, e: F.max(F.when(F.col("rule") == rule, e))
    spread = REACH * (F.col("q3") - F.col("q1"))
    return j.groupBy("lang", "source").agg(
        *(at(k, F.col("q3") + spread + s).alias(f"hi_{k}") for k, s in HIGH.items()),
        *(at(k, F.col("q1") - spread - s).alias(f"lo_{k}") for k, s in LOW.items()),
    )


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep_text: bool = True) -> DataFrame:
    """docs as struct `rec`, the measures, base_failed and kept.

    Null language or source is a group of its own. An empty table gives an empty result. Equal rows
    get equal verdicts; a measure that lies on a fence is kept. Texts may be of any length. Columns of docs may
    have any names, as they stay inside `rec`. The measured rows are written once and read twice (sketch and join).
    """
    m = measure(docs, text)
    if not keep_text:
        m = m.withColumn("rec", F.col("rec").dropFields(text))
    m = stage(m, "quality")
    f = fences(sketches(m, F.col(f"rec.{lang}"), F.col(f"rec.{source}"))).select(F.col("lang").alias("f_lang"), F.col("source").alias("f_source"), *(f"hi_{k}" for k in HIGH), *(f"lo_{k}" for k in LOW))
    j = m.join(f, F.col(f"rec.{lang}").eqNullSafe(F.col("f_lang")) & F.col(f"rec.{source}").eqNullSafe(F.col("f_source")), "left")
    x = _measures()
    inside = F.lit(True)
    for k in HIGH:
        inside &= x[k] <= F.col(f"hi_{k}")
    for k in LOW:
        inside &= x[k] >= F.col(f"lo_{k}")
    return j.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("f_lang", "f_source")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = judge(docs, keep_text=False)
    return out.select("rec.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_HI = " AND ".join(f"x_{k} <= hi_{k}" for k in HIGH)
_LO = " AND ".join(f"x_{k} >= lo_{k}" for k in LOW)
_RULES = ["sym", "rep", "dup", "length"]


def _sql_quartiles(table: str, keys: str) -> str:
    return f"""
    SELECT {keys}, rule, min(CASE WHEN 4 * upto >= total THEN edge END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN edge END) AS q3, max(total) AS docs
    FROM (SELECT *, sum(n) OVER (PARTITION BY {keys}, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {keys}, rule) AS total,
                 CASE WHEN bucket > 0 THEN pow({GAMMA}, bucket) ELSE 0 END AS edge FROM {table}) GROUP BY {keys}, rule"""


_AT = ", ".join(
    [f"max(CASE WHEN rule = '{k}' THEN q3 + {REACH} * (q3 - q1) + {s} END) AS hi_{k}" for k, s in HIGH.items()]
    + [f"max(CASE WHEN rule = '{k}' THEN q1 - {REACH} * (q3 - q1) - {s} END) AS lo_{k}" for k, s in LOW.items()]
)

#: Relations from `source_docs` (doc_id, text, lang, source) to `judged`; rn tells repeated rows apart.
JUDGED_SQL = rf"""
src AS (SELECT *, row_number() OVER () AS rn FROM source_docs),
tok AS (SELECT *, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM src),
win AS (SELECT rn, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rn, w, unnest(range(1, len(w) - 1)) AS i FROM tok WHERE len(w) >= 3)),
dup AS (SELECT rn, i FROM (SELECT *, count(*) OVER (PARTITION BY rn, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rn, sum(least(3, coalesce(nxt - i, 3))) AS n FROM (SELECT rn, i, lead(i) OVER (PARTITION BY rn ORDER BY i) AS nxt FROM dup) GROUP BY rn),
mea AS (SELECT t.*, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM tok t LEFT JOIN rep r USING (rn)),
bas AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS x_sym, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS x_rep,
    CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS x_dup, CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS x_length FROM mea),
ske AS (SELECT lang, source, rule, CASE WHEN x > 0 THEN 1 + floor(ln(x::DOUBLE) / ln({GAMMA})) ELSE 0 END AS bucket, count(*) AS n
    FROM ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, x_{k} AS x FROM bas WHERE NOT base_failed" for k in _RULES)}) GROUP BY ALL),
skl AS (SELECT lang, rule, bucket, sum(n) AS n FROM ske GROUP BY ALL),
own AS ({_sql_quartiles("ske", "lang, source")}),
wid AS ({_sql_quartiles("skl", "lang")}),
pic AS (SELECT o.lang, o.source, o.rule, (o.docs * o.q1 + {PRIOR} * w.q1) / (o.docs + {PRIOR}) AS q1, (o.docs * o.q3 + {PRIOR} * w.q3) / (o.docs + {PRIOR}) AS q3
    FROM own o JOIN wid w ON o.lang IS NOT DISTINCT FROM w.lang AND o.rule = w.rule),
fen AS (SELECT lang, source, {_AT} FROM pic GROUP BY lang, source),
judged AS (SELECT b.*, NOT base_failed AND coalesce({_HI} AND {_LO}, TRUE) AS kept FROM bas b LEFT JOIN fen f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source)"""

OP10_SQL = f"""WITH source_docs AS (SELECT doc_id, text, lang, source FROM documents), {JUDGED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""
