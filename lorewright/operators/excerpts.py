"""Excerpts and contexts for questions: windows of the texts that a search has found, scored by where the terms stand."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from .intents import EVIDENCE, GUARDED, INTENTS, in_sql, tags
from .models import _TERMS, terms
from .priors import _FOUND, found_by, pages_of

#: Characters of a window, from one to the next, and the fewest that one may have; what a pattern of an intent adds.
WINDOW, STRIDE, LEAST, BONUS = 500, 300, 50, 0.3


def window_starts(n: int) -> list[int]:
    """Where the windows of a text of n characters begin: up to the one that reaches its end."""
    out = []
    for s in range(0, n, STRIDE):
        if min(n, s + WINDOW) - s < LEAST:
            break
        out.append(s)
        if s + WINDOW >= n:
            break
    return out


def window_scores(text: str, q: str, patterns: list[regex.Pattern]) -> np.ndarray:
    """How many terms of the question each window holds, and BONUS for each pattern.

    A term's places are found once; each falls into the few windows that hold it whole, so the windows are never
    searched for terms one by one.
    """
    n = len(window_starts(len(text)))
    score = np.zeros(n)
    for t in terms(q):
        held = np.zeros(n, bool)
        at = text.find(t)
        while at >= 0:
            first = max(0, -(-(at + len(t) - WINDOW) // STRIDE))
            held[first : at // STRIDE + 1] = True
            # on to the first place that may fall into a further window
            at = text.find(t, at + 1)
        score += held
    for p in patterns:
        score += BONUS * np.array([bool(p.search(text[s : s + WINDOW])) for s in window_starts(len(text))], float)
    return score


def excerpts(pairs: DataFrame, per_doc: int = 2) -> DataFrame:
    """(query_id, vec_id, start, end, score, snippet): the best windows of each pair (query_id, vec_id, q, text)."""
    t = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    rows = pairs.select("query_id", "vec_id", "q", t.alias("text"), tags(F.col("q")).alias("intents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {k: regex.compile(v) for k, v in EVIDENCE.items()}
        for b in batches:
            out = []
            for row in b.to_pylist():
                # letter by letter, so that places in both are the same
                low = "".join(c.lower() if len(c.lower()) == 1 else c for c in row["text"])
                starts = window_starts(len(low))
                score = np.round(window_scores(low, row["q"], [compiled[i] for i in row["intents"]]), 9)
                for k in np.lexsort((starts, -score))[:per_doc] if starts else []:
                    s = starts[k]
                    out.append((row["query_id"], row["vec_id"], s, min(len(low), s + WINDOW), float(score[k]), row["text"][s : s + WINDOW]))
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["query_id", "vec_id", "start", "end", "score", "snippet"])

    return rows.mapInArrow(run, "query_id long, vec_id long, start long, end long, score double, snippet string")


def contexts(hits: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, context, sources, size): the texts of a question's first hits (query_id, rank, title, text), each under its
    number and title. At most `most` texts of a question meet."""
    h = hits.filter(F.col("rank") <= most).select("query_id", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "title", F.lit(":\n"), "text").alias("part"), (F.char_length("text") + F.char_length("title") + 20).alias("size"))
    g = h.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "part"))).alias("all"), F.count("*").alias("sources"), F.sum("size").alias("size"))
    return g.select("query_id", F.array_join(F.transform("all", lambda x: x["part"]), "\n\n").alias("context"), "sources", "size")


_THREE = "thr AS (SELECT query_id, vec_id, q, title, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM fou QUALIFY rank <= 3)"
_BONUS = " + ".join(f"CASE WHEN regexp_matches(lower(q), '{in_sql(INTENTS[k])}') AND regexp_matches(lower(snippet), '{v}') THEN {BONUS} ELSE 0 END" for k, v in EVIDENCE.items())


_BEST = f"""{_FOUND}, {_THREE}, w AS (SELECT *, unnest(range(0, length(text), {STRIDE})) AS start FROM thr), x AS (SELECT *, substring(text, start + 1, {WINDOW}) AS snippet FROM w WHERE (start = 0 OR start + {WINDOW - STRIDE} < length(text)) AND length(text) - start >= {LEAST}),
    bes AS (SELECT query_id, vec_id, q, start, least(length(text), start + {WINDOW})::BIGINT AS "end", round(len(list_filter({_TERMS}, lambda w: contains(lower(snippet), w))) + {_BONUS}, 9)::DOUBLE AS score, snippet FROM x QUALIFY row_number() OVER (PARTITION BY query_id, vec_id ORDER BY score DESC, start) <= 2)"""


@query("excerpts_of_hits", f'WITH {_BEST} SELECT query_id, vec_id, start, "end", score, snippet FROM bes')
def excerpts_of_hits(spark: SparkSession, d: str) -> DataFrame:
    """The two best windows of the three best pages of each question."""
    pairs = found_by(spark, d, 3).join(pages_of(spark, d), "vec_id")
    return excerpts(pairs.select("query_id", "vec_id", "q", "text"))


def guarded(questions: DataFrame, context: DataFrame) -> DataFrame:
    """(query_id, intent, refused): for each guarded intent of a question (query_id, q) whether nothing in its context
    (query_id, snippet) is evidence for it. Snippets are told by a flag for each intent before they are combined."""
    held = context.groupBy("query_id").agg(*(F.bool_or(F.lower("snippet").rlike(EVIDENCE[k])).alias(k) for k in GUARDED))
    j = questions.join(held, "query_id", "left")
    verdict = F.array(*(F.when(F.lower("q").rlike(INTENTS[k]), F.struct(F.lit(k).alias("intent"), (~F.coalesce(F.col(k), F.lit(False))).alias("refused"))) for k in GUARDED))
    return j.select("query_id", F.explode(F.array_compact(verdict)).alias("v")).select("query_id", "v.*")


@query("evidence_guard_hits", f"WITH {_BEST}, que AS (SELECT DISTINCT query_id, q FROM fou) " + " UNION ALL ".join(f"SELECT query_id, '{k}' AS intent, NOT coalesce((SELECT bool_or(regexp_matches(lower(snippet), '{EVIDENCE[k]}')) FROM bes WHERE bes.query_id = que.query_id), FALSE) AS refused FROM que WHERE regexp_matches(lower(q), '{INTENTS[k]}')" for k in GUARDED))
def evidence_guard_hits(spark: SparkSession, d: str) -> DataFrame:
    """Questions refused where the excerpts of what a search has found hold no evidence."""
    found = found_by(spark, d, 3)
    return guarded(found.select("query_id", "q").distinct(), excerpts_of_hits(spark, d))


@query(
    "context_of_hits",
    f"""WITH {_FOUND}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM fou QUALIFY rank <= 8)
    SELECT query_id, string_agg('[' || rank || '] ' || title || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS sources, sum(length(text) + length(title) + 20)::BIGINT AS size FROM r GROUP BY query_id""",
)
def context_of_hits(spark: SparkSession, d: str) -> DataFrame:
    """What a question's eight best pages say, as one text."""
    found = found_by(spark, d, 8, with_rank=True)
    return contexts(found.join(pages_of(spark, d), "vec_id").select("query_id", "rank", "title", "text"))
