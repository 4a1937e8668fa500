"""Models as plug-ins: a function that is loaded once in each worker and fed Arrow batches; what it fails on is counted.

A model is a name, a version and `load`, which returns the function when a worker first needs it: for embedding from
texts to vectors, for scoring from questions and texts to numbers. Rows that it can't take come back as failed and
do not stop the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..registry import query, read
from .priors import _FOUND, found_by, pages_of
from .retrieval import corpus, cosine_topk

_LOADED: dict[tuple[str, str], Callable[..., Any]] = {}


@dataclass(frozen=True)
class Model:
    name: str
    version: str
    load: Callable[[], Callable[..., Any]]

    def function(self) -> Callable[..., Any]:
        """The loaded function; one for each worker process."""
        key = (self.name, self.version)
        if key not in _LOADED:
            _LOADED[key] = self.load()
        return _LOADED[key]


def _each(function: Callable[..., Any], columns: list[list]) -> list:
    """function over a batch; if it fails, or gives another number of rows, over one row at a time: null where it fails."""
    try:
        out = list(function(*columns))
        if len(out) == len(columns[0]):
            return out
    except Exception:  # noqa: BLE001
        pass
    out = []
    for row in zip(*columns, strict=True):
        try:
            out.append(list(function(*([x] for x in row)))[0])
        except Exception:  # noqa: BLE001
            out.append(None)
    return out


def embedded(pages: DataFrame, text: str, model: Model, seen: Observation | None = None, batch: int = 256) -> DataFrame:
    """pages with embedding (array<double>, null if the model failed), failed, model, version and text_length.

    seen gets the numbers of rows, of failed ones and of characters when the result is written.
    """
    schema = StructType(pages.schema.fields[:]).add("embedding", ArrayType(DoubleType())).add("failed", "boolean")
    at = pages.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = model.function()
        for whole in batches:
            for b in (whole.slice(k, batch) for k in range(0, whole.num_rows, batch)):
                got = _each(function, [b.column(at).to_pylist()])
                vectors = [None if v is None else [float(x) for x in v] for v in got]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float64())), pa.array([v is None for v in vectors])], names=schema.names)

    out = pages.mapInArrow(run, schema)
    out = out.withColumns({"model": F.lit(model.name), "version": F.lit(model.version), "text_length": F.coalesce(F.char_length(text), F.lit(0))})
    if seen is None:
        return out
    return out.observe(seen, F.count("*").alias("rows"), F.count_if("failed").alias("failed"), F.sum("text_length").alias("characters"))


def scored(pairs: DataFrame, model: Model | None, question: str = "q", text: str = "pair", batch: int = 256) -> DataFrame:
    """pairs with score and failed: 0.0 where the model fails, and everywhere without a model."""
    if model is None:
        return pairs.withColumns({"score": F.lit(0.0), "failed": F.lit(False)})
    schema = StructType(pairs.schema.fields[:]).add("score", "double").add("failed", "boolean")
    q, t = pairs.columns.index(question), pairs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = model.function()
        for whole in batches:
            for b in (whole.slice(k, batch) for k in range(0, whole.num_rows, batch)):
                got = _each(function, [b.column(q).to_pylist(), b.column(t).to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([0.0 if s is None else float(s) for s in got]), pa.array([s is None for s in got])], names=schema.names)

    return pairs.mapInArrow(run, schema)


def hashing(dim: int = 16) -> Model:
    """The default for embedding: every token adds +1 or -1 to a slot, by its md5."""

    def load() -> Callable[[list[str]], list[np.ndarray]]:
        known: dict[str, tuple[int, int]] = {}

        def slot(token: str) -> tuple[int, int]:
            if token not in known:
                if len(known) > 100_000:
                    known.clear()
                h = hashlib.md5(token.encode()).hexdigest()
                known[token] = int(h[0], 16) % dim, 1 if h[1] < "8" else -1
            return known[token]

        def run(texts: list[str]) -> list[np.ndarray]:
            out = []
            for t in texts:
                v = np.zeros(dim)
                for token in re.findall("[a-z0-9]+", t.lower()):
                    k, x = slot(token)
                    v[k] += x
                out.append(v)
            return out

        return run

    return Model("md5-hashing", str(dim), load)


def terms(q: str) -> set[str]:
    return {t.lower() for t in q.split() if len(t) > 2}


def overlap() -> Model:
    """The default for scoring: how many terms of the question the text holds."""
    return Model("term-overlap", "1", lambda: lambda qs, ts: [float(sum(w in t.lower() for w in terms(q))) for q, t in zip(qs, ts, strict=True)])


def best(pairs: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def reranked(found: DataFrame, pages: DataFrame, rows: DataFrame, model: Model | None, k: int = 10, top: int = 3, each: int = 3) -> DataFrame:
    """(query_id, vec_id, score, rank, failed): found (query_id, vec_id, q) scored by the model, the best `top` joined by
    their nearest rows, and all of these scored again. pages: (vec_id, title, text), of which 4000 characters count."""
    pair = F.concat("title", F.lit("\n\n"), F.substring(F.coalesce("text", F.lit("")), 1, 4000))
    score = lambda df: scored(df.join(pages, "vec_id").select("query_id", "vec_id", "q", pair.alias("pair")), model)
    first = best(score(found.select("query_id", "vec_id", "q")), top).select("query_id", "vec_id", "q")
    asked = rows.join(first.select("vec_id").distinct(), "vec_id").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    near = cosine_topk(asked, rows, each, exclude_self=True).select(F.col("query_id").alias("of"), "vec_id")
    more = first.select("query_id", "q", F.col("vec_id").alias("of")).join(near, "of").select("query_id", "vec_id", "q")
    both = found.select("query_id", "vec_id", "q").unionByName(more).distinct()
    return best(score(both), k).select("query_id", "vec_id", "score", "rank", "failed")


_SLOTS = "slots AS (SELECT doc_id, unnest(range(16)) AS k FROM documents), toks AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM documents), val AS (SELECT doc_id, strpos('0123456789abcdef', substring(md5(t), 1, 1)) - 1 AS k, sum(CASE WHEN substring(md5(t), 2, 1) < '8' THEN 1 ELSE -1 END) AS x FROM toks GROUP BY ALL)"


@query("model_embed", f"WITH {_SLOTS}, vec AS (SELECT doc_id, list(coalesce(x, 0)::DOUBLE ORDER BY k) AS v FROM slots LEFT JOIN val USING (doc_id, k) GROUP BY doc_id) SELECT doc_id, CASE WHEN doc_id % 50 > 0 THEN v END AS embedding, doc_id % 50 = 0 AS failed, 'md5-hashing' AS model, '16' AS version, CASE WHEN doc_id % 50 > 0 THEN length(text) ELSE 0 END::INT AS text_length FROM documents JOIN vec USING (doc_id)")
def model_embed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all documents by the default model; those without a text (here: every fiftieth) fail."""
    docs = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 > 0, F.col("text")).alias("text"))
    return embedded(docs, "text", hashing()).drop("text")


@query("model_report", "SELECT 'md5-hashing' AS model, count(*) AS rows, count(*) FILTER (doc_id % 50 = 0) AS failed, sum(CASE WHEN doc_id % 50 > 0 THEN length(text) ELSE 0 END)::BIGINT AS characters FROM documents")
def model_report(spark: SparkSession, d: str) -> DataFrame:
    """What a run of the model has seen and failed on, counted while its result is written."""
    docs, seen = read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 > 0, F.col("text")).alias("text")), Observation("model")
    embedded(docs, "text", hashing(), seen).write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([(hashing().name, got["rows"], got["failed"], got["characters"])], "model string, rows long, failed long, characters long")


_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower(q), '\\s+'), lambda w: length(w) > 2))"
_SCORE = f"len(list_filter({_TERMS}, lambda w: contains(lower(p.title || chr(10) || chr(10) || substring(coalesce(p.text, ''), 1, 4000)), w)))::DOUBLE"


@query(
    "rerank_neighbors",
    f"""WITH {_FOUND}, f20 AS (SELECT query_id, vec_id, q FROM fou QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20),
    one AS (SELECT f.*, {_SCORE} AS s FROM f20 f JOIN pag p USING (vec_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 3),
    nea AS (SELECT a.vec_id AS src, b.vec_id, round(list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))), 9) AS s FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT vec_id FROM one)
      QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) <= 3),
    bot AS (SELECT query_id, vec_id, q FROM f20 UNION SELECT query_id, nea.vec_id, q FROM one JOIN nea ON src = one.vec_id)
    SELECT query_id, vec_id, {_SCORE} AS score, row_number() OVER (PARTITION BY query_id ORDER BY {_SCORE} DESC, vec_id) AS rank, FALSE AS failed FROM bot JOIN pag p USING (vec_id) QUALIFY rank <= 10""",
)
def rerank_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return reranked(found_by(spark, d, 20), pages_of(spark, d).select("vec_id", "title", "text"), corpus(spark, d), overlap())
