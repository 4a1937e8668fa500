"""Retrieval over whole tables of questions: exact top-k by cosine, merging, spelling, excerpts, attribution."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..joins import grid
from ..registry import query, read
from .indexes import suggestions


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def unit(v: Column) -> Column:
    """v by its length; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: x / F.when(n == 0, 1.0).otherwise(n))


def rounded(x: Column, digits: int) -> Column:
    """x with so many digits as DuckDB's round() has it: the product with the power of ten is rounded, half away from zero,
    and the sign of a zero stays. Spark's round() goes by the shortest decimal of x, whose halves are other ones."""
    scale = F.lit(10.0**digits)
    z = x * scale
    r = F.rint(z)
    return F.when((z - r == 0.5) & (z > 0), r + 1).when((z - r == -0.5) & (z < 0), r - 1).otherwise(r) / scale


def corpus(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


#: Vectors of a block of rows, and of a block of queries; cells of one query whose best are merged at once; queries of a
#: block whose scores are made exact at once.
ROW_BLOCK, QUERY_BLOCK, FAN, EXACT = 4096, 1024, 64, 128


def packed(vectors: DataFrame, columns: list[str], blocks: int, name: str, body: str) -> DataFrame:
    """Rows in so many blocks, dealt by the first of the columns: (name, body: the columns as an array of structs)."""
    block = F.pmod(F.xxhash64(columns[0]), F.lit(blocks)).cast("int").alias(name)
    return vectors.groupBy(block).agg(F.collect_list(F.struct(*columns)).alias(body))


def n_blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def by_dimension(vectors: DataFrame, vector: str) -> dict[int, int]:
    """How many vectors there are of each dimension; null and empty ones are left out."""
    count = vectors.filter(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).count().limit(65).collect()
    if len(count) > 64:
        raise ValueError("vectors of more than 64 dimensions")
    return {r.dim: r["count"] for r in count}


def _vectors(block: pa.Array, vector: str) -> np.ndarray:
    return block.field(vector).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(block), -1)


def _inner(x: Iterator[np.ndarray], y: Iterator[np.ndarray]) -> np.ndarray:
    """Inner products of vectors given by components, summed from the first component on as SQL sums a list."""
    total = 0.0
    for a, b in zip(x, y, strict=True):
        total = total + a * b
    return total


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As rounded()."""
    z = x * 10.0**digits
    r = np.rint(z)
    return (r + ((z - r == 0.5) & (z > 0)) - ((z - r == -0.5) & (z < 0)) if (np.abs(z - r) == 0.5).any() else r) / 10.0**digits


def cosine_topk(queries: DataFrame, rows: DataFrame, k: int, exclude_self: bool = False, weight: float | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): of all rows the k nearest to each query. queries: (query_id, q); rows: (vec_id, v).

    A score is the cosine to nine digits; with `weight`, that times the weight to six digits, and rows are chosen by this.
    Blocks of queries and blocks of rows make a grid of matrix products, a task for each cell; of a cell only the k best of
    each query are kept, and these are merged in a tree of FAN cells at a time. Products only tell which rows may be among
    the k best: these are scored again by sums in the order of the components, so that a score does not hang on its block.
    A query is held against the rows of its own dimension; null and empty vectors take no part.
    """
    asked, held = by_dimension(queries, "q"), by_dimension(rows, "v")
    parts = [_topk(queries.filter(F.size("q") == d), rows.filter(F.size("v") == d), asked[d], held[d], k, exclude_self, weight) for d in sorted(asked.keys() & held)]
    if not parts:
        return queries.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    return functools.reduce(DataFrame.unionByName, parts)


def _topk(queries: DataFrame, rows: DataFrame, n_queries: int, n_rows: int, k: int, exclude_self: bool, weight: float | None) -> DataFrame:
    blocks, parts = n_blocks(n_queries, QUERY_BLOCK), n_blocks(n_rows, ROW_BLOCK)
    # twice what rounding moves a score by at most
    slack = 2e-9 if weight is None else 1.1e-6 + 2e-9 * abs(weight)

    def best_of(x: np.ndarray, y: np.ndarray, qid: np.ndarray, vid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of queries, ids and scores of the k best of each, best first."""
        a, b = (np.sqrt(_inner(z.T, z.T)) for z in (x, y))
        one = lambda z, n: z / np.where(n == 0, 1.0, n)[:, None]
        s = one(x, a) @ one(y, b).T
        if weight is not None:
            s *= weight
        s[np.isnan(s)] = -np.inf
        if exclude_self:
            s[qid[:, None] == vid[None, :]] = -np.inf
        few = min(k, s.shape[1])
        least = np.partition(s, s.shape[1] - few, axis=1)[:, s.shape[1] - few] - slack
        i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        n = a[i] * b[j]
        value = _inner((c[i] for c in x.T), (c[j] for c in y.T)) / np.where(n == 0, 1.0, n)
        value = _rounded(np.where(n == 0, 0.0, value), 9)
        if weight is not None:
            value = _rounded(value * weight, 6)
        order = np.lexsort((vid[j], -value, i))
        i, j, value = i[order], j[order], value[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k
        return i[top], vid[j[top]], value[top]

    def run(asked: pa.Array, held: pa.Array, part: int) -> Iterator[pa.RecordBatch]:
        x, y = _vectors(asked, "q"), _vectors(held, "v")
        qid, vid = (z.to_numpy(zero_copy_only=False) for z in (asked.field("query_id"), held.field("vec_id")))
        for at in range(0, len(x), EXACT):
            own = qid[at : at + EXACT]
            i, found, value = best_of(x[at : at + EXACT], y, own, vid)
            yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(np.full(len(i), part, np.int32)), pa.array(found), pa.array(value)], names=["query_id", "part", "vec_id", "score"])

    left = packed(queries, ["query_id", "q"], blocks, "block", "left_of")
    right = packed(rows, ["vec_id", "v"], parts, "part", "right_of")
    best = grid(left, right, blocks, parts, run, "query_id long, part int, vec_id long, score double")
    while parts > FAN:
        best, parts = best.withColumn("part", F.floor(F.col("part") / FAN).cast("int")), -(-parts // FAN)
        best = ranked(best, ["query_id", "part"], k).drop("rank")
    return ranked(best.drop("part"), ["query_id"], k)


def ranked(found: DataFrame, group: list[str], k: int) -> DataFrame:
    """The k best rows of each group by score, then vec_id, with their rank."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def few_queries(rows: DataFrame) -> DataFrame:
    """The queries of searches: rows whose id is divisible by 100."""
    return rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))


_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_COS = "round(coalesce(list_inner_product(a.v, b.v) / nullif(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)), 0), 0), 9)"


def _topk_sql(k: int, where: str = "TRUE") -> str:
    return f"SELECT a.vec_id AS query_id, b.vec_id AS vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM e a JOIN e b ON {where} WHERE a.vec_id % 100 = 0 QUALIFY rank <= {k}"


@query("cosine_topk", f"WITH {_E} {_topk_sql(10)}")
def cosine_top(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    return cosine_topk(few_queries(rows), rows, 10)


@query("kg_similar_entities", f"WITH {_E} {_topk_sql(5, 'a.vec_id <> b.vec_id')}")
def kg_similar_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    return cosine_topk(few_queries(rows), rows, 5, exclude_self=True)


@query("semantic_search", f"WITH {_E} SELECT * FROM ({_topk_sql(6)}) WHERE score > 0.3")
def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus(spark, d)
    return cosine_topk(few_queries(rows), rows, 6).filter("score > 0.3")


@query(
    "semantic_search_terms",
    f"""WITH {_E}, f AS (SELECT query_id // 500 AS asker, vec_id, min((query_id, rank)) AS seen FROM ({_topk_sql(6)}) WHERE score > 0.3 GROUP BY ALL)
    SELECT asker, vec_id, row_number() OVER (PARTITION BY asker ORDER BY seen) AS n FROM f QUALIFY n <= 8""",
)
def semantic_search_terms(spark: SparkSession, d: str) -> DataFrame:
    """An asker has up to five terms (here the queries of one run of 500 ids): the best of each, those found by an earlier
    term once, eight in all."""
    found = semantic_search(spark, d).groupBy(F.floor(F.col("query_id") / 500).alias("asker"), "vec_id").agg(F.min(F.struct("query_id", "rank")).alias("seen"))
    return found.withColumn("n", F.row_number().over(W.partitionBy("asker").orderBy("seen"))).filter("n <= 8").select("asker", "vec_id", "n")


@query("hybrid_merge", f"WITH {_E}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({_COS} * CASE WHEN b.label < 5 THEN 1.1 ELSE 1.0 END, 6) AS score FROM e a, e b WHERE a.vec_id % 100 = 0) SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10")
def hybrid_merge(spark: SparkSession, d: str) -> DataFrame:
    """Pages (labels 0 to 4) weigh 1.1 times as much as entities; the best ten of both. Ten of each side suffice, if they
    are the best by the weighed score as it is rounded."""
    rows = corpus(spark, d)
    q = few_queries(rows)
    side = lambda which, weight: cosine_topk(q, rows.filter(which), 10, weight=weight).drop("rank")
    # a row without a label is an entity
    return ranked(side("label < 5", 1.1).unionByName(side("coalesce(label >= 5, true)", 1.0)), ["query_id"], 10)


@query("l2_normalize", "SELECT vec_id, list_transform(v, lambda x: round(x / CASE WHEN n = 0 THEN 1 ELSE n END, 9)) AS unit FROM (SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings)")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("vec_id", F.transform(unit(F.col("v")), lambda x: rounded(x, 9)).alias("unit"))


@query("vector_blend", f"WITH {_E} SELECT a.vec_id, list_transform(list_zip(a.v, b.v), lambda x: round(0.7 * x[1] + 0.3 * x[2], 9)) AS blend FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def vector_blend(spark: SparkSession, d: str) -> DataFrame:
    a = corpus(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return a.join(b, "vec_id").select("vec_id", F.zip_with("v", "w", lambda x, y: F.round(0.7 * x + 0.3 * y, 9)).alias("blend"))


@query("embedding_scan_valid", "SELECT vec_id, len(embedding) AS dimension FROM embeddings WHERE embedding IS NOT NULL")
def embedding_scan_valid(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").filter("embedding is not null")
    # of rows that repeat an id the least vector stands
    return e.groupBy("vec_id").agg(F.size(F.min("embedding")).alias("dimension"))


@query("hash_embed", "WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS token FROM documents) SELECT doc_id, substring(md5(token), 1, 1) AS slot, sum(CASE WHEN substring(md5(token), 2, 1) < '8' THEN 1 ELSE -1 END)::BIGINT AS value FROM t GROUP BY ALL")
def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    """Feature hashing: a token adds +1 or -1 to one of sixteen slots. A sparse vector per document."""
    t = read(spark, d, "documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    h = F.md5("token")
    return t.select("doc_id", F.substring(h, 1, 1).alias("slot"), F.when(F.substring(h, 2, 1) < "8", 1).otherwise(-1).alias("x")).groupBy("doc_id", "slot").agg(F.sum("x").alias("value"))


@query("title_fallback", "WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 3)) AS q FROM (SELECT item_id, b.text || ' ' || p_name AS text FROM benchmark b JOIN part ON p_partkey = item_id + 1)), w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT item_id, w AS title, 0.5::DOUBLE AS score FROM t JOIN w ON len(list_filter(q, lambda x: contains(w, x))) > 0")
def title_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Titles that hold a token of the question, here a benchmark text and a part's name. Tokens are paired with titles
    by the pieces of four characters that both hold, and then compared."""
    part = read(spark, d, "part")
    q = read(spark, d, "benchmark").join(part, F.col("p_partkey") == F.col("item_id") + 1).select("item_id", F.concat_ws(" ", "text", "p_name").alias("t"))
    q = q.select("item_id", F.explode(F.array_distinct(F.filter(tokens(F.col("t")), lambda x: F.char_length(x) > 3))).alias("token")).withColumn("piece", F.substring("token", 1, 4))
    w = part.select(F.explode(F.split("p_name", " ")).alias("title")).distinct().filter(F.char_length("title") > 3)
    at = F.sequence(F.lit(1), F.char_length("title") - 3)
    w = w.select("title", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col("title"), i, F.lit(4))))).alias("piece"))
    return q.join(w, "piece").filter(F.contains("title", F.col("token"))).select("item_id", "title", F.lit(0.5).alias("score")).distinct()


@query("subquery_expand", "SELECT item_id, n, q FROM (SELECT item_id, unnest(range(1, 4)) AS n, unnest([text, text || ' strategy', text || ' location']) AS q FROM benchmark)")
def subquery_expand(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    e = F.array_distinct(F.array(t, F.concat(t, F.lit(" strategy")), F.concat(t, F.lit(" location"))))
    return read(spark, d, "benchmark").select("item_id", F.posexplode(F.slice(e, 1, 8)).alias("n", "q")).withColumn("n", (F.col("n") + 1).cast("long"))


@query(
    "spell_suggest",
    """WITH lex AS (SELECT w, count(*) AS freq FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w),
    q AS (SELECT DISTINCT substring(w, 1, 2) || substring(w, 4) AS q FROM lex WHERE length(w) > 4),
    c AS (SELECT q, w, freq, levenshtein(q, w) AS dist FROM q JOIN lex ON q[1] = w[1] AND abs(length(q) - length(w)) <= 2 WHERE q NOT IN (SELECT w FROM lex)),
    f AS (SELECT *, round(1 - dist / greatest(length(q), length(w))::DOUBLE, 9) AS confidence FROM c WHERE dist <= CASE WHEN length(q) >= 5 THEN 2 ELSE 1 END)
    SELECT q, w AS suggestion, confidence, row_number() OVER (PARTITION BY q ORDER BY confidence DESC, freq DESC, w) AS rank FROM f QUALIFY rank <= 3""",
)
def spell_suggest(spark: SparkSession, d: str) -> DataFrame:
    """Unknown words against the lexicon: same first letter, distance two (one for short words)."""
    lex = read(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy("w").agg(F.count("*").alias("freq"))
    q = lex.filter(F.char_length("w") > 4).select(F.concat(F.substring("w", 1, 2), F.expr("substring(w, 4)")).alias("tok")).distinct()
    q = q.join(lex.select(F.col("w").alias("tok")), "tok", "left_anti")
    return suggestions(q, lex, 3).select(F.col("tok").alias("q"), F.col("w").alias("suggestion"), "confidence", "rank")


@query(
    "excerpt_select",
    """WITH w AS (SELECT doc_id, lang, unnest(range(0, greatest(1, length(text)), 300)) AS start, text FROM documents),
    x AS (SELECT doc_id, lang, start, substring(text, start + 1, 500) AS snippet FROM w),
    s AS (SELECT doc_id, start, len(list_filter(['the', 'und', 'les', 'que', 'with'], lambda t: contains(lower(snippet), t)))::BIGINT AS score, snippet FROM x WHERE length(snippet) >= 50)
    SELECT doc_id, start, score FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start) <= 2""",
)
def excerpt_select(spark: SparkSession, d: str) -> DataFrame:
    """Windows of 500 characters, 300 apart, by the terms they hold; the two best of a document, in place."""
    terms = F.array(*(F.lit(t) for t in ("the", "und", "les", "que", "with")))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.char_length("text")) - 1, F.lit(300))
    window = F.transform(starts, lambda s: F.struct(s.alias("start"), F.lower(F.substring(F.col("text"), s + 1, F.lit(500))).alias("x")))
    scored = F.transform(F.filter(window, lambda w: F.char_length(w["x"]) >= 50), lambda w: F.struct((-F.size(F.filter(terms, lambda t: F.contains(w["x"], t)))).cast("long").alias("minus"), w["start"].cast("long").alias("start")))
    best = read(spark, d, "documents").select("doc_id", F.explode(F.slice(F.array_sort(scored), 1, 2)).alias("b"))
    return best.select("doc_id", "b.start", (-F.col("b.minus")).alias("score"))


@query("resolve_references", "WITH u AS (SELECT conv_id, turn, text, lag(regexp_extract(text, '([A-Z][a-z]+)', 1)) OVER (PARTITION BY conv_id ORDER BY turn) AS entity FROM conversations) SELECT conv_id, turn, CASE WHEN entity <> '' THEN regexp_replace(text, '\\b(it|he|she|they|this|that)\\b', entity) ELSE text END AS resolved FROM u")
def resolve_references(spark: SparkSession, d: str) -> DataFrame:
    """The first pronoun of a turn becomes the first name of the turn before."""
    name = F.lag(F.regexp_extract("text", "([A-Z][a-z]+)", 1)).over(W.partitionBy("conv_id").orderBy("turn"))
    c = read(spark, d, "conversations").select("conv_id", "turn", "text", name.alias("entity"))
    at = F.regexp_instr("text", F.lit(r"\b(it|he|she|they|this|that)\b"))
    word = F.regexp_extract("text", r"\b(it|he|she|they|this|that)\b", 1)
    new = F.concat(F.substring(F.col("text"), F.lit(1), at - 1), F.col("entity"), F.expr("substring(text, regexp_instr(text, '\\\\b(it|he|she|they|this|that)\\\\b') + length(regexp_extract(text, '\\\\b(it|he|she|they|this|that)\\\\b', 1)))"))
    return c.select("conv_id", "turn", F.when((F.col("entity") != "") & (word != ""), new).otherwise(F.col("text")).alias("resolved"))
