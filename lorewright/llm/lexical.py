"""Ranked lexical search of a table of items over all documents, through K2-treaps of ranges of documents.

1. One pass over the documents counts each one's terms and keeps, in its own order, how often it holds the terms
   that are asked for. The number of documents, their terms and the document frequencies come from that table.
2. Each task reads its documents in ranges, builds a treap of (term, document) impacts for each range, and lets all
   items descend. What an item has found in a range is the least that the next range has to beat.
3. Of each task the k best of an item are left, and these are merged.

Items are taken in blocks of bounded size (BLOCK characters, or one item); documents never leave their task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from .common import read, scratch, stage
from .treap import Treap

#: A term: ASCII letters and digits and everything beyond ASCII. On UTF-8 bytes; A to Z are lower-cased before.
TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Characters of a block of items, and entries and documents of a range.
BLOCK, ENTRIES, RANGE = 1 << 22, 1 << 20, 1 << 15
#: Saturation and the share of the length in it, both as percent of whole numbers.
LENGTH_SHARE = 25


def terms(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode().lower())


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """The part of a score that does not depend on the term, in whole numbers rounded down."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * n * documents) // length
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def postings(docs: DataFrame, text: str, doc_id: str, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, term, tf): of each document its terms with repeats, and which asked terms it holds how often."""
    spark = docs.sparkSession
    asked = spark.sparkContext.broadcast(number)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = asked.value.get
        for b in batches:
            n, term, tf = [], [], []
            for t in b.column(1):
                found = terms(t.as_py())
                n.append(len(found))
                count = Counter(found)
                held = [(k, c) for x, c in count.items() if (k := get(x)) is not None]
                term.append([k for k, _ in held])
                tf.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(term, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "term", "tf"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, term array<int>, tf array<long>")


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a task in tables of up to RANGE documents and ENTRIES entries (or one document)."""
    held, rows, entries = [], 0, 0
    for b in batches:
        size = np.diff(b.column(2).offsets.to_numpy())
        start = 0
        for i, s in enumerate(size):
            if rows and (rows == RANGE or entries + s > ENTRIES):
                yield pa.Table.from_batches([*held, b.slice(start, i - start)])
                held, rows, entries, start = [], 0, 0, i
            rows, entries = rows + 1, entries + s
        held.append(b.slice(start))
    if rows:
        yield pa.Table.from_batches(held)


def search_block(held: DataFrame, items: list[tuple[object, dict[int, int]]], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): of each task the k best documents of each item (by its number) with a score above 0."""
    spark = held.sparkSession
    # terms of like weight are neighbours in the grid, so that the greatest impact of a cell tells something of each row
    order = np.argsort(weights, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    asks = [(place[np.fromiter(c, np.int64, len(c))], np.fromiter(c.values(), np.int64, len(c))) for _, c in items]
    told = spark.sparkContext.broadcast((place, weights, asks))
    kind, arrow_kind = held.schema["doc_id"].dataType.simpleString(), to_arrow_type(held.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weights, asks = told.value
        best: list[list[tuple]] = [[] for _ in asks]
        first = lambda x: (-x[0], x[1] is not None, x[1])
        for part in ranges(batches):
            part = part.sort_by([("doc_id", "ascending")]).combine_chunks()
            ids = part.column("doc_id").to_pylist()
            # nulls come last in the sort; they go first, as the least
            nulls = part.column("doc_id").null_count
            ids = ids[len(ids) - nulls :] + ids[: len(ids) - nulls]
            size = pc.list_value_length(part.column("term")).to_numpy().astype(np.int64)
            column = (np.repeat(np.arange(len(size)), size) + nulls) % max(1, len(ids))
            term = part.column("term").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            tf = part.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            n = np.repeat(part.column("n").to_numpy(), size)
            value = weights[term] * impacts(tf, n, documents, length)
            ok = value > 0
            tree = Treap(place[term[ok]], column[ok], value[ok], len(weights), len(ids))
            for i, (rows, times) in enumerate(asks):
                least = best[i][-1][0] - 1 if len(best[i]) == k else 0
                found = tree.best(rows, times, k, least)
                if found:
                    best[i] = sorted([*best[i], *((s, ids[c]) for s, c in found)], key=first)[:k]
        out = [(i, d, s) for i, b in enumerate(best) for s, d in b]
        for at in range(0, len(out), 1 << 16):
            item, doc, score = zip(*out[at : at + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, arrow_kind), pa.array(score, pa.int64())], names=["item", "doc_id", "score"])

    return held.mapInArrow(run, f"item long, doc_id {kind}, score long")


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[object, Counter]]]:
    """Items with their counted terms, so many at a time that their texts have BLOCK characters (or one item)."""
    held, size = [], 0
    for r in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        if held and size + len(r.t or "") > BLOCK:
            yield held
            held, size = [], 0
        held.append((r.i, Counter(terms(r.t))))
        size += len(r.t or "")
    if held:
        yield held


def lexical_search(items: DataFrame, docs: DataFrame, k: int = 20, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0, ties by the lesser doc_id.

    A null text has no terms; a document or item without terms is found by and finds nothing. Repeated rows are
    documents (and items: each is answered) of their own; a null doc_id is less than all others. Texts may be of any
    length. An empty table on either side gives an empty result. Only the named columns are read.
    """
    spark = docs.sparkSession
    schema = f"item_id {items.schema[item_id].dataType.simpleString()}, rank int, doc_id {docs.schema[doc_id].dataType.simpleString()}, score long"
    parts: list[DataFrame] = []
    with scratch(spark) as keep:
        for block in blocks(items, item_id, item_text):
            number = {t: i for i, t in enumerate(sorted({t for _, c in block for t in c}))}
            held = stage(postings(docs, text, doc_id, number), "postings")
            documents, length = held.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
            if not documents or not number:
                continue
            df = np.zeros(len(number), np.int64)
            for r in held.select(F.explode("term").alias("t")).groupBy("t").count().toLocalIterator():
                df[r.t] = r["count"]
            weights = np.array([weight(documents, int(x)) for x in df], np.int64)
            asks = [(i, {number[t]: c for t, c in counted.items()}) for i, counted in block]
            found = search_block(held, asks, weights, documents, length, k)
            rank = F.row_number().over(W.partitionBy("item").orderBy(F.col("score").desc(), "doc_id"))
            found = found.withColumn("rank", rank).filter(F.col("rank") <= k)
            names = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(asks)], f"item long, item_id {items.schema[item_id].dataType.simpleString()}")
            parts.append(keep(stage(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "found")))
    out = spark.createDataFrame([], schema)
    for p in parts:
        out = p if p is parts[0] else out.unionByName(p)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = rf"""WITH ask AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_FOLD}, '{_TERM}')) AS t FROM benchmark) GROUP BY ALL),
  tok AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_TERM}') AS ts FROM documents),
  siz AS (SELECT doc_id, len(ts)::BIGINT AS n FROM tok),
  tot AS (SELECT count(*) FILTER (n > 0)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM siz),
  pos AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM tok) WHERE t IN (SELECT t FROM ask) GROUP BY ALL),
  wei AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM pos, tot GROUP BY t, nn),
  imp AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll))) AS v FROM pos JOIN wei USING (t) JOIN siz USING (doc_id), tot),
  sco AS (SELECT item_id, doc_id, sum(times * v)::BIGINT AS score FROM ask JOIN imp USING (t) GROUP BY ALL HAVING sum(times * v) > 0)
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM sco QUALIFY rank <= 20"""
