"""Lines that many documents share: exploded, hashed, counted by documents, dropped and put together again by position.

1. Every line long enough becomes (document, position, 128-bit hash of its key). A document counts a key once.
2. A first count by key, combined map-side, leaves the keys that enough rows hold; only their lines are looked at again.
3. Keys with very many rows are so few that they can be broadcast (their number is bounded by the rows of all);
   the lines of the others are joined by a shuffle in which no key has more than a fixed share of the rows.
4. The positions to drop come back to their document, which is put together again without them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import read, scratch, stage

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: At most so many keys are broadcast: those with a greater share of all rows than one in so many.
HOT_KEYS = 1 << 17


def line_key(line: str, least: int = 0) -> bytes | None:
    """A line without white space at both ends, A to Z lower-cased, in UTF-8; None if it has fewer code points than `least`."""
    line = line.strip(BLANK)
    return line.encode().lower() if len(line) >= least else None


def long_lines(docs: DataFrame, text: str, doc_id: str, least: int) -> DataFrame:
    """(doc, version, pos, h1, h2) of every line whose key has at least so many code points; a 128-bit hash of the key.

    version tells rows of one doc_id with different texts apart.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pos, digests = [], [], []
            for k, t in enumerate(b.column(2)):
                for at, line in enumerate((t.as_py() or "").split("\n")):
                    if len(line) >= least and (key := line_key(line, least)) is not None:
                        row.append(k)
                        pos.append(at)
                        digests.append(hashlib.blake2b(key, digest_size=16).digest())
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc", "version", "pos", "h1", "h2"])

    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc {kind}, version long, pos int, h1 long, h2 long")


def join_by_key(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """rows with the columns of keys, a stored table with `n`, the rows of each key among total ones.

    Up to HOT_KEYS keys are broadcast, so that rows stay where they are. Of more keys those with a share of over
    1 / HOT_KEYS, which can't be more than HOT_KEYS, are; the others' rows are shuffled, and no key brings more
    than total / HOT_KEYS of them together.
    """
    if keys.count() <= HOT_KEYS:
        return rows.join(F.broadcast(keys), ["h1", "h2"])
    most = total // HOT_KEYS
    hot = rows.join(F.broadcast(keys.filter(F.col("n") > most)), ["h1", "h2"])
    return hot.unionByName(rows.join(keys.filter(F.col("n") <= most), ["h1", "h2"]))


def dropped_lines(docs: DataFrame, text: str, doc_id: str, least: int, documents: int) -> DataFrame:
    """(doc, version, drops): the positions of lines whose key at least so many documents hold, but for the greatest doc_id's."""
    rows = long_lines(docs, text, doc_id, least)
    count = rows.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= documents)
    keys = stage(count, "line-keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    held = stage(join_by_key(rows, keys, total), "held")
    # a document counts once, however often it holds the line; rows without an id are one document, less than all others
    once = held.groupBy("h1", "h2", "doc").agg(F.count("*").alias("rows"))
    wide = once.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("rows").alias("n"), F.max("doc").alias("last")).filter(F.col("docs") >= documents)
    wide = stage(wide.select("h1", "h2", "n", "last"), "wide-keys")
    held = join_by_key(held.drop("n"), wide, total).filter(~F.col("doc").eqNullSafe(F.col("last")))
    return held.groupBy("doc", "version").agg(F.collect_set("pos").alias("drops"))


def without_lines(rows: DataFrame) -> DataFrame:
    """rows (rec, text, drops) as (rec, kept, n_lines, n_dropped): texts without the lines at the positions of drops."""
    schema = StructType(rows.select("rec").schema.fields[:]).add("kept", "string").add("n_lines", "long").add("n_dropped", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, n, gone = [], [], []
            for text, drops in zip(b.column(1), b.column(2), strict=True):
                lines, drop = (text.as_py() or "").split("\n"), set(drops.as_py() or ())
                n.append(len(lines))
                gone.append(len(drop))
                kept.append("\n".join(x for k, x in enumerate(lines) if k not in drop) if drop else text.as_py() or "")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def shared_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = 40, documents: int = 5) -> DataFrame:
    """docs as struct `rec`, with kept (the text that stays), n_lines (before) and n_dropped.

    A line goes if its key has at least `least` code points and at least `documents` documents hold it, unless its
    document has the greatest doc_id of them. A null or empty text is one empty line. Repeated rows are one document: their
    lines count once and share their verdict. Rows without a doc_id are together one document, less than all others. Texts and
    lines may be of any length; an empty table gives an empty result; other columns may have any names.
    """
    with scratch(docs.sparkSession) as keep:
        drops = keep(stage(dropped_lines(docs, text, doc_id, least, documents), "drops"))
    rec = docs.select(F.struct("*").alias("rec"), F.col(text).alias("text"), F.col(doc_id).alias("of"), F.xxhash64(text).alias("as"))
    # texts move once, at every size: positions are as many as the lines that go, so a broadcast of them has no bound
    j = rec.join(drops.hint("merge"), F.col("of").eqNullSafe(F.col("doc")) & (F.col("as") == F.col("version")), "left")
    return without_lines(j.select("rec", "text", "drops"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return shared_lines(docs).select("rec.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = f"""WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
  k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
  w AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
  j AS (SELECT k.*, last IS NOT NULL AND doc_id <> last AS gone FROM k LEFT JOIN w USING (key))
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id"""
