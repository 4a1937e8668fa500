"""Language-model scoring by prediction by partial matching over bytes.

Training counts every run of ORDER + 1 bytes of the training texts (lower-cased in A-Z, an end mark last);
counts of shorter runs are sums of these. A byte is predicted from the longest context that was seen; if it
was not seen there the model escapes to the next shorter context (method C: escapes count as often as there
are distinct bytes) and excludes the bytes that the longer context would have predicted. Since a context's
bytes are among those of its suffix, the escape chain of a context is a sum of constants of its nodes.

All counted runs take part. The prediction of a byte depends on its run alone, so runs are a table of
predictions: those with a share of RARE or more, 1 / RARE at most, are broadcast; all others are joined with
the documents that hold them. A run that training has not seen needs its escape chain: as far as contexts
of two bytes or more go, all that it needs are runs that share the nearest two bytes of their contexts, so
these are brought together, and the runs of one and two bytes (65,536 at most) are broadcast.

Beside it the base score of a text: its words under an add-one unigram model of the training words.
Counts of frequent words (a bounded number) are broadcast; all other words are joined, as the runs are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import read, stage
from .hashing import word_hashes

ORDER = 5
#: Byte runs with this share of all or more are broadcast: 1 / RARE at most.
RARE = 2.0**-23
#: Words with this share of the training words or more are broadcast: 1 / FREQUENT at most.
FREQUENT = 2.0**-19
#: Marks the end of a text, and fills the context before its start. No UTF-8 text holds this byte.
END = 255
#: Bytes, or runs, handled at once.
CHUNK = 1 << 21
#: Sums of predictions are whole multiples of this, so that they don't depend on the order of rows.
GRAIN = 2.0**-36


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7, F.lit(0))


def lowered(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode().lower(), np.uint8)


def codes(b: np.ndarray) -> np.ndarray:
    """For each byte of a text and its end: the byte (lowest) and the ORDER bytes before it, nearest first."""
    full = np.full(len(b) + ORDER + 1, END, np.uint8)
    full[ORDER:-1] = b
    out = np.zeros(len(b) + 1, np.uint64)
    for k in range(ORDER + 1):
        out |= full[ORDER - k : len(full) - k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _counted(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(place, weights=np.concatenate([n for _, n in parts])).astype(np.int64)


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, key, n): counts of words (kind 0, by hash), byte runs (1) and texts (2) over all of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, list] = {0: [], 1: []}
            parts: dict[int, list] = {0: [], 1: []}
            size = 0
            for k, t in enumerate(b.column(0)):
                x = lowered(t.as_py())
                parts[0].append(word_hashes(x))
                parts[1].append(codes(x))
                size += len(x)
                if size >= CHUNK or k == b.num_rows - 1:
                    for kind in (0, 1):
                        found[kind].append(_counted(parts[kind]))
                        parts[kind] = []
                    size = 0
            for kind in (0, 1):
                keys, n = _summed(found[kind])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([b.num_rows], pa.int64())], names=["kind", "key", "n"])

    return docs.select(text).mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Table:
    """A hash table from numbers to rows, in numpy: keys that meet an occupied slot go to the next table."""

    def __init__(self, keys: np.ndarray):
        self.tables: list[tuple[np.ndarray, np.ndarray, int]] = []
        left = np.arange(len(keys))
        for turn in range(64):
            if not len(left):
                break
            bits = max(4, int(4 * len(left)).bit_length())
            slot = self._slot(keys[left], turn, bits)
            held, row = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
            row[slot] = left  # of keys with one slot the last stays
            used = row >= 0
            held[used] = keys[row[used]]
            self.tables.append((held, row, bits))
            left = left[row[slot] != left]

    @staticmethod
    def _slot(keys: np.ndarray, turn: int, bits: int) -> np.ndarray:
        h = (keys + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return (h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if there is none."""
        out, open_ = np.full(len(keys), -1, np.int32), None
        for turn, (held, row, bits) in enumerate(self.tables):
            k = keys if open_ is None else keys[open_]
            slot = self._slot(k, turn, bits)
            r = row[slot]
            r[held[slot] != k] = -1
            if open_ is None:
                out = r
                open_ = np.flatnonzero(r < 0)
            else:
                out[open_] = r
                open_ = open_[r < 0]
            if not len(open_):
                break
        return out


class Model:
    """The trie as flat arrays. runs[j]: (key of j context bytes and the byte, count), sorted by key."""

    def __init__(self, runs: list[tuple[np.ndarray, np.ndarray]], total: int):
        self.run_table, self.log_count, self.direct = [], [], []
        self.context_table, self.escape, self.below, self.below_escape = [], [], [], []
        low = None  # of the nodes one byte shorter: keys, kept counts, all counts, distinct bytes
        for j, (keys, n) in enumerate(runs):
            nodes, place = np.unique(keys >> np.uint64(8), return_inverse=True)
            kept = np.bincount(place, weights=n, minlength=len(nodes))
            distinct = np.bincount(place, minlength=len(nodes)).astype(float)
            # a context was followed as often as it occurred itself, by runs that are kept or not
            every = np.full(len(nodes), float(total)) if j == 0 else self._counts(runs[j - 1], nodes)
            every = np.maximum(every, kept)
            self.run_table.append(Table(keys))
            self.log_count.append(np.log10(n))
            self.direct.append(np.log10(n / (every + distinct)[place]))
            self.context_table.append(Table(nodes))
            self.escape.append(np.log10((every - kept + distinct) / (every + distinct)))
            if j:
                # what the next shorter context has left when the bytes seen here are excluded
                excluded = np.bincount(place, weights=self._counts(runs[j - 1], keys & np.uint64((1 << (8 * j)) - 1)), minlength=len(nodes))
                up = np.searchsorted(low[0], nodes & np.uint64((1 << (8 * (j - 1))) - 1))
                kinds = low[3][up] - distinct
                escapes = low[2][up] - low[1][up] + kinds
                rest = low[2][up] - excluded + kinds
                with np.errstate(divide="ignore", invalid="ignore"):
                    self.below.append(np.where(rest > 0, np.log10(rest), 0.0))
                    self.below_escape.append(np.where(escapes > 0, np.log10(escapes / rest), 0.0))
            low = nodes, kept, every, distinct
        root = len(runs[0][0]) if runs else 0
        self.uniform = -np.log10(max(1, 256 - root))

    @staticmethod
    def _counts(run: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        """Counts of keys among the kept runs, 0 if there is none."""
        if not len(run[0]):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(run[0], keys), len(run[0]) - 1)
        return np.where(run[0][at] == keys, run[1][at], 0.0)

    def log10(self, c: np.ndarray) -> np.ndarray:
        """log10 probability of the lowest byte of each code in its context."""
        out = np.zeros(len(c))
        todo = np.arange(len(c))
        last = np.full(len(c), -1, np.int32)  # node of the next longer context, if the model escaped from it
        for j in range(len(self.run_table) - 1, -1, -1):
            key = c[todo] & np.uint64((1 << (8 * (j + 1))) - 1)
            hit = self.run_table[j].find(key)
            seen = hit >= 0
            fresh = last[todo] < 0
            first, then = todo[seen & fresh], todo[seen & ~fresh]
            out[first] += self.direct[j][hit[seen & fresh]]
            if len(then):
                out[then] += self.log_count[j][hit[seen & ~fresh]] - self.below[j][last[then]]
            todo, key, fresh = todo[~seen], key[~seen], fresh[~seen]
            if not len(todo):
                return out
            node = self.context_table[j].find(key >> np.uint64(8))
            start, on = todo[fresh & (node >= 0)], todo[~fresh]
            out[start] += self.escape[j][node[fresh & (node >= 0)]]
            if len(on):
                out[on] += self.below_escape[j][last[on]]
            last[todo] = node
        out[todo] += np.where(last[todo] >= 0, self.uniform, -np.log10(256))
        return out


def _suffixes(keys: np.ndarray, n: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the runs of j + 1 bytes from those of longer ones."""
    out, place = np.unique(keys & np.uint64((1 << (8 * (j + 1))) - 1), return_inverse=True)
    return out, np.bincount(place, weights=n, minlength=len(out))


def build(counts: DataFrame) -> Model:
    """The whole trie in one place, for a corpus that fits there."""
    runs = counts.filter("kind = 1").select("key", "n").toArrow()
    keys, n = runs["key"].to_numpy().view(np.uint64), runs["n"].to_numpy().astype(float)
    return Model([_suffixes(keys, n, j) for j in range(ORDER + 1)], n.sum())


def predictions(runs: DataFrame) -> DataFrame:
    """(key, n, value) of each seen run: log10 of its count by that of its context and the context's distinct bytes."""
    context = W.partitionBy(F.shiftright("key", 8))
    # with all runs kept a context occurred as often as they follow it
    return runs.select("key", "n", (F.log10(F.col("n").cast("double")) - F.log10((F.sum("n").over(context) + F.count("*").over(context)).cast("double"))).alias("value"))


def escapes(runs: DataFrame, unseen: DataFrame) -> DataFrame:
    """(key, value) of runs that training has not seen. unseen: (key), distinct, none of them among runs."""
    short = []
    for j in (0, 1):
        t = runs.groupBy(F.col("key").bitwiseAND((1 << (8 * (j + 1))) - 1).alias("key")).agg(F.sum("n").alias("n")).toArrow()
        short.append(_suffixes(t["key"].to_numpy().view(np.uint64), t["n"].to_numpy().astype(float), j))
    total = short[0][1].sum()

    def solve(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        seen, asked = n > 0, keys[n == 0]
        if len(asked):
            value = Model(short + [_suffixes(keys[seen], n[seen].astype(float), j) for j in range(2, ORDER + 1)], total).log10(asked)
        else:
            value = np.zeros(0)
        return pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)), pa.array(value)], names=["key", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for b in batches:
            held.append((b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()))
            size += b.num_rows
            if size < CHUNK:
                continue
            keys, n = (np.concatenate(z) for z in zip(*held, strict=True))
            pair = (keys >> np.uint64(8)) & np.uint64(0xFFFF)
            cut = int(np.flatnonzero(pair == pair[-1])[0])  # the last pair may go on in the next batch
            if cut:
                yield solve(keys[:cut], n[:cut])
            held, size = [(keys[cut:], n[cut:])], len(keys) - cut
        if held:
            yield solve(*(np.concatenate(z) for z in zip(*held, strict=True)))

    pair = F.shiftright("key", 8).bitwiseAND(0xFFFF)
    both = runs.select("key", "n").unionByName(unseen.select("key", F.lit(0).cast("long").alias("n")))
    both = both.withColumn("pair", pair).repartition("pair").sortWithinPartitions("pair")
    return both.select("key", "n").mapInArrow(run, "key long, value double")


def score(docs: DataFrame, counts: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text counts as empty: one token, the end. Equal rows get equal scores. Without training texts
    every byte has probability 1/256. Texts may be of any length. An empty table gives an empty result; other
    columns of docs, whatever their names, are not read.
    """
    words = counts.filter("kind = 0")
    n, v, texts = counts.agg(F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("n"))), F.lit(0)), F.count(F.when(F.col("kind") == 0, 1)), F.coalesce(F.sum(F.when(F.col("kind") == 2, F.col("n"))), F.lit(0))).first()
    n, v = n + texts, v + (texts > 0)
    frequent = words.filter(F.col("n") >= max(1.0, n * FREQUENT)).select("key", "n")
    head = frequent.toArrow()
    keys = head["key"].to_numpy().view(np.uint64)
    runs = counts.filter("kind = 1")
    predicted = stage(predictions(runs), "predictions")
    common = F.col("n") >= max(1.0, (runs.agg(F.sum("n")).first()[0] or 0) * RARE)
    fast = predicted.filter(common).select("key", "value").toArrow()
    # a run that is not in the table has row -1: the zero at the end
    shared = docs.sparkSession.sparkContext.broadcast((Table(fast["key"].to_numpy().view(np.uint64)), np.append(fast["value"].to_numpy(), 0.0), Table(keys), head["n"].to_numpy().astype(float)))
    schema = "doc_id long, held_out boolean, n_tokens long, head_known long, head_sum double, head_score double, rare array<struct<kind int, key long, c long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_table, value, table, number = shared.value
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                texts_, size = [], 0
                while at + len(texts_) < whole.num_rows and (size < CHUNK or not texts_):
                    texts_.append(lowered(whole.column(2)[at + len(texts_)].as_py()))
                    size += len(texts_[-1])
                b = whole.slice(at, len(texts_))
                at += len(texts_)
                each = [codes(x) for x in texts_]
                at_run = run_table.find(np.concatenate(each))
                logs = value[at_run]
                ends = np.cumsum([len(x) for x in each])
                total = np.add.reduceat(logs, np.append(0, ends[:-1]))
                tokens, known, sums, rare, offsets = [], [], [], [], [0]
                for x, c, row_ in zip(texts_, each, np.split(at_run, ends[:-1]), strict=True):
                    h = word_hashes(x)
                    row = table.find(h)
                    tokens.append(len(h) + 1)
                    known.append(int((row >= 0).sum()))
                    sums.append(float(np.log10(number[row[row >= 0]] + 1).sum()))
                    for kind, missed in ((0, h[row < 0]), (1, c[row_ < 0])):
                        key, times = np.unique(missed, return_counts=True)
                        rare.append((np.full(len(key), kind, np.int32), key.view(np.int64), times.astype(np.int64)))
                    offsets.append(offsets[-1] + len(rare[-2][0]) + len(rare[-1][0]))
                parts = [pa.array(np.concatenate(z)) for z in zip(*rare, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, names=["kind", "key", "c"]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(sums), pa.array(total), lists], names=["doc_id", "held_out", "n_tokens", "head_known", "head_sum", "head_score", "rare"])

    scored = docs.select(F.col(doc_id).cast("long").alias("doc_id"), (fold(F.col(doc_id)) == 2).alias("held_out"), text).mapInArrow(run, schema)
    scored = stage(scored.withColumn("uid", F.monotonically_increasing_id()), "scored")
    tail = scored.select("uid", F.explode("rare").alias("r")).select("uid", "r.kind", "r.key", "r.c")
    asked = tail.filter("kind = 1").select("key").distinct()
    unseen = stage(asked.join(predicted.select("key"), "key", "left_anti"), "unseen")
    grains = lambda value: F.round(value / GRAIN).cast("long").alias("grains")
    others = words.filter(F.col("n") < max(1.0, n * FREQUENT)).select("kind", "key", grains(F.log10(F.col("n") + 1.0)))
    for table in (predicted.filter(~common), escapes(runs, unseen)):
        others = others.unionByName(table.select(F.lit(1).alias("kind"), "key", grains(F.col("value"))))
    part = lambda kind, x: F.coalesce(F.sum(F.when(F.col("kind") == kind, x)), F.lit(0))
    tail = tail.join(others, ["kind", "key"]).groupBy("uid").agg(part(0, F.col("c")).alias("tail_known"), part(0, F.col("c") * F.col("grains")).alias("tail_sum"), part(1, F.col("c") * F.col("grains")).alias("tail_score"))
    j = scored.drop("rare").join(tail, "uid", "left")
    end_known = F.lit(1 if texts else 0)
    sums = F.col("head_sum") + F.coalesce("tail_sum", F.lit(0)) * GRAIN + F.log10(F.lit(float(texts) + 1.0))
    return j.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + end_known).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (sums - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0)) * GRAIN).alias("score"),
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = stage(count(docs.filter(fold(F.col("doc_id")) != 2)), "counts")
    return score(docs, counts)
