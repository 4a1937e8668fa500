"""Toxicity by a small convolutional network over hashed words, trained in numpy.

A word's embedding is the sum of three rows of one table: those of its hash, of its first four and of
its first six bytes. Filters of one, two and three words slide over the text, each keeps its largest
response, and a logistic unit combines them. The decision threshold is calibrated for each language,
which is guessed from the text itself by its function words.

All labelled rows are learned from, by Spark: texts are dealt to shards, in each pass every shard descends from
the same weights over its own texts, and the next pass begins from the mean of what the shards have moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, stage, with_ids
from .hashing import span_hashes

#: Rows of the embedding table, its width, the widths of the filters and the filters of each width.
ROWS, DIM, WIDTHS, FILTERS = 1 << 18, 8, (1, 2, 3), 8
#: Texts, and words, of a shard: so many are learned from one after the other before weights are averaged.
SHARD, SHARD_WORDS = 8192, 4_000_000
#: Weights travel as whole numbers of this part of one and logits are counted in steps of that, so that sums of
#: them do not hang on their order; logits count as LAST at most.
FINE, STEP, LAST = 2.0**32, 1024, 64
#: Texts of all languages, of those that calibrate, that count with those of one language for its threshold.
PRIOR = 40
#: Passes over all labelled texts: as many as make VISITS in a shard, from 3 to 20.
VISITS, BATCH, RATE, SEED = 36_000, 32, 0.05, 11
#: Words of one matrix product.
CHUNK = 100_000

# Function words that tell the languages apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with this are was from by at as it",
    "de": "der die das und nicht ist ein eine mit von den dem auf für sich auch",
    "fr": "le la les des et un une est dans pour que qui sur par au du pas",
    "es": "el los las y del por con una para se no su al lo más como",
}
LANGUAGES = ("", *FUNCTION_WORDS)

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True


def word_rows(text: str) -> np.ndarray:
    """The three table rows of every word: runs of letters and digits, lower-cased."""
    b = np.frombuffer(text.lower().encode(), np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _LETTER[b]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros((0, 3), np.int32)
    out = np.empty((len(starts), 3), np.int32)
    for k, longest in enumerate((len(b), 4, 6)):
        h = span_hashes(b, starts, np.minimum(ends, starts + longest))
        out[:, k] = (h ^ np.uint64(k * 0x9E3779B9)) >> np.uint64(64 - 18)
    return out


def _language_table() -> np.ndarray:
    t = np.zeros(ROWS, np.int8)
    for k, words in enumerate(FUNCTION_WORDS.values(), 1):
        t[word_rows(words)[:, 0]] = k
    return t


@dataclass
class Network:
    table: np.ndarray = field(default_factory=lambda: np.zeros((ROWS, DIM), np.float32))
    filters: np.ndarray = field(default_factory=lambda: np.zeros((DIM, sum(WIDTHS) * FILTERS), np.float32))
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    out: np.ndarray = field(default_factory=lambda: np.zeros(len(WIDTHS) * FILTERS, np.float32))
    bias: float = -3.0
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES), np.float32))
    languages: np.ndarray = field(default_factory=_language_table)

    def responses(self, rows: np.ndarray) -> list[np.ndarray]:
        """For each width, (windows, FILTERS) before the rectifier."""
        x = (self.table[rows[:, 0]] + self.table[rows[:, 1]] + self.table[rows[:, 2]]) @ self.filters
        out, at = [], 0
        for k, w in enumerate(WIDTHS):
            n = len(rows) - w + 1
            if n > 0:
                r = x[:n, at : at + FILTERS] + self.shift[k * FILTERS : (k + 1) * FILTERS]
                for i in range(1, w):
                    r = r + x[i : n + i, at + i * FILTERS : at + (i + 1) * FILTERS]
                out.append(r)
            else:
                out.append(np.zeros((0, FILTERS), np.float32))
            at += w * FILTERS
        return out

    def best(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest response of each filter over a text of any length, 0 at least, and the place of its first (-1 if 0)."""
        best, where = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, -1)
        for at in range(0, max(1, len(rows)), CHUNK):
            for k, r in enumerate(self.responses(rows[at : at + CHUNK + max(WIDTHS) - 1])):
                if len(r):
                    own, top = slice(k * FILTERS, (k + 1) * FILTERS), r.argmax(axis=0)
                    value = r[top, np.arange(FILTERS)]
                    where[own] = np.where(value > best[own], at + top, where[own])
                    best[own] = np.maximum(value, best[own])
        return best, where

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """The largest response of each filter over a text of any length, 0 at least."""
        best = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        for at in range(0, max(1, len(rows)), CHUNK):
            for k, r in enumerate(self.responses(rows[at : at + CHUNK + max(WIDTHS) - 1])):
                if len(r):
                    part = best[k * FILTERS : (k + 1) * FILTERS]
                    np.maximum(part, r.max(axis=0), out=part)
        return best

    def logit(self, rows: np.ndarray) -> float:
        return float(self.pooled(rows) @ self.out + self.bias)

    def language(self, rows: np.ndarray) -> int:
        votes = np.bincount(self.languages[rows[:, 0]], minlength=len(LANGUAGES))[1:]
        return int(votes.argmax()) + 1 if votes.sum() else 0

    def score(self, text: str | None) -> float:
        rows = word_rows(text or "")
        z = self.logit(rows) - float(self.threshold[self.language(rows)])
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


#: The weights that are learned, and a sum of squared gradients for each (Adagrad).
WEIGHTS = ("table", "filters", "shift", "out")


#: Of each column of the filters: its filter, and the place of its word in the window.
_COLUMN = np.arange(sum(WIDTHS) * FILTERS)
_FILTER = np.concatenate([k * FILTERS + np.tile(np.arange(FILTERS), w) for k, w in enumerate(WIDTHS)])
_OFFSET = np.concatenate([np.repeat(np.arange(w), FILTERS) for w in WIDTHS])


def start(seen: np.ndarray, n: np.ndarray) -> Network:
    """A network before any pass, by how many clean and toxic texts have each row (2, ROWS) and how many there are (2).
    The first coordinate of the table starts as the lower bound of each row's log-odds of being in a toxic text, the rest
    small and random."""
    rng, net = np.random.default_rng(SEED), Network()
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    doubt = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    net.table = rng.normal(0, 0.02, (ROWS, DIM)).astype(np.float32)
    net.table[:, 0] = np.clip(odds - 2 * doubt, 0, 4)
    net.filters = rng.normal(0, 0.1, net.filters.shape).astype(np.float32)
    at = 0
    for w in WIDTHS:
        for i in range(w):
            net.filters[0, at + i * FILTERS : at + (i + 1) * FILTERS] += 1 / w
        at += w * FILTERS
    net.out = rng.normal(0.1, 0.02, net.out.shape).astype(np.float32)
    return net


def descend(net: Network, sums: Network, texts: list[np.ndarray], labels: list[int]) -> np.ndarray:
    """One step of Adagrad over a batch of word rows, in place; the rows of the table that it has moved."""
    grad = {name: np.zeros_like(getattr(net, name)) for name in WEIGHTS[1:]}
    grad_bias, touched, moves = 0.0, [], []
    for rows, y in zip(texts, labels, strict=True):
        pooled, where = net.best(rows)
        z = pooled @ net.out + net.bias
        d = (1 / (1 + np.exp(-z)) - y) / len(texts)
        grad["out"] += d * pooled
        grad_bias += d
        live = where[_FILTER] >= 0
        f, column = _FILTER[live], _COLUMN[live]
        g, three = d * net.out[f], rows[where[f] + _OFFSET[live]]
        grad["shift"] += np.where(where >= 0, d * net.out, 0)
        grad["filters"][:, column] += (g[:, None] * net.table[three].sum(axis=1)).T
        touched.append(three.ravel())
        moves.append(g[:, None] * net.filters[:, column].T)
    for name, g in grad.items():
        square = getattr(sums, name)
        square += g * g
        setattr(net, name, getattr(net, name) - RATE * g / np.sqrt(square))
    sums.bias += grad_bias**2
    net.bias -= RATE * grad_bias / np.sqrt(sums.bias)
    rows, place = np.unique(np.concatenate(touched), return_inverse=True)
    g = np.zeros((len(rows), DIM), np.float32)
    np.add.at(g, place, np.repeat(np.concatenate(moves).astype(np.float32), 3, axis=0))
    sums.table[rows] += g * g
    net.table[rows] -= RATE * g / np.sqrt(sums.table[rows])
    return rows


def cells(net: Network) -> np.ndarray:
    """All weights as rows of DIM: the table, then the others."""
    rest = np.concatenate([net.filters.ravel(), net.shift, net.out, [net.bias]])
    return np.concatenate([net.table, np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)]).astype(np.float32)


def from_cells(weights: np.ndarray) -> Network:
    net, rest = Network(table=weights[:ROWS].copy()), weights[ROWS:].ravel().copy()
    a, b = net.filters.size, net.filters.size + len(net.shift)
    net.filters, net.shift, net.out = rest[:a].reshape(net.filters.shape), rest[a:b], rest[b : b + len(net.out)]
    net.bias = float(rest[b + len(net.out)])
    return net


_MOVED = [f"{kind}{k}" for kind in "ws" for k in range(DIM)]


def one_pass(found: DataFrame, net: Network, sums: Network, shards: int, turn: int) -> tuple[Network, Network]:
    """The weights and sums after each shard has descended over its texts (id, y, rows), in an order of the turn: what
    the shards that have moved a cell have moved it by in the mean."""
    sent = found.sparkSession.sparkContext.broadcast((cells(net), cells(sums)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = sent.value
        own, square = map(from_cells, before)
        moved, texts, labels = np.zeros(len(before[0]), bool), [], []
        for b in batches:
            for y, r in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                texts.append(np.frombuffer(r.as_py(), np.int32).reshape(-1, 3))
                labels.append(y)
                if len(texts) == BATCH:
                    moved[descend(own, square, texts, labels)] = moved[ROWS:] = True
                    texts, labels = [], []
        if texts:
            moved[descend(own, square, texts, labels)] = moved[ROWS:] = True
        at = np.flatnonzero(moved)
        by = [np.rint((x[at].astype(float) - y[at]) * FINE).astype(np.int64) for x, y in zip((cells(own), cells(square)), before, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(np.ascontiguousarray(x[:, k])) for x in by for k in range(DIM))], names=["cell", *_MOVED])

    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    dealt = found.select("id", "y", "rows").repartitionById(shards, shard).sortWithinPartitions(F.xxhash64("id", F.lit(turn)), "id")
    got = dealt.mapInArrow(run, "cell int, " + ", ".join(f"{c} long" for c in _MOVED)).groupBy("cell").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in _MOVED))
    # a row for each cell that was moved, as many as the network has at most
    got = got.toArrow()
    sent.destroy()
    at, n = got["cell"].to_numpy(), got["n"].to_numpy()[:, None] * FINE
    out = []
    for kind, old in (("w", net), ("s", sums)):
        new = cells(old)
        new[at] += (np.stack([got[f"{kind}{k}"].to_numpy() for k in range(DIM)], axis=1) / n).astype(np.float32)
        out.append(from_cells(new))
    return out[0], out[1]


def fit(found: DataFrame) -> Network:
    """Train on word rows of texts, a stored table (id, y, words, rows) with distinct ids: all of them, in every pass."""
    count = {r.y: r for r in found.groupBy("y").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()}
    net = Network()
    if len(count) < 2:
        net.bias = 6.0 if 1 in count else -6.0
        return net

    def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, ROWS), np.int64)
        for b in batches:
            for y, r in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen[y, np.unique(np.frombuffer(r.as_py(), np.int32))] += 1
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[0, at]), pa.array(seen[1, at])], names=["row", "clean", "toxic"])

    # ROWS rows at most
    got = found.select("y", "rows").mapInArrow(count_rows, "row long, clean long, toxic long").groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    seen = np.zeros((2, ROWS))
    seen[:, got["row"].to_numpy()] = got["clean"].to_numpy(), got["toxic"].to_numpy()
    net = start(seen, np.array([count[0].n, count[1].n]))
    sums = Network(*(np.full_like(getattr(net, k), 0.01) for k in WEIGHTS), bias=0.01)
    n = count[0].n + count[1].n
    shards = max(1, -(-n // SHARD), -(-(count[0].words + count[1].words) // SHARD_WORDS))
    for turn in range(min(20, max(3, VISITS * shards // n))):
        net, sums = one_pass(found, net, sums, shards, turn)
    return net


def _best_threshold(z: np.ndarray, toxic: np.ndarray, texts: np.ndarray) -> float:
    """The logit that gives the highest F1, of weights of toxic texts and of all texts at falling logits z; of equals the
    middle of the widest gap."""
    f1 = 2 * np.cumsum(toxic) / (np.cumsum(texts) + toxic.sum())
    gap = np.append(z[:-1] - z[1:], 0.0)
    good = np.flatnonzero(f1 >= f1.max() - 1e-12)
    k = good[gap[good].argmax()]
    return float((z[k] + z[k + 1]) / 2) if k + 1 < len(z) else float(z[k])


def calibrate(net: Network, found: DataFrame) -> Network:
    """A threshold for each guessed language, by its own texts and, as if they were PRIOR texts, those of all languages;
    texts (y, rows) are counted by language and by their logit to a step."""
    sent = found.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [np.frombuffer(r.as_py(), np.int32).reshape(-1, 3) for r in b.column(1)]
            z = np.clip([sent.value.logit(r) for r in texts], -LAST, LAST)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sent.value.language(r) for r in texts], pa.int32()), pa.array(np.rint(z * STEP).astype(np.int32), pa.int32())], names=["y", "lang", "step"])

    # a row for each language and step at most
    got = found.select("y", "rows").mapInArrow(run, "y int, lang int, step int").groupBy("lang", "step").agg(F.sum("y").alias("toxic"), F.count("*").alias("n")).toArrow()
    sent.destroy()
    lang, toxic, n = (got[c].to_numpy().astype(float) for c in ("lang", "toxic", "n"))
    if not n.sum() or toxic.sum() in (0, n.sum()):
        return net
    step, place = np.unique(-got["step"].to_numpy(), return_inverse=True)
    for k in range(len(LANGUAGES)):
        weight = (lang == k) + PRIOR / n.sum()
        net.threshold[k] = _best_threshold(-step / STEP, *(np.bincount(place, x * weight, len(step)) for x in (toxic, n)))
    return net


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Network:
    """Fit on all labelled rows of folds 1 to 3 and calibrate on all of fold 4; fold 0 is never read.

    An id with several labels is toxic if one of them says so; of rows that repeat an id one text stands, the one of
    fewest words. Without labels, or with one kind only, the network answers the same for all texts.
    """
    y = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and id is not null")
    y = stage(y.groupBy("id").agg(F.max("y").alias("y")).withColumn("fold", fold(F.col("id"))).filter("fold > 0"), "labels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [word_rows(t.as_py() or "") for t in b.column(3)]
            out = [*b.columns[:3], pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=["id", "y", "fold", "words", "rows"])

    found = with_ids(docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")), y, "id", "inner").select("id", "y", F.col("fold").cast("int"), "text")
    found = found.mapInArrow(run, "id long, y int, fold int, words long, rows binary").groupBy("id", "y", "fold").agg(F.min(F.struct("words", "rows")).alias("t"))
    found = stage(found.select("id", "y", "fold", "t.*"), "labelled")
    return calibrate(fit(found.filter("fold < 4")), found.filter("fold = 4"))


def classify(docs: DataFrame, net: Network, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, from its whole text.

    Null and empty texts get the score of a text without words. Equal texts get equal scores, whatever their
    length. An empty table gives an empty result. Other columns of docs, whatever their names, are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = np.array([model.value.score(t.as_py()) for t in b.column(2)], float)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(fold(F.col(doc_id)) == 0, F.lit(False))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), held.alias("held_out"), text).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, train(docs, read(spark, sf_dir, "labels")))
