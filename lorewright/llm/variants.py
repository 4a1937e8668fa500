"""Spelling variants: words one edit apart, found in a trie over letter-group counts, and their forms and roots.

1. Words are counted by documents' tasks and then by word.
2. A word's frequency vector has a count for each letter group; successive groups are the levels of a trie. One edit
   takes at most one letter from one group (the deficit) and puts at most one into another (the surplus).
3. The top of the trie, down to nodes of at most so many words, is worked out level by level and deals the words to
   shards. A word visits the shards that its vector reaches with the budget of one deficit and, after it, one surplus.
   In this order each pair of words meets once.
4. In a shard a depth-first search takes all visitors down the trie together; those whose budget is spent drop out.
   The words of a leaf are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, release, scratch, stage

#: On lower-cased UTF-8: a-z and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: A group for each letter, frequent ones first, and further groups that all other code points are dealt to.
LETTERS, OTHERS = "etaoinsrhldcumfpgwybvkxjqz", 6
GROUPS = len(LETTERS) + OTHERS
#: Counts beyond it are this one: one edit still changes a count by one at most.
MOST = 15
#: Words of a shard at most and at least, entries of a task's table of counts, words of a leaf, visitors taken down at once.
SHARD_MOST, SHARD_LEAST, HELD, LEAF, VISITORS = 20_000, 1_000, 200_000, 8, 1 << 16
_GROUP = {c: k for k, c in enumerate(LETTERS)}


def slipped(run: bytes, start: int, slip: int) -> str:
    """The run as it is, or without one code point if its checksum is divisible by slip."""
    h = zlib.crc32(run, start)
    word = run.decode()
    if slip and h % slip == 0:
        k = h % len(word)
        word = word[:k] + word[k + 1 :]
    return word


def word_counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 6, least_count: int = 5, slip: int = 0) -> DataFrame:
    """(word, n): the words of all texts with so many code points, and their occurrences if there are enough.

    With slip, a run loses a code point where the crc32 of `<doc_id>:<run>` is divisible by it (a null doc_id: empty).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            for d, t in zip(b.column(0), b.column(1), strict=True):
                start = zlib.crc32(f"{d.as_py() or ''}:".encode())
                for x, n in Counter(RUN.findall((t.as_py() or "").encode().lower())).items():
                    if len(x) >= least_length:
                        word = slipped(x, start, slip)
                        if len(word) >= least_length:
                            held[word] += n
                if len(held) > HELD:
                    yield rows()
        yield rows()

    found = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def vector(word: str) -> bytes:
    """The counts of the letter groups."""
    v = bytearray(GROUPS)
    for c in word:
        k = _GROUP.get(c)
        k = len(LETTERS) + ord(c) % OTHERS if k is None else k
        v[k] = min(MOST, v[k] + 1)
    return bytes(v)


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced code point."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    lo, hi = 0, len(b)  # the first place where they differ
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return a[lo + 1 :] == b[lo + (len(a) == len(b)) :]


def top(words: DataFrame, most: int) -> tuple[set[bytes], dict[bytes, tuple[int, int]]]:
    """The top of the trie over words (word, n, vec): nodes of more words than that, and the others below them as
    {prefix: (number, slices)}. A node that all levels leave too large is cut into slices by a hash of the word.

    A node of more than `most` words has at most MOST + 1 children, so the top has no more nodes than a fixed multiple
    of levels * words / most.
    """
    inner, shards, wide = set(), {}, [b""]
    for level in range(GROUPS + 1):
        at = F.substring("vec", 1, level) if level else F.lit(b"")
        spark = words.sparkSession
        some = words.withColumn("at", at)
        if level:
            above = F.broadcast(spark.createDataFrame([(p,) for p in wide], "up binary"))
            some = some.withColumn("up", F.substring("vec", 1, level - 1)).join(above, "up", "left_semi")
        wide = []
        for r in some.groupBy("at").count().toLocalIterator():
            if r["count"] > most and level < GROUPS:
                wide.append(bytes(r.at))
            else:
                shards[bytes(r.at)] = (len(shards), -(-r["count"] // most))
        inner.update(wide)
        if not wide:
            break
    return inner, shards


def reached(vec: bytes, inner: set[bytes], shards: dict[bytes, tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The shards (number, slices) that a vector reaches with one deficit and, after it, one surplus."""
    todo = [(b"", 0, 0)]
    while todo:
        prefix, deficit, surplus = todo.pop()
        if prefix in shards:
            yield shards[prefix]
        elif prefix in inner:
            c = vec[len(prefix)]
            todo.append((prefix + bytes([c]), deficit, surplus))
            if c and not deficit:
                todo.append((prefix + bytes([c - 1]), 1, surplus))
            if c < MOST and deficit and not surplus:
                todo.append((prefix + bytes([c + 1]), deficit, 1))


def dealt(words: DataFrame, inner: set[bytes], shards: dict[bytes, tuple[int, int]]) -> DataFrame:
    """(shard, slice, role, word, n, vec): each word at home (role 0) and as a visitor (role 1) where it may find one."""
    told = words.sparkSession.sparkContext.broadcast((inner, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, shards = told.value
        for b in batches:
            row, shard, piece, role = [], [], [], []
            for k, (w, v) in enumerate(zip(b.column("word"), b.column("vec"), strict=True)):
                vec = v.as_py()
                p = b""
                while p in inner:
                    p = vec[: len(p) + 1]
                number, slices = shards[p]
                row.append(k)
                shard.append(number)
                piece.append(zlib.crc32(w.as_py().encode()) % slices)
                role.append(0)
                for number, slices in reached(vec, inner, shards):
                    row += [k] * slices
                    shard += [number] * slices
                    piece += range(slices)
                    role += [1] * slices
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(piece, pa.int32()), pa.array(role, pa.int32()), *(b.column(c).take(at) for c in ("word", "n", "vec"))], names=["shard", "slice", "role", "word", "n", "vec"])

    return words.mapInArrow(run, "shard int, slice int, role int, word string, n long, vec binary")


class Shard:
    """Words of one shard, sorted by their vectors: a node of the trie is a range of them."""

    def __init__(self, words: list[str], n: list[int], vectors: list[bytes]):
        v = np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, GROUPS)
        order = np.lexsort(v.T[::-1])
        self.v = v[order].astype(np.int8)
        self.words, self.n = [words[i] for i in order], [n[i] for i in order]
        self.lookup: dict[tuple[int, int], dict[str, list[int]]] = {}

    def near(self, words: list[str], vectors: list[bytes]) -> Iterator[tuple[int, int]]:
        """(visitor, own word) of each pair one edit apart: of two words with equal vectors the lesser is the own one."""
        if not self.words or not words:
            return
        q = np.frombuffer(b"".join(vectors), np.uint8).reshape(-1, GROUPS).astype(np.int8)
        none = np.zeros(len(words), np.int8)
        todo = [(0, len(self.words), 0, np.arange(len(words)), none, none)]
        while todo:
            lo, hi, level, who, deficit, surplus = todo.pop()
            if level == GROUPS or hi - lo <= LEAF:
                yield from self._leaf(lo, hi, level, words, q, who, deficit, surplus)
                continue
            column = self.v[lo:hi, level]
            counts, starts = np.unique(column, return_index=True)
            for c, start, end in zip(counts, starts, [*starts[1:], hi - lo], strict=True):
                d = c - q[who, level]
                ok = (d == 0) | ((d == -1) & (deficit == 0)) | ((d == 1) & (deficit == 1) & (surplus == 0))
                if ok.any():
                    d = d[ok]
                    todo.append((lo + start, lo + end, level + 1, who[ok], deficit[ok] + (d < 0), surplus[ok] + (d > 0)))

    def _leaf(self, lo: int, hi: int, level: int, words: list[str], q: np.ndarray, who: np.ndarray, deficit: np.ndarray, surplus: np.ndarray) -> Iterator[tuple[int, int]]:
        if level == GROUPS and hi - lo > LEAF:
            # many words of one vector: looked up by what is left of them without one code point
            table = self._table(lo, hi)
            for k in who:
                a = words[k]
                found = {b for x in {a, *(a[:i] + a[i + 1 :] for i in range(len(a)))} for b in table.get(x, ())}
                yield from ((int(k), b) for b in sorted(found) if self._meets(a, b, q[k], one_edit(a, self.words[b])))
            return
        v = self.v[lo:hi, level:]
        for at in range(0, len(who), 4096):
            some = who[at : at + 4096]
            d = v[None, :, :] - q[some][:, None, level:]
            minus, plus = (np.maximum(-d, 0)).sum(axis=2) + deficit[at : at + 4096, None], (np.maximum(d, 0)).sum(axis=2) + surplus[at : at + 4096, None]
            for i, j in zip(*np.nonzero((minus <= 1) & (plus <= minus)), strict=True):
                k, b = int(some[i]), lo + int(j)
                if self._meets(words[k], b, q[k], one_edit(words[k], self.words[b])):
                    yield k, b

    def _table(self, lo: int, hi: int) -> dict[str, list[int]]:
        """Words of a range by themselves and by all that is left of them without one code point."""
        if (lo, hi) not in self.lookup:
            table: dict[str, list[int]] = {}
            for b in range(lo, hi):
                w = self.words[b]
                for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
                    table.setdefault(x, []).append(b)
            self.lookup[lo, hi] = table
        return self.lookup[lo, hi]

    def _meets(self, a: str, b: int, q: np.ndarray, near: bool) -> bool:
        """Whether the visitor is the one of the two that reports the pair: its first differing count is the greater one,
        and of equal vectors its word is."""
        if not near:
            return False
        differ = np.flatnonzero(self.v[b] != q)
        return bool(self.v[b, differ[0]] < q[differ[0]]) if len(differ) else self.words[b] < a


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) for words (word, n): both directions of every pair of words one edit apart.

    A word may be of any length. An empty table gives an empty result.
    """

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([vector(w.as_py()) for w in b.column(0)], pa.binary())], names=["word", "n", "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, own, shard = None, ([], [], []), None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("shard", "slice", "role")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                place, role = (keys[0, lo], keys[1, lo]), keys[2, lo]
                w, n, v = (b.column(c).slice(lo, hi - lo).to_pylist() for c in ("word", "n", "vec"))
                if place != home:
                    home, own, shard = place, ([], [], []), None
                if role == 0:
                    for held, more in zip(own, (w, n, v), strict=True):
                        held += more
                    continue
                shard = shard or Shard(*own)
                for at in range(0, len(w), VISITORS):
                    some = list(shard.near(w[at : at + VISITORS], v[at : at + VISITORS]))
                    x = [(w[at + k], shard.words[j], shard.n[j]) for k, j in some] + [(shard.words[j], w[at + k], n[at + k]) for k, j in some]
                    one, two, three = zip(*x, strict=True) if x else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(three, pa.int64())], names=["word", "near", "near_n"])

    held = stage(words.mapInArrow(vectors, "word string, n long, vec binary"), "vectors")
    total = held.count()
    inner, shards = top(held, min(SHARD_MOST, max(SHARD_LEAST, total // 1000)))
    places = max(1, sum(s for _, s in shards.values()))
    tasks = min(places, max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // SHARD_MOST))
    rows = dealt(held, inner, shards).repartition(tasks, "shard", "slice").sortWithinPartitions("shard", "slice", "role")
    return rows.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): where the forms end. Each round doubles the steps that a word has gone.

    A form occurs more often than its word, so the chains end.
    """
    cur = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = cur.select(F.col("word").alias("root"), F.col("root").alias("far"))
        new = stage(cur.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        if new.filter("moved").isEmpty():
            return new.select("word", "root")
        cur = new.select("word", "root")
        release(cur.sparkSession)


def variants(words: DataFrame, ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for words (word, n), each once.

    n_near counts the words one edit away. The form is the one of them with the greatest n (of equal ones the least by code
    points), if it has ratio times the word's n; the root is where the forms end, the word itself if it has none.
    A word may be of any length; an empty table gives an empty result.
    """
    spark = words.sparkSession
    with scratch(spark) as keep:
        words = stage(words, "words")
        near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
        j = words.join(near, "word", "left")
        is_form = -F.col("best.minus") >= ratio * F.col("n")
        j = stage(j.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
        out = j.join(roots(j.filter("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return keep(out)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts may be null or empty (no words); repeated rows count as often as they come."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return variants(word_counts(docs, slip=199))
