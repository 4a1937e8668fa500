"""Removing passages that a document with a smaller id already has, by sorting suffixes.

A passage of LENGTH bytes is removed if it also starts in a document with a smaller id. To find such
passages all suffixes would be sorted by their first LENGTH bytes. Most of them are unlike all others,
and that is found cheaply first:

1. Every passage has an anchor, the run of ANCHOR bytes in it with the least hash. Successive passages
   mostly share their anchor; such a run of passages is handled as one, named by the hash of its anchor
   and another, independent hash of all its bytes. Runs whose bytes are those of a run in a document with
   a smaller id are removed. Runs that share the anchor of a differing run in another document stay in question.
2. The suffixes at passages in question are range-partitioned by their leading bytes (splitters from a
   sample), each partition is sorted by multikey quicksort, and neighbours with equal leading bytes are
   compared. Splitters are whole passages, so equal passages never lie on both sides of a border. Of equal
   passages all but those of the smallest id go.

A bucket of step 1 holds the runs of an interval of anchor hashes. What many documents share is combined
before it is sent, in both steps: of equal runs or passages in a batch only the smallest id's travels. A
document is told by its id and a hash of its text, so rows of one id with equal texts are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, read, release, stage, with_ids
from .hashing import INVERSE, mix, powers, prefix

LENGTH, ANCHOR = 50, 28
#: Text of a bucket of step 1, bytes scanned at once, and passages of a partition of step 2.
BUCKET_BYTES, PIECE, PART_ROWS = 8 << 20, 1 << 20, 400_000
#: Passages that are sorted and sent together in step 2.
SEND_ROWS = 1 << 20
#: Ranges of step 2 at most, so that splitters have a bound; beyond it each range is divided by a hash. Sampled
#: passages for each range, and documents of which one is sampled.
MOST_RANGES, SAMPLED, ONE_OF = 1 << 16, 24, 8
#: Text whose runs are sent together.
SEND_BYTES = 8 << 20
#: Low bits of a window's entry that hold the place; the others are the hash.
PLACE = np.uint64(28)
#: Bits of an anchor's hash that are not sent: anchors only propose what is compared.
DROPPED = np.uint64(16)


def runs(b: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first passage, last passage, hash of the anchor, hash of all bytes) of each run of passages.

    b holds texts end to end, ends their ends. No passage reaches over an end.
    """
    n, width = len(b) - length + 1, length - anchor + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return none.astype(np.int64), none.astype(np.int64), none, none
    p = prefix(b)
    grams = (p[anchor:] - p[:-anchor]) * powers(INVERSE, len(b) - anchor + 1)
    least = (grams >> PLACE) << PLACE
    least |= np.arange(len(grams), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if width > span:
        least = np.minimum(least[:n], least[width - span : width - span + n])
    at = least[:n] & np.uint64((1 << 28) - 1)
    new = np.append(True, at[1:] != at[:-1])
    valid = np.ones(n, bool)
    for e in ends[:-1]:
        valid[max(0, e - length + 1) : e] = False
        if e < n:
            new[e] = True
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(np.append((new | ~valid)[1:], True) & valid)
    anchors = at[first].astype(np.int64)
    held, digest = memoryview(np.ascontiguousarray(b)), xxhash.xxh3_64_intdigest
    whole = np.array([digest(held[f:u]) for f, u in zip(first.tolist(), (stop + length).tolist(), strict=True)], np.uint64)
    return first, stop, mix(grams[anchors]) >> DROPPED, whole


ENTRY = np.dtype([("gram", "<u8"), ("whole", "<u8"), ("doc", "<u4"), ("first", "<u4"), ("more", "u1")])


def _planes(x: np.ndarray) -> bytes:
    """The entries column by column and byte by byte, which compresses far better than rows do."""
    parts = []
    for name in ENTRY.names:
        c = np.ascontiguousarray(x[name])
        if name == "gram":
            c = np.diff(c, prepend=np.uint64(0))  # sorted
        parts.append(np.ascontiguousarray(c.view(np.uint8).reshape(len(x), -1).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _entries(z: bytes, n: int) -> np.ndarray:
    raw, out, at = zstandard.ZstdDecompressor().decompress(z, max_output_size=n * ENTRY.itemsize), np.zeros(n, ENTRY), 0
    for name in ENTRY.names:
        size = ENTRY[name].itemsize
        c = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
        out[name] = np.ascontiguousarray(c).view(ENTRY[name]).ravel()
        at += n * size
    out["gram"] = np.cumsum(out["gram"])
    return out


SENT = "bucket int, n int, entries binary, doc_ids binary, rids binary"
#: Runs of a bucket that are removed (kind 0) or in question (1), for the documents of one slice.
FOUND = "slice int, kind int, rids binary, doc_ids binary, counts binary, pairs binary"
#: The same for one document, with the number of passages.
GATHERED = "rid long, owner long, pairs binary, n long"
#: Passages in question of one range: a table of the distinct ones, and where they are. Rows with n = 0 hold runs that go.
PACKED = "part int, n int, suffixes binary, counts binary, entries binary, doc_ids binary, rids binary"


def _equal_groups(x: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries in the order of (gram, whole, id); the number of the (gram, whole) group of each, and each group's first.

    Most anchors are unlike all others, so only ties are sorted by all three.
    """
    gram = np.ascontiguousarray(x["gram"])
    order = np.argsort(gram)
    gram = gram[order]
    same = gram[1:] == gram[:-1]
    tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
    rows = order[tied]
    rows = rows[np.lexsort((ids[rows], x["whole"][rows], gram[tied]))]
    order[tied] = rows
    new = np.append(True, ~same) if len(x) else np.zeros(0, bool)
    whole = x["whole"][rows]
    new[tied[1:]] |= whole[1:] != whole[:-1]
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _by_document(doc: np.ndarray, first: np.ndarray, more: np.ndarray) -> dict[int, bytes]:
    """For each document its (first, last) passages as pairs of numbers."""
    if not len(doc):
        return {}
    order = np.argsort(doc, kind="stable")
    doc, pairs = doc[order], np.stack([first[order], first[order] + more[order]], 1).astype("<u4")
    cuts = np.flatnonzero(np.diff(doc)) + 1
    return {int(d): p.tobytes() for d, p in zip(doc[np.append(0, cuts)], np.split(pairs, cuts), strict=True)}


def send(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (rid, owner, text) to packed runs by bucket. Rows with n = 0 hold what is known to go already."""

    def pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes of about PIECE, the ends of the texts in them, whose texts these are, and where they start in these."""
        held, whose, size = [], [], 0
        for k, t in enumerate(texts):
            if len(t) < LENGTH:
                continue
            if len(t) > PIECE:
                x = np.frombuffer(t, np.uint8)
                for at in range(0, len(t) - LENGTH + 1, PIECE):
                    part = x[at : at + PIECE + LENGTH - 1]
                    yield part, np.array([len(part)]), np.array([k]), np.array([at])
                continue
            held.append(t)
            whose.append(k)
            size += len(t)
            if size >= PIECE:
                yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(h) for h in held]), np.array(whose), np.zeros(len(held), np.int64)
                held, whose, size = [], [], 0
        if held:
            yield np.frombuffer(b"".join(held), np.uint8), np.cumsum([len(h) for h in held]), np.array(whose), np.zeros(len(held), np.int64)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
        """(rids, ids, texts) of about SEND_BYTES."""
        for b in batches:
            rids, ids = b.column(0).to_numpy().astype(np.int64), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            texts, size, start = [], 0, 0
            for k, t in enumerate(b.column(2)):
                texts.append(t.as_py().encode())
                size += len(texts[-1])
                if size >= SEND_BYTES or k == b.num_rows - 1:
                    yield rids[start : k + 1], ids[start : k + 1], texts
                    texts, size, start = [], 0, k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rids, ids, texts in cut(batches):
            parts = []
            for x, ends, whose, start in pieces(texts):
                first, last, gram, whole = runs(x, ends)
                text = np.searchsorted(ends, first, side="right")
                e = np.zeros(len(first), ENTRY)
                e["gram"], e["whole"], e["doc"], e["more"] = gram, whole, whose[text], last - first
                e["first"] = first - np.append(0, ends[:-1])[text] + start[text]
                parts.append(e)
            x = np.concatenate(parts) if parts else np.zeros(0, ENTRY)
            order, group, heads = _equal_groups(x, ids[x["doc"]])
            x = x[order]
            again = ids[x["doc"]] > ids[x["doc"][heads]][group] if len(x) else np.zeros(0, bool)
            gone, x = x[again], x[~again]
            out: list[tuple] = [(int(d) % buckets, 0, p, ids[d : d + 1].tobytes(), rids[d : d + 1].tobytes()) for d, p in _by_document(gone["doc"], gone["first"], gone["more"]).items()]
            bucket = ((x["gram"] >> np.uint64(16)) * np.uint64(buckets)) >> np.uint64(32)
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in range(buckets):
                e = x[cuts[k] : cuts[k + 1]].copy()
                if len(e):
                    used, e["doc"] = np.unique(e["doc"], return_inverse=True)
                    out.append((k, len(e), _planes(e), ids[used].tobytes(), rids[used].tobytes()))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["bucket", "n", "entries", "doc_ids", "rids"])

    return docs.select("rid", "owner", "text").mapInArrow(run, SENT)


def _per_slice(kind: int, rid: np.ndarray, own: np.ndarray, pairs: np.ndarray, slices: int) -> Iterator[tuple]:
    """Rows of FOUND, one for each slice of documents that has any of these (first, last) passages."""
    part = (rid.view(np.uint64) % np.uint64(slices)).astype(np.int64)
    order = np.lexsort((own, rid, part))
    part, rid, own, pairs = part[order], rid[order], own[order], pairs[order]
    edges = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else [], len(part)).astype(np.int64)
    for start, stop in zip(edges[:-1], edges[1:], strict=True):
        r, o = rid[start:stop], own[start:stop]
        heads = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (o[1:] != o[:-1])))
        counts = np.diff(np.append(heads, stop - start))
        yield int(part[start]), kind, r[heads].tobytes(), o[heads].tobytes(), counts.astype("<u4").tobytes(), pairs[start:stop].astype("<u4").tobytes()


def _found(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 6
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = ("slice", "kind", "rids", "doc_ids", "counts", "pairs")
    return pa.table({name: pa.array(c, k) for name, c, k in zip(names, columns, kinds, strict=True)})


def settle(slices: int) -> Callable[[pa.Table], pa.Table]:
    """One bucket: what goes, and what stays in question, in a row for each slice of documents."""

    def run(rows: pa.Table) -> pa.Table:
        parts, ids, rids, base = [], [], [], 0
        known: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for n, entries, i, r in zip(rows["n"].to_pylist(), rows["entries"], rows["doc_ids"], rows["rids"], strict=True):
            i, r = np.frombuffer(i.as_py(), np.int64), np.frombuffer(r.as_py(), np.int64)
            if n:
                e = _entries(entries.as_py(), n)
                e["doc"] += base
                parts.append(e)
                ids.append(i)
                rids.append(r)
                base += len(i)
            else:
                pairs = np.frombuffer(entries.as_py(), "<u4").reshape(-1, 2)
                known.append((np.repeat(r, len(pairs)), np.repeat(i, len(pairs)), pairs))
        out: list[tuple] = []
        if parts:
            x, ids, rids = np.concatenate(parts), np.concatenate(ids), np.concatenate(rids)
            order, group, heads = _equal_groups(x, ids[x["doc"]])
            x, own = x[order], ids[x["doc"][order]]
            again = own > own[heads][group]
            # anchors with differing runs and more than one document
            gram_new = np.append(True, x["gram"][1:] != x["gram"][:-1])
            gram, starts = np.cumsum(gram_new) - 1, np.flatnonzero(gram_new)
            kinds = np.bincount(gram[heads], minlength=len(starts))
            mixed = (kinds > 1) & (np.maximum.reduceat(own, starts) != np.minimum.reduceat(own, starts))
            asked = ~again & mixed[gram]
            pairs = np.stack([x["first"], x["first"] + x["more"]], 1)
            known.append((rids[x["doc"][again]], own[again], pairs[again]))
            out += _per_slice(1, rids[x["doc"][asked]], own[asked], pairs[asked], slices)
        if known:
            out += _per_slice(0, *(np.concatenate(z) for z in zip(*known, strict=True)), slices)
        return _found(out)

    return run


def _gather(rows: pa.Table) -> pa.Table:
    """One slice of documents: the runs of each document from all buckets."""
    rid, own, counts, pairs = (np.frombuffer(b"".join(rows[c].to_pylist()), t) for c, t in (("rids", np.int64), ("doc_ids", np.int64), ("counts", "<u4"), ("pairs", "<u4")))
    rid, own, pairs = np.repeat(rid, counts), np.repeat(own, counts), pairs.reshape(-1, 2)
    order = np.lexsort((own, rid))
    rid, own, pairs = rid[order], own[order], pairs[order]
    heads = np.flatnonzero(np.append(True, (rid[1:] != rid[:-1]) | (own[1:] != own[:-1])))
    n = np.add.reduceat(pairs[:, 1].astype(np.int64) - pairs[:, 0] + 1, heads)
    return pa.table({"rid": rid[heads], "owner": own[heads], "pairs": pa.array([p.tobytes() for p in np.split(pairs, heads[1:])], pa.binary()), "n": n})


def gather(found: DataFrame) -> DataFrame:
    """GATHERED from rows of FOUND of one kind."""
    return found.groupBy("slice").applyInArrow(_gather, GATHERED)


def _positions(pairs: bytes) -> np.ndarray:
    p = np.frombuffer(pairs, "<u4").reshape(-1, 2).astype(np.int64)
    size = p[:, 1] - p[:, 0] + 1
    return np.repeat(p[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())


def splitters(asked: DataFrame, rows: int, parts: int) -> np.ndarray:
    """Sorted passages that cut those in question into about so many ranges. asked: (rid, owner, text, pairs)."""
    ranges = min(parts, MOST_RANGES)
    if ranges <= 1:
        return np.zeros(0, f"S{LENGTH}")
    stride = np.uint64(max(1, rows // ONE_OF // (ranges * SAMPLED)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in range(b.num_rows):
                x, at = np.frombuffer(b.column(2)[k].as_py().encode(), np.uint8), _positions(b.column(3)[k].as_py())
                at = at[mix(at.astype(np.uint64) + np.uint64(b.column(0)[k].as_py() % 2**64)) % stride == 0]
                out += [w.tobytes() for w in np.lib.stride_tricks.sliding_window_view(x, LENGTH)[at]]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["suffix"])

    some = asked.mapInArrow(run, "suffix binary").toArrow()["suffix"].to_pylist()
    some = np.sort(np.array(some, f"S{LENGTH}"))
    return np.unique(some[np.linspace(0, len(some), ranges + 1)[1:-1].astype(np.int64)]) if len(some) else some


def pack(asked: DataFrame, cuts: np.ndarray, parts: int) -> DataFrame:
    """Passages in question, sorted and combined in batches, to PACKED rows by range. asked: (rid, owner, text, pairs)."""
    shared = asked.sparkSession.sparkContext.broadcast(cuts)
    sub = np.uint64(max(1, -(-parts // (len(cuts) + 1))))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        """(passages, place in its text, number of its document, ids, rids) of about SEND_ROWS passages."""
        held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
        size = 0

        def joined() -> tuple[np.ndarray, ...]:
            raw = np.zeros((size, -(-LENGTH // 8) * 8), np.uint8)
            raw[:, :LENGTH] = np.concatenate([h[0] for h in held])
            doc = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
            return raw, np.concatenate([h[1] for h in held]), doc, np.array([h[2] for h in held], np.int64), np.array([h[3] for h in held], np.int64)

        for b in batches:
            for rid, own, text, pairs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, at = np.lib.stride_tricks.sliding_window_view(np.frombuffer(text.encode(), np.uint8), LENGTH), _positions(pairs)
                for k in range(0, len(at), SEND_ROWS):
                    held.append((x[at[k : k + SEND_ROWS]], at[k : k + SEND_ROWS], own, rid))
                    size += len(held[-1][1])
                    if size >= SEND_ROWS:
                        yield joined()
                        held, size = [], 0
        if held:
            yield joined()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for raw, at, doc, ids, rids in chunks(batches):
            words = raw.view(">u8").astype(np.uint64)
            order = multikey_order(words, ids[doc])
            words, raw, at, doc = words[order], raw[order], at[order], doc[order]
            new = np.append(True, (words[1:] != words[:-1]).any(axis=1))
            group, heads = np.cumsum(new) - 1, np.flatnonzero(new)
            gone = ids[doc] > ids[doc[heads]][group]
            out: list[tuple] = [(d % parts, 0, p, b"", b"", ids[d : d + 1].tobytes(), rids[d : d + 1].tobytes()) for d, p in _by_document(doc[gone], at[gone], np.zeros(int(gone.sum()), np.int64)).items()]
            at, doc, group = at[~gone], doc[~gone], group[~gone]
            # places side by side that hold one and the same passage, as in a run of one byte, are one entry
            first = np.append(True, (group[1:] != group[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1))
            starts = np.flatnonzero(first)
            more = np.diff(np.append(starts, len(at))) - 1
            at, doc, group = at[starts], doc[starts], group[starts]
            part = np.searchsorted(shared.value, np.ascontiguousarray(raw[heads, :LENGTH]).view(f"S{LENGTH}").ravel(), side="right").astype(np.uint64)
            if sub > 1:
                part = part * sub + mix(np.bitwise_xor.reduce(mix(words[heads] + np.arange(words.shape[1], dtype=np.uint64)), axis=1)) % sub
            counts = np.bincount(group, minlength=len(heads))
            by = np.argsort(part, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, np.diff(part[by]) > 0)), len(by))
            offsets = np.append(0, np.cumsum(counts))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                mine = by[a:b]
                size = counts[mine]
                e = np.repeat(offsets[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
                used, d = np.unique(doc[e], return_inverse=True)
                entries = b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in (d, at[e], more[e]))
                out.append((int(part[mine[0]]), len(mine), z.compress(raw[heads[mine], :LENGTH].tobytes()), z.compress(size.astype("<u4").tobytes()), z.compress(entries), ids[used].tobytes(), rids[used].tobytes()))
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[2:])], names=["part", "n", "suffixes", "counts", "entries", "doc_ids", "rids"])

    return asked.mapInArrow(run, PACKED)


def multikey_order(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The order of rows of big-endian words, then of ids: by the first word, and rows that tie on it by
    the next, as multikey quicksort does with characters of eight bytes."""
    order = np.argsort(words[:, 0], kind="stable")
    tie = np.append(False, words[order[1:], 0] == words[order[:-1], 0])
    for depth in range(1, words.shape[1] + 1):
        # rows of groups that are still undecided, and the number of their group
        open_ = tie | np.append(tie[1:], False)
        if not open_.any():
            break
        place = np.flatnonzero(open_)
        rows, group = order[place], np.cumsum(~tie[place])
        key = words[rows, depth] if depth < words.shape[1] else ids[rows]
        inner = np.lexsort((key, group))
        order[place] = rows[inner]
        key = key[inner]
        same = np.append(False, key[1:] == key[:-1]) & tie[place]
        tie[place] = same
    return order


def sort_range(slices: int) -> Callable[[pa.Table], pa.Table]:
    """One range of suffixes, sorted: what goes, in a row for each slice of documents."""

    def run(rows: pa.Table) -> pa.Table:
        z, known, held, base = zstandard.ZstdDecompressor(), [], [], 0
        for n, suffix, counts, entries, i, r in zip(*(rows[c].to_pylist() for c in ("n", "suffixes", "counts", "entries", "doc_ids", "rids")), strict=True):
            i, r = np.frombuffer(i, np.int64), np.frombuffer(r, np.int64)
            if not n:
                pairs = np.frombuffer(suffix, "<u4").reshape(-1, 2)
                known.append((np.repeat(r, len(pairs)), np.repeat(i, len(pairs)), pairs))
                continue
            counts = np.frombuffer(z.decompress(counts), "<u4").astype(np.int64)
            d, at, more = (np.ascontiguousarray(c.reshape(4, -1).T).view("<u4").ravel() for c in np.split(np.frombuffer(z.decompress(entries), np.uint8), 3))
            # all places of a passage in a batch are of one doc_id
            held.append((np.frombuffer(z.decompress(suffix), np.uint8).reshape(n, LENGTH), i[d[np.cumsum(counts) - counts]], counts, r[d], i[d], at, more))
        if held:
            suffix, ids, counts, rid, own, at, more = (np.concatenate(c) for c in zip(*held, strict=True))
            raw = np.zeros((len(suffix), -(-LENGTH // 8) * 8), np.uint8)
            raw[:, :LENGTH] = suffix
            words = raw.view(">u8").astype(np.uint64)
            order = multikey_order(words, ids)
            words = words[order]
            new = np.append(True, (words[1:] != words[:-1]).any(axis=1))
            least = ids[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            gone = np.zeros(len(ids), bool)
            gone[order] = ids[order] > least
            gone = np.repeat(gone, counts)
            known.append((rid[gone], own[gone], np.stack([at[gone], at[gone] + more[gone]], 1)))
        return _found(list(_per_slice(0, *(np.concatenate(c) for c in zip(*known, strict=True)), slices)) if known else [])

    return run


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document.

    Null text counts as empty. Rows with one doc_id take nothing from each other; a null doc_id is smaller
    than all others. Passages are judged on the input. Texts of any length; an empty table gives an empty result.
    Other columns of docs, whatever their names, are not read.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("owner"), F.xxhash64("text").alias("rid"), "text")
    key = ["rid", "owner"]
    long_ = d.filter(F.octet_length("text") >= LENGTH)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    # as many slices of documents as buckets: a slice takes one row of each bucket at most, and holds the runs of some BUCKET_BYTES
    settled = stage(send(long_, buckets).groupBy("bucket").applyInArrow(settle(buckets), FOUND), "settled")
    release(docs.sparkSession)
    question = stage(gather(settled.filter("kind = 1")), "question")
    rows = question.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(1, -(-rows // PART_ROWS))
    asked = lambda q: with_ids(long_, stage(q.select(*key), "keys"), key).join(q.drop("n"), key).select(*key, "text", "pairs")
    cuts = splitters(asked(question.filter(F.pmod(F.xxhash64("rid", "owner"), F.lit(ONE_OF)) == 0)), rows, parts) if parts > 1 else np.zeros(0, f"S{LENGTH}")
    again = stage(pack(asked(question), cuts, parts).groupBy("part").applyInArrow(sort_range(buckets), FOUND), "again")
    release(docs.sparkSession)
    gone = stage(gather(settled.filter("kind = 0").unionByName(again)).select(*key, F.col("pairs").alias("removed")), "gone")
    keys = stage(gone.select(*key), "keys")
    for table in (settled, question, again):
        discard(table)
    release(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for t, removed in zip(b.column(1), b.column(2), strict=True):
                raw, removed = t.as_py().encode(), removed.as_py()
                kept, n, spans = raw, 0, 0
                if removed:
                    pairs = np.frombuffer(removed, "<u4").reshape(-1, 2).astype(np.int64)
                    edges = np.bincount(pairs[:, 0], minlength=len(raw) + 1) - np.bincount(pairs[:, 1] + LENGTH, minlength=len(raw) + 1)
                    out = np.cumsum(edges[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~out].tobytes()
                    n, spans = int(out.sum()), int(np.count_nonzero(np.diff(out.astype(np.int8), prepend=0) == 1))
                for c, v in zip(columns, (len(raw), n, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    columns[c].append(v)
            kinds = {"kept_sha256": pa.string(), "kept": pa.binary()}
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, kinds.get(c, pa.int64())) for c, v in columns.items())], names=["doc_id", *columns])

    # texts that lose nothing stay where they are
    whole = with_ids(d, keys, key, "left_anti").select("doc_id", "text", F.lit(None).cast("binary").alias("removed"))
    j = with_ids(d, keys, key).join(gone, key).select("doc_id", "text", "removed").unionByName(whole)
    return j.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents")).drop("kept")
