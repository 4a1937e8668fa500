"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard.

Vectors go to shards of about SHARD rows by a hash of their id. A shard's graph is kept as flat arrays:
the distinct vectors with the ids of each, and for each level the members and a fixed number of neighbours
of each. Queries, in blocks, search every shard from the top level down; the nearest of all shards are
merged. A query whose search ends among vectors that are about equally near, where links lead nowhere in
particular, is compared with the whole shard.

Nearness is the inner product. Graphs are built on vectors with one more coordinate that makes all
norms of a shard equal, so that nearness in the graph is a proper distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import read, stage

#: Rows of a shard, and queries of a block.
SHARD, BLOCK = 8192, 512
#: Neighbours of a node, candidates they are chosen from, share of a level in the next, search width.
LINKS, CANDIDATES, THIN, WIDTH = 32, 64, 16, 128
#: A search has ended in a dense place if the scores from the last wanted to the last found differ by no more
#: than this share of the greatest possible score.
DENSE = 0.02


def neighbours(x: np.ndarray) -> np.ndarray:
    """(n, LINKS) neighbours of each row, -1 where there are fewer.

    Of the nearest CANDIDATES those come first that are nearer to the node than to any chosen before;
    half the places go to such, the rest to the nearest and to nodes that chose this one.
    """
    n = len(x)
    k = min(CANDIDATES, n - 1)
    links = np.full((n, LINKS), -1, np.int32)
    if k <= 0:
        return links
    near, sims = np.empty((n, k), np.int32), np.empty((n, k), np.float32)
    for at in range(0, n, 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(s, top, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        near[at : at + 512], sims[at : at + 512] = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    half = LINKS // 2
    chosen = np.zeros((n, k), bool)
    for at in range(0, n, 256):
        c = x[near[at : at + 256]]
        between = np.einsum("nid,njd->nij", c, c, optimize=True)
        own, blocked, count = sims[at : at + 256], np.zeros((len(c), k), bool), np.zeros(len(c), int)
        for i in range(k):
            take = ~blocked[:, i] & (count < half)
            chosen[at : at + 256, i] = take
            count += take
            # a later candidate that is nearer to this one than to the node is not needed
            blocked |= take[:, None] & (between[:, i, :] > own)
    rank = np.where(chosen, 0, 1)
    order = np.argsort(rank, axis=1, kind="stable")[:, :half]
    mine = np.take_along_axis(near, order, 1)
    a, b = np.repeat(np.arange(n, dtype=np.int32), mine.shape[1]), mine.ravel()
    # both directions; of a node's links its own come first, then those from others by nearness
    src, dst = np.concatenate([a, b]), np.concatenate([b, a])
    own_first = np.concatenate([np.zeros(len(a), np.int8), np.ones(len(b), np.int8)])
    near_by = np.einsum("nd,nd->n", x[src], x[dst])
    order = np.lexsort((-near_by, own_first, src))
    src, dst = src[order], dst[order]
    key = src.astype(np.int64) * n + dst
    _, first = np.unique(key, return_index=True)
    keep = np.zeros(len(src), bool)
    keep[first] = True
    src, dst = src[keep], dst[keep]
    place = np.arange(len(src)) - np.searchsorted(src, src)
    fit = place < LINKS
    links[src[fit], place[fit]] = dst[fit]
    return links


def build(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the bottom up: (members, their neighbours as places among the members)."""
    levels, members = [], np.arange(len(x), dtype=np.int32)
    rng = np.random.default_rng(len(x))
    while True:
        levels.append((members, neighbours(x[members])))
        if len(members) <= 2 * THIN:
            return levels
        members = np.sort(rng.choice(members, max(1, len(members) // THIN), replace=False))


def search(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]], q: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """(queries, up to width) rows found near to each query, -1 where there are fewer. All queries at once."""
    n = len(q)
    found = np.repeat(levels[-1][0][None, :width], n, 0)
    for members, links in reversed(levels):
        v = x[members]
        place = np.full(len(x) + 1, -1, np.int32)
        place[members] = np.arange(len(members), dtype=np.int32)
        beam = place[found]  # entry points; all are members here, as levels are nested
        seen = np.zeros((n, len(members) + 1), bool)
        np.put_along_axis(seen, beam, True, 1)
        seen[:, -1] = True
        score = np.where(beam >= 0, np.einsum("nkd,nd->nk", v[beam], q), -np.inf)
        done = beam < 0
        while True:
            open_score = np.where(done, -np.inf, score)
            step = np.argsort(-open_score, axis=1)[:, :4]
            live = np.take_along_axis(open_score, step, 1) > -np.inf
            active = np.flatnonzero(live.any(axis=1))
            if not len(active):
                break
            step, live = step[active], live[active]
            d = done[active]
            np.put_along_axis(d, step, True, 1)
            done[active] = d
            nodes = np.take_along_axis(beam[active], step, 1)
            new = np.where(live[:, :, None], links[nodes], -1).reshape(len(active), -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            s = seen[active]
            new[np.take_along_axis(s, new, 1)] = -1
            np.put_along_axis(s, new, True, 1)
            seen[active] = s
            value = np.where(new >= 0, np.einsum("nkd,nd->nk", v[new], q[active], optimize=True), -np.inf)
            b, w = np.concatenate([beam[active], new], 1), np.concatenate([score[active], value], 1)
            d = np.concatenate([done[active], new < 0], 1)
            top = np.argsort(-w, axis=1)[:, :width]
            b, w, d = (np.take_along_axis(z, top, 1) for z in (b, w, d))
            if beam.shape[1] < b.shape[1]:
                more = b.shape[1] - beam.shape[1]
                beam = np.pad(beam, ((0, 0), (0, more)), constant_values=-1)
                score = np.pad(score, ((0, 0), (0, more)), constant_values=-np.inf)
                done = np.pad(done, ((0, 0), (0, more)), constant_values=True)
            beam[active, : b.shape[1]], score[active, : b.shape[1]], done[active, : b.shape[1]] = b, w, d
        found = np.where(beam >= 0, members[beam], -1)
    return found


def whole(x: np.ndarray, first: np.ndarray, q: np.ndarray, width: int) -> np.ndarray:
    """The width rows of x that are nearest to one query, by all scores; ties go to the smaller of first."""
    return np.lexsort((first, -np.einsum("kd,d->k", x, q)))[:width]


#: vectors holds the distinct ones as they were given, in double precision.
INDEX = "shard long, dim int, ids binary, starts binary, vectors binary, levels array<struct<members binary, links binary>>"


def widened(x: np.ndarray) -> np.ndarray:
    """x in single precision with one more coordinate, by which all rows have one norm."""
    norm = (x * x).sum(axis=1)
    return np.column_stack([x, np.sqrt(np.maximum(norm.max() - norm, 0))]).astype(np.float32)


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    """A column of lists of one length as an array."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    ids = rows["vec_id"].to_numpy()
    x, place = np.unique(matrix(rows["embedding"], len(ids)), axis=0, return_inverse=True)
    order = np.lexsort((ids, place.ravel()))
    ids, starts = ids[order], np.append(0, np.cumsum(np.bincount(place.ravel())))
    levels = [{"members": m.tobytes(), "links": k.tobytes()} for m, k in build(widened(x))]
    kind = pa.list_(pa.struct([("members", pa.binary()), ("links", pa.binary())]))
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([key[1].as_py()], pa.int32()), "ids": [ids.tobytes()], "starts": [starts.astype(np.int64).tobytes()], "vectors": [x.tobytes()], "levels": pa.array([levels], kind)})


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, embedding as array<double>, dim) without vectors that are null, zero, or hold null or non-finite components.

    One row for each vec_id: of rows that repeat an id the least vector stands, by its components in order. Rows
    without an id take no part.
    """
    e = F.col(embedding).cast("array<double>")
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), e.alias("embedding"))
    v = v.filter(F.col("vec_id").isNotNull() & F.forall("embedding", fine) & F.exists("embedding", lambda c: c != 0))
    v = v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return v.withColumn("dim", F.size("embedding"))


def build_index(vectors: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """One row per shard, holding its graph as flat arrays."""
    shards = max(1, -(-vectors.count() // shard_rows))
    v = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)))
    return v.groupBy("shard", "dim").applyInArrow(_build_shard, INDEX)


def nearest(index: DataFrame, queries: DataFrame, k: int = 20, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, other than itself.

    Scores are inner products in double precision; ties go to the smaller vec_id. Vectors of another
    dimension than the query are no candidates. Without vectors or queries the result is empty. Other columns
    of the table, whatever their names, are not read.
    """

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        empty = {"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())}
        if not left.num_rows or not right.num_rows:
            return pa.table(empty)
        ids = np.frombuffer(left["ids"][0].as_py(), np.int64)
        starts = np.frombuffer(left["starts"][0].as_py(), np.int64)
        plain = np.frombuffer(left["vectors"][0].as_py(), np.float64).reshape(len(starts) - 1, -1)
        x = widened(plain)
        levels = []
        for level in left["levels"][0].as_py():
            members = np.frombuffer(level["members"], np.int32)
            levels.append((members, np.frombuffer(level["links"], np.int32).reshape(len(members), -1)))
        own, q = right["vec_id"].to_numpy(), matrix(right["embedding"], right.num_rows)
        found = search(x, levels, np.column_stack([q, np.zeros(len(q))]).astype(np.float32))
        first = ids[starts[:-1]]
        # k + 1 vectors of k + 1 ids each suffice, as one id may be the query's own
        few = min(k + 1, found.shape[1])
        exact = np.where(found < 0, -np.inf, np.einsum("nkd,nd->nk", plain[found], q))
        part = -np.sort(-exact, axis=1)
        reach = np.sqrt((x[0].astype(np.float64) ** 2).sum() * (q * q).sum(axis=1))
        short = (found >= 0).sum(axis=1) < min(WIDTH, len(x))
        for i in np.flatnonzero(short | (part[:, few - 1] - part[:, -1] <= DENSE * reach)):
            near = whole(plain, first, q[i], found.shape[1])
            found[i] = -1
            found[i, : len(near)] = near
        exact = np.where(found < 0, -np.inf, np.einsum("nkd,nd->nk", plain[found], q))
        order = np.lexsort((first[found], -exact), axis=1)[:, :few]
        exact, found = np.take_along_axis(exact, order, 1), np.take_along_axis(found, order, 1)
        at = starts[found][:, :, None] + np.arange(k + 1)
        held = (at < starts[found + 1][:, :, None]) & (exact > -np.inf)[:, :, None]
        member = ids[np.where(held, at, 0)].reshape(len(q), -1)
        exact = np.where(held, exact[:, :, None], -np.inf).reshape(len(q), -1)
        exact[member == own[:, None]] = -np.inf
        order = np.lexsort((member, -exact), axis=1)[:, :k]
        score, near = np.take_along_axis(exact, order, 1), np.take_along_axis(member, order, 1)
        ok = score > -np.inf
        return pa.table({"query_id": np.repeat(own, ok.sum(axis=1)), "vec_id": near[ok], "score": score[ok]})

    # every block of queries meets every shard of its dimension once
    places = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-queries.count() // block))))
    q = stage(queries.select("vec_id", "embedding", "dim", places.alias("block")), "queries")
    blocks = q.select("dim", "block").distinct()
    left = index.join(blocks, "dim")
    shards = index.select(F.col("shard").alias("q_shard"), F.col("dim").alias("q_dim"))
    right = q.join(shards, F.col("dim") == F.col("q_dim")).select("q_shard", "q_dim", F.col("block").alias("q_block"), "vec_id", "embedding")
    found = left.groupBy("shard", "dim", "block").cogroup(right.groupBy("q_shard", "q_dim", "q_block")).applyInArrow(run, "query_id long, vec_id long, score double")
    by = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stage(valid(read(spark, sf_dir, "embeddings")), "vectors")
    return nearest(stage(build_index(v), "index"), v.filter("vec_id % 20 = 0"))
