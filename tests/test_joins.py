"""Joins, running sums and grids where one key holds most rows, against plain versions."""

import random

import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from lorewright import joins
from lorewright.operators import graph, retrieval
from lorewright.staging import scratch, stage


@pytest.mark.parametrize("whole", [True, False])
def test_lookup_of_hot_and_rare_keys(spark, monkeypatch, whole):
    monkeypatch.setattr(joins, "BROADCAST", joins.BROADCAST if whole else 0)
    monkeypatch.setattr(joins, "HOT", 4)
    rows = [(0, i) for i in range(60)] + [(k, k) for k in range(1, 30)] + [(None, 1)]
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 25)], "k long, t string")
    got = joins.lookup(spark.createDataFrame(rows, "k long, x long"), table, ["k"])
    assert sorted(map(tuple, got.select("k", "x", "t").collect())) == sorted((k, x, f"t{k}") for k, x in rows if k is not None and k < 25)
    assert joins.lookup(spark.createDataFrame([], "k long, x long"), table, ["k"]).count() == 0


def test_running_sums_of_one_large_group_and_small_ones(spark):
    r = random.Random(1)
    rows = [("a", s, r.randint(1, 5)) for s in range(500)] + [("b", 3, 2), ("b", 1, 4), (None, 7, 1)]
    got = joins.running(spark.createDataFrame(rows[:-1], "g string, s long, n long"), ["g"], [F.col("s").desc()], "n").collect()
    assert len(got) == len(rows) - 1
    for x in got:
        own = [y for y in rows if y[0] == x.g]
        assert x.before == sum(n for _, s, n in own if s > x.s) and x.total == sum(n for _, _, n in own)


def test_numbers_follow_the_order_from_zero(spark):
    got = joins.numbered(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")), [F.col("x")], "n").collect()
    assert [x.x for x in sorted(got, key=lambda x: x.n)] == sorted(x.x for x in got) and sorted(x.n for x in got) == list(range(1000))


def test_each_cell_of_a_grid_is_a_task(spark):
    """One block of queries and many blocks of rows: as many tasks as cells, and each sees two blocks only."""
    left = retrieval.packed(spark.range(5).selectExpr("id as a"), ["a"], 1, "block", "left_of")
    right = retrieval.packed(spark.range(400).selectExpr("id as b"), ["b"], 12, "part", "right_of")

    def run(one, other, part):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([len(one)], pa.int64()), pa.array([len(other)], pa.int64())], names=["part", "task", "x", "y"])

    got = joins.grid(left, right, 1, 12, run, "part int, task int, x long, y long").collect()
    assert len({g.task for g in got}) == 12 and sorted(g.part for g in got) == list(range(12))
    assert {g.x for g in got} == {5} and sum(g.y for g in got) == 400


def test_search_merges_a_tree_and_keeps_to_dimensions(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 5)
    monkeypatch.setattr(retrieval, "FAN", 3)
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(3)]) for i in range(150)] + [(i, [r.gauss(0, 1) for _ in range(2)]) for i in range(150, 200)]
    rows += [(200, []), (201, None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    q = df.filter("vec_id % 40 = 0").selectExpr("vec_id as query_id", "v as q")
    got = {}
    for x in retrieval.cosine_topk(q, df, 4).collect():
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    assert sorted(got) == [0, 40, 80, 120, 160]
    for i, found in got.items():
        want = sorted((-round(cos(rows[i][1], v), 9), j) for j, v in rows if v and len(v) == len(rows[i][1]))[:4]
        assert [j for _, j in sorted(found)] == [j for _, j in want]


@pytest.mark.parametrize("limits", [(joins.BROADCAST, 4096), (0, 2)])
def test_ranks_of_hubs_against_brute_force(spark, monkeypatch, limits):
    """Half of all triples hang on one tail, with many equal scores."""
    monkeypatch.setattr(joins, "BROADCAST", limits[0])
    monkeypatch.setattr(joins, "HOT", 8)
    monkeypatch.setattr(graph, "ANSWERS", limits[1])
    monkeypatch.setattr(graph, "ROW_BLOCK", 9)
    r = random.Random(3)
    nodes = [f"n{i}" for i in range(60)]
    triples = sorted({(n, "in", "n0") for n in nodes[:40]} | {(r.choice(nodes), r.choice(["a", "b"]), r.choice(nodes)) for _ in range(60)})
    test = triples[::4]
    vec = {n: [float(r.randint(-1, 1)), float(r.randint(-1, 1))] for n in nodes}
    t = stage(spark.createDataFrame(triples, "head string, relation string, tail string"), "t")
    v = stage(spark.createDataFrame(list(vec.items()), "node string, v array<double>"), "v")
    got = {(x.head, x.relation, x.tail, x.side): (x.optimistic, x.pessimistic, x.candidates) for x in graph.filtered_ranks(t, stage(spark.createDataFrame(test, t.schema), "q"), v).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(vec[a], vec[b]))
    for h, rel, tail in test:
        for side, fixed, answer in (("tail", h, tail), ("head", tail, h)):
            right = {x[2] for x in triples if x[:2] == (h, rel)} if side == "tail" else {x[0] for x in triples if x[1:] == (rel, tail)}
            other = [dot(fixed, n) for n in nodes if n not in right]
            s = dot(fixed, answer)
            assert got[h, rel, tail, side] == (1 + sum(o > s for o in other), 1 + sum(o >= s for o in other), 1 + len(other))
    assert len(got) == 2 * len(test)


def test_propagated_means_do_not_depend_on_how_hubs_are_sent(spark, monkeypatch):
    edges = [(f"n{i}", "hub", 1.0) for i in range(30)] + [("hub", f"n{i}", 1.0) for i in range(30)] + [("n1", "n2", 2.0), ("n2", "n1", 2.0)]
    adj = stage(spark.createDataFrame(edges, "src string, dst string, weight double"), "adj")
    one = {x.node: x.v for x in graph.propagate(adj)[-1].collect()}
    monkeypatch.setattr(joins, "BROADCAST", 0)
    monkeypatch.setattr(joins, "HOT", 4)
    other = {x.node: x.v for x in graph.propagate(adj)[-1].collect()}
    assert one.keys() == other.keys() and all(a == pytest.approx(b) for n in one for a, b in zip(one[n], other[n]))


def test_scratch_deletes_what_results_do_not_read(spark):
    with scratch(spark) as keep:
        a, b = stage(spark.range(3), "a"), stage(spark.range(4), "b")
        kept = keep(b.filter("id > 0"))
    assert kept.count() == 3
    with pytest.raises(Exception):
        a.count()
