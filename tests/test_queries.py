"""Every registered query with SQL gives the rows that DuckDB gives on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lorewright import catalog
from lorewright.operators import graph, retrieval
from lorewright.sources import files
from lorewright.streaming import feeds, tables


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return [shown(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows_as_sql(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(str([shown(r[c]) for c in cols]) for r in df.collect())
    r = duck.sql(catalog.ORACLE[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted(str([shown(x[i]) for i in at]) for x in r.fetchall())


def test_stream_keeps_latest_revision(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "title string, revid long, ts timestamp, kind string"
    for part in ([("a", 1, "new"), ("b", 1, "new")], [("a", 3, "edit"), ("a", 2, "edit")]):
        spark.createDataFrame(part, "title string, revid long, kind string").selectExpr("title", "revid", "current_timestamp() as ts", "kind").coalesce(1).write.mode("append").parquet(src)
    target = str(tmp_path / "out")
    feeds.upsert(feeds.feed(spark, src, schema, 1), target, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.title, r.revid) for r in tables.snapshot(spark, target).collect()) == [("a", 3), ("b", 1)]


def test_lines_are_read_in_their_order_and_bad_ones_skipped(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(['{"conv_id": 1, "turn": 1}', "", "not json", '{"conv_id": 2, "turn"', '{"conv_id": 3, "turn": 2}']))
    read = lambda n=None: sorted(r.conv_id for r in files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "conv_id long, turn long", n).collect())
    assert read() == [1, 3] and read(4) == [1] and read(5) == [1, 3]


def test_triples_and_titles_come_back_from_files(spark, tmp_path):
    t = spark.createDataFrame([('a "b"', "r,s", "c\nd", "x", "1"), (" e ", "r", "f", "x", "2"), ("g", " ", "h", "x", "3")], files.TRIPLE)
    files.write_triples(t, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_triples(spark, str(tmp_path / "t")).collect())) == [('a "b"', "r,s", "c\nd"), ("e", "r", "f")]
    files.write_titles(spark.createDataFrame([("b",), ("a",), ("a",)], "title string"), str(tmp_path / "n"))
    assert sorted(r.title for r in files.read_titles(spark, str(tmp_path / "n")).collect()) == ["a", "b"]


def test_search_takes_all_blocks_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "ROW_BLOCK", 7)
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)] + [(60, [0.0, 0.0, 0.0]), (61, None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    q = df.filter("vec_id % 5 = 0").selectExpr("vec_id as query_id", "v as q")
    got = {}
    for r in retrieval.cosine_topk(q, df, 4, exclude_self=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    for i, v in rows[:61:5]:
        want = sorted((-round(sum(a * b for a, b in zip(v, w)) / norm(v) / norm(w), 9), j) for j, w in rows[:61] if j != i)[:4]
        assert [(j, pytest.approx(-s)) for s, j in want] == [(j, s) for _, j, s in sorted(got[i])]


def test_streams_see_repeats_and_what_they_hold_already(spark, tmp_path):
    src, schema = str(tmp_path / "in"), "source string, text string"
    for part in ([("s", "one"), ("s", "two"), ("s", "one")], [("s", "two"), ("s", "three")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    model = lambda df: df.selectExpr("key", "length(text) as size")
    feeds.embed(feeds.feed(spark, src, schema, 1), str(tmp_path / "index"), str(tmp_path / "cp"), model).awaitTermination()
    assert sorted(r["size"] for r in tables.snapshot(spark, str(tmp_path / "index")).collect()) == [3, 3, 5]


def test_factors_tell_groups_apart(spark):
    edges = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(8) for j in range(8) if i != j and (i + j) % 5]
    adj = spark.createDataFrame(edges, "src string, dst string, weight double")
    ids = spark.createDataFrame([(f"{g}{i}", n * 8 + i) for n, g in enumerate("ab") for i in range(8)], "label string, id long")
    v = {r.node: r.v for r in graph.factors(adj, ids, rank=4).collect()}
    dot = lambda x, y: sum(a * b for a, b in zip(v[x], v[y]))
    same = [dot(f"{g}{i}", f"{g}{j}") for g in "ab" for i in range(8) for j in range(i)]
    other = [dot(f"a{i}", f"b{j}") for i in range(8) for j in range(8)]
    assert len(v) == 16 and sum(same) / len(same) > 2 * abs(sum(other) / len(other))


def test_registered_factors_cover_the_graph(spark, data):
    v = catalog.QUERIES["kg_factors"](spark, data)
    nodes = catalog.QUERIES["kg_adjacency"](spark, data).select("src").distinct()
    assert v.count() == nodes.count() and v.join(nodes, v["node"] == nodes["src"], "left_anti").count() == 0


def test_past_issues_stand_once(spark):
    from lorewright.operators import rendering as templates

    now = spark.createDataFrame([(1, "x"), (2, "x"), (2, "x")], "page long, issue string")
    past = spark.createDataFrame([(2, "x"), (3, "x"), (3, "x")], "page long, issue string")
    assert sorted(map(tuple, templates.with_past(now, past, "page").collect())) == [(1, "x", "found"), (2, "x", "found"), (3, "x", "past")]
    assert templates.with_past(now.limit(0), past.limit(0), "page").count() == 0
