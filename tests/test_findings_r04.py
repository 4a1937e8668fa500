"""Cases of the findings of round 4; each failed before its finding was settled."""

import math
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lorewright import catalog
from lorewright.llm import toxicity
from lorewright.operators import graph, rendering
from lorewright.staging import stage


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the given tables, as they are: no rounding, with the signs of zeros."""
    c = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    want = c.sql(f"select {', '.join(df.columns)} from ({catalog.ORACLE[name]})").fetchall()
    return sorted(repr(tuple(r)) for r in df.collect()), sorted(map(repr, want))


def embeddings(vectors, labels=None):
    v = pa.array(vectors, pa.list_(pa.float32()))
    return pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": v, "label": pa.array(labels or [k % 10 for k in range(len(vectors))], pa.int32())})


def test_f6_unit_vectors_are_rounded_as_in_sql(spark, tmp_path):
    """15 / 2e9 is 7.5e-9 as a decimal, but times 1e9 it is less than 7.5; a small negative number becomes -0.0."""
    got, want = against_sql(spark, tmp_path, "l2_normalize", embeddings=embeddings([[15.0, 2e9], [-15.0, 2e9], [-1e-12, 1.0], [5.0, -2e9], [0.0, -0.0], [], [3.0, 4.0, 12.0]]))
    assert got == want


def test_f7_merged_pages_are_chosen_by_their_rounded_scores(spark, tmp_path):
    """Thirteen pages equal to six digits, the nearest last by id: ids decide, not what rounding has cut off."""
    near = [[math.cos(1e-4 * (14 - k)), math.sin(1e-4 * (14 - k))] for k in range(13)]
    got, want = against_sql(spark, tmp_path, "hybrid_merge", embeddings=embeddings([[1.0, 0.0], *near, *([0.0, 1.0] for _ in range(5))], [9, *[1] * 13, *[8] * 5]))
    assert got == want


def test_f7_merged_scores_are_those_of_sql(spark, tmp_path):
    """Cosines that end in a half of the sixth digit, for entities."""
    r = random.Random(4)
    rows = [[1.0, 0.0, 0.0, 0.0]]
    for _ in range(4000):
        x = (r.randrange(900_000, 999_999) + 0.5) / 1e6
        rows.append([x, math.sqrt(1 - x * x), 0.0, 0.0])
    got, want = against_sql(spark, tmp_path, "hybrid_merge", embeddings=embeddings(rows, [r.randrange(10) for _ in rows]))
    assert got == want


def test_f9_all_labelled_rows_are_learned_from(spark, monkeypatch):
    """Each kind of insult is in few rows only, so that a part of the rows does not tell them all; shards are small."""
    for bound in ("SAMPLE_TOXIC", "SAMPLE_CLEAN", "SAMPLE_CALIBRATE", "TEXT_WORDS"):
        monkeypatch.setattr(toxicity, bound, 10, raising=False)
    monkeypatch.setattr(toxicity, "SHARD", 400, raising=False)
    r = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    bad = [f"insult{chr(97 + k)}" for k in range(20)]
    rows = [(i, int(i % 4 == 0), " ".join(r.choices(words, k=r.choice([20, 40, 90])) + ([bad[i // 4 % 20]] if i % 4 == 0 else []))) for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    net = toxicity.train(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    toxic = {i: y for i, y, _ in rows}
    held = [x.predicted == toxic[x.doc_id] for x in toxicity.classify(docs, net).collect() if x.held_out]
    assert len(held) > 200 and sum(held) > 0.97 * len(held)


def test_f3_f5_ranks_move_shapes_not_entities(spark, monkeypatch):
    """Entities of one vector are one row of the grid of scores: 3 shapes of 600 entities, in blocks of 2 rows, make few cells."""
    cells = []
    grid = graph.grid
    monkeypatch.setattr(graph, "grid", lambda left, right, n_left, n_right, *rest: (cells.append(n_left * n_right), grid(left, right, n_left, n_right, *rest))[1])
    monkeypatch.setattr(graph, "ROW_BLOCK", 2)
    r = random.Random(6)
    vectors = {f"n{i}": [float(i % 3), 1.0 - i % 3] for i in range(600)}
    triples = sorted({(f"n{r.randrange(600)}", r.choice("ab"), f"n{r.randrange(40)}") for _ in range(900)})
    test = triples[::9]
    write = lambda rows, schema: stage(spark.createDataFrame(rows, schema), "given")
    t = write(triples, "head string, relation string, tail string")
    got = {x[:4]: x[4:] for x in map(tuple, graph.filtered_ranks(t, write(test, t.schema), write(list(vectors.items()), "node string, v array<double>")).collect())}
    assert cells and max(cells) <= 2
    score = lambda a, b: math.floor(sum(x * y for x, y in zip(vectors[a], vectors[b])) * graph.GRID + graph.SHIFT)
    for h, rel, tl in test:
        for side, fixed, answer in (("tail", h, tl), ("head", tl, h)):
            right = {(b if side == "tail" else a) for a, x, b in triples if x == rel and (a if side == "tail" else b) == fixed}
            own, others = score(fixed, answer), [score(fixed, v) for v in vectors if v not in right]
            assert got[(h, rel, tl, side)] == (1 + sum(x > own for x in others), 1 + sum(x >= own for x in others), 1 + len(others))


@pytest.mark.parametrize("name", ["template_render", "page_readable"])
def test_f2_f4_pages_are_rendered_within_their_rows(spark, data, monkeypatch, name):
    """No table of templates is staged on the way, and the pages that a small file of parts becomes are dealt over tasks."""
    monkeypatch.setattr(rendering, "PAGES", 40, raising=False)
    df = catalog.QUERIES[name](spark, data)
    assert all(f.endswith("/part.parquet") for f in df.inputFiles())
    assert df.rdd.getNumPartitions() >= 4
