"""Plug-in models, excerpts by places of terms, contexts, and the fold of ranking rules, against plain versions."""

import random

import pytest
import regex
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lorewright.operators import chain, evidence, excerpts, models, priors
from lorewright.operators.intents import EVIDENCE, INTENTS


def test_a_model_that_fails_on_some_rows(spark):
    """A batch that fails is taken row by row; what still fails is counted, and a wrong number of results is a failure."""

    def load():
        def run(texts):
            if any(t == "bad" for t in texts):
                raise ValueError("bad")
            return [[float(len(t))] for t in texts] if "short" not in texts or len(texts) == 1 else []

        return run

    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "short"), (4, None), (5, "")], "id long, t string").coalesce(1)
    seen = Observation()
    got = {r.id: (r.embedding, r.failed, r.text_length) for r in models.embedded(df, "t", models.Model("odd", "1", load), seen).collect()}
    assert got == {1: ([1.0], False, 1), 2: (None, True, 3), 3: ([5.0], False, 5), 4: (None, True, 0), 5: ([0.0], False, 0)}
    assert seen.get == {"rows": 5, "failed": 2, "characters": 9}
    assert models.embedded(df.limit(0), "t", models.hashing()).count() == 0


def test_scores_without_and_with_a_model(spark):
    df = spark.createDataFrame([("the Red fox of it", "a RED foxes"), (None, "x")], "q string, pair string")
    assert {(r.score, r.failed) for r in models.scored(df, None).collect()} == {(0.0, False)}
    assert sorted((r.score, r.failed) for r in models.scored(df, models.overlap()).collect()) == [(0.0, True), (2.0, False)]


def test_models_are_loaded_once(spark):
    loads = []
    m = models.Model("once", "1", lambda: loads.append(1) or (lambda t: t))
    assert m.function() is m.function() and models.Model("once", "1", lambda: 1 / 0).function() is m.function() and len(loads) == 1


def brute_excerpts(q, text, per_doc=2):
    text = text.strip()
    found = []
    for start in range(0, len(text), 300):
        end = min(len(text), start + 500)
        if end - start < 50:
            break
        low = text[start:end].lower()
        score = sum(t in low for t in {t.lower() for t in q.split() if len(t) > 2})
        score += sum(0.3 for k, p in EVIDENCE.items() if regex.search(INTENTS[k], q.lower()) and regex.search(p, low))
        found.append((-round(score, 9), start, end, text[start:end]))
        if end == len(text):
            break
    return [(s, e, -m, x) for m, s, e, x in sorted(found)[:per_doc]]


def test_excerpts_equal_windows_searched_one_by_one(spark):
    r = random.Random(11)
    words = ["drop", "drops", "table", "aaa", "aaaa", "É", "located", "in", "near", "max", "hit", "\n", "cave"]
    texts = ["", None, "x" * 49, "x" * 50, "aaa " * 400, "  " + "y" * 549 + "drop table"] + ["x" * r.randint(0, 300) + " ".join(r.choices(words, k=r.randint(0, 500))) for _ in range(30)]
    qs = ["Which drops", "where is it located", "aaa aaaa É max hit", ""]
    rows = [(i, j, q, t) for i, q in enumerate(qs) for j, t in enumerate(texts)]
    got = {}
    for x in excerpts.excerpts(spark.createDataFrame(rows, "query_id long, vec_id long, q string, text string")).collect():
        got.setdefault((x.query_id, x.vec_id), []).append((x.start, x.end, x.score, x.snippet))
    for i, j, q, t in rows:
        want = sorted(brute_excerpts(q, t or ""))
        assert [x[:2] + x[3:] for x in sorted(got.get((i, j), []))] == [x[:2] + x[3:] for x in want]
        assert [x[2] for x in sorted(got.get((i, j), []))] == pytest.approx([x[2] for x in want])


def test_contexts_take_the_first_hits(spark):
    hits = spark.createDataFrame([(1, k, f"t{k}", "x" * k) for k in range(1, 12)] + [(2, 1, "a", "")], "query_id long, rank int, title string, text string")
    got = {r.query_id: (r.context, r.sources, r.size) for r in excerpts.contexts(hits).collect()}
    assert got[2] == ("[1] a:\n", 1, 21)
    assert got[1] == ("\n\n".join(f"[{k}] t{k}:\n" + "x" * k for k in range(1, 9)), 8, sum(k + 22 for k in range(1, 9)))


def test_each_step_is_kept_within_its_bounds(spark):
    """A score at the upper bound does not store what is beyond it for a later step."""
    df = spark.createDataFrame([(0.99, [0.05, -0.02]), (-0.99, [-0.12, 0.05, 0.02]), (0.5, [])], "s double, d array<double>")
    got = [r[0] for r in df.select(priors.with_priors(F.col("s"), F.col("d"))).collect()]
    assert got == pytest.approx([0.98, -0.93, 0.5])


def test_pages_that_answer_nothing(spark):
    rows = [("Fox (disambiguation)", []), ("Fox (Interface item)", []), ("Fox", ["Interface items"]), ("Fox", ["x", "Disambiguation pages"]), ("Fox", ["Foxes"]), ("Fox", [])]
    df = spark.createDataFrame(rows, "title string, categories array<string>")
    assert [r[0] for r in df.select(priors.answers_nothing(F.col("title"), F.col("categories"))).collect()] == [True] * 4 + [False] * 2


def test_expansion_keeps_to_its_caps(spark):
    """Points on a line: each is near its neighbours, and the order of discovery decides who is within the caps."""
    import math

    rows = [(i, [math.cos(i / 50), math.sin(i / 50)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    cos = lambda a, b: round(sum(x * y for x, y in zip(rows[a][1], rows[b][1])), 9)

    def brute(seed, rounds, per, most, frontier):
        front, seen, out = [seed], {seed}, []
        for n in range(1, rounds + 1):
            new = []
            for a in front:
                for b in sorted((j for j in range(60) if j != a), key=lambda j: (-cos(a, j), j))[:per]:
                    if b not in seen and b not in new:
                        new.append(b)
            new = new[: most - len(out)]
            out += [(seed, b, n) for b in new]
            seen |= set(new)
            front = new[:frontier]
        return out

    seeds = spark.createDataFrame([(5,), (30,), (30,)], "seed long")
    for caps in ((2, 3, 40, 12), (3, 4, 7, 2), (4, 2, 3, 1)):
        got = evidence.expanded(df, seeds, *caps).select("seed", "vec_id", "round").collect()
        assert sorted(map(tuple, got)) == sorted(brute(5, *caps) + brute(30, *caps))


def test_tools_take_unused_titles_once(spark):
    found = [(1, 1, 1, 10, "a", 0.9), (1, 1, 2, 11, "b", 0.8), (1, 2, 1, 12, "a", 0.99), (1, 2, 2, 13, "c", 0.7), (1, 6, 1, 14, "d", 0.9), (2, 1, 1, 11, "b", 0.9)]
    df = spark.createDataFrame(found, "asker long, term long, rank int, vec_id long, title string, score double")
    used = spark.createDataFrame([(2, "b")], "asker long, title string")
    assert sorted(map(tuple, chain.tool_search(df, used).collect())) == [(1, "a", 10, 1), (1, "b", 11, 2)]
    assert [r.title for r in chain.tool_search(df, used, 0.5, 9, 1).collect()] == ["a"]
