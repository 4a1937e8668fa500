"""The pipeline, stage by stage, against plain versions of its stages on the smallest tables."""

import duckdb
from tokenizers import Tokenizer

import corpus_pipeline
from lorewright.llm import bpe, common, pii
from lorewright.llm.quality import JUDGED_SQL

from .test_operators import brute_components


def test_stages_on_smallest_tables(spark, data):
    docs = common.read(spark, data, "documents")
    columns, out = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        docs = common.stage(step(spark, docs, data), "test")
        out[name] = docs.collect()
        assert name == "encoding" or docs.columns == columns

    good = {r[0] for r in duckdb.sql(f"WITH source_docs AS (SELECT doc_id, text, lang, source FROM '{data}/documents.parquet'), {JUDGED_SQL} SELECT doc_id FROM judged WHERE kept").fetchall()}
    assert sorted(r.doc_id for r in out["quality rules"]) == sorted(good)

    groups = brute_components({r.doc_id: r.text for r in out["quality rules"]}, corpus_pipeline.PERCENT, corpus_pipeline.WIDTH)
    first = sorted(i for i, (n, c) in groups.items() if c == i or not n)
    assert sorted(r.doc_id for r in out["near-duplicates"]) == first

    before = {r.doc_id: r.text for r in out["near-duplicates"]}
    hidden = {r.doc_id: r for r in out["personal data"]}
    assert hidden.keys() == before.keys()
    for i, r in hidden.items():
        assert r.text == pii.redacted(before[i], pii.spans(before[i])) and r.n_chars == len(r.text)

    size = {i: len(r.text.encode().split()) for i, r in hidden.items()}
    taken = dict.fromkeys(size, 0)
    for r in out["source mix"]:
        taken[r.doc_id] += len(r.text.encode().split())
    assert all(taken[i] <= 2 * n for i, n in size.items())
    sources = {r.source for r in hidden.values()}
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(sources)

    lib = Tokenizer.from_file(bpe.default_path())
    want = sorted((r.doc_id, lib.encode(r.text, add_special_tokens=False).ids) for r in out["source mix"])
    assert sorted((r.doc_id, r.ids) for r in out["encoding"]) == want


def test_stages_take_odd_rows(spark, data):
    """Nulls, empty and long texts, repeated rows, columns whose names the stages use themselves, and no n_chars."""
    schema = "doc_id long, text string, lang string, source string, rec string, size string, slot string, uid string, first string, row string"
    tail = ("x",) * 6
    good = [" ".join(f"w{i}x{k}" for k in range(120)) + f"\nmail me{i}@host.org" for i in range(12)]
    rows = [(i, t, "en", "s", *tail) for i, t in enumerate(good)]
    rows += [(20, good[0], "en", "s", *tail)] * 2 + [(21, "long text of many words " * 20_000, "en", None, *tail)]
    rows += [(22, "", "en", "s", *tail), (23, None, "en", "s", *tail), (None, good[1] + " end", None, None, *tail), (None,) * 10]
    docs = spark.createDataFrame(rows, schema)
    columns, out = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        empty = step(spark, docs.limit(0), data)
        assert empty.count() == 0
        out[name] = common.stage(step(spark, docs, data), "test").collect()
        assert name == "encoding" or empty.columns == columns
    assert all(r.text for r in out["quality rules"])
    ids = [r.doc_id for r in out["near-duplicates"]]
    assert sorted(i for i in ids if i is not None) == [0, *range(1, 12), 21, 22, 23]
    hidden = [r for r in out["personal data"]]
    assert len(hidden) == len(rows) and not any("@" in (r.text or "") for r in hidden)
    assert all(r.text for r in out["source mix"]) and {r.rec for r in out["source mix"]} == {"x"}
    assert sorted(r.doc_id or -1 for r in out["encoding"]) == sorted(r[0] or -1 for r in rows)


def test_stages_called_before_any_is_written(spark, data):
    """Two results of one stage and one of another, made first and then read, in another order."""
    docs = common.read(spark, data, "documents")
    half = docs.filter("doc_id % 2 = 0")
    a, b, c = corpus_pipeline.keep_good(spark, docs, data), corpus_pipeline.keep_good(spark, half, data), corpus_pipeline.one_of_each(spark, half, data)
    assert c.count() <= half.count() and b.count() <= half.count() and a.count() >= b.count() > 0
    assert c.count() == corpus_pipeline.one_of_each(spark, half, data).count()
