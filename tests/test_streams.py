"""Tables merged on reading, the served index and sessions as keyed state, each also after a restart."""

import pytest
from pyspark.sql import functions as F

from lorewright.streaming import feeds, sessions, tables

CHANGE = "title string, revid long, kind string, gone boolean"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_versions_stay_as_they_were_opened(spark, tmp_path):
    at = str(tmp_path / "t")
    put = lambda batch, *r: tables.commit(spark.createDataFrame(list(r), CHANGE), at, ["title"], "revid", batch, "gone", 4)
    assert tables.manifest(spark, at) is None
    assert put(0, ("a", 1, "new", False), ("b", 5, "new", None), ("a", 2, "edit", False)) == 1
    first = tables.snapshot(spark, at)
    assert put(1, ("b", 6, "gone", True), ("c", 1, "new", False), ("a", 1, "late", False)) == 2
    # a batch that runs again publishes nothing
    assert put(1, ("x", 9, "new", False)) == 2
    assert rows(first) == rows(tables.snapshot(spark, at, 1)) == [("a", 2, "edit"), ("b", 5, "new")]
    assert rows(tables.snapshot(spark, at)) == [("a", 2, "edit"), ("c", 1, "new")]
    # a batch writes its changes only
    assert sum(e["rows"] for e in tables.manifest(spark, at)["entries"]) == 5
    assert tables.compact(spark, at) == 3 and tables.compact(spark, at) is None
    assert {e["kind"] for e in tables.manifest(spark, at)["entries"]} == {"base"}
    assert rows(tables.snapshot(spark, at)) == [("a", 2, "edit"), ("c", 1, "new")]
    # what is older than a deletion does not come back
    assert put(2, ("b", 3, "late", False)) == 4 and rows(tables.snapshot(spark, at)) == [("a", 2, "edit"), ("c", 1, "new")]
    assert tables.vacuum(spark, at, 1) == 2 and tables.versions(spark, at) == [4]
    assert rows(tables.snapshot(spark, at)) == [("a", 2, "edit"), ("c", 1, "new")]
    with pytest.raises(Exception):
        tables.snapshot(spark, at, 1)


def test_an_empty_batch_and_two_writers(spark, tmp_path):
    at = str(tmp_path / "t")
    none = spark.createDataFrame([], CHANGE)
    assert tables.commit(none, at, ["title"], "revid", 0, "gone") == 1 and tables.snapshot(spark, at).count() == 0
    with pytest.raises(tables.Conflict):
        tables._publish(spark, at, tables.manifest(spark, at))
    assert tables.versions(spark, at) == [1] and tables.compact(spark, at) is None


def test_upserts_go_on_from_their_checkpoint(spark, tmp_path):
    src, at, cp = (str(tmp_path / x) for x in ("in", "t", "cp"))
    write = lambda *r: spark.createDataFrame(list(r), CHANGE).coalesce(1).write.mode("append").parquet(src)
    run = lambda: feeds.upsert(feeds.feed(spark, src, CHANGE, 1), at, cp, "gone").awaitTermination()
    write(("a", 1, "new", False), ("b", 1, "new", False))
    run()
    write(("b", 2, "gone", True))
    write(("c", 1, "new", False), ("a", 3, "edit", False))
    run()
    assert rows(tables.snapshot(spark, at)) == [("a", 3, "edit"), ("c", 1, "new")]
    assert len(tables.versions(spark, at)) == 2


def test_batches_are_answered_from_the_version_that_is_there(spark, tmp_path):
    src, at, out, cp = (str(tmp_path / x) for x in ("in", "t", "out", "cp"))
    ask = lambda k: spark.createDataFrame([(k,)], "k long").coalesce(1).write.mode("append").parquet(src)
    put = lambda n: tables.commit(spark.createDataFrame([(1, n)], "id long, n long"), at, ["id"], "n", n)
    run = lambda: feeds.serve(feeds.feed(spark, src, "k long", 1), at, out, cp, lambda q, t: q.join(t.select("n"))).awaitTermination()
    put(0)
    ask(1)
    run()
    put(1)
    ask(2)
    run()
    assert rows(spark.read.parquet(out).select("k", "n", "version")) == [(1, 0, 1), (2, 1, 2)]


def test_sessions_keep_their_state_over_a_restart(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    turn = "conv_id long, turn long, text string"
    write = lambda *r: spark.createDataFrame(list(r), turn).coalesce(1).write.mode("append").parquet(src)
    run = lambda: sessions.log_sessions(feeds.feed(spark, src, turn, 1), out, cp, 2).awaitTermination()
    write((1, 1, "The second brother is Dharok."), (1, 0, "hi"), (2, 0, None), (None, 0, "x"))
    run()
    # a repeat, a further statement that replaces one, another conversation
    write((1, 1, "again"), (1, 2, "The 2nd brother is Karil."), (2, 1, "and the 3rd brother is Guthan"))
    write((1, 3, "so"))
    run()
    got = {(r.conv_id, r.turn): (r.history, r.chars, r.known) for r in spark.read.parquet(out).collect()}
    assert got == {
        (1, 0): ([0], 2, []), (1, 1): ([0, 1], 31, ["2=Dharok"]), (1, 2): ([1, 2], 54, ["2=Karil"]), (1, 3): ([2, 3], 27, ["2=Karil"]),
        (2, 0): ([0], 0, []), (2, 1): ([0, 1], 29, ["3=Guthan"]),
    }
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
    assert spark.read.parquet(out).agg(F.count("*")).first()[0] == 6
