import random

import pytest

from lorewright.llm import mixing


def reshare(sizes):
    """Targets by resharing the excess again and again. sizes: by source in rank order."""
    weights = [mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i in range(len(sizes))]
    caps, total = [mixing.MOST * s for s in sizes], mixing.SHARE * sum(sizes)
    full = set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        if not free:
            return caps
        left = total - sum(caps[i] for i in full)
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > caps[i]}
        if not over:
            return [caps[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


@pytest.mark.parametrize("sizes", [[10] * 20, [1000, 1, 1, 1, 50], [0, 0, 7], [5], [3, 300, 30, 3000, 2, 900, 0]])
def test_targets_are_those_of_resharing(spark, sizes):
    rows = spark.createDataFrame([(f"s{i:02d}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    want = reshare(sizes)
    assert [got[f"s{i:02d}"] for i in range(len(sizes))] == pytest.approx(want)


def docs(spark, n=300):
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 40, 900]))), rng.choice(["b", "b", "b", "a", "ä", None]), "clash", 1) for i in range(n)]
    rows += [(7, None, "a", "clash", 1), (8, "", None, "clash", 1), (9, "x y z", "c", "clash", 1), (9, "x y z", "c", "clash", 1), (None, "one", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string, rank int")


@pytest.mark.parametrize("block", [7, 64, 5000])
def test_each_source_takes_its_target(spark, block):
    laid, pieces = mixing.mix(docs(spark), block=block)
    words, size, target = {}, {}, {}
    at = {r.uid: r for r in laid.collect()}
    taken = dict.fromkeys(at, 0)
    slots = set()
    for r in pieces.collect():
        taken[r.uid] += r.words
        slots.add(r.slot)
    for uid, r in at.items():
        assert taken[uid] <= 2 * r.size
        words[r.rank] = words.get(r.rank, 0) + taken[uid]
        size[r.rank], target[r.rank] = r.source_size, r.target
    for k in words:
        assert words[k] == int(target[k])
    assert sum(words.values()) == pytest.approx(1.5 * sum(size.values()), abs=len(size))
    assert len(slots) == (sum(-(-int(t) // block) for t in target.values()))


def test_reruns_agree_and_slots_interleave(spark):
    one, two = (sorted((r.slot, r.first, r.words) for r in mixing.mix(docs(spark))[1].collect()) for _ in range(2))
    assert one == two
    laid, pieces = mixing.mix(docs(spark), block=64)
    rows = pieces.join(laid, "uid").select("slot", "rank").distinct().orderBy("slot").collect()
    share = sum(r["rank"] == 2 for r in rows) / len(rows)
    half = rows[: len(rows) // 2]
    assert abs(sum(r["rank"] == 2 for r in half) / len(half) - share) < 0.05


def test_empty_table(spark):
    laid, pieces = mixing.mix(docs(spark).limit(0))
    assert laid.count() == pieces.count() == 0
