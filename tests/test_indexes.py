"""Words near each other and texts that hold a name, through their indexes, against all pairs."""

import random

import pytest

from lorewright import joins
from lorewright.operators import indexes


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("short", [indexes.SHORT, 5])
def test_words_within_two(spark, monkeypatch, short):
    """Short and long words and those about the limit between them, changed by up to three letters."""
    monkeypatch.setattr(indexes, "SHORT", short)
    r = random.Random(9)
    words = {"", "a", "ab", "é"}
    for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 22, 23, 24, 25, 26, 27, 30, 45):
        for _ in range(4):
            w = "".join(r.choices("abc", k=n))
            words.add(w)
            for _ in range(3):
                for _ in range(r.randint(1, 3)):
                    k = r.randint(0, len(w))
                    w = r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abc") + w[k:], w[:k] + r.choice("abc") + w[k + 1 :]])
                words.add(w)
    words = sorted(words)
    df = spark.createDataFrame([(w,) for w in words], "a string")
    for most in (1, 2):
        got = {(x.a, x.b): x.distance for x in indexes.within_two(df, df.withColumnRenamed("a", "b"), most).collect()}
        assert got == {(a, b): n for a in words for b in words if abs(len(a) - len(b)) <= most and (n := distance(a, b)) <= most}


@pytest.mark.parametrize("whole", [True, False])
def test_texts_that_hold_a_name(spark, monkeypatch, whole):
    """Names shorter than a gram, of frequent grams only, in no text; a gram that nearly all texts have."""
    monkeypatch.setattr(joins, "BROADCAST", joins.BROADCAST if whole else 0)
    monkeypatch.setattr(joins, "HOT", 8)
    r = random.Random(10)
    texts = sorted({"the " + "".join(r.choices("abcd ", k=r.randint(0, 12))) for _ in range(150)} | {"", "é", "aaaa"})
    names = ["the", "the a", "a", "é", "ab", "abc", "dcba", "zzz", "aaa", "", "the b", " c", "bcd", "aab"]
    got = indexes.holds(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"), spark.createDataFrame([(n,) for n in [*names, None]], "needle string"))
    assert sorted(map(tuple, got.collect())) == sorted((t, n) for t in texts for n in names if n and n in t)
    assert indexes.holds(spark.createDataFrame([], "text string"), spark.createDataFrame([("a",)], "needle string")).count() == 0
    assert indexes.holds(spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([], "needle string")).count() == 0
