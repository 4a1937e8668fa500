"""Indexes that turn fuzzy conditions into joins by equality: words by what is left of them without a letter or two,
texts by their trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..joins import lookup
from ..registry import query, read
from ..staging import scratch, stage

#: Words of up to so many letters are found by deletions, whose number grows as the square; longer ones by thirds.
SHORT = 24
#: Letters of a gram.
GRAM = 3


def _one_less(word: Column) -> Column:
    """What is left of a word without one of its letters."""
    n = F.char_length(word)
    cut = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), cut)).otherwise(F.array().cast("array<string>"))


def deletions(word: Column, most: int = 2) -> Column:
    """The word and what is left of it without up to `most` (one or two) letters, each once.

    Two words at a distance of up to `most` have one of these in common.
    """
    one = F.array_distinct(_one_less(word))
    every = [F.array(word), one] + ([F.flatten(F.transform(one, _one_less))] if most > 1 else [])
    return F.array_distinct(F.concat(*every))


def _thirds(word: Column, shifted: bool) -> Column:
    """Keys of a long word: its three parts with their number and the length of the whole.

    Of two words at a distance of up to two, one part of either is untouched and stands, by at most two places
    shifted, in the other, whose length is at most two apart: that is what the shifted side asks for.
    """
    n = F.char_length(word)
    key = lambda k, start, size, whole: F.concat_ws("|", F.lit(k).cast("string"), whole.cast("string"), F.substring(word, start, size))
    out = []
    for k in range(3):
        if not shifted:
            start = F.floor(n * k / 3).cast("int") + 1
            out.append(F.array(key(k, start, F.floor(n * (k + 1) / 3).cast("int") + 1 - start, n)))
            continue
        # the other word's parts, for each length that it may have, at each place where they may stand here
        for change in range(-2, 3):
            m = n + change
            start = F.floor(m * k / 3).cast("int") + 1
            size = F.floor(m * (k + 1) / 3).cast("int") + 1 - start
            at = F.filter(F.transform(F.array(*(F.lit(s) for s in range(-2, 3))), lambda s: start + s), lambda p: p > 0)  # noqa: B023
            out.append(F.transform(at, lambda p: key(k, p, size, m)))  # noqa: B023
    return F.concat(*out)


def within_two(asked: DataFrame, words: DataFrame, distance: int = 2) -> DataFrame:
    """(a, b, distance) of all pairs of asked (a) and words (b), both distinct, at most `distance` (one or two) apart.

    No pair is compared that has no key in common; the work is that of the words and of what their keys share.
    """
    n = lambda c: F.char_length(c)
    short = lambda df, c: df.filter(n(c) <= SHORT).select(c, F.explode(deletions(F.col(c), distance)).alias("key"))
    # words near the limit are in both indexes, so that no pair falls between them
    thirds = lambda df, c, shifted: df.filter(n(c) > SHORT - 3).select(c, F.explode(F.array_distinct(_thirds(F.col(c), shifted))).alias("key"))
    pairs = short(asked, "a").join(short(words, "b"), "key").select("a", "b").unionByName(thirds(asked, "a", True).join(thirds(words, "b", False), "key").select("a", "b"))
    return pairs.distinct().withColumn("distance", F.levenshtein("a", "b")).filter(F.col("distance") <= distance)


def suggestions(words: DataFrame, lexicon: DataFrame, most: int) -> DataFrame:
    """(tok, w, confidence, rank) for distinct words (tok) against lexicon (w, freq): first letter equal, distance two (one
    for words of up to four letters)."""
    near = within_two(words.select(F.col("tok").alias("a")), lexicon.select(F.col("w").alias("b")))
    near = near.filter((F.substring("a", 1, 1) == F.substring("b", 1, 1)) & (F.col("distance") <= F.when(F.char_length("a") >= 5, 2).otherwise(1)))
    j = near.select(F.col("a").alias("tok"), F.col("b").alias("w"), "distance").join(lexicon, "w")
    j = j.withColumn("confidence", F.round(1 - F.col("distance") / F.greatest(F.char_length("tok"), F.char_length("w")).cast("double"), 9))
    # the best few of a word: kept sorted and cut map-side would need an aggregate of its own; a word has few neighbours
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), (-F.col("freq")).alias("f"), "w"))), 1, most)
    return j.groupBy("tok").agg(best.alias("all")).select("tok", F.posexplode("all").alias("n", "x")).select("tok", "x.w", (-F.col("x.c")).alias("confidence"), (F.col("n") + 1).alias("rank"))


def grams(text: Column, size: int) -> Column:
    """The distinct pieces of so many letters."""
    n = F.char_length(text)
    all_ = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(n >= size, F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))


def holds(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """(text, needle): each of the distinct texts with each of the distinct needles that it contains.

    Texts are indexed by the grams that some needle has. A needle is looked up by its rarest gram only, and what is found
    is compared; one that is shorter than a gram is a gram of its own size. A gram's texts are never collected: where one
    gram has many, its needles go to them (lookup). Empty and null needles are in no text.
    """
    asked = needles.filter(F.char_length("needle") > 0).withColumn("size", F.least(F.char_length("needle"), F.lit(GRAM)))
    asked = stage(asked, "needles")
    sizes = [r.size for r in asked.select("size").distinct().collect()]  # GRAM of them at most
    if not sizes:
        return texts.select("text", F.lit("").alias("needle")).limit(0)
    of = lambda c, k: F.when(F.col("size") == k, grams(F.col(c), k)) if k else None
    own = stage(asked.select("needle", F.explode(F.coalesce(*(of("needle", k) for k in sizes))).alias("gram")), "needle-grams")
    wanted = stage(own.select("gram").distinct(), "wanted")
    posts = texts.filter("text is not null").select("text", F.explode(F.concat(*(grams(F.col("text"), k) for k in sizes))).alias("gram"))
    posts = stage(lookup(posts, wanted, ["gram"], 40), "postings")
    counts = posts.groupBy("gram").agg(F.count("*").alias("texts"))
    # a needle with a gram that no text has is in none
    rarest = own.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("n"), "gram")).alias("g"))
    chosen = stage(rarest.filter("g.n > 0").groupBy("g.gram").agg(F.collect_list("needle").alias("needles")), "chosen")
    return lookup(posts, chosen, ["gram"], 1000).select("text", F.explode(F.filter("needles", lambda x: F.contains("text", x))).alias("needle"))


_LEXICON = "w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part UNION SELECT DISTINCT lower(p_brand) || ' and ' || lower(p_type) || ' of a length beyond all' FROM part)"


@query("spelling_neighbours", f"WITH {_LEXICON} SELECT x.w AS a, y.w AS b, levenshtein(x.w, y.w)::INT AS distance FROM w x JOIN w y ON x.w < y.w AND levenshtein(x.w, y.w) <= 2")
def spelling_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of words, short and long ones, at a distance of up to two."""
    part = read(spark, d, "part")
    w = part.select(F.explode(F.split("p_name", " ")).alias("a")).union(part.select(F.concat(F.lower("p_brand"), F.lit(" and "), F.lower("p_type"), F.lit(" of a length beyond all")))).distinct()
    with scratch(spark) as keep:
        w = keep(stage(w, "words"))
        return within_two(w, w.withColumnRenamed("a", "b")).filter("a < b")
