"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix has the point frac((i + 1) * golden ratio); the cumulative target weights map it to
a source. The k-th slot of a source takes the k-th block of that source: its documents in shuffled
order, laid end to end (as often as the target needs, at most twice), cut into blocks of equally many
words. The last block of a source ends at its target. DataFrame functions only.

Running totals over a source never meet in one task: they are taken in two steps, over pieces of the
shuffled order (or of the slot numbers) and then inside each piece; those over all sources go by ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import n_words, numbered, read, stage

#: Weights by the rank of a source, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix for each word of the input, and the most for each word of a source.
SHARE, MOST = 1.5, 2.0
#: Words in a block.
BLOCK = 1024
#: Slots in a piece of the schedule.
PIECE = 4096
GOLDEN = 0.6180339887498949


def shuffle_key(doc_id: Column, seed: int = 0) -> Column:
    """The place of a document in the shuffled order of its source."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size) -> also target and rank. One row per source.

    The excess over a source's cap is shared again by weight until none is above its cap. At the end
    all sources below their caps have one and the same ratio of target to weight, so that ratio is
    found directly, in the order of cap by weight.
    """
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    s = numbered(sizes.select("source", "source_size"), [F.col("source").asc_nulls_last()]).withColumnRenamed("row_no", "rank")
    s = s.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    total, weights = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    s = numbered(s, [F.col("cap") / F.col("weight"), F.col("rank")], ("cap", "weight"))
    level = (F.lit(SHARE * total) - F.col("before_cap")) / (F.lit(weights) - F.col("before_weight"))
    s = s.withColumn("level", F.when(level * F.col("weight") < F.col("cap"), level))
    # the first source in the order that stays below its cap gives the ratio; later ones would give less
    ratio = F.lit(s.agg(F.max("level")).first()[0]).cast("double")
    return s.select("source", "source_size", "rank", F.coalesce(F.least(F.col("cap"), ratio * F.col("weight")), F.col("cap")).alias("target"))


def lay_out(sized: DataFrame, tgt: DataFrame, doc_id: str = "doc_id", seed: int = 0) -> DataFrame:
    """Each document with its source's target and `start`, its first word's place in the source's stream."""
    key = shuffle_key(F.col(f"rec.{doc_id}"), seed)
    d = sized.withColumn("key", key).withColumn("piece", F.substring(key, 1, 3))
    part = d.groupBy("source", "piece").agg(F.sum("size").alias("words"))
    part = part.withColumn("before", F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    part = part.join(tgt, part["source"].eqNullSafe(tgt["source"])).select(part["source"].alias("p_source"), F.col("piece").alias("p_piece"), "before", "source_size", "rank", "target")
    inside = W.partitionBy("source", "piece").orderBy("key", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(part, d["source"].eqNullSafe(part["p_source"]) & (d["piece"] == part["p_piece"]))
    return d.withColumn("start", F.col("before") + F.col("within")).drop("p_source", "p_piece", "before", "within", "piece", "key", "tie")


def schedule(spark: SparkSession, tgt: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, rank, turn): the order of the mix; slot takes block number `turn` of the source `rank`.

    A source that the points give too few slots gets the rest after all others.
    """
    need = tgt.select("rank", "target", F.ceil(F.floor("target") / block).cast("long").alias("need"))
    n, sources = need.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    total = need.agg(F.sum("target")).first()[0]
    edges = numbered(need, [F.col("rank")], ("target",)).filter("target > 0")
    lo, hi = (F.col("before_target") / F.lit(total)).alias("lo"), ((F.col("before_target") + F.col("target")) / F.lit(total)).alias("hi")
    edges = edges.select("rank", "need", lo, hi)
    # an equality to join on: cells of the unit interval, several for each source; a cell holds the sources that reach into it
    n_cells = 1 << max(10, (4 * sources).bit_length())
    point = (F.col("slot") + 1) * F.lit(GOLDEN)
    slots = spark.range(n, numPartitions=max(1, min(10_000, n // 50_000))).withColumnRenamed("id", "slot").withColumn("u", point - F.floor(point))
    cells = edges.select("rank", "need", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * n_cells), F.least(F.lit(n_cells - 1), F.floor(F.col("hi") * n_cells)))).alias("cell"))
    j = slots.withColumn("cell", F.floor(F.col("u") * n_cells)).join(cells, "cell").filter("u >= lo and (u < hi or (hi >= 0.999999999999 and u >= hi))")
    j = j.select("slot", "rank", "need", F.floor(F.col("slot") / PIECE).alias("piece"))
    part = j.groupBy("rank", "piece").agg(F.count("*").alias("n"))
    part = part.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("rank").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    turn = F.row_number().over(W.partitionBy("rank", "piece").orderBy("slot")) - 1
    j = j.withColumn("t", turn).join(part.select("rank", "piece", "before"), ["rank", "piece"]).withColumn("turn", F.col("before") + F.col("t"))
    main = j.filter("turn < need").select("slot", "rank", "turn")
    got = part.groupBy("rank").agg(F.sum("n").alias("got"))
    rest = need.join(got, "rank", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    rest = rest.select("rank", F.explode(F.sequence(F.col("got"), F.col("need") - 1)).alias("turn"))
    return main.unionByName(rest.select((F.lit(n) + F.col("turn") * sources + F.col("rank") - 1).alias("slot"), "rank", "turn"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = 0, block: int = BLOCK, keep_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(laid, pieces). laid: every document with size, source_size, target and `uid`. pieces: (uid, slot,
    pass, first, words): in the mix, the slot takes so many words of a document from word `first`.

    Null text has size 0, null source is a source of its own (the last), rows that are alike are
    documents of their own; rows of one doc_id are laid by size and then by a digest of the text. A document
    without words is never taken; one of any length is cut into blocks. An empty table gives empty results.
    Columns of docs may have any names, as they stay inside `rec`.
    """
    spark = docs.sparkSession
    d = docs.select(F.struct("*").alias("rec"))
    whole = F.col(f"rec.{text}")
    d = d.select("rec", n_words(whole).alias("size"), F.col(f"rec.{source}").alias("source"), F.md5(F.coalesce(whole, F.lit(""))).alias("tie"))
    if not keep_text:
        d = d.withColumn("rec", F.col("rec").dropFields(text))
    d = stage(d, "mix-sizes")
    tgt = stage(targets(d.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    laid = lay_out(d, tgt, doc_id, seed)
    laid = stage(laid.drop("source").withColumn("uid", F.monotonically_increasing_id()), "mix-laid")
    # the words of a document in pass p have the places start + p * source_size on; they reach into these blocks
    last = F.least(F.col("target"), F.col("at") + F.col("size"))
    t = laid.filter("size > 0").select("uid", "rank", "size", F.floor("target").alias("target"), F.posexplode(F.array("start", F.col("start") + F.col("source_size"))).alias("pass", "at"))
    t = t.filter("at < target").withColumn("end", last.cast("long"))
    t = t.withColumn("turn", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    lo, hi = F.greatest(F.col("at"), F.col("turn") * block), F.least(F.col("end"), (F.col("turn") + 1) * block)
    t = t.select("uid", "rank", "turn", "pass", (lo - F.col("at")).alias("first"), (hi - lo).alias("words"))
    return laid, t.join(schedule(spark, tgt, block), ["rank", "turn"]).select("uid", "slot", "pass", "first", "words")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also first_slot: the slot of the mix in which a document first comes, null for one that is not taken."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    laid, pieces = mix(docs, keep_text=False)
    taken = pieces.groupBy("uid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return laid.join(taken, "uid", "left").select("rec.doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


#: From `mix_docs` (doc_id, text, source and more) to `mixed`, which has start, target, taken_1, taken_2 and first_slot.
MIXED_SQL = rf"""
siz AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('0:' || coalesce(doc_id::VARCHAR, '')) AS key, md5(coalesce(text, '')) AS tie FROM mix_docs),
sou AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM siz GROUP BY source),
wei AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(rank - 1) % {len(WEIGHTS)} + 1] AS weight, {MOST} * source_size::DOUBLE AS cap FROM sou),
lev AS (SELECT *, ({SHARE} * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM wei),
tar AS (SELECT *, least(cap, coalesce((SELECT max(level) FROM lev WHERE level * weight < cap) * weight, cap)) AS target FROM lev),
nee AS (SELECT rank, target, ceil(floor(target) / {BLOCK})::BIGINT AS need, coalesce(sum(target) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(target) OVER () AS lo,
    (coalesce(sum(target) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + target) / sum(target) OVER () AS hi FROM tar),
poi AS (SELECT slot, (slot + 1) * {GOLDEN}::DOUBLE - floor((slot + 1) * {GOLDEN}::DOUBLE) AS u FROM (SELECT unnest(range((SELECT coalesce(sum(need), 0)::BIGINT FROM nee))) AS slot)),
slo AS (SELECT slot, rank, need, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS turn FROM poi JOIN nee ON u >= lo AND u < hi WHERE target > 0),
res AS (SELECT rank, unnest(range(coalesce(got, 0), need)) AS turn FROM nee LEFT JOIN (SELECT rank, count(*) AS got FROM slo GROUP BY rank) USING (rank)),
sch AS (SELECT rank, turn, slot FROM slo WHERE turn < need UNION ALL
    SELECT rank, turn, (SELECT coalesce(sum(need), 0)::BIGINT FROM nee) + turn * (SELECT count(*) FROM nee) + rank - 1 FROM res),
lay AS (SELECT s.*, t.source_size, t.target, t.rank, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM siz s JOIN tar t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT l.*, least(greatest(floor(target)::BIGINT - start, 0), size) AS taken_1, least(greatest(floor(target)::BIGINT - start - source_size, 0), size) AS taken_2,
    CASE WHEN size > 0 AND start < floor(target) THEN slot END::BIGINT AS first_slot FROM lay l LEFT JOIN sch c ON l.rank = c.rank AND l.start // {BLOCK} = c.turn)"""

OP8_SQL = f"""WITH mix_docs AS (SELECT doc_id, text, source FROM documents), {MIXED_SQL}
SELECT doc_id, size, source_size, target, (taken_1 + taken_2)::BIGINT AS taken, first_slot FROM mixed"""
