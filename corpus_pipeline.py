"""From documents to an encoded training mix: quality rules, near-duplicates, personal data, source mix, BPE.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the docs of the next one. A stage deletes the tables that it wrote and its result does not read; those that the
result reads belong to the caller, so stages may be called in any number before one is written. run() deletes
what it no longer reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewright.llm import bpe, common, dedup, mixing, pii, quality

#: The least similarity of near-duplicates in percent, and the words of a shingle.
PERCENT, WIDTH = 80, 5


def recounted(docs: DataFrame) -> DataFrame:
    """docs, with n_chars (if there is such a column) the characters of text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. Rows without text go; repeated rows share their verdict.

    Verdicts are worked out without carrying texts and come back by a 128-bit digest of the row, so that the rows
    themselves are neither written on the way nor (up to common.FEW_IDS verdicts) moved.
    Like all stages: texts of any length, columns of any names beside doc_id, text, lang and source; an empty table
    gives an empty table.
    """
    one, two = common.fresh(docs, "digest_1"), common.fresh(docs, "digest_2")
    told = [F.col("doc_id"), F.col("lang"), F.col("source"), F.col("text")]
    marked = docs.withColumns({one: F.xxhash64(F.lit(1), *told), two: F.xxhash64(F.lit(2), *reversed(told))})
    with common.scratch(spark) as keep:
        judged = quality.judge(marked.select(*told, one, two), keep_text=False)
        good = keep(common.stage(judged.filter("kept").select(F.col(f"rec.{one}"), F.col(f"rec.{two}")).distinct(), "good"))
    return common.with_ids(marked, good, [one, two]).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least doc_id, of repeated rows one.

    A row without words is no duplicate and stays. Shingles are of five words here, the width for near-duplicates
    where nothing else is asked; op7 takes four by its contract.
    """
    return dedup.near_duplicates(docs, percent=PERCENT, width=WIDTH).filter("first").select("rec.*")


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every personal span replaced by its kind; n_chars follows. Null text stays null."""
    return recounted(pii.redact(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in the order of its slots: a row for each time that a document is taken, with the words taken of it.

    A document that is taken whole keeps its text as it is; of one that is taken in part the words are
    joined by one space. One without words is not taken, rows that are alike are documents of their own. Texts are
    moved once, to their places in the order; sizes, slots and shares are worked out without them.
    """
    row = common.fresh(docs, "row")
    held = common.stage(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    with common.scratch(spark) as keep:
        laid, pieces = mixing.mix(held.select("doc_id", "source", "text", row), keep_text=False)
        taken = pieces.groupBy("uid", "pass").agg(F.min("slot").alias("slot"), F.min("first").alias("first"), F.sum("words").alias("words"))
        taken = taken.join(laid.select("uid", F.col(f"rec.{row}").alias("of"), "size"), "uid")
        taken = keep(common.stage(taken.select("of", "slot", "first", "words", "size", "pass"), "taken"))
    j = held.select(F.struct("*").alias("rec")).join(F.broadcast(taken) if taken.count() <= common.FEW_IDS else taken, F.col(f"rec.{row}") == F.col("of"))
    j = j.repartitionByRange("slot", "of", "pass").sortWithinPartitions("slot", "of", "pass")
    text = F.col("rec.text")
    part = F.array_join(F.slice(common.words(text), (F.col("first") + 1).cast("int"), F.col("words").cast("int")), " ")
    text = F.when(F.col("words") == F.col("size"), text).otherwise(part)
    return recounted(j.select(*(text.alias(c) if c == "text" else F.col(f"rec.`{c}`") for c in docs.columns)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mix, also of rows without text (none) and repeated ones."""
    return bpe.encode(docs, bpe.default_path(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", one_of_each),
    ("personal data", hide_personal_data),
    ("source mix", mix_sources),
    ("encoding", encode),
]

#: SQL expresses neither the near-duplicate stage at this size nor the encoding; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES[:-1]):
        before = docs
        with common.scratch(spark) as keep:
            docs = keep(common.stage(step(spark, docs, sf_dir), name.replace(" ", "-")))
        common.release(spark)
        if k:
            common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
