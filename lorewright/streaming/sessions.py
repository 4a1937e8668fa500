"""Sessions as keyed state of a stream: the last turns of each conversation and the names that it knows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.sessions import _FACTS_SQL, _SAID, stated
from ..registry import query, workspace
from .feeds import append_log, feed, table

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
OUT = "conv_id long, turn long, history array<long>, chars long, known array<string>"


class Session(StatefulProcessor):
    """Of each conversation a list of its last turns, no longer than `most`, and a map of the names it has stated.

    Both are forgotten when they have not been written for `ttl` milliseconds. A turn whose number is not above the last
    one's is a repeat and gives no row. Turns of a micro-batch are taken in their order.
    """

    def __init__(self, most: int, ttl: int):
        self.most, self.ttl = most, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, chars long", self.ttl)
        self.names = handle.getMapState("names", "ordinal string", "name string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = [(int(t), int(c)) for t, c in self.turns.get()]
        out = []
        for r in pd.concat(list(rows)).sort_values("turn").itertuples(index=False):
            if turns and r.turn <= turns[-1][0]:
                continue
            turns = [*turns, (int(r.turn), int(r.chars))][-self.most :]
            if isinstance(r.ordinal, str):
                self.names.updateValue((r.ordinal,), (r.name,))
            known = sorted(f"{k[0]}={v[0]}" for k, v in self.names.iterator())
            out.append((key[0], int(r.turn), [t for t, _ in turns], sum(c for _, c in turns), known))
        if out:
            self.turns.put(turns)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "history", "chars", "known"])

    def close(self) -> None:
        pass


def sessions(turns: DataFrame, most: int = 10, ttl: int = 30 * 24 * 3600 * 1000) -> DataFrame:
    """(conv_id, turn, history, chars, known) for a stream of turns (conv_id, turn, text): after each turn the numbers and
    characters of the last ones, and what is known by number. The state of a conversation has a bounded list of turns."""
    t = turns.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.char_length(F.coalesce("text", F.lit(""))).alias("chars"), stated(F.col("text")).alias("fact"))
    t = t.select("conv_id", "turn", F.col("chars").cast("long").alias("chars"), "fact.ordinal", "fact.name")
    return t.groupBy("conv_id").transformWithStateInPandas(Session(most, ttl), OUT, "Append", "ProcessingTime")


def log_sessions(turns: DataFrame, target: str, checkpoint: str, most: int = 10) -> StreamingQuery:
    """Run sessions() to the end of what is there and append its rows to a log; goes on from its checkpoint.

    State that is forgotten by the clock asks for another batch without data again and again; these are switched off, so
    that the query ends when all is read.
    """
    spark = turns.sparkSession
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        # the running query has its own copy of the settings
        return append_log(sessions(turns, most), target, checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@query(
    "stream_sessions",
    f"""WITH {_FACTS_SQL}, w AS (SELECT conv_id, turn, length(text) AS n FROM talk),
    h AS (SELECT conv_id, turn, list(turn) OVER s AS history, (sum(n) OVER s)::BIGINT AS chars FROM w WINDOW s AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    k AS (SELECT h.conv_id, h.turn, f.ordinal || '=' || arg_max(f.name, f.turn) AS fact FROM h JOIN facts f ON f.conv_id = h.conv_id AND f.turn <= h.turn AND f.ordinal IS NOT NULL GROUP BY h.conv_id, h.turn, f.ordinal),
    g AS (SELECT conv_id, turn, list_sort(list(fact)) AS known FROM k GROUP BY ALL)
    SELECT h.*, coalesce(known, []) AS known FROM h LEFT JOIN g USING (conv_id, turn)""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """After each turn of a stream of conversations the last three turns and the names known by number."""
    at = workspace(spark)
    turns = feed(spark, table(d, "conversations"), "conv_id long, turn long, role string, text string")
    log_sessions(turns.select("conv_id", "turn", F.expr(_SAID).alias("text")), f"{at}/log", f"{at}/checkpoint", 3).awaitTermination()
    return spark.read.schema(OUT).parquet(f"{at}/log")
