"""Joins and running sums that keep their size when one key holds a large part of all rows, and a grid of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import stage

#: Bytes of a table that is broadcast whole, and the share of rows (one in so many) from which a key counts as hot.
BROADCAST, HOT = 32 << 20, 1024
#: Tasks of a grid at most; beyond it a task takes several cells.
TASKS = 100_000


def lookup(rows: DataFrame, table: DataFrame, key: list[str], width: int = 100) -> DataFrame:
    """rows joined with table, a stored table of at most one row (of about `width` bytes) for each key.

    A table within BROADCAST is broadcast. Of a larger one the rows of hot keys are, which can't be more than HOT; the
    other keys' rows are shuffled, none of them in a greater share than one in HOT. rows are read more than once then.
    """
    if table.count() * width <= BROADCAST:
        return rows.join(F.broadcast(table), key)
    counts = rows.groupBy(*key).agg(F.count("*").alias("n_"))
    hot = stage(counts.filter(F.col("n_") * HOT > rows.count()).select(*key), "hot-keys")
    one = rows.join(F.broadcast(table.join(F.broadcast(hot), key, "left_semi")), key)
    return one.unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(table, key))


def so_far(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name, the sum of its column over all rows before in the order.

    Rows are dealt out by ranges of the order, so no task sees more than a range; only the ranges' totals, one row for
    each shuffle partition, meet in one place. The order must tell all rows apart.
    """
    ranged = stage(df.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "ranged")
    total = ranged.groupBy("range_").agg(*(F.sum(c).alias(f"{n}_all") for n, c in sums.items()))
    before = W.orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0)
    total = total.select("range_", *(F.coalesce(F.sum(f"{n}_all").over(before), none).alias(f"{n}_all") for n in sums))
    inside = W.partitionBy("range_").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    j = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), none).alias(f"{n}_in") for n, c in sums.items()))
    j = j.join(F.broadcast(total), "range_")
    return j.select(*df.columns, *((F.col(f"{n}_all") + F.col(f"{n}_in")).alias(n) for n in sums))


def numbered(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """df with the place of each row in the order, from 0."""
    return so_far(df, order, {name: F.lit(1)}).withColumn(name, F.col(name).cast("long"))


def running(df: DataFrame, group: list[str], order: list[Column], count: str) -> DataFrame:
    """df with `before`, the sum of count over the rows of its group that come before it in the order, and `total` of
    the group. A group may hold any share of all rows: it is cut by ranges of the order."""
    held = stage(so_far(df, [*(F.col(g) for g in group), *order], {"before_": F.col(count)}), "so-far")
    start = stage(held.groupBy(*group).agg(F.min("before_").alias("start_"), F.sum(count).alias("total")), "starts")
    return lookup(held, start, group).withColumn("before", F.col("before_") - F.col("start_")).drop("before_", "start_")


def grid(left: DataFrame, right: DataFrame, n_left: int, n_right: int, run: Callable[[pa.Array, pa.Array, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What run gives for each block of left (block, left_of) with each block of right (part, right_of).

    Each pair of blocks is a cell, and each cell a task (up to TASKS), so no task holds more than two blocks, however many
    blocks either side has. run gets the structs of both blocks and the number of the right one.
    """
    cell = (F.col("block").cast("long") * n_right + F.col("part")).alias("cell")
    one = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1)))).select(cell, F.lit(0).alias("role"), "part", "left_of")
    other = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1)))).select(cell, F.lit(1).alias("role"), "part", "right_of")
    tasks = min(TASKS, n_left * n_right)
    rows = one.unionByName(other, allowMissingColumns=True).repartitionById(tasks, (F.col("cell") % tasks).cast("int"))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            for k in range(b.num_rows):
                cell, role = b.column("cell")[k].as_py(), b.column("role")[k].as_py()
                if not role:
                    at, held = cell, b.column("left_of")[k].values
                elif at == cell:
                    yield from run(held, b.column("right_of")[k].values, b.column("part")[k].as_py())

    return rows.sortWithinPartitions("cell", "role").mapInArrow(cells, schema)
