"""Ranking helpers that hold up when one group owns a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.plans.lineage import cut_lineage


def top_k(df: DataFrame, partition: list[str], order: list[Column], k: int, rank: str = "rnk") -> DataFrame:
    """The first k rows per group.

    Spark turns the filter on row_number into a WindowGroupLimit, which keeps
    at most k rows per group and task before the shuffle, so a hot group costs
    no more than k rows per upstream task.
    """
    window = Window.partitionBy(*partition).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def first_k(df: DataFrame, partition: list[str], order: list[Column], k: int | None) -> DataFrame:
    """All rows, or ranked and cut to the first k per group where a report asks for that."""
    return df if k is None else top_k(df, partition, order, k)


def range_row_number(df: DataFrame, partition: list[str], order: list[str], name: str) -> DataFrame:
    """Exact row_number() over (partition, ascending by order), by many tasks however large one partition is.

    Rows are range-partitioned and sorted by partition and order, so a hot
    partition spans as many tasks as it needs. A row's place is its place in
    its task, plus the rows of its partition in the tasks before; only those
    counts, one per partition and task, meet in a window. The sorted rows are
    written to the checkpoint folder first: their places have to stay as they
    were when the counts are joined back.
    """
    placed = cut_lineage(
        df.repartitionByRange(*partition, *order)
        .sortWithinPartitions(*partition, *order)
        .withColumn("_id", F.monotonically_increasing_id())
        .withColumn("_task", F.shiftright("_id", 33))
    )
    before = Window.partitionBy(*partition).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*partition, "_task")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_start"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_start") + 1)
        .drop("_n", "_start")
    )
    return (
        placed.join(shifts, [*partition, "_task"])
        .withColumn(name, (F.col("_id") + F.col("_shift")).cast("bigint"))
        .drop("_id", "_task", "_shift")
    )
