"""Exact ranks inside groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pressloom.session import cut


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the row number ``name`` of each row in its group.

    A window function would bring a group into one task. Here the rows are sorted
    by range over all tasks, a large group lies in many of them, and a row's rank
    is its place in its task plus the rows of the group in earlier tasks; only
    one row for each (task, group) is gathered for that. ``order`` must be total
    for a result that doesn't depend on chance. Null groups are groups.
    """
    spread = cut(df.repartitionByRange(*[F.col(g) for g in groups], *order).sortWithinPartitions(*groups, *order).withColumn("_at", F.monotonically_increasing_id()))
    spread = spread.withColumn("_task", F.shiftright("_at", 33))
    parts = spread.groupBy("_task", *groups).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    parts = parts.select(F.col("_task").alias("_t"), *[F.col(g).alias(f"_g_{i}") for i, g in enumerate(groups)], "_first", "_before")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_g_{i}")) for i, g in enumerate(groups)], F.col("_task") == F.col("_t"))
    out = spread.join(parts, same)
    return out.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name))
