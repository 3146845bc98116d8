"""Limits on the records of dominant contributors.

The limits nest (author in domain in parent organisation), so the sets that obey
them are the independent sets of a laminar matroid, and the greedy choice is
optimal: keep the best records of every group of the innermost level, then the
best of what is left at the next level, and so on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.operators.ranked import ranked


@dataclass(frozen=True)
class Level:
    """At most ``most`` rows, or a ``share`` (rounded up) of the rows with the same ``scope``, for each group of ``keys``.

    A row whose ``free`` column is null or blank is no contributor's and isn't limited at this level.
    """

    keys: tuple[str, ...]
    most: int | None = None
    share: float | None = None
    scope: tuple[str, ...] = ()
    free: str | None = None


def within_caps(df: DataFrame, id_col: str, quality: str, levels: list[Level]) -> DataFrame:
    """``df`` (slim rows: id, quality, key columns) with ``kept``, false for the rows over a limit, and ``level``, the number of that limit from 1.

    Higher quality is kept first, null and NaN quality last, ties go to the lesser id.
    The size of a scope counts all rows of ``df``, so shares don't move while
    levels drop rows. Null keys are groups of their own. Ids must be unique. An
    empty table gives an empty table.
    """
    order = [F.when(F.isnan(quality), None).otherwise(F.col(quality)).desc_nulls_last(), F.col(id_col).asc()]
    now = df.withColumn("level", F.lit(None).cast("int"))
    for number, level in enumerate(levels, 1):
        bound = F.col(level.free).isNotNull() & (F.trim(level.free) != "") if level.free else F.lit(True)
        alive = now.where(F.col("level").isNull() & bound)
        rest = now.where(F.col("level").isNotNull() | ~bound)
        placed = ranked(alive, list(level.keys), order)
        if level.most is not None:
            limit = F.lit(level.most)
        else:
            size = df.groupBy(*level.scope).agg(F.count("*").alias("_size"))
            names = [f"_s_{i}" for i in range(len(level.scope))]
            size = size.select(*[F.col(c).alias(n) for c, n in zip(level.scope, names)], "_size")
            on = F.lit(True)
            for c, n in zip(level.scope, names):
                on = on & F.col(c).eqNullSafe(F.col(n))
            placed = placed.join(size, on).drop(*names) if names else placed.join(F.broadcast(size))  # no scope: one row
            limit = F.ceil(F.col("_size") * level.share - 1e-9)
        placed = placed.withColumn("level", F.when(F.col("rank") > limit, number)).select(*now.columns)
        now = placed.unionByName(rest)
    return now.withColumn("kept", F.col("level").isNull())
