"""Mixed timestamp formats and time zones: one instant in UTC for every written time, or none.

Every value is matched against a small set of layouts. A layout that yields an
existing date is a *reading*. A source writes a mixture of layouts, whose
weights are found by expectation-maximisation: values with one reading vote for
it, values with two (``03/04/2023``) share their vote by the current weights.
The posterior chooses the reading; where it stays below ``certainty`` the value
is marked ambiguous and has no instant.

The statistics are counts of layout sets by source, so the iteration runs on
(source, set) rows and never on the values.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressloom.functions import clock
from pressloom.schemas import fields
from pressloom.session import spool

EARLIEST = 631152000  # 1990-01-01, in seconds
READ = fields("first string, wall_1 long, second string, wall_2 long, utc_1 long, utc_2 long, zone string")


@F.pandas_udf(READ)
def read_written(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The at most two readings of each value, in one struct."""
    for values in batches:
        rows = []
        for value in values:
            found = clock.readings(value)
            a = found[0] if found else (None, None, None, None)
            b = found[1] if len(found) > 1 else (None, None, None, None)
            rows.append((a[0], a[1], b[0], b[1], a[2], b[2], a[3]))
        out = pd.DataFrame(rows, columns=["first", "wall_1", "second", "wall_2", "utc_1", "utc_2", "zone"])
        yield out.astype({c: "Int64" for c in ("wall_1", "wall_2", "utc_1", "utc_2")})


def _mixture(rounds: int, stated: float):
    """EM over the layouts of one source. Rows: the layout sets of the source with their counts, and its clock's hint."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [({a, b} - {None}, n) for a, b, n in zip(pdf["first"], pdf["second"], pdf["n"])]
        layouts = sorted({x for names, _ in sets for x in names})
        hint = pdf["day_first"].dropna()

        def settle(prior: dict[str, float]) -> dict[str, float]:
            weight = {x: v / sum(prior.values()) for x, v in prior.items()}
            for _ in range(rounds):
                votes = dict(prior)
                for names, n in sets:
                    total = sum(weight[x] for x in names)
                    for x in names:
                        votes[x] += n * weight[x] / total
                whole = sum(votes.values())
                weight = {x: v / whole for x, v in votes.items()}
            return weight

        prior = dict.fromkeys(layouts, 0.5)
        if not len(hint):
            weight = settle(prior)
        else:
            told, other = ("slash_day_first", "slash_month_first")[:: 1 if bool(hint.iloc[0]) else -1]
            weight = settle(prior | {x: stated for x in (told,) if x in prior})
            if weight.get(other, 0.0) > weight.get(told, 0.0) and told in prior:
                weight = settle(prior)  # the values overrule the clock
            else:
                weight[other] = 0.0  # dates that only fit the other order are none
        return pd.DataFrame({"source_id": [pdf["source_id"].iloc[0]] * len(layouts), "layout": layouts, "weight": [weight[x] for x in layouts]})

    return fit


def layout_weights(read: DataFrame, clocks: DataFrame, rounds: int = 20, stated: float = 30.0) -> DataFrame:
    """(source_id, layout, weight) from rows with source_id and the struct ``r`` of :func:`read_written`.

    A clock that states the order of slashed dates is a prior of ``stated``
    votes for that order and none for the other; where the values that fit one
    order only outweigh it, they overrule it. A source without clock has only its
    own values. A null source_id is a source of its own.
    """
    sets = read.where(F.col("r.first").isNotNull()).groupBy("source_id", "r.first", "r.second").agg(F.count("*").alias("n"))
    hints = clocks.select(F.col("source_id").alias("h_source"), "day_first").dropDuplicates(["h_source"])
    sets = sets.join(hints, F.col("source_id") == F.col("h_source"), "left").drop("h_source")
    return sets.groupBy("source_id").applyInPandas(_mixture(rounds, stated), "source_id string, layout string, weight double")


def normalise(values: DataFrame, clocks: DataFrame, certainty: float = 0.95, rounds: int = 20) -> DataFrame:
    """Instants of ``values`` (any columns, source_id, written) by the clocks of their feeds.

    ``clocks``: source_id, clock_zone (null: UTC), day_first. Returns the columns
    of ``values`` with utc_second (null when none), layout, posterior, and
    status: ``ok``, ``none`` (no time of day, relative, impossible, before
    1990), ``ambiguous`` (readings that the mixture can't separate) or
    ``clock_change`` (a wall time that its clock showed twice or never).
    Null and empty values have status ``none``; repeated rows stay repeated; a
    source without clock reads as UTC. An empty table gives an empty table.
    """
    packed = spool(values.select(F.struct("*").alias("v"), "source_id", read_written(F.col("written")).alias("r")), "read")  # parsed once for weights and readings
    weights = (
        layout_weights(packed, clocks, rounds)
        .groupBy(F.col("source_id").alias("w_source"))
        .agg(F.map_from_entries(F.collect_list(F.struct("layout", "weight"))).alias("w"))  # at most one entry a layout
    )
    zones = clocks.dropDuplicates(["source_id"]).select(F.col("source_id").alias("c_source"), F.coalesce("clock_zone", F.lit("UTC")).alias("clock_zone"))
    df = packed.join(weights, F.col("source_id").eqNullSafe(F.col("w_source")), "left").join(zones, F.col("source_id") == F.col("c_source"), "left")
    of = lambda c: F.coalesce(F.try_element_at(F.col("w"), F.col(c)), F.lit(0.0))
    df = df.withColumns({"p1": of("r.first"), "p2": of("r.second")})
    first = F.col("p1") >= F.col("p2")
    df = df.withColumns(
        {
            "layout": F.when(first, F.col("r.first")).otherwise(F.col("r.second")),
            "wall": F.when(first, F.col("r.wall_1")).otherwise(F.col("r.wall_2")),
            "utc": F.when(first, F.col("r.utc_1")).otherwise(F.col("r.utc_2")),
            "best": F.greatest("p1", "p2"),
            "zone": F.coalesce("r.zone", "clock_zone", F.lit("UTC")),
        }
    )
    df = df.withColumns(
        {
            "posterior": F.when(F.col("best") > 0, F.col("best") / (F.col("p1") + F.col("p2"))),
            "instant": F.coalesce("utc", clock.zoned_instant(F.col("wall"), F.col("zone"))),
        }
    )
    status = (
        F.when(F.col("r.first").isNull() | (F.col("best") == 0), "none")
        .when(F.col("posterior") < certainty, "ambiguous")
        .when(F.col("instant").isNull(), "clock_change")
        .when(F.col("instant") < EARLIEST, "none")
        .otherwise("ok")
    )
    df = df.withColumn("status", status)
    return df.select("v.*", F.when(F.col("status") == "ok", F.col("instant")).alias("utc_second"), "layout", "posterior", "status")
