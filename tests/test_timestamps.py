from datetime import datetime, timezone

import pytest

from pressloom.functions.clock import readings
from pressloom.operators import timestamps

CLOCKS = "source_id string, clock_zone string, day_first boolean"


def second(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp())


@pytest.mark.parametrize(
    "text, utc",
    [
        ("2023-01-15T17:48:04Z", second(2023, 1, 15, 17, 48, 4)),
        (" 2023-01-15t13:55:42z\n", second(2023, 1, 15, 13, 55, 42)),
        ("Mon, 16 Jan 2023 03:01:17 +0100", second(2023, 1, 16, 2, 1, 17)),
        ("2023-01-16T11:22:07+09", second(2023, 1, 16, 2, 22, 7)),
        ("20230116T002726Z", second(2023, 1, 16, 0, 27, 26)),
        ("1673829624014", 1673829624),
        ("June 16, 2023 at 2:25 p.m. EDT", second(2023, 6, 16, 18, 25)),
        ("12 Feb 2023 01:59 GMT", second(2023, 2, 12, 1, 59)),
    ],
)
def test_value_names_its_instant(text, utc):
    assert [r[2] for r in readings(text)] == [utc]


@pytest.mark.parametrize("text", [None, "", "  ", "TBD", "2023-01-15", "2 hours ago", "Tue, 31 Feb 2024 10:00:00 GMT", "0000-00-00 00:00:00", "x" * 5000, "2023-01-15 25:00"])
def test_value_without_instant(text):
    assert readings(text) == ()


def rows(spark, values, clocks):
    df = spark.createDataFrame([(i, s, v, "extra") for i, (s, v) in enumerate(values)], "row_id long, source_id string, written string, status string").withColumnRenamed("status", "layer")
    out = timestamps.normalise(df, spark.createDataFrame(clocks, CLOCKS))
    return {r["row_id"]: r for r in out.collect()}


def test_clock_changes_and_order_of_slashes(spark):
    clocks = [("b", "Europe/Berlin", True), ("n", "America/New_York", False), ("u", None, None)]
    values = [("b", "2022-10-30 02:30:00"), ("b", "2023-03-26 02:30:00"), ("b", "03/04/2023 10:00"), ("n", "03/04/2023 10:00 AM"), ("n", "15/01/2023 17:09"), ("u", "2023-01-01 00:00"), ("b", "2022-10-30T02:35:19+02:00[Europe/Berlin]"), ("b", None), ("b", "2023-01-15 10:00")]
    out = rows(spark, values, clocks)
    assert [out[i]["status"] for i in range(9)] == ["clock_change", "clock_change", "ok", "ok", "none", "ok", "ok", "none", "ok"]
    assert out[2]["utc_second"] == second(2023, 4, 3, 8) and out[3]["utc_second"] == second(2023, 3, 4, 15)
    assert out[6]["utc_second"] == second(2022, 10, 30, 0, 35, 19) and out[8]["utc_second"] == second(2023, 1, 15, 9)


def test_mixture_learns_the_order_where_no_clock_states_it(spark):
    values = [("x", f"{d:02}/03/2023 10:00") for d in range(13, 29)] + [("x", "04/03/2023 10:00"), ("y", "04/03/2023 10:00")]
    out = rows(spark, values, [("z", None, None)])
    assert out[16]["utc_second"] == second(2023, 3, 4, 10) and out[16]["layout"] == "slash_day_first"
    assert out[17]["status"] == "ambiguous" and out[17]["utc_second"] is None


def test_empty_table(spark):
    empty = spark.createDataFrame([], "row_id long, source_id string, written string")
    assert timestamps.normalise(empty, spark.createDataFrame([], CLOCKS)).count() == 0


def test_values_overrule_a_wrong_clock(spark):
    values = [("x", f"03/{d:02}/2023 10:00") for d in range(13, 29)] * 4 + [("x", "03/04/2023 10:00")]
    out = rows(spark, values, [("x", None, True)])
    assert out[len(values) - 1]["utc_second"] == second(2023, 3, 4, 10)
