import pandas as pd
import pytest
from conftest import at
from pyspark.sql import functions as F

from tarmac.functions import codes, timebucket
from tarmac.operators.spine import spine


def one(df):
    return df.first()[0]


def test_minute_mark_and_bucket_end(rows):
    df = rows(
        "t:ts",
        [("2022-09-25 13:00:01",), ("2022-09-25 13:15:00",), ("2022-09-25 13:15:00.000001",), ("2022-09-25 13:59:59",), ("2022-09-25 14:00:00",)],
    )
    got = df.select(timebucket.minute_mark("t"), timebucket.bucket_end("t")).collect()
    assert [r[0] for r in got] == [15, 15, 30, 60, 0]
    assert [r[1] for r in got] == [
        at("2022-09-25 13:15"), at("2022-09-25 13:15"), at("2022-09-25 13:30"), at("2022-09-25 14:00"), at("2022-09-25 14:00"),
    ]


def test_floor_seven_minutes_is_aligned_to_the_epoch(rows):
    times = ["1970-01-01 00:20:00", "2022-09-25 13:59:59.999999", "2024-02-29 00:00:00", "1969-12-31 23:59:00"]
    got = rows("t:ts", [(t,) for t in times]).select(timebucket.floor_minutes("t", 7)).collect()
    assert [r[0] for r in got] == [pd.Timestamp(t).floor("7min").to_pydatetime() for t in times]
    assert got[0][0] == at("1970-01-01 00:14")


def test_ids(rows):
    df = rows("t:ts", [("2022-09-25 14:00:00",)])
    made = df.select(timebucket.bucket_id(F.lit("KDEN"), "t").alias("id"))
    assert one(made) == "KDEN_22-09-25_1300_60"
    assert one(made.select(timebucket.end_of_id("id"))) == at("2022-09-25 14:00")
    assert one(made.select(timebucket.station_of_id("id"))) == "KDEN"


@pytest.mark.parametrize(
    "t, expected",
    [
        ("2022-09-25 01:15:00", "KDEN_220925_0100_15"),
        ("2022-09-25 04:00:00", "KDEN_220925_0100_180"),
        ("2022-09-25 05:15:00", "KDEN_220925_0500_15"),
    ],
)
def test_submission_id(rows, t, expected):
    df = rows("t:ts", [(t,)])
    assert one(df.select(timebucket.submission_id(F.lit("KDEN"), F.col("t")))) == expected


def test_forecast_steps(rows):
    df = rows("t:ts", [("2022-09-25 00:15:00",)])
    steps = one(df.select(timebucket.forecast_steps("t")))
    assert len(steps) == 12 and steps[0] == at("2022-09-25 01:15") and steps[-1] == at("2022-09-25 04:00")


def day_hour(rows, base, day, hour, legacy=None):
    df = rows("t:ts", [(base,)]).select(timebucket.month_frame("t").alias("f"))
    return one(df.select(timebucket.day_hour("f", str(day), str(hour), legacy=legacy)))


def test_period_over_month_end(rows):
    assert day_hour(rows, "2022-09-30 18:00:00", 30, 18) == at("2022-09-30 18:00")
    assert day_hour(rows, "2022-09-30 18:00:00", 1, 24) == at("2022-10-02 00:00")
    assert day_hour(rows, "2022-09-30 18:00:00", 1, 24, "end") == at("2022-09-01 00:00")
    assert day_hour(rows, "2022-12-31 23:00:00", 1, 5) == at("2023-01-01 05:00")
    assert day_hour(rows, "2023-01-01 00:00:00", 31, 23) == at("2022-12-31 23:00")
    assert day_hour(rows, "2022-02-15 00:00:00", 30, 0, "start") is None
    assert day_hour(rows, "2022-02-15 00:00:00", 30, 0, "end") == at("2022-03-30 00:00")
    assert day_hour(rows, "2022-09-30 18:00:00", 45, 3) is None


def test_spine_sizes_and_cycle(spark):
    train = spine(spark)
    test = spine(spark, part="test", max_cycles=11)
    assert train.count() == 266_760
    assert spine(spark, end=codes.CYCLE_END_OBSERVED).count() == 266_880
    assert test.count() == 84_480
    assert spine(spark, part="test").count() == 84_480

    def hours(df):
        return {r[0] for r in df.select("hour_start").distinct().collect()}

    in_train, in_test = hours(train), hours(test)
    assert at("2022-09-24 23:00") in in_train and at("2022-09-25 00:00") in in_test
    assert at("2022-10-02 23:00") in in_test and at("2022-10-03 00:00") in in_train
    assert not in_train & in_test


def test_spine_positions_are_dense(spark):
    for part in ("train", "test", "all"):
        low, high, n, distinct = (
            spine(spark, ["A", "B"], part=part)
            .filter("station = 'B'")
            .agg(F.min("pos"), F.max("pos"), F.count("*"), F.count_distinct("pos"))
            .first()
        )
        assert low == 0 and high == n - 1 and distinct == n


def test_legacy_block_hour(rows):
    df = rows("t:ts", [("2022-09-25 06:30:00",)])
    assert one(df.select(timebucket.legacy_block_hour("t"))) == 5
