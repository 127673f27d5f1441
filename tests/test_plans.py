"""What no plan may contain, and results under heavy skew."""

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from tarmac.operators.asof import asof_observation
from tarmac.operators.counts import throughput, with_throughput, zero_filled_arrivals
from tarmac.operators.dedup import keep_first
from tarmac.operators.spine import spine, station_order
from tarmac.plans import QUERIES

FORBIDDEN = [
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroupsInPandas",
    "GlobalLimit",
]
# These count a whole table: one row of each task meets in one.
COUNTS = {"null_audit", "row_count_audit"}
TRAINS = {"gbt_forecast", "blended_forecast", "early_stopped_boosting", "random_search", "saved_model_forecast"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - TRAINS))
def test_plan_has_no_cross_join_no_python_and_no_single_task(spark, name):
    plan = QUERIES[name](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert [word for word in FORBIDDEN if word in plan] == []
    assert "SinglePartition" not in plan or name in COUNTS


STATIONS = ["hot", "a", "b", "c"]


@pytest.fixture(scope="module")
def skewed(spark):
    """200,000 rows over two days; half of them at one station, half of those in one quarter hour."""
    i = F.col("id")
    hot = i % 2 == 0
    second = F.when(i % 4 == 0, 36_000 + i % 900).otherwise((i * 37) % 172_800)
    return (
        spark.range(200_000)
        .select(
            i,
            F.when(hot, "hot").otherwise(F.element_at(F.array(*[F.lit(s) for s in "abc"]), (i % 3 + 1).cast("int"))).alias("station"),
            F.timestamp_micros(F.lit(1_661_990_400_000_000) + second * 1_000_000).cast("timestamp_ntz").alias("ts"),
            F.when(i % 3 == 0, F.lit("one")).otherwise(i.cast("string")).alias("gufi"),
        )
    )


def test_counts_under_skew(spark, skewed):
    arrivals = skewed.select("gufi", station_order(F.col("station"), STATIONS).alias("station_ord"), F.col("ts").alias("arrival_ts"))
    grid = spine(spark, STATIONS, "2022-08-31 00:00:00", "2022-09-02 23:00:00", "all")
    total = zero_filled_arrivals(grid, arrivals).agg(F.sum("value")).first()[0]
    assert total == skewed.select("gufi").distinct().count()


def test_bucket_counts_under_skew(skewed):
    counts = throughput(skewed)
    assert counts.agg(F.sum("throughput")).first()[0] == 200_000
    # The hot bucket has a quarter of all rows, and reaches the shuffle as one row per task.
    assert counts.agg(F.max("throughput")).first()[0] >= 50_000
    rows = skewed.withColumn("time_bucket", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    assert with_throughput(rows).count() == 200_000


def test_first_row_of_a_hot_key(skewed):
    first = keep_first(skewed, ["gufi"], [F.col("ts"), F.col("id")]).filter("gufi = 'one'").first()
    expected = skewed.filter("gufi = 'one'").orderBy("ts", "id").first()
    assert (first.id, first.ts) == (expected.id, expected.ts)


def test_asof_under_skew(spark, skewed):
    grid = spine(spark, STATIONS, "2022-09-01 00:00:00", "2022-09-02 23:00:00", "all").select("station", "bucket_end")
    observations = skewed.withColumnRenamed("ts", "datetime").withColumn("seen", F.col("datetime"))
    got = asof_observation(grid, observations, ["id", "seen"], [F.col("id")])
    expected = (
        grid.join(skewed, "station")
        .filter("ts <= bucket_end AND ts >= bucket_end - INTERVAL 6 HOURS")
        .groupBy("station", "bucket_end")
        .agg(F.max(F.struct("ts", "id")).alias("m"))
        .select("station", "bucket_end", F.col("m.id").alias("id"), F.col("m.ts").alias("seen"))
    )
    assert got.filter("id IS NOT NULL").exceptAll(expected).count() == 0
    assert got.filter("id IS NOT NULL").count() == expected.count()


def test_reduction_happens_before_the_shuffle(spark):
    plan = QUERIES["arrival_throughput_zero_filled"](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "partial_count" in plan and "SortAggregate" not in plan and "Window" not in plan


def test_few_keys_leave_the_rows_where_they_are(spark):
    """Parameters and stations are broadcast after a count, also where Spark doesn't see beforehand that they are few."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("minmax_by_station", "semi_relevant_forecasts"):
            plan = QUERIES[name](spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_many_keys_are_joined_by_shuffling(spark, monkeypatch):
    from tarmac.operators import joins

    rows = spark.range(100).select((F.col("id") % 7).alias("k"))
    monkeypatch.setattr(joins, "FEW_ROWS", 3)
    assert "Broadcast" not in joins.few(rows.distinct(), 7)._jdf.queryExecution().logical().toString()
    assert rows.join(joins.counted_few(rows.distinct()), "k").count() == 100
