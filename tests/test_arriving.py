"""State that grows with its input: counts, streams, codes, sketches, as-of answers."""

import random
from datetime import datetime, timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from tarmac.functions.timebucket import DAY_US, HOUR_US, bucket_end
from tarmac.operators import code_table, sketches
from tarmac.operators.asof_any import asof_any
from tarmac.operators.counts import distinct_flights
from tarmac.operators.dedup import first_seen_packed
from tarmac.sources.tables import write_table
from tarmac.streaming import first_seen

SPEC = "gufi:string station_ord:int arrival_ts:ts"


def full_counts(arrivals):
    """The batch count over all rows at once."""
    seen = first_seen_packed(arrivals)
    counts = seen.groupBy("station_ord", bucket_end("arrival_ts").alias("bucket_end")).agg(F.count("*").alias("n"))
    return sorted(tuple(r) for r in counts.collect())


def listed(df):
    return sorted(tuple(r) for r in df.select("station_ord", "bucket_end", "n").collect())


@pytest.fixture(scope="module")
def flights(rows):
    """A flight with a third of all rows, flights that come back at earlier stations, rows that are never seen."""
    dice = random.Random(5)
    data = []
    for i in range(600):
        day = dice.randrange(6)
        when = datetime(2024, 3, 1 + day, dice.randrange(20), dice.randrange(60), dice.choice([0, 0, 17]))
        name = "hot" if i % 3 == 0 else f"f{dice.randrange(80)}"
        data.append((name, dice.randrange(1, 5), when))
    data += [(None, 1, datetime(2024, 3, 1)), ("x", None, datetime(2024, 3, 1)), ("y", 1, None)]
    return rows(SPEC, data).cache()


def test_runs_over_parts_equal_one_run(spark, flights, tmp_path):
    state = f"{tmp_path}/state"
    dealt = flights.withColumn("part", F.pmod(F.hash("gufi", "station_ord", "arrival_ts"), F.lit(4)))
    for run in range(4):
        first_seen.update_first_seen(dealt.filter(F.col("part") == run), state, run)
        want = full_counts(dealt.filter(F.col("part") <= run))
        assert listed(first_seen.first_seen_counts(spark, state)) == want


def test_a_flight_moves_to_an_earlier_station(spark, rows, tmp_path):
    state = f"{tmp_path}/state"
    first_seen.update_first_seen(rows(SPEC, [("a", 3, "2024-03-02 10:05:00"), ("b", 3, "2024-03-02 10:05:00")]), state, 0)
    first_seen.update_first_seen(rows(SPEC, [("a", 1, "2024-03-05 08:00:00"), ("b", 4, "2024-03-01 00:00:00")]), state, 1)
    assert listed(first_seen.first_seen_counts(spark, state)) == [(1, at("2024-03-05 08:00"), 1), (3, at("2024-03-02 10:15"), 1)]
    first_seen.update_first_seen(rows(SPEC, [("b", 1, "2024-03-05 07:59:00")]), state, 2)
    assert listed(first_seen.first_seen_counts(spark, state)) == [(1, at("2024-03-05 08:00"), 2)]


def test_a_run_that_was_lost_is_repeated(spark, flights, tmp_path, monkeypatch):
    state = f"{tmp_path}/state"
    early, late = flights.filter("arrival_ts < '2024-03-04'"), flights.filter("arrival_ts >= '2024-03-04'")
    first_seen.update_first_seen(early, state, 0)
    before = listed(first_seen.first_seen_counts(spark, state))
    write = first_seen._replace

    def lost(df, path, run, *more):
        if path.endswith("minima"):
            raise RuntimeError("executor lost")
        write(df, path, run, *more)

    monkeypatch.setattr(first_seen, "_replace", lost)
    with pytest.raises(RuntimeError, match="lost"):
        first_seen.update_first_seen(late, state, 1)
    assert listed(first_seen.first_seen_counts(spark, state)) == before  # half a run counts for nothing
    monkeypatch.setattr(first_seen, "_replace", write)
    first_seen.update_first_seen(late, state, 1)
    assert listed(first_seen.first_seen_counts(spark, state)) == full_counts(early.unionByName(late))


def test_only_touched_days_are_read(spark, flights, rows, tmp_path):
    state = f"{tmp_path}/state"
    first_seen.update_first_seen(flights, state, 0)
    counts = spark.read.schema(first_seen.COUNTS).parquet(f"{state}/counts")
    deltas = rows("station_ord:int bucket_end:ts n:long day:int", [(1, "2024-03-02 10:15:00", 1, 19784)])
    touched = first_seen.touched_counts(counts, deltas)
    assert {r.day for r in touched.select("day").distinct().collect()} == {19784}
    plan = touched._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [day" in plan.replace("isnotnull(day#", "day#") or "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_files_are_taken_once(spark, flights, tmp_path):
    state = f"{tmp_path}/state"
    named = flights.withColumn("file", F.lit("one"))
    first_seen.update_first_seen(named, state, 0, source="file")
    again = named.withColumn("station_ord", F.lit(1)).unionByName(named.limit(0))
    first_seen.update_first_seen(again, state, 1, source="file")
    assert listed(first_seen.first_seen_counts(spark, state)) == full_counts(flights)


def test_a_stream_in_batches_equals_the_batch_count(spark, flights, tmp_path):
    state = f"{tmp_path}/state"
    for day in range(1, 7):
        part = flights.filter(F.dayofmonth("arrival_ts") == day)
        write_table(part, f"{state}/in", mode="append")
        for _ in range(2 if day == 3 else 1):  # starting again without new files changes nothing
            first_seen.sort_out_late(spark, f"{state}/in", state, DAY_US)
            query = first_seen.count_stream(spark, state, DAY_US, 10 * DAY_US)
            dropped = [o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]]
            assert sum(dropped) == 0
    assert first_seen.streamed_counts(spark, state).count() == 0  # no flight is complete yet
    first_seen.close_stream(spark, state, DAY_US, 10 * DAY_US)
    assert listed(first_seen.streamed_counts(spark, state)) == full_counts(flights)
    assert first_seen.late_arrivals(spark, state).count() == 0


def test_late_rows_are_kept_apart_and_nothing_is_lost(spark, rows, tmp_path):
    state = f"{tmp_path}/state"
    batches = [
        [("a", 2, "2024-03-01 10:00:00"), ("b", 2, "2024-03-03 10:00:00")],
        [("c", 1, "2024-03-02 12:00:00"), ("a", 1, "2024-03-01 23:00:00"), ("d", 1, "2024-03-02 09:59:59")],
    ]
    for batch in batches:
        write_table(rows(SPEC, batch), f"{state}/in", mode="append")
        first_seen.sort_out_late(spark, f"{state}/in", state, DAY_US)
        first_seen.count_stream(spark, state, DAY_US, DAY_US)
    first_seen.close_stream(spark, state, DAY_US, DAY_US)
    assert sorted(r.gufi for r in first_seen.late_arrivals(spark, state).collect()) == ["a", "d"]
    want = [(1, at("2024-03-02 12:00"), 1), (2, at("2024-03-01 10:00"), 1), (2, at("2024-03-03 10:00"), 1)]
    assert listed(first_seen.streamed_counts(spark, state)) == want


# codes


def test_codes_stay_and_follow_in_order(spark, rows, tmp_path):
    path = f"{tmp_path}/codes"
    code_table.extend_codes(rows("name:string", [("m",), ("b",), (None,), ("b",)]), "name", path, 0)
    code_table.extend_codes(rows("name:string", [("a",), ("z",), ("m",)]), "name", path, 1)
    code_table.extend_codes(rows("name:string", [("z",)]), "name", path, 2)
    code_table.extend_codes(rows("name:string", [("a",), ("z",), ("m",)]), "name", path, 1)  # repeated after a loss
    assert dict(tuple(r) for r in code_table.codes_of(spark, path).collect()) == {"b": 1, "m": 2, "a": 3, "z": 4}
    coded = code_table.with_codes(rows("name:string", [("m",), ("new",), (None,)]), "name", "code", path)
    assert sorted(r.code for r in coded.collect()) == [0, 0, 2]


def test_many_labels_over_many_ranges(spark, tmp_path):
    path = f"{tmp_path}/codes"
    labels = spark.range(5000).select(F.format_string("%05d", "id").alias("name"))
    code_table.extend_codes(labels.filter("id % 2 = 0"), "name", path, 0)
    code_table.extend_codes(labels, "name", path, 1)
    got = {r.label: r.code for r in code_table.codes_of(spark, path).collect()}
    assert sorted(got.values()) == list(range(1, 5001))
    evens = [got[f"{i:05d}"] for i in range(0, 5000, 2)]
    assert evens == list(range(1, 2501)) and [got[f"{i:05d}"] for i in range(1, 5000, 2)] == list(range(2501, 5001))


# sketches


def test_merged_sketches_stay_within_their_bounds(spark):
    i = F.col("id")
    moment = F.timestamp_micros(F.lit(1_709_251_200_000_000) + (i % 86_400) * 1_000_000).cast("timestamp_ntz")
    rows_ = spark.range(300_000).select(F.lit("s").alias("station"), (i * 7 % 90_001).alias("gufi"), moment.alias("ts"), F.pow(i % 1013, F.lit(2)).alias("value"))
    stored = sketches.flight_sketches(rows_)
    merged = sketches.merged_flights(stored, "station").first().flights
    assert abs(merged - 90_001) <= 4 * sketches.distinct_error() * 90_001
    exact = distinct_flights(rows_).groupBy("station").agg(F.sum("flights").alias("n")).first().n
    assert exact >= 90_001
    quantiles = (0.05, 0.5, 0.95)
    stored = sketches.value_sketches(rows_, ["station", F.hour("ts").alias("hour")], "value")
    found = sketches.merged_quantiles(stored, ["station"], quantiles)
    assert found.first().samples == 300_000
    errors = sketches.rank_errors(rows_, ["station"], "value", found, quantiles).first()
    assert max(errors.q05_error, errors.q50_error, errors.q95_error) <= 5 * sketches.quantile_error()


# as-of


def brute_asof(left, right, tolerance):
    out = []
    for key, when in left:
        seen = [(t, o, v) for k, t, o, v in right if k is not None and k == key and t is not None and when is not None and t <= when]
        newest = max(seen, key=lambda r: (r[0], r[1]), default=None)
        fresh = newest is not None and when - newest[0] <= tolerance
        out.append((key, when, newest[2] if fresh else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("slot_rows", [1, 5, 1_000_000])
def test_asof_at_any_instant(rows, slot_rows):
    dice = random.Random(slot_rows)

    def instant():
        return datetime(2024, 3, 1) + timedelta(microseconds=dice.randrange(20 * 3600) * 1_000_000 + dice.choice([0, 1, 999_999]))

    moments = [instant() for _ in range(120)]
    left = [(dice.choice(["hot", "hot", "a", None]), dice.choice([*moments, None])) for _ in range(300)]
    right = [(dice.choice(["hot", "hot", "a", "b", None]), dice.choice(moments), i, dice.choice([None, i])) for i in range(150)]
    got = asof_any(
        rows("station:string ts:ts", left), rows("station:string datetime:ts o:long v:long", right), ["v"], [F.col("o")],
        tolerance_us=HOUR_US, slot_rows=slot_rows,
    )
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_asof(left, right, timedelta(hours=1))


def test_asof_edges(rows):
    left = rows("station:string ts:ts", [("a", "2024-03-01 06:00:00"), ("a", "2024-03-01 06:00:01"), ("a", "2024-02-29 23:00:00"), ("a", "2024-03-01 00:00:00")])
    right = rows("station:string datetime:ts o:long v:string", [("a", "2024-03-01 00:00:00", 1, "old"), ("a", "2024-03-01 00:00:00", 2, "new")])
    got = asof_any(left, right, ["v"], [F.col("o")], tolerance_us=6 * HOUR_US, age="age_us")
    assert {r.ts: (r.v, r.age_us) for r in got.collect()} == {
        at("2024-03-01 06:00"): ("new", 6 * HOUR_US),
        at("2024-03-01 06:00:01"): (None, None),
        at("2024-02-29 23:00"): (None, None),
        at("2024-03-01 00:00"): ("new", 0),
    }
    none = asof_any(left, right.limit(0), ["v"], [F.col("o")], tolerance_us=1)
    assert [r.v for r in none.collect()] == [None] * 4


def test_asof_splits_a_burst_of_instants(spark):
    """One key, one slot, 60,000 instants in a minute and as many rows at one instant."""
    base = 1_709_251_200_000_000
    i = F.col("id")
    micros = F.when(i % 2 == 0, F.lit(base + 30_000_000)).otherwise(base + i * 500)
    left = spark.range(120_000).select(F.lit("k").alias("station"), F.timestamp_micros(micros).cast("timestamp_ntz").alias("ts"))
    right = spark.range(120_000).select(F.lit("k").alias("station"), F.timestamp_micros(F.lit(base) + i * 500).cast("timestamp_ntz").alias("datetime"), i.alias("o"), i.alias("v"))
    got = asof_any(left, right, ["v"], [F.col("o")], tolerance_us=HOUR_US, slot_rows=4000)
    assert got.groupBy("v").count().count() == 60_001 and got.filter("v IS NULL").count() == 0
    assert got.filter("v = 60000").count() == 60_000
