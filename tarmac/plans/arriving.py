"""State that is kept while rows arrive: first-seen counts, sketches, codes; and as-of joins at any instant."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions.timebucket import DAY_US, HOUR_US, epoch_us, floor_minutes, from_us
from tarmac.operators import code_table, sketches
from tarmac.operators.asof_any import asof_any
from tarmac.operators.counts import flights_of_buckets
from tarmac.plans import standins as s
from tarmac.plans.registry import query
from tarmac.session import scratch
from tarmac.sources.tables import table, write_table
from tarmac.streaming import first_seen

_PLACE = f"list_position({s.STATIONS!r}, station)::INTEGER AS station_ord"


@query(
    "kept_up_first_seen",
    f"WITH {s.ARRIVALS_SQL}, {s.COUNTS_SQL.split('counted AS')[0].rstrip().rstrip(',')} SELECT {_PLACE}, bucket_end, n FROM ends",
)
def kept_up_first_seen(spark, folder):
    """Three runs, each over rows of all days; flights that turn up at an earlier station leave their old bucket."""
    state = scratch(spark, "first-seen")
    rows = s.arrivals(spark, folder).withColumn("file", F.concat(F.lit("part"), F.pmod(F.xxhash64("gufi", "arrival_ts"), F.lit(3)).cast("string")))
    for run, upto in enumerate(("part0", "part1", "part2")):
        first_seen.update_first_seen(rows.filter(F.col("file") <= upto), state, run, source="file")
    return first_seen.first_seen_counts(spark, state)


_DELAY, _GAP = 2 * DAY_US, DAY_US
# One user in forty comes with the last batch only: the early days of these are late, the others within the delay.


@query(
    "streamed_first_seen",
    f"""WITH {s.ARRIVALS_SQL.replace('FROM events', ', user_id, ts FROM events')},
    bounds AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM events),
    dealt AS (SELECT a.*, CASE WHEN user_id % 40 = 0 THEN 2 WHEN epoch_us(ts) < bounds.a + (z - bounds.a) // 3 THEN 0
                WHEN epoch_us(ts) < bounds.a + (z - bounds.a) * 2 // 3 THEN 1 ELSE 2 END AS batch FROM arrivals a, bounds),
    highs AS (SELECT b.batch, max(d.arrival_ts) AS newest FROM (SELECT DISTINCT batch FROM dealt) b LEFT JOIN dealt d ON d.batch < b.batch GROUP BY ALL),
    marked AS (SELECT dealt.*, coalesce(arrival_ts < newest - INTERVAL 2 DAYS, false) AS late FROM dealt JOIN highs USING (batch)),
    first AS (SELECT * FROM marked WHERE NOT late AND arrival_ts IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY gufi ORDER BY station_ord, arrival_ts) = 1),
    both_ AS (SELECT 'counted' AS kind, station_ord, arrival_ts FROM first UNION ALL SELECT 'late', station_ord, arrival_ts FROM marked WHERE late)
    SELECT kind, station_ord, CASE WHEN time_bucket(INTERVAL 15 MINUTES, arrival_ts) = arrival_ts THEN arrival_ts
           ELSE time_bucket(INTERVAL 15 MINUTES, arrival_ts) + INTERVAL 15 MINUTES END AS bucket_end, count(*) AS n
    FROM both_ GROUP BY ALL""",
)
def streamed_first_seen(spark, folder):
    """The first-seen count as an event-time stream over three arriving batches; late rows are kept and counted apart."""
    state = scratch(spark, "streamed")
    us = epoch_us("ts")
    events = table(spark, folder, "events")
    low, high = events.agg(F.min(us), F.max(us)).first()
    third = F.when(F.col("user_id") % 40 == 0, 2).when(us < F.lit(low + (high - low) // 3), 0).when(us < F.lit(low + (high - low) * 2 // 3), 1)
    arrivals = s.arrivals(spark, folder, extra={"batch": third.otherwise(2)})
    for batch in range(3):
        part = arrivals.filter(F.col("batch") == batch).select("gufi", "station_ord", "arrival_ts")
        write_table(part, f"{state}/in", mode="append")
        first_seen.sort_out_late(spark, f"{state}/in", state, _DELAY)
        first_seen.count_stream(spark, state, _DELAY, _GAP)
    first_seen.close_stream(spark, state, _DELAY, _GAP)
    late = first_seen.late_arrivals(spark, state).groupBy("station_ord", first_seen.bucket_end("arrival_ts").alias("bucket_end")).agg(F.count("*").alias("n"))
    counted = first_seen.streamed_counts(spark, state)
    return counted.withColumn("kind", F.lit("counted")).unionByName(late.withColumn("kind", F.lit("late")))


_ASKED_SQL = """
    asked AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE event_type END AS station,
                     ts + to_microseconds((user_id % 7) * 13000001 - 26000002) AS ts FROM events)"""


@query(
    "asof_any_instant",
    f"""WITH {s.OBSERVATIONS_SQL}, {_ASKED_SQL},
    newest AS (
      SELECT a.*, epoch_us(a.ts) - epoch_us(o.datetime) AS age_us, o.temperature, o.visibility, o.wind_speed
      FROM asked a ASOF LEFT JOIN
        (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY station, datetime ORDER BY event_id DESC) = 1) o
        ON a.station = o.station AND a.ts >= o.datetime)
    SELECT event_id, station, ts, {', '.join(f'CASE WHEN age_us <= 1800000000 THEN {v} END AS {v}' for v in (*s.WEATHER, 'age_us'))} FROM newest""",
)
def asof_any_instant(spark, folder):
    """Newest observation of the last half hour at event times, off every grid; more than half of all rows at one station."""
    user = F.col("user_id")
    asked = table(spark, folder, "events").select(
        "event_id",
        F.when(user % 2 == 0, F.lit("view")).otherwise(F.col("event_type")).alias("station"),
        from_us(epoch_us("ts") + (user % 7) * 13_000_001 - 26_000_002).alias("ts"),
    )
    return asof_any(asked, s.observations(spark, folder), s.WEATHER, [F.col("event_id")], tolerance_us=HOUR_US // 2, age="age_us")


_BUCKETS_SQL = """
    e AS (SELECT event_type AS station, user_id, date_trunc('minute', ts) AS ts FROM events),
    b AS (SELECT station, user_id, ts, time_bucket(INTERVAL 15 MINUTES, ts) AS f FROM e),
    x AS (SELECT station, user_id, f AS bucket FROM b UNION ALL SELECT station, user_id, f - INTERVAL 15 MINUTES FROM b WHERE f = ts)"""


@query(
    "distinct_from_sketches",
    f"""WITH {_BUCKETS_SQL}
    SELECT level, station, date_trunc(level, bucket)::TIMESTAMP AS start, count(DISTINCT user_id) AS flights, true AS within_bound
    FROM x, (VALUES ('hour'), ('day')) t(level) GROUP BY ALL""",
)
def distinct_from_sketches(spark, folder):
    """Distinct flights of hours and days, merged from stored sketches of buckets, against the exact count: within four
    standard errors, for every one of them."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("gufi"), F.col("event_type").alias("station"), floor_minutes("ts", 1).alias("ts")
    )
    path = scratch(spark, "sketches")
    write_table(sketches.flight_sketches(rows), path)
    stored = spark.read.parquet(path)
    exact = flights_of_buckets(rows, "gufi", "station", "ts", 15)
    found = []
    for level in ("hour", "day"):
        start = F.date_trunc(level, "time_bucket").cast("timestamp_ntz").alias("start")
        estimates = sketches.merged_flights(stored, "station", start).withColumnRenamed("flights", "estimate")
        counts = exact.groupBy("station", start).agg(F.count_distinct("gufi").alias("flights"))
        near = F.abs(F.col("estimate") - F.col("flights")) <= F.col("flights") * (4 * sketches.distinct_error()) + 0.5
        found.append(counts.join(estimates, ["station", "start"]).select(F.lit(level).alias("level"), "station", "start", "flights", near.alias("within_bound")))
    return found[0].unionByName(found[1])


@query(
    "quantiles_from_sketches",
    "SELECT event_type AS station, count(value) AS samples, true AS q10_near, true AS q50_near, true AS q90_near FROM events GROUP BY 1",
)
def quantiles_from_sketches(spark, folder):
    """Quantiles of each station, merged from a stored sketch a day, with the error of their rank measured on all rows."""
    rows = table(spark, folder, "events").select(F.col("event_type").alias("station"), "ts", "value")
    path = scratch(spark, "sketches")
    write_table(sketches.value_sketches(rows, ["station", F.to_date("ts").alias("day")], "value"), path)
    quantiles = (0.1, 0.5, 0.9)
    merged = sketches.merged_quantiles(spark.read.parquet(path), ["station"], quantiles)
    errors = sketches.rank_errors(rows, ["station"], "value", merged, quantiles)
    # five times the error that 99 of 100 estimates keep
    near = [(F.col(f"{q}_error") <= 5 * sketches.quantile_error()).alias(f"{q}_near") for q in ("q10", "q50", "q90")]
    return merged.join(errors, "station").select("station", "samples", *near)


@query(
    "lasting_codes",
    """WITH first AS (SELECT p_name, row_number() OVER (ORDER BY p_name) AS code FROM (SELECT DISTINCT p_name FROM part WHERE p_partkey % 3 <> 0)),
    more AS (SELECT p_name, (SELECT count(*) FROM first) + row_number() OVER (ORDER BY p_name) AS code
             FROM (SELECT DISTINCT p_name FROM part WHERE p_name NOT IN (SELECT p_name FROM first)))
    SELECT p_partkey, coalesce(first.code, 0) AS code_then, coalesce(first.code, more.code) AS code_now
    FROM part LEFT JOIN first USING (p_name) LEFT JOIN more USING (p_name)""",
)
def lasting_codes(spark, folder):
    """Codes after a first run and after a second one with more labels: none changes, labels unseen so far share 0."""
    path = scratch(spark, "codes")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    code_table.extend_codes(parts.filter("p_partkey % 3 <> 0"), "p_name", path, 0)
    then = scratch(spark, "codes-then")
    write_table(code_table.with_codes(parts, "p_name", "code_then", path), then)
    code_table.extend_codes(parts, "p_name", path, 1)
    coded = code_table.with_codes(spark.read.parquet(then), "p_name", "code_now", path)
    return coded.select("p_partkey", "code_then", "code_now")
