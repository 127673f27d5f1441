"""Counts, duplicates and joins of flight tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import joins
from tarmac.operators.counts import distinct_flights, throughput, with_throughput, zero_filled_arrivals
from tarmac.operators.dedup import first_seen, keep_last
from tarmac.operators.spine import spine
from tarmac.functions.timebucket import floor_minutes
from tarmac.plans import standins as s
from tarmac.plans.registry import query
from tarmac.sources.flights import thin_out
from tarmac.sources.tables import only_stations, table


@query(
    "arrival_throughput_zero_filled",
    f"{s.counts_sql('train')} SELECT station, hour_start, bucket_end, cycle, pos, value FROM counted",
)
def arrival_throughput_zero_filled(spark, folder):
    """First-seen arrivals per training bucket, zero where none."""
    counts = zero_filled_arrivals(s.grid(spark, folder, "train"), s.arrivals(spark, folder))
    return counts.select("station", "hour_start", "bucket_end", "cycle", "pos", "value")


@query(
    "arrival_throughput_test_part",
    f"{s.counts_sql('test')} SELECT station, hour_start, bucket_end, cycle, pos, value FROM counted",
)
def arrival_throughput_test_part(spark, folder):
    counts = zero_filled_arrivals(s.grid(spark, folder, "test"), s.arrivals(spark, folder))
    return counts.select("station", "hour_start", "bucket_end", "cycle", "pos", "value")


# Midnight order dates put every arrival exactly on the hour: the corrected count keeps them all, the legacy one none.
_ORDER_ARRIVALS = """
    arrivals AS (SELECT o_custkey::VARCHAR AS gufi, o_orderpriority AS station,
                        list_position(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority) AS station_ord,
                        o_orderdate AS arrival_ts FROM orders),
    seen AS (SELECT * FROM arrivals QUALIFY row_number() OVER (PARTITION BY gufi ORDER BY station_ord, arrival_ts) = 1),
    hours AS (SELECT unnest(generate_series(date_trunc('hour', min(o_orderdate) - INTERVAL 1 MICROSECOND)::TIMESTAMP,
                     date_trunc('hour', max(o_orderdate) - INTERVAL 1 MICROSECOND)::TIMESTAMP, INTERVAL 1 HOUR)) AS h FROM orders),
    grid AS (SELECT station, h + to_minutes(m) AS bucket_end
             FROM hours, (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) t(station),
                  (VALUES (15), (30), (45), (60)) q(m))"""
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _order_counts(spark, folder, legacy):
    from tarmac.operators.spine import station_order

    arrivals = table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("gufi"),
        station_order(F.col("o_orderpriority"), _PRIORITIES).alias("station_ord"),
        F.col("o_orderdate").alias("arrival_ts"),
    )
    grid = spine(spark, _PRIORITIES, *s.hours_of(arrivals, "arrival_ts"), "all")
    counts = zero_filled_arrivals(grid, arrivals, legacy)
    return counts.groupBy("station").agg(
        F.count("*").alias("buckets"), F.sum("value").alias("arrivals"), F.count_if(F.col("value") > 0).alias("busy")
    )


@query(
    "on_the_hour_arrivals",
    f"""WITH {_ORDER_ARRIVALS}, n AS (SELECT station, arrival_ts AS bucket_end, count(*) AS n FROM seen GROUP BY ALL)
    SELECT station, count(*) AS buckets, sum(coalesce(n, 0))::BIGINT AS arrivals, count(*) FILTER (n > 0) AS busy
    FROM grid LEFT JOIN n USING (station, bucket_end) GROUP BY station""",
)
def on_the_hour_arrivals(spark, folder):
    """Arrivals exactly on the hour belong to the bucket that ends there."""
    return _order_counts(spark, folder, legacy=False)


@query(
    "on_the_hour_arrivals_legacy",
    f"""WITH {_ORDER_ARRIVALS} SELECT station, count(*) AS buckets, 0::BIGINT AS arrivals, 0::BIGINT AS busy
    FROM grid GROUP BY station""",
)
def on_the_hour_arrivals_legacy(spark, folder):
    return _order_counts(spark, folder, legacy=True)


@query(
    "first_seen_flights",
    f"""WITH {s.ARRIVALS_SQL} SELECT gufi, station, station_ord, arrival_ts FROM arrivals WHERE arrival_ts IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY gufi ORDER BY station_ord, arrival_ts) = 1""",
)
def first_seen_flights(spark, folder):
    return first_seen(s.arrivals(spark, folder))


@query(
    "throughput_floor15",
    """SELECT event_type AS station, time_bucket(INTERVAL 15 MINUTES, ts) AS time_bucket, count(*) AS throughput
    FROM events GROUP BY ALL""",
)
def throughput_floor15(spark, folder):
    return throughput(table(spark, folder, "events").withColumnRenamed("event_type", "station"))


@query(
    "throughput_joined_back",
    """SELECT event_id, event_type AS station, time_bucket(INTERVAL 15 MINUTES, ts) AS time_bucket,
    count(*) OVER (PARTITION BY event_type, time_bucket(INTERVAL 15 MINUTES, ts)) AS throughput FROM events""",
)
def throughput_joined_back(spark, folder):
    rows = table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("station"), floor_minutes("ts", 15).alias("time_bucket")
    )
    return with_throughput(rows).select("event_id", "station", "time_bucket", "throughput")


@query(
    "distinct_per_bucket",
    """WITH e AS (SELECT event_type AS station, user_id, date_trunc('minute', ts) AS ts FROM events),
    b AS (SELECT station, user_id, ts, time_bucket(INTERVAL 15 MINUTES, ts) AS f FROM e),
    x AS (SELECT station, user_id, f AS time_bucket FROM b
          UNION ALL SELECT station, user_id, f - INTERVAL 15 MINUTES FROM b WHERE f = ts)
    SELECT station, time_bucket, count(DISTINCT user_id) AS flights FROM x GROUP BY ALL""",
)
def distinct_per_bucket(spark, folder):
    """Distinct flights with both bucket ends included, on times cut to the minute so that some lie on the grid."""
    rows = table(spark, folder, "events").select(
        F.col("user_id").alias("gufi"), F.col("event_type").alias("station"), floor_minutes("ts", 1).alias("ts")
    )
    return distinct_flights(rows)


_FLOOR7 = "time_bucket(INTERVAL 7 MINUTES, ts, TIMESTAMP '1970-01-01')"


@query(
    "floor7_dedup_first",
    f"""SELECT event_type AS arrival_airport, user_id AS gufi, {_FLOOR7} AS at, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY event_type, user_id, {_FLOOR7} ORDER BY event_id) = 1""",
)
def floor7_dedup_first(spark, folder):
    return thin_out(_tracks(spark, folder), ["at"], [F.col("event_id")])


@query(
    "floor7_dedup_first_legacy",
    f"""SELECT event_type AS arrival_airport, user_id AS gufi, {_FLOOR7} AS at, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY {_FLOOR7} ORDER BY event_id) = 1""",
)
def floor7_dedup_first_legacy(spark, folder):
    return thin_out(_tracks(spark, folder), ["at"], [F.col("event_id")], legacy=True)


def _tracks(spark, folder):
    return table(spark, folder, "events").select(
        F.col("event_type").alias("arrival_airport"), F.col("user_id").alias("gufi"), F.col("ts").alias("at"), "event_id", "value"
    )


@query(
    "exact_duplicates_dropped",
    "SELECT DISTINCT l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem",
)
def exact_duplicates_dropped(spark, folder):
    return table(spark, folder, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag").distinct()


@query(
    "latest_row_per_key",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_row_per_key(spark, folder):
    rows = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return keep_last(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query("station_filter", "SELECT * FROM events WHERE event_type IN ('view', 'signup', 'purchase')")
def station_filter(spark, folder):
    return only_stations(table(spark, folder, "events"), ["view", "signup", "purchase"], "event_type")


_TRACKS_SQL = """
    tfm AS (SELECT user_id AS gufi, event_type AS arrival_airport, ts AS estimated_arrival_time, true AS is_arrival
            FROM events WHERE value >= 50),
    etd AS (SELECT user_id AS gufi, event_type AS arrival_airport, ts AS estimated_departure_time, false AS is_arrival
            FROM events WHERE value < 50)"""


def _two_tracks(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("gufi"), F.col("event_type").alias("arrival_airport"), "ts", "value"
    )
    arriving = events.filter("value >= 50").select("gufi", "arrival_airport", F.col("ts").alias("estimated_arrival_time"))
    leaving = events.filter("value < 50").select("gufi", "arrival_airport", F.col("ts").alias("estimated_departure_time"))
    return arriving, leaving


@query(
    "outer_join_tracks",
    """WITH e AS (SELECT user_id AS gufi, event_type AS arrival_airport, event_id % 2 = 0 AS is_arrival, ts, value FROM events),
    a AS (SELECT gufi, is_arrival, arrival_airport, ts AS estimated_arrival_time FROM e WHERE value >= 50),
    d AS (SELECT gufi, is_arrival, arrival_airport, ts AS estimated_departure_time FROM e WHERE value < 50)
    SELECT gufi, is_arrival, arrival_airport, estimated_arrival_time, estimated_departure_time
    FROM a FULL OUTER JOIN d USING (gufi, is_arrival, arrival_airport)""",
)
def outer_join_tracks(spark, folder):
    """Two track tables whose flag is data, so that some rows meet and others stand alone."""
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("gufi"),
        (F.col("event_id") % 2 == 0).alias("is_arrival"),
        F.col("event_type").alias("arrival_airport"),
        "ts",
        "value",
    )
    keys = list(joins.TRACK_KEYS)
    return joins.outer_join_tracks(
        events.filter("value >= 50").select(*keys, F.col("ts").alias("estimated_arrival_time")),
        events.filter("value < 50").select(*keys, F.col("ts").alias("estimated_departure_time")),
    )


@query(
    "outer_as_union",
    f"""WITH {_TRACKS_SQL} SELECT gufi, is_arrival, arrival_airport, estimated_arrival_time, estimated_departure_time
    FROM tfm FULL OUTER JOIN etd USING (gufi, is_arrival, arrival_airport)""",
)
def outer_as_union(spark, folder):
    """The same rows without a shuffle."""
    return joins.merge_tracks(*_two_tracks(spark, folder)).select(
        *joins.TRACK_KEYS, "estimated_arrival_time", "estimated_departure_time"
    )


@query(
    "runway_enrichment",
    """WITH r AS (SELECT o_orderkey AS gufi, 'K' || (o_orderkey % 10) AS arrival_airport, o_orderdate FROM orders),
    t AS (SELECT l_orderkey AS gufi, 'K' || (l_orderkey % 10) AS arrival_airport, l_linenumber, l_shipdate FROM lineitem),
    m AS (SELECT o_orderkey AS gufi, 'K' || (o_orderkey % 10) AS arrival_airport, o_orderpriority AS aircraft_type
          FROM orders WHERE o_orderstatus <> 'P')
    SELECT gufi, arrival_airport, aircraft_type, o_orderdate, l_linenumber, l_shipdate
    FROM m JOIN r USING (arrival_airport, gufi) JOIN t USING (arrival_airport, gufi)""",
)
def runway_enrichment(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")

    def keyed(df, key):
        return df.withColumn("gufi", F.col(key)).withColumn(
            "arrival_airport", F.concat(F.lit("K"), (F.col(key) % 10).cast("string"))
        )

    runways = keyed(orders, "o_orderkey").select("gufi", "arrival_airport", "o_orderdate")
    tracks = keyed(lines, "l_orderkey").select("gufi", "arrival_airport", "l_linenumber", "l_shipdate")
    aircraft = keyed(orders.filter("o_orderstatus <> 'P'"), "o_orderkey").select(
        "gufi", "arrival_airport", F.col("o_orderpriority").alias("aircraft_type")
    )
    return joins.enrich_flights(runways, tracks, aircraft)


@query(
    "weather_bucket_join",
    f"""WITH {s.OBSERVATIONS_SQL},
    w AS (SELECT station, time_bucket(INTERVAL 15 MINUTES, datetime) AS time_bucket, temperature AS value, visibility
          FROM observations QUALIFY row_number() OVER (
            PARTITION BY station, time_bucket(INTERVAL 15 MINUTES, datetime) ORDER BY datetime DESC, event_id DESC) = 1),
    f AS (SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'view' ELSE event_type END AS station,
                 time_bucket(INTERVAL 15 MINUTES, ts) AS time_bucket, value FROM events)
    SELECT f.*, w.value AS value_taf, w.visibility FROM f LEFT JOIN w USING (station, time_bucket)""",
)
def weather_bucket_join(spark, folder):
    """Flights with the weather of their bucket; the clashing column gets a suffix; one station is heavily loaded."""
    weather = joins.latest_per_bucket(
        s.observations(spark, folder), ["temperature", "visibility"], [F.col("datetime"), F.col("event_id")]
    ).withColumnRenamed("temperature", "value")
    flights = table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("user_id") % 2 == 0, F.lit("view")).otherwise(F.col("event_type")).alias("station"),
        floor_minutes("ts", 15).alias("time_bucket"),
        "value",
    )
    return joins.join_weather(flights, weather).select(*flights.columns, "value_taf", "visibility")


_RELEVANT = """
    f AS (SELECT event_type AS station, time_bucket(INTERVAL 15 MINUTES, ts) AS time_bucket
          FROM events WHERE value >= 100 AND event_type <> 'error'),
    w AS (SELECT event_id, event_type AS station, time_bucket(INTERVAL 15 MINUTES, ts) AS time_bucket FROM events)"""


@query(
    "semi_relevant_forecasts",
    f"""WITH {_RELEVANT} SELECT event_id, station, time_bucket FROM w
    WHERE station IN (SELECT station FROM f) AND time_bucket IN (SELECT time_bucket FROM f)""",
)
def semi_relevant_forecasts(spark, folder):
    weather = table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("station"), floor_minutes("ts", 15).alias("time_bucket"), "value"
    )
    flights = weather.filter("value >= 100 AND station <> 'error'")
    return joins.relevant_weather(weather.drop("value"), flights).select("event_id", "station", "time_bucket")


@query(
    "anti_unprocessed",
    "SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def anti_unprocessed(spark, folder):
    done = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = table(spark, folder, "orders")
    return joins.unprocessed(orders, done, "o_orderkey").select(*orders.columns)


@query(
    "tagged_union",
    """SELECT o_orderkey, o_orderdate,
    CASE o_orderstatus WHEN 'O' THEN 'original' WHEN 'P' THEN 'amended' ELSE 'corrected' END AS kind,
    o_orderstatus = 'P' AS is_ammend, o_orderstatus = 'F' AS is_correct,
    CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS o_totalprice FROM orders""",
)
def tagged_union(spark, folder):
    """Three tables of which only one has every column."""
    orders = table(spark, folder, "orders")
    parts = {k: orders.filter(F.col("o_orderstatus") == k).select("o_orderkey", "o_orderdate") for k in "OP"}
    full = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate", "o_totalprice")
    return joins.union_kinds(parts["O"], parts["P"], full)
