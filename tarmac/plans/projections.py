"""Projections, filters, casts and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import casting, numeric
from tarmac.functions.codes import COVER_OKTAS
from tarmac.functions.timebucket import lenient_timestamp
from tarmac.operators import series
from tarmac.plans import standins as s
from tarmac.plans.registry import query
from tarmac.schemas import schema
from tarmac.sources.tables import table


@query(
    "project_rename_tag",
    """SELECT o_orderkey AS gufi, o_orderdate AS estimated_arrival_time, true AS is_arrival, 'KDEN' AS arrival_airport
    FROM orders""",
)
def project_rename_tag(spark, folder):
    orders = table(spark, folder, "orders").drop("o_totalprice", "o_custkey")
    return (
        orders.withColumnsRenamed({"o_orderkey": "gufi", "o_orderdate": "estimated_arrival_time"})
        .withColumns({"is_arrival": F.lit(True), "arrival_airport": F.lit("KDEN")})
        .select("gufi", "estimated_arrival_time", "is_arrival", "arrival_airport")
    )


@query("present_columns_only", "SELECT event_id, ts, value FROM events")
def present_columns_only(spark, folder):
    return casting.present_columns(table(spark, folder, "events"), ["event_id", "altitude", "ts", "gust", "value"])


@query(
    "conformed_columns",
    "SELECT event_id::INTEGER AS event_id, value::DOUBLE AS value, NULL::VARCHAR AS cover_type_1, props FROM events",
)
def conformed_columns(spark, folder):
    return casting.conform(
        table(spark, folder, "events"), schema("event_id:int value:double cover_type_1:string props:string")
    )


@query(
    "lenient_cast",
    """WITH t AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'not a date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS raw,
    CASE WHEN user_id % 5 = 0 THEN 'M' || floor(value)::BIGINT ELSE floor(value)::BIGINT::VARCHAR END AS num FROM events)
    SELECT event_id, try_cast(raw AS TIMESTAMP) AS at, try_cast(num AS INTEGER) AS num FROM t""",
)
def lenient_cast(spark, folder):
    """Unreadable text becomes null and stops nothing."""
    whole = F.floor("value").cast("long").cast("string")
    return table(spark, folder, "events").select(
        "event_id",
        lenient_timestamp(
            F.when(F.col("user_id") % 3 == 0, F.lit("not a date")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        ).alias("at"),
        F.when(F.col("user_id") % 5 == 0, F.concat(F.lit("M"), whole)).otherwise(whole).try_cast("int").alias("num"),
    )


@query(
    "numeric_downcast",
    """SELECT l_orderkey::INTEGER AS l_orderkey, l_linenumber, l_returnflag,
    try_cast(l_partkey * 2000000 AS INTEGER) AS big, round(l_quantity::FLOAT::DOUBLE, 4) AS l_quantity FROM lineitem""",
)
def numeric_downcast(spark, folder):
    wide = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_partkey") * F.lit(2000000)).alias("big"), "l_quantity"
    )
    return casting.downcast(wide).withColumn("l_quantity", F.round(F.col("l_quantity").cast("double"), 4))


@query(
    "numbers_to_double",
    "SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal FROM customer",
)
def numbers_to_double(spark, folder):
    return casting.numbers_to_double(table(spark, folder, "customer").drop("c_mktsegment"))


@query(
    "dtype_enforced",
    """SELECT s_suppkey::INTEGER AS s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey, s_acctbal::VARCHAR AS s_acctbal
    FROM supplier""",
)
def dtype_enforced(spark, folder):
    return casting.conform(
        table(spark, folder, "supplier"), schema("s_suppkey:int s_name:string s_nationkey:long s_acctbal:string")
    )


@query(
    "struct_expand",
    """SELECT event_id, value * 2 AS doubled, value >= 100 AS high, length(props)::INTEGER AS size FROM events""",
)
def struct_expand(spark, folder):
    """A computed record becomes columns."""
    record = F.struct(
        (F.col("value") * 2).alias("doubled"), (F.col("value") >= 100).alias("high"), F.length("props").alias("size")
    )
    return casting.expand_struct(table(spark, folder, "events").select("event_id", record.alias("r")), "r")


@query(
    "horizon_rows",
    """WITH t AS (SELECT DISTINCT event_type AS station, date_trunc('hour', ts) AS start FROM events)
    SELECT station, start, k::INTEGER AS step, start + to_minutes(45 + 15 * k) AS at FROM t, generate_series(1, 12) g(k)""",
)
def horizon_rows(spark, folder):
    """Twelve forecast steps after each context block."""
    blocks = (
        table(spark, folder, "events")
        .select(F.col("event_type").alias("station"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start"))
        .distinct()
    )
    return series.horizon_rows(blocks)


@query(
    "time_range_filter",
    """SELECT event_id, ts FROM events
    WHERE ts >= TIMESTAMP '2024-01-05 06:00:00' AND ts <= TIMESTAMP '2024-01-11 18:00:00'""",
)
def time_range_filter(spark, folder):
    low, high = (F.lit(t).cast("timestamp_ntz") for t in ("2024-01-05 06:00:00", "2024-01-11 18:00:00"))
    return table(spark, folder, "events").filter(F.col("ts").between(low, high)).select("event_id", "ts")


@query(
    "regex_fullmatch_filter",
    """WITH t AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE event_type END AS station FROM events)
    SELECT event_id, station FROM t WHERE regexp_full_match(station, '.+')""",
)
def regex_fullmatch_filter(spark, folder):
    """Neither null nor empty text passes."""
    station = F.when(F.col("user_id") % 4 > 1, F.col("event_type")).when(F.col("user_id") % 4 == 1, F.lit(""))
    return (
        table(spark, folder, "events").select("event_id", station.alias("station")).filter(F.col("station").rlike("^.+$"))
    )


@query(
    "boolean_filter",
    """SELECT user_id, ts FROM (SELECT user_id, ts, value >= 5 AS is_arrival FROM events) WHERE is_arrival""",
)
def boolean_filter(spark, folder):
    return (
        table(spark, folder, "events")
        .withColumn("is_arrival", F.col("value") >= 5)
        .filter("is_arrival")
        .select("user_id", "ts")
    )


@query(
    "arrival_flag",
    f"WITH {s.ARRIVALS_SQL} SELECT gufi, station, arrival_ts, arrival_ts IS NOT NULL AS is_arrival FROM arrivals",
)
def arrival_flag(spark, folder):
    flights = s.arrivals(spark, folder).select("gufi", "station", "arrival_ts")
    return flights.withColumn("is_arrival", F.col("arrival_ts").isNotNull())


@query(
    "null_predicates",
    f"""WITH {s.OBSERVATIONS_SQL} SELECT station, count_if(temperature IS NULL)::BIGINT AS no_temperature,
    count_if(temperature IS NOT NULL AND wind_speed IS NOT NULL)::BIGINT AS whole FROM observations GROUP BY station""",
)
def null_predicates(spark, folder):
    t, w = F.col("temperature"), F.col("wind_speed")
    return (
        s.observations(spark, folder)
        .groupBy("station")
        .agg(F.count_if(t.isNull()).alias("no_temperature"), F.count_if(t.isNotNull() & w.isNotNull()).alias("whole"))
    )


@query(
    "rows_without_gaps",
    f"""WITH {s.OBSERVATIONS_SQL} SELECT event_id, temperature, wind_speed FROM observations
    WHERE temperature IS NOT NULL AND wind_speed IS NOT NULL""",
)
def rows_without_gaps(spark, folder):
    rows = s.observations(spark, folder).dropna(subset=["temperature", "wind_speed"])
    return rows.select("event_id", "temperature", "wind_speed")


@query("distinct_keys", "SELECT DISTINCT event_type AS station, ts::DATE AS day FROM events")
def distinct_keys(spark, folder):
    return table(spark, folder, "events").select(F.col("event_type").alias("station"), F.to_date("ts").alias("day")).distinct()


@query(
    "cover_code_lookup",
    """WITH t AS (SELECT event_id, ['SKC', 'FEW', 'SCT', 'BKN', 'OVC', 'VV'][user_id % 6 + 1] AS cover FROM events)
    SELECT event_id, cover, CASE cover WHEN 'SKC' THEN 0 WHEN 'FEW' THEN 2 WHEN 'SCT' THEN 4 WHEN 'BKN' THEN 7
    WHEN 'OVC' THEN 8 END::INTEGER AS oktas FROM t""",
)
def cover_code_lookup(spark, folder):
    """A code the table lacks gives null."""
    names = F.array(*[F.lit(c) for c in ("SKC", "FEW", "SCT", "BKN", "OVC", "VV")])
    cover = F.element_at(names, (F.col("user_id") % 6 + 1).cast("int"))
    coded = table(spark, folder, "events").select("event_id", cover.alias("cover"))
    return coded.withColumn("oktas", numeric.code_lookup(COVER_OKTAS, F.col("cover")))


@query(
    "conditional_max",
    """SELECT event_type AS station, max(ts) FILTER (ts <= TIMESTAMP '2024-01-16 12:00:00') AS newest FROM events GROUP BY 1""",
)
def conditional_max(spark, folder):
    at = F.lit("2024-01-16 12:00:00").cast("timestamp_ntz")
    return (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("station"))
        .agg(F.max(F.when(F.col("ts") <= at, F.col("ts"))).alias("newest"))
    )


@query(
    "preview_in_order",
    "SELECT event_id, ts, value FROM events ORDER BY ts, event_id LIMIT 5",
)
def preview_in_order(spark, folder):
    """The first rows in time order: a top-k per partition, not a sort of the table."""
    return table(spark, folder, "events").select("event_id", "ts", "value").orderBy("ts", "event_id").limit(5)
