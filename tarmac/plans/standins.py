"""The roles of the flight and weather tables, played by the tables at hand.

``events`` gives arrivals (its type is the station), observations, forecast lines and report texts. Every row of the
table takes part. Each role exists twice: as a DataFrame and as a common table expression for the check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions.timebucket import DAY_US, HOUR_US, epoch_us, floor_us, from_us
from tarmac.operators.spine import spine, station_order
from tarmac.sources.tables import table

STATIONS = ["view", "signup", "purchase", "error", "click"]
CYCLE_DAYS, TRAIN_DAYS = 8, 6


def hours_of(times: DataFrame, column: str, unit: str = "hour") -> tuple[str, str]:
    """First and last hour of a grid whose buckets hold every time of a column, from one aggregate; the first hour is that
    of the ``unit`` it lies in. A time exactly on the hour belongs to the hour before."""
    us = epoch_us(column)
    low, high = (from_us(end(us) - 1) for end in (F.min, F.max))
    shown = [F.date_format(F.date_trunc(u, t), "yyyy-MM-dd HH:mm:ss") for u, t in ((unit, low), ("hour", high))]
    return tuple(times.agg(*shown).first())


def grid(spark: SparkSession, folder: str, part: str = "all") -> DataFrame:
    """Quarter hours from the first event's day to the last event, for the five stations; cycles of six training days and
    two test days."""
    start, end = hours_of(table(spark, folder, "events"), "ts", "day")
    return spine(spark, STATIONS, start, end, part, CYCLE_DAYS, TRAIN_DAYS)


_DAY = "date_diff('day', first_hour, hour_start)"


def grid_sql(part: str = "all") -> str:
    keep = {"all": "true", "train": f"{_DAY} % {CYCLE_DAYS} < {TRAIN_DAYS}", "test": f"{_DAY} % {CYCLE_DAYS} >= {TRAIN_DAYS}"}
    days = {"all": CYCLE_DAYS, "train": TRAIN_DAYS, "test": CYCLE_DAYS - TRAIN_DAYS}[part]
    skip = TRAIN_DAYS if part == "test" else 0
    names = ", ".join(f"('{s}', {i})" for i, s in enumerate(STATIONS, start=1))
    return f"""
    span AS (SELECT date_trunc('day', min(ts) - INTERVAL 1 MICROSECOND)::TIMESTAMP AS first_hour,
                    date_trunc('hour', max(ts) - INTERVAL 1 MICROSECOND)::TIMESTAMP AS last_hour FROM events),
    hours AS (SELECT first_hour, unnest(generate_series(first_hour, last_hour, INTERVAL 1 HOUR)) AS hour_start FROM span),
    grid AS (
      SELECT s.station, s.station_ord::INTEGER AS station_ord, hour_start,
             hour_start + to_minutes(q.m) AS bucket_end,
             ({_DAY} // {CYCLE_DAYS})::INTEGER AS cycle,
             ((({_DAY} // {CYCLE_DAYS}) * {days} + {_DAY} % {CYCLE_DAYS} - {skip}) * 96
              + extract('hour' FROM hour_start) * 4 + q.m // 15 - 1)::BIGINT AS pos
      FROM hours, (VALUES {names}) s(station, station_ord), (VALUES (15), (30), (45), (60)) q(m)
      WHERE {keep[part]})"""


def arrivals(spark: SparkSession, folder: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """A flight is one user on one day; a small value stands for a flight that never arrived."""
    return table(spark, folder, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("."), F.date_format("ts", "yyyyMMdd")).alias("gufi"),
        F.col("event_type").alias("station"),
        station_order(F.col("event_type"), STATIONS).alias("station_ord"),
        F.when(F.col("value") >= 5, F.col("ts")).alias("arrival_ts"),
        *[column.alias(name) for name, column in (extra or {}).items()],
    )


ARRIVALS_SQL = f"""
    arrivals AS (
      SELECT user_id || '.' || strftime(ts, '%Y%m%d') AS gufi, event_type AS station,
             list_position({STATIONS!r}, event_type)::INTEGER AS station_ord,
             CASE WHEN value >= 5 THEN ts END AS arrival_ts
      FROM events)"""


COUNTS_SQL = """
    seen AS (
      SELECT gufi, station, arrival_ts FROM arrivals WHERE arrival_ts IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY gufi ORDER BY station_ord, arrival_ts) = 1),
    ends AS (
      SELECT station, count(*) AS n,
             CASE WHEN time_bucket(INTERVAL 15 MINUTES, arrival_ts) = arrival_ts THEN arrival_ts
                  ELSE time_bucket(INTERVAL 15 MINUTES, arrival_ts) + INTERVAL 15 MINUTES END AS bucket_end
      FROM seen GROUP BY ALL),
    counted AS (SELECT grid.*, coalesce(n, 0)::BIGINT AS value FROM grid LEFT JOIN ends USING (station, bucket_end))"""


def counts_sql(part: str = "all") -> str:
    """The grid with its counts, as ``counted``."""
    return f"WITH {grid_sql(part)}, {ARRIVALS_SQL}, {COUNTS_SQL}"


WEATHER = ["temperature", "visibility", "wind_speed"]


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("station"),
        F.col("ts").alias("datetime"),
        "event_id",
        F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("temperature"),
        (F.col("value") * 100).alias("visibility"),
        F.when(F.col("value") < 120, (F.col("user_id") % 40).cast("double")).alias("wind_speed"),
    )


OBSERVATIONS_SQL = """
    observations AS (
      SELECT event_type AS station, ts AS datetime, event_id,
             CASE WHEN user_id % 7 <> 0 THEN value END AS temperature,
             value * 100 AS visibility,
             CASE WHEN value < 120 THEN (user_id % 40)::DOUBLE END AS wind_speed
      FROM events)"""

FORECAST_ORDER = ["issue_ts", "line_no"]


def forecast_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A line per event: its user decides kind and role, its time the report it belongs to.

    Reports start every six hours plus up to 28 minutes, so most starts lie off the grid.
    """
    user, us = F.col("user_id"), epoch_us("ts")
    valid = floor_us(us, 6 * HOUR_US) + (user % 5) * F.lit(7 * 60_000_000)
    role = F.floor(user / 3) % 4
    return table(spark, folder, "events").select(
        F.col("event_type").alias("station"),
        F.element_at(F.array(F.lit("original"), F.lit("amended"), F.lit("corrected")), (user % 3 + 1).cast("int")).alias("kind"),
        from_us(valid).alias("validity_start"),
        F.when(role == 1, from_us(us + F.lit(20 * 60_000_000))).alias("from_time"),
        F.when(role == 2, from_us(valid + F.lit(2 * HOUR_US))).alias("tempo_start"),
        F.when(role == 3, from_us(us - F.lit(DAY_US))).alias("becmg_start"),
        F.col("ts").alias("issue_ts"),
        F.col("event_id").alias("line_no"),
        F.when(F.col("value") < 70, F.col("value")).alias("temperature"),
        F.when(user % 2 == 0, (user % 7).cast("double")).alias("visibility"),
        (user % 40).cast("double").alias("wind_speed"),
    )


FORECASTS_SQL = """
    staged AS (
      SELECT *, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') + to_minutes((user_id % 5) * 7) AS valid,
             (user_id // 3) % 4 AS role
      FROM events),
    forecasts AS (
      SELECT event_type AS station, ['original', 'amended', 'corrected'][user_id % 3 + 1] AS kind,
             valid AS validity_start,
             CASE role WHEN 1 THEN ts + INTERVAL 20 MINUTES END AS from_time,
             CASE role WHEN 2 THEN valid + INTERVAL 2 HOURS END AS tempo_start,
             CASE role WHEN 3 THEN ts - INTERVAL 24 HOURS END AS becmg_start,
             ts AS issue_ts, event_id AS line_no,
             CASE WHEN value < 70 THEN value END AS temperature,
             CASE WHEN user_id % 2 = 0 THEN (user_id % 7)::DOUBLE END AS visibility,
             (user_id % 40)::DOUBLE AS wind_speed
      FROM staged)"""


def asof_sql(source: str = "grid") -> str:
    """Values of the newest observation within six hours, as ``observed``; brute force over the definition."""
    return f"""
    newest AS (
      SELECT g.*, o.datetime, o.temperature, o.visibility, o.wind_speed
      FROM {source} g ASOF LEFT JOIN
        (SELECT * FROM observations QUALIFY row_number() OVER (PARTITION BY station, datetime ORDER BY event_id DESC) = 1) o
        ON g.station = o.station AND g.bucket_end >= o.datetime),
    observed AS (
      SELECT * EXCLUDE (datetime, temperature, visibility, wind_speed),
             CASE WHEN datetime >= bucket_end - INTERVAL 6 HOURS THEN temperature END AS temperature,
             CASE WHEN datetime >= bucket_end - INTERVAL 6 HOURS THEN visibility END AS visibility,
             CASE WHEN datetime >= bucket_end - INTERVAL 6 HOURS THEN wind_speed END AS wind_speed
      FROM newest)"""


def forecast_asof_sql(source: str = "grid", legacy: bool = False) -> str:
    """Forecast in force, as ``forecast``, from every line of the newest report."""

    def field(v: str) -> str:
        parts = [f"base.{v}", f"change.{v}", f"above.{v}"] if legacy else [f"change.{v}", f"base.{v}"]
        return f"coalesce({', '.join(parts)})"

    def overlay(v: str) -> str:
        kinds = ", ".join(f"max(CASE WHEN kind = '{k}' THEN {v} END)" for k in ("corrected", "amended", "original"))
        return f"coalesce({kinds}) AS {v}"

    values = "{'temperature': temperature, 'visibility': visibility, 'wind_speed': wind_speed}"
    is_base = "from_time IS NULL AND tempo_start IS NULL AND becmg_start IS NULL"
    started = "(from_time <= bucket_end OR tempo_start <= bucket_end OR becmg_start <= bucket_end)"
    return f"""
    starts AS (SELECT DISTINCT station, kind, validity_start FROM forecasts),
    picked AS (
      SELECT g.station, g.bucket_end, s.kind, max(s.validity_start) AS validity_start
      FROM {source} g JOIN starts s ON g.station = s.station AND s.validity_start <= g.bucket_end
        AND s.validity_start >= date_trunc('day', g.bucket_end) - INTERVAL 6 HOURS
      GROUP BY ALL),
    candidates AS (
      SELECT p.station, p.bucket_end, p.kind, f.* EXCLUDE (station, kind),
             {is_base} AS is_base, coalesce({started}, false) AS started
      FROM picked p JOIN forecasts f USING (station, kind, validity_start)),
    changes AS (
      SELECT *, first_value(CASE WHEN started THEN line_no END) OVER (
        PARTITION BY station, bucket_end, kind ORDER BY started DESC, issue_ts DESC, line_no DESC) AS change_no
      FROM candidates),
    changed AS (
      SELECT *, first_value(CASE WHEN started THEN issue_ts END) OVER (
        PARTITION BY station, bucket_end, kind ORDER BY started DESC, issue_ts DESC, line_no DESC) AS change_ts
      FROM changes),
    states AS (
      SELECT station, bucket_end, kind,
             last({values} ORDER BY issue_ts, line_no) FILTER (is_base) AS base,
             last({values} ORDER BY issue_ts, line_no) FILTER (started) AS change,
             last({values} ORDER BY issue_ts, line_no)
               FILTER (is_base AND (issue_ts < change_ts OR (issue_ts = change_ts AND line_no < change_no))) AS above
      FROM changed GROUP BY ALL),
    fields AS (
      SELECT station, bucket_end, kind, {', '.join(f'{field(v)} AS {v}' for v in WEATHER)} FROM states),
    overlaid AS (SELECT station, bucket_end, {', '.join(overlay(v) for v in WEATHER)} FROM fields GROUP BY ALL),
    forecast AS (SELECT g.*, o.* EXCLUDE (station, bucket_end) FROM {source} g LEFT JOIN overlaid o USING (station, bucket_end))"""
