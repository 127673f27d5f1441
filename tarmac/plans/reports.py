"""Report texts, rendered from ``events`` and parsed back.

Each event is rendered as one observation file and one forecast file, so the texts grow with the table and every
file stays as short as a real one. The check renders or derives the same fields in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import schemas
from tarmac.functions import codes, extract
from tarmac.functions.text import first_match
from tarmac.functions.timebucket import HOUR_US, MINUTE_US, day_hour, epoch_us, floor_us, from_us, month_frame
from tarmac.operators.asof import asof_observation
from tarmac.plans import standins as s
from tarmac.plans.registry import query
from tarmac.session import scratch
from tarmac.sources import reports
from tarmac.sources.tables import table, write_table

STATIONS = ["VIEW", "SIGN", "PURC", "CLIC"]
CLOUDS = ["CLR", "FEW030", "SCT045CB BKN100", "FEW010 SCT020 BKN030TCU OVC200", "VV002"]
VISIBILITIES = ["9999", "10SM", "1 1/2SM", "P6SM", "0800", "1/4SM"]


def _pick(names, key):
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names) + 1).cast("int"))


def _two(number):
    return F.lpad(number.cast("string"), 2, "0")


def observation_texts(spark, folder):
    """``value, source_file``: one good block, then one without a second line."""
    user, whole = F.col("user_id"), F.floor("value")
    stamp = F.date_format("ts", "yyyy/MM/dd HH:mm")
    wind = F.concat(
        F.lpad((user * 10 % 360).cast("string"), 3, "0"),
        _two(whole % 60),
        F.when(F.col("value") > 60, F.concat(F.lit("G"), _two(whole % 60 + 9))).otherwise(""),
        F.lit("KT"),
    )
    degrees = F.concat(F.when(user % 2 == 0, "M").otherwise(""), _two(user % 35), F.lit("/M"), _two(user % 20))
    hectopascal = F.concat(F.lit("Q"), F.lpad((user % 60 + 980).cast("string"), 4, "0"))
    pressure = F.when(user % 3 == 0, F.lit("A2992")).otherwise(hectopascal)
    line = F.concat_ws(
        " ",
        F.upper(F.substring("event_type", 1, 4)),
        F.concat(F.date_format("ts", "ddHHmm"), F.lit("Z")),
        wind,
        _pick(VISIBILITIES, whole),
        _pick(CLOUDS, user),
        degrees,
        pressure,
    )
    text = F.concat(stamp, F.lit("\n"), line, F.lit("\n\n"), stamp, F.lit("\n"))
    return table(spark, folder, "events").select(
        text.alias("value"), F.concat(F.col("event_id").cast("string"), F.lit("/obs.txt")).alias("source_file")
    )


_OBSERVATION_LINES = f"""
    lines AS (
      SELECT event_id || '/obs.txt' AS source_file, date_trunc('minute', ts)::TIMESTAMP AS datetime,
        upper(substr(event_type, 1, 4)) || ' ' || strftime(ts, '%d%H%MZ') || ' '
        || lpad((user_id * 10 % 360)::VARCHAR, 3, '0') || lpad((floor(value)::BIGINT % 60)::VARCHAR, 2, '0')
        || CASE WHEN value > 60 THEN 'G' || lpad((floor(value)::BIGINT % 60 + 9)::VARCHAR, 2, '0') ELSE '' END || 'KT '
        || {VISIBILITIES!r}[floor(value)::BIGINT % {len(VISIBILITIES)} + 1] || ' '
        || {CLOUDS!r}[user_id % {len(CLOUDS)} + 1] || ' '
        || CASE WHEN user_id % 2 = 0 THEN 'M' ELSE '' END || lpad((user_id % 35)::VARCHAR, 2, '0') || '/M' || lpad((user_id % 20)::VARCHAR, 2, '0') || ' '
        || CASE WHEN user_id % 3 = 0 THEN 'A2992' ELSE 'Q' || lpad((user_id % 60 + 980)::VARCHAR, 4, '0') END AS line
      FROM events)"""


def _observation_sql(legacy: bool) -> str:
    def number(pattern, group, kind="DOUBLE"):
        return f"try_cast(nullif(regexp_extract(line, '{pattern}', {group}), '') AS {kind})"

    def degrees(pattern, part):
        pair = f"nullif(regexp_extract(line, '{pattern}', 1), '')"
        return f"try_cast(replace(split_part({pair}, '/', {part}), 'M', '-') AS DOUBLE) + 0.0::DOUBLE"

    fraction = r"(?:^|\s)(?:(\d{1,2}) )?M?(\d)/(\d{1,2})SM(?:\s|$)"

    temperature = codes.TEMPERATURE_LOOSE if legacy else codes.TEMPERATURE_WORD
    wind = codes.WIND_GUST_AFTER_UNIT if legacy else codes.WIND
    metres = number(codes.METRES, 1) if legacy else f"""coalesce({number(codes.METRES_WORD, 1)},
        (coalesce({number(fraction, 1)}, 0) + {number(fraction, 2)} / {number(fraction, 3)}) * 1609.344,
        {number(codes.MILES_WHOLE, 1)} * 1609.344)"""
    altimeter = f"{number(codes.ALTIMETER_Q, 1, 'INTEGER')} * 10"
    if not legacy:
        altimeter = f"coalesce({altimeter}, round_even({number(codes.ALTIMETER_A, 1)} / 10 * 33.8639, 0)::INTEGER)"
    layers = ", ".join(
        f"""substr(layers[{i}], 1, 3) AS cover_type_{i}, try_cast(substr(layers[{i}], 4, 3) AS INTEGER) * 100 AS altitude_{i},
        nullif(substr(layers[{i}], 7), '') AS cloud_type_{i}"""
        for i in (1, 2, 3)
    )
    names = ", ".join(f"'{n}'" for n in STATIONS)
    return f"""WITH {_OBSERVATION_LINES},
    parsed AS (SELECT *, regexp_extract_all(line, '{codes.CLOUD_LAYER}', 1) AS layers FROM lines)
    SELECT source_file, 0::INTEGER AS block_no, substr(line, 1, 4) AS station_id, datetime,
      round({metres}::FLOAT::DOUBLE, 3) AS visibility, ({altimeter})::INTEGER AS altimeter_tenths_hpa,
      {degrees(temperature, 1)} AS temperature, {degrees(temperature, 2)} AS dew_point,
      {number(wind, 1)} AS wind_direction, {number(wind, 2)} AS wind_speed, {number(wind, 3)} AS wind_gust, {layers}
    FROM parsed WHERE substr(line, 1, 4) IN ({names})"""


_SINGLES = ["temperature", "dew_point", "wind_direction", "wind_speed", "wind_gust"]


def _as_double(df):
    return df.withColumns({c: F.col(c).cast("double") for c in _SINGLES}).withColumn(
        "visibility", F.round(F.col("visibility").cast("double"), 3)
    )


def _stored(texts):
    """The texts as a table of several files, as a folder of reports would be; rendering is one task on a small table."""
    path = scratch(texts.sparkSession, "texts")
    write_table(texts, path, max_records_per_file=5000)
    return texts.sparkSession.read.schema(texts.schema).parquet(path)


@query("parse_observation_text", _observation_sql(False))
def parse_observation_text(spark, folder):
    """Observation text to typed rows of the stations asked for."""
    return _as_double(reports.parse_observations(_stored(observation_texts(spark, folder)), STATIONS))


@query("parse_observation_text_legacy", _observation_sql(True))
def parse_observation_text_legacy(spark, folder):
    return _as_double(reports.parse_observations(observation_texts(spark, folder), STATIONS, legacy=True))


_FIELDS = [c for c in schemas.OBSERVATIONS.names if c not in ("station_id", "datetime")]


@query(
    "reports_on_spine",
    f"""WITH {s.grid_sql()}, parsed AS ({_observation_sql(False)}),
    newest AS (
      SELECT g.station, g.bucket_end, o.* EXCLUDE (source_file, block_no, station_id) FROM grid g ASOF LEFT JOIN
        (SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY station_id, datetime ORDER BY source_file DESC) = 1) o
        ON upper(substr(g.station, 1, 4)) = o.station_id AND g.bucket_end >= o.datetime)
    SELECT station, bucket_end, {', '.join(f'CASE WHEN datetime >= bucket_end - INTERVAL 6 HOURS THEN {c} END AS {c}' for c in _FIELDS)} FROM newest""",
)
def reports_on_spine(spark, folder):
    """From report texts to the grid: every field of the newest parsed observation of the last six hours."""
    parsed = reports.parse_observations(_stored(observation_texts(spark, folder)), STATIONS)
    grid = s.grid(spark, folder).select("station", "bucket_end", F.upper(F.substring("station", 1, 4)).alias("station_id"))
    found = asof_observation(grid, parsed, _FIELDS, [F.col(c) for c in reports.ORDER], station="station_id")
    return _as_double(found.drop("station_id"))


@query(
    "rejected_blocks",
    "SELECT event_id || '/obs.txt' AS source_file, 1::INTEGER AS block_no, strftime(ts, '%Y/%m/%d %H:%M') AS block FROM events",
)
def rejected_blocks(spark, folder):
    """Blocks that give no row are kept apart, not lost."""
    return reports.rejected_observations(observation_texts(spark, folder))


@query(
    "cloud_layers",
    f"""WITH {_OBSERVATION_LINES}, l AS (SELECT source_file, regexp_extract_all(line, '{codes.CLOUD_LAYER}', 1)[1:3] AS layers FROM lines)
    SELECT source_file, substr(layers[i], 1, 3) AS cover, try_cast(substr(layers[i], 4, 3) AS INTEGER) * 100 AS altitude,
      nullif(substr(layers[i], 7), '') AS cloud, i::INTEGER AS layer
    FROM l, generate_series(1, 3) g(i) WHERE i <= len(layers)""",
)
def cloud_layers(spark, folder):
    """Up to three layers of each report, one row per layer."""
    lines = reports.observation_blocks(observation_texts(spark, folder)).filter(F.col("line").isNotNull())
    lines = lines.withColumn("layers", extract.layers_of(F.col("line")))
    layers = extract.cloud_layers(F.col("layers"))
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("layer"),
                layers[f"cover_type_{i}"].alias("cover"),
                layers[f"altitude_{i}"].alias("altitude"),
                layers[f"cloud_type_{i}"].alias("cloud"),
            )
            for i in (1, 2, 3)
        ]
    )
    return lines.select("source_file", F.explode(rows).alias("r")).select("source_file", "r.*").filter("cover IS NOT NULL")


@query(
    "dayhour_to_timestamp",
    """WITH t AS (SELECT event_id, o.ts + to_days((user_id % 5)::INTEGER - 2) AS "at", o.ts FROM events o)
    SELECT event_id, date_trunc('hour', "at")::TIMESTAMP AS "at", date_trunc('day', "at")::TIMESTAMP + INTERVAL 1 DAY AS midnight FROM t""",
)
def dayhour_to_timestamp(spark, folder):
    """Day and hour within two days of the base, over month ends; hour 24 is the next midnight."""
    at = from_us(epoch_us("ts") + (F.col("user_id") % 5 - 2) * F.lit(24 * HOUR_US))
    rows = table(spark, folder, "events").select("event_id", month_frame("ts").alias("frame"), at.alias("t"))
    return rows.select(
        "event_id",
        day_hour("frame", "day(t)", "hour(t)").alias("at"),
        day_hour("frame", "day(t)", "24").alias("midnight"),
    )


@query(
    "dayhour_to_timestamp_legacy",
    """WITH t AS (SELECT event_id, ts, (user_id % 31 + 1)::INTEGER AS d,
      make_date(1995 + (user_id % 6)::INTEGER, (event_id % 12 + 1)::INTEGER, 15) AS base FROM events),
    m AS (SELECT *, extract('day' FROM last_day(base)) AS days, date_trunc('month', base)::TIMESTAMP AS month,
      (date_trunc('month', base) + INTERVAL 1 MONTH)::TIMESTAMP AS next_month FROM t)
    SELECT event_id, CASE WHEN d <= days THEN month + to_days(d - 1) END AS period_start,
      CASE WHEN d <= days THEN month + to_days(d - 1)
           WHEN d <= extract('day' FROM last_day(next_month::DATE)) THEN next_month + to_days(d - 1) END AS period_end FROM m""",
)
def dayhour_to_timestamp_legacy(spark, folder):
    """The older rule: same month, hour 24 back to 0, only a missing day moves an end to the next month."""
    day = (F.col("user_id") % 31 + 1).cast("int")
    base = F.make_date((F.col("user_id") % 6 + 1995).cast("int"), (F.col("event_id") % 12 + 1).cast("int"), F.lit(15))
    return (
        table(spark, folder, "events")
        .select("event_id", day.alias("d"), month_frame(base.cast("timestamp_ntz")).alias("frame"))
        .select(
            "event_id",
            day_hour("frame", "d", "24", legacy="start").alias("period_start"),
            day_hour("frame", "d", "24", legacy="end").alias("period_end"),
        )
    )


MARKS = ["", "Ammendment\n", "CORRECTION\n", "Ammendment\nCorrection\n"]


def forecast_texts(spark, folder):
    """``value, source_file``: one block of a date line, marker lines, a base line and three change lines."""
    user = F.col("user_id")
    base = floor_us(epoch_us("ts"), HOUR_US)
    events = table(spark, folder, "events").select(
        "event_id", "event_type", "user_id", F.floor("value").alias("whole"), base.alias("us")
    )

    def at(minutes, fmt):
        return F.date_format(from_us(F.col("us") + F.lit(minutes * MINUTE_US)), fmt)

    def ends(minutes):
        """Midnight is written as hour 24 of the day before."""
        return F.when(
            F.pmod(F.col("us") + F.lit(minutes * MINUTE_US), F.lit(24 * HOUR_US)) == 0,
            F.concat(at(minutes - 1, "dd"), F.lit("24")),
        ).otherwise(at(minutes, "ddHH"))

    wind = F.concat(F.lpad((user * 10 % 360).cast("string"), 3, "0"), _two(F.col("whole") % 60), F.lit("KT"))
    station = F.upper(F.substring("event_type", 1, 4))
    marks = _pick(MARKS, user)
    code = _pick(["", "AMD ", "COR ", "AMD COR "], user)
    head = F.concat(
        F.lit("TAF "), code, station, F.lit(" "), at(0, "ddHHmm"), F.lit("Z "), at(0, "ddHH"), F.lit("/"), ends(1440)
    )
    text = F.concat(
        at(0, "yyyy/MM/dd HH:mm"), F.lit("\n"), marks,
        head, F.lit(" "), wind, F.lit(" P6SM "), _pick(CLOUDS, user), F.lit(" QNH2992INS\n"),
        F.lit("  FM"), at(210, "ddHHmm"), F.lit(" 18012G25KT 1 1/2SM BKN008CB\n\n"),
        F.lit("  TEMPO "), at(240, "ddHH"), F.lit("/"), ends(360), F.lit(" 1/2SM TSRA OVC004\n"),
        F.lit("  BECMG "), at(480, "ddHH"), F.lit("/"), ends(600), F.lit(" "), wind, F.lit(" 9999 SCT250 QNH1013HPA TX"), _two(user % 35), F.lit("/"), at(840, "ddHH"), F.lit("Z TNM"), _two(user % 20), F.lit("/"), at(1260, "ddHH"), F.lit("Z"),
    )
    name = F.concat(
        F.col("event_id").cast("string"), F.lit("/taf."), at(0, "yyyyMMdd"), F.lit("."), at(0, "HH"), F.lit("Z.txt")
    )
    return events.select(text.alias("value"), name.alias("source_file"))


_WIND = "(user_id * 10 % 360)::DOUBLE AS wind_direction, (floor(value)::BIGINT % 60)::DOUBLE AS wind_speed, NULL::DOUBLE AS wind_gust"
_KINDS_SQL = "[['original'], ['amended'], ['corrected'], ['amended', 'corrected']][user_id % 4 + 1]"
_CLOUD_SQL = f"regexp_extract_all({CLOUDS!r}[user_id % {len(CLOUDS)} + 1], '{codes.CLOUD_LAYER}', 1)"

# Lines are numbered within the cleaned block: the date line is 0, a removed marker leaves an empty line in place.
_FIRST = "CASE WHEN user_id % 4 = 0 THEN 1 WHEN user_id % 4 = 3 THEN 3 ELSE 2 END"
_FORECAST_LINES = f"""
    issued AS (SELECT *, date_trunc('hour', ts)::TIMESTAMP AS base, {_FIRST} AS first, {_CLOUD_SQL} AS layers,
      event_id || '/taf.' || strftime(ts, '%Y%m%d.%HZ.txt') AS source_file FROM events),
    roles AS (
      SELECT source_file, user_id, first + 0 AS line_no, base, event_type, NULL::TIMESTAMP AS from_time, NULL::TIMESTAMP AS tempo_start,
        NULL::TIMESTAMP AS tempo_end, NULL::TIMESTAMP AS becmg_start, NULL::TIMESTAMP AS becmg_end, 6.0::DOUBLE AS visibility,
        10132::INTEGER AS altimeter_tenths_hpa, {_WIND}, substr(layers[1], 1, 3) AS cover_type_1,
        try_cast(substr(layers[1], 4, 3) AS INTEGER) * 100 AS altitude_1, nullif(substr(layers[1], 7), '') AS cloud_type_1,
        layers, NULL::DOUBLE AS temperature FROM issued
      UNION ALL SELECT source_file, user_id, first + 1, base, event_type, base + INTERVAL 210 MINUTES, NULL, NULL, NULL, NULL, 1.5, NULL,
        180, 12, 25, 'BKN', 800, 'CB', [], NULL FROM issued
      UNION ALL SELECT source_file, user_id, first + 2, base, event_type, NULL, base + INTERVAL 4 HOURS, base + INTERVAL 6 HOURS, NULL, NULL,
        0.5, NULL, NULL, NULL, NULL, 'OVC', 400, NULL, [], NULL FROM issued
      UNION ALL SELECT source_file, user_id, first + 3, base, event_type, NULL, NULL, NULL, base + INTERVAL 8 HOURS, base + INTERVAL 10 HOURS,
        6.0, 10130, (user_id * 10 % 360)::DOUBLE, (floor(value)::BIGINT % 60)::DOUBLE, NULL, 'SCT', 25000, NULL, [], (user_id % 35)::DOUBLE FROM issued)"""


@query(
    "parse_forecast_lines",
    f"""WITH {_FORECAST_LINES}, k AS (SELECT *, unnest({_KINDS_SQL}) AS kind FROM roles)
    SELECT source_file, 0::INTEGER AS block_no, line_no::INTEGER AS line_no, kind, kind = 'amended' AS is_ammend,
      kind = 'corrected' AS is_correct, upper(substr(event_type, 1, 4)) AS station_id, base AS datetime, base AS validity_start,
      base + INTERVAL 24 HOURS AS validity_end, from_time, tempo_start, tempo_end, becmg_start, becmg_end, visibility,
      altimeter_tenths_hpa, temperature, NULL::DOUBLE AS dew_point, wind_direction, wind_speed, wind_gust, cover_type_1, altitude_1, cloud_type_1,
      substr(layers[2], 1, 3) AS cover_type_2, try_cast(substr(layers[2], 4, 3) AS INTEGER) * 100 AS altitude_2, nullif(substr(layers[2], 7), '') AS cloud_type_2,
      substr(layers[3], 1, 3) AS cover_type_3, try_cast(substr(layers[3], 4, 3) AS INTEGER) * 100 AS altitude_3, nullif(substr(layers[3], 7), '') AS cloud_type_3
    FROM k""",
)
def parse_forecast_lines(spark, folder):
    """Forecast text to one row per line, with roles and times; periods run over midnight and month ends."""
    return reports.parse_forecasts(_stored(forecast_texts(spark, folder)))


@query(
    "rejected_forecast_blocks",
    """SELECT event_id || '/taf.' || CASE WHEN event_id % 5 = 0 THEN 'latest' ELSE strftime(ts, '%Y%m%d.%HZ') END || '.txt' AS source_file,
    0::INTEGER AS block_no, concat_ws(', ', CASE WHEN event_id % 5 = 0 THEN 'issue time' END,
      CASE WHEN event_id % 7 = 0 THEN 'station' END, CASE WHEN event_id % 7 = 0 OR event_id % 5 = 0 THEN 'validity' END) AS missing
    FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0""",
)
def rejected_forecast_blocks(spark, folder):
    """Files whose name has no time, and blocks that are no report."""
    event = F.split("source_file", "/")[0].cast("bigint")
    texts = forecast_texts(spark, folder).withColumn("event", event)
    broken = F.when(F.col("event") % 7 == 0, F.lit("2024/01/01 00:00\nno report here\n")).otherwise(F.col("value"))
    name = F.when(F.col("event") % 5 == 0, F.concat(F.col("event").cast("string"), F.lit("/taf.latest.txt"))).otherwise(F.col("source_file"))
    return reports.rejected_forecasts(texts.select(broken.alias("value"), name.alias("source_file")))


@query(
    "parse_forecast_lines_legacy",
    f"""WITH {_FORECAST_LINES}, k AS (SELECT *, unnest({_KINDS_SQL}) AS kind FROM roles),
    t AS (SELECT *, base + INTERVAL 24 HOURS AS e FROM k),
    z AS (SELECT *, CASE WHEN extract('hour' FROM e) = 0 THEN e - INTERVAL 1 DAY ELSE e END AS written FROM t)
    SELECT source_file, line_no::INTEGER AS line_no, kind, base AS validity_start,
      CASE WHEN extract('day' FROM written) = 1 AND extract('day' FROM base) <> 1
           THEN date_trunc('month', base)::TIMESTAMP + to_hours(extract('hour' FROM written))
           ELSE written END AS validity_end,
      CASE WHEN from_time IS NOT NULL THEN 2.0 WHEN tempo_start IS NOT NULL THEN 2.0 ELSE 6.0 END::DOUBLE AS visibility
    FROM z""",
)
def parse_forecast_lines_legacy(spark, folder):
    """The older reading: period ends stay in the month of issue, fractions of a mile lose their top."""
    lines = reports.parse_forecasts(forecast_texts(spark, folder), legacy=True)
    return lines.filter("visibility IS NOT NULL").select(
        "source_file", "line_no", "kind", "validity_start", "validity_end", "visibility"
    )


@query(
    "classify_report_kind",
    f"""SELECT event_id || '/taf.' || strftime(ts, '%Y%m%d.%HZ.txt') AS source_file, date_trunc('hour', ts)::TIMESTAMP AS issue_ts,
    unnest({_KINDS_SQL}) AS kind FROM events""",
)
def classify_report_kind(spark, folder):
    """Marker words decide the kind in any case; a block with both words counts as both kinds."""
    return reports.forecast_blocks(forecast_texts(spark, folder)).select("source_file", "issue_ts", "kind")


@query(
    "observation_stations",
    f"""WITH {_OBSERVATION_LINES} SELECT regexp_extract(line, '{codes.FORECAST_STATION}', 1) AS station, count(*) AS reports
    FROM lines GROUP BY 1""",
)
def observation_stations(spark, folder):
    lines = reports.observation_blocks(observation_texts(spark, folder)).filter(F.col("line").isNotNull())
    return lines.groupBy(first_match(F.col("line"), codes.FORECAST_STATION).alias("station")).agg(
        F.count("*").alias("reports")
    )
