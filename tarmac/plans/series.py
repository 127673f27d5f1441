"""Features, scaling, splits and series on the counted grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import numeric, timebucket
from tarmac.operators import features, ordered, quality, scale, series, split
from tarmac.operators.asof import asof_observation
from tarmac.operators.counts import throughput, zero_filled_arrivals
from tarmac.plans import standins as s
from tarmac.plans.registry import query
from tarmac.sources.tables import table


def counted(spark, folder, part="all"):
    return zero_filled_arrivals(s.grid(spark, folder, part), s.arrivals(spark, folder))


_ALL, _TRAIN = s.counts_sql("all"), s.counts_sql("train")


def _rounded(df, columns, digits=6):
    """Rounded for the comparison; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


@query(
    "cyclic_time_features",
    """SELECT event_id, round(sin(2 * pi() * extract('hour' FROM ts) / 24), 6) + 0.0 AS hour_sin,
    round(cos(2 * pi() * extract('hour' FROM ts) / 24), 6) + 0.0 AS hour_cos,
    round(sin(2 * pi() * (extract('isodow' FROM ts) - 1) / 7), 6) + 0.0 AS day_sin,
    round(cos(2 * pi() * (extract('isodow' FROM ts) - 1) / 7), 6) + 0.0 AS day_cos,
    round(sin(2 * pi() * extract('month' FROM ts) / 12), 6) + 0.0 AS month_sin FROM events""",
)
def cyclic_time_features(spark, folder):
    hour = numeric.cyclic(F.hour("ts"), 24)
    day = numeric.cyclic(timebucket.monday_weekday("ts"), 7)
    month = numeric.cyclic(F.month("ts"), 12)
    columns = {"hour_sin": hour[0], "hour_cos": hour[1], "day_sin": day[0], "day_cos": day[1], "month_sin": month[0]}
    return _rounded(table(spark, folder, "events").select("event_id", *[e.alias(n) for n, e in columns.items()]), columns)


# Three cloud layers per event, from its numbers.
_LAYERS_SQL = """
    layered AS (SELECT event_id, ['FEW', 'SCT', 'BKN', 'OVC', 'VV', 'SKC'][user_id % 6 + 1] AS c1,
      (floor(value)::BIGINT * 100)::INTEGER AS a1, CASE WHEN user_id % 4 = 0 THEN 'CB' END AS t1,
      ['BKN', 'OVC', 'SCT'][user_id % 3 + 1] AS c2, (floor(value / 3)::BIGINT * 500)::INTEGER AS a2,
      CASE WHEN user_id % 5 = 0 THEN 'TCU' WHEN user_id % 5 = 1 THEN 'CB' END AS t2,
      CASE WHEN user_id % 2 = 0 THEN 'OVC' END AS c3, CASE WHEN user_id % 2 = 0 THEN 40000 - (floor(value)::BIGINT * 90)::INTEGER END AS a3,
      NULL::VARCHAR AS t3 FROM events)"""


def _layered(spark, folder):
    user, value = F.col("user_id"), F.col("value")

    def pick(names):
        return F.element_at(F.array(*[F.lit(n) for n in names]), (user % len(names) + 1).cast("int"))

    events = table(spark, folder, "events").select(
        "event_id",
        pick(["FEW", "SCT", "BKN", "OVC", "VV", "SKC"]).alias("cover_type_1"),
        (F.floor(value) * 100).cast("int").alias("altitude_1"),
        F.when(user % 4 == 0, "CB").alias("cloud_type_1"),
        pick(["BKN", "OVC", "SCT"]).alias("cover_type_2"),
        (F.floor(value / 3) * 500).cast("int").alias("altitude_2"),
        F.when(user % 5 == 0, "TCU").when(user % 5 == 1, "CB").alias("cloud_type_2"),
        F.when(user % 2 == 0, "OVC").alias("cover_type_3"),
        F.when(user % 2 == 0, 40000 - F.floor(value) * 90).cast("int").alias("altitude_3"),
        F.lit(None).cast("string").alias("cloud_type_3"),
    )
    return events


def _oktas(c, default):
    return f"CASE {c} WHEN 'SKC' THEN 0 WHEN 'FEW' THEN 2 WHEN 'SCT' THEN 4 WHEN 'BKN' THEN 7 WHEN 'OVC' THEN 8 ELSE {default} END"


def _severity_sql(legacy):
    def times(i):
        # In the legacy form the type is looked up among the cover codes, where no cloud type is found.
        return "1" if legacy else f"CASE WHEN t{i} = 'CB' THEN 100 ELSE 1 END"

    total = " + ".join(
        f"coalesce({_oktas(f'c{i}', 0)} * ({times(i)}) / CASE WHEN a{i} = 0 THEN 1000.0::DOUBLE ELSE a{i}::DOUBLE END, 0)"
        for i in (1, 2, 3)
    )
    return f"""WITH {_LAYERS_SQL}, t AS (SELECT event_id, {total} AS total FROM layered)
    SELECT event_id, round(CASE WHEN total > 0 THEN (log10(total) + 5) / 5 ELSE 0 END, 6) + 0.0 AS severity FROM t"""


@query("cloud_severity", _severity_sql(False))
def cloud_severity(spark, folder):
    rows = _layered(spark, folder).select("event_id", numeric.cloud_severity(numeric.layer_columns()).alias("severity"))
    return _rounded(rows, ["severity"])


@query("cloud_severity_legacy", _severity_sql(True))
def cloud_severity_legacy(spark, folder):
    severity = numeric.cloud_severity(numeric.layer_columns(), legacy=True)
    return _rounded(_layered(spark, folder).select("event_id", severity.alias("severity")), ["severity"])


def _bands_sql(legacy):
    edges = [0, 500, 2000, 10000, 20000, 35000]
    columns = []
    for low, high in zip(edges, edges[1:]):
        least = ">=" if low == 0 and not legacy else ">"

        def inside(i, low=low, high=high, least=least):
            return f"(a{i} {least} {low} AND a{i} <= {high})"

        default = "NULL" if legacy else "0"
        cover = " ".join(f"WHEN {inside(i)} THEN {_oktas(f'c{i}', default)}" for i in (3, 2, 1))
        columns.append(f"(CASE {cover} ELSE 0 END)::INTEGER AS cover_{low}_{high}")
        for cloud in ("CB", "TCU"):
            any_layer = " OR ".join(f"coalesce({inside(i)} AND t{i} = '{cloud}', false)" for i in (1, 2, 3))
            columns.append(f"({any_layer})::INTEGER AS {cloud}_{low}_{high}")
    if legacy:
        columns.append("0::INTEGER AS TCU_200_10000")
    return f"WITH {_LAYERS_SQL} SELECT event_id, {', '.join(columns)} FROM layered"


@query("cloud_bands", _bands_sql(False))
def cloud_bands(spark, folder):
    bands = numeric.cloud_bands(numeric.layer_columns())
    return _layered(spark, folder).select("event_id", *[e.alias(n) for n, e in bands.items()])


@query("cloud_bands_legacy", _bands_sql(True))
def cloud_bands_legacy(spark, folder):
    bands = numeric.cloud_bands(numeric.layer_columns(), legacy=True)
    return _layered(spark, folder).select("event_id", *[e.alias(n) for n, e in bands.items()])


@query(
    "visibility_miles",
    """SELECT event_id, CASE WHEN floor(value * 100 / 1609.344) >= 7 THEN 6 ELSE floor(value * 100 / 1609.344) END::DOUBLE AS miles,
    CASE WHEN floor(value * 100 / 1609.344) BETWEEN 7 AND 10 THEN 6 ELSE floor(value * 100 / 1609.344) END::DOUBLE AS first_version
    FROM events""",
)
def visibility_miles(spark, folder):
    metres = F.col("value") * 100
    return table(spark, folder, "events").select(
        "event_id",
        numeric.whole_miles(metres).alias("miles"),
        numeric.whole_miles(metres, first_version=True).alias("first_version"),
    )


@query(
    "lag_features",
    """WITH t AS (SELECT event_type AS station, time_bucket(INTERVAL 15 MINUTES, ts) AS time_bucket, count(*) AS throughput
      FROM events GROUP BY ALL)
    SELECT *, lag(throughput) OVER (PARTITION BY station ORDER BY time_bucket) AS before FROM t""",
)
def lag_features(spark, folder):
    """Value of the previous bucket that has rows, however long ago."""
    rows = throughput(table(spark, folder, "events").withColumnRenamed("event_type", "station"))
    return ordered.previous(rows, ["station"], "time_bucket", "throughput", "before")


_LEADS = {f"value_ahead_{k}": k for k in range(1, 13)}


@query(
    "lead_features",
    f"""{_TRAIN} SELECT station, bucket_end, value, {', '.join(
        f"lead(value, {k}) OVER (PARTITION BY station ORDER BY bucket_end) AS {n}" for n, k in _LEADS.items())} FROM counted""",
)
def lead_features(spark, folder):
    """The next twelve rows of the station, over the gaps between training cycles too."""
    rows = counted(spark, folder, "train").select("station", "bucket_end", "pos", "value")
    return ordered.shifted(rows, ["station"], "pos", "value", _LEADS, chunk_rows=576).drop("pos")


@query(
    "lead_features_complete",
    f"""{_TRAIN}, l AS (SELECT station, bucket_end, value, {', '.join(
        f"lead(value, {k}) OVER (PARTITION BY station ORDER BY bucket_end) AS {n}" for n, k in _LEADS.items())} FROM counted)
    SELECT * FROM l WHERE value_ahead_12 IS NOT NULL""",
)
def lead_features_complete(spark, folder):
    rows = counted(spark, folder, "train").select("station", "bucket_end", "pos", "value")
    led = ordered.shifted(rows, ["station"], "pos", "value", _LEADS, chunk_rows=576).drop("pos")
    return led.dropna(subset=list(_LEADS))


@query(
    "series_blocks",
    f"""{_ALL} SELECT station, bucket_end, cycle AS series,
    time_bucket(INTERVAL 4 HOURS, bucket_end - INTERVAL 1 MICROSECOND) AS block,
    (date_diff('minute', time_bucket(INTERVAL 4 HOURS, bucket_end - INTERVAL 1 MICROSECOND), bucket_end) // 15 - 1)::INTEGER AS block_pos,
    value FROM counted""",
)
def series_blocks(spark, folder):
    """Series and block numbers by time arithmetic."""
    return counted(spark, folder).select(
        "station",
        "bucket_end",
        F.col("cycle").alias("series"),
        timebucket.block_start("bucket_end").alias("block"),
        timebucket.block_pos("bucket_end").alias("block_pos"),
        "value",
    )


@query(
    "block_context",
    f"""{_ALL} SELECT station, bucket_end, value FROM counted
    WHERE date_diff('minute', time_bucket(INTERVAL 4 HOURS, bucket_end - INTERVAL 1 MICROSECOND), bucket_end) <= 60""",
)
def block_context(spark, folder):
    """The first four rows of every block: the known past of a forecast."""
    rows = counted(spark, folder).select("station", "bucket_end", "value")
    return rows.filter(timebucket.block_pos("bucket_end") < 4)


@query(
    "category_codes",
    "SELECT c_custkey, c_mktsegment, (dense_rank() OVER (ORDER BY c_mktsegment) - 1)::INTEGER AS code FROM customer",
)
def category_codes(spark, folder):
    rows = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return ordered.category_codes(rows, "c_mktsegment", "code")


@query(
    "category_codes_many",
    "SELECT c_custkey, c_name, (dense_rank() OVER (ORDER BY c_name) - 1)::INTEGER AS code FROM customer",
)
def category_codes_many(spark, folder):
    """As many labels as rows; ranked by prefix ranges."""
    return ordered.category_codes(table(spark, folder, "customer").select("c_custkey", "c_name"), "c_name", "code")


def _windows_sql(source="counted", key="cycle"):
    over = f"OVER (PARTITION BY station, {key} ORDER BY bucket_end)"
    lags = ", ".join(f"lag(value, {k}) {over} AS value_lag_{k}" for k in range(4))
    steps = ", ".join(f"lead(value, {k}) {over} AS value_step_{k}" for k in range(1, 13))
    return f"""w AS (SELECT station, {key}, bucket_end, {lags}, {steps} FROM {source}),
    windows AS (SELECT * FROM w WHERE value_lag_3 IS NOT NULL AND value_step_12 IS NOT NULL)"""


@query("supervised_windows", f"{_TRAIN}, {_windows_sql()} SELECT * FROM windows")
def supervised_windows(spark, folder):
    """Four past and twelve future steps inside one series."""
    return series.supervised_windows(counted(spark, folder, "train"), ["station", "cycle"], "bucket_end", "value")


_COVARIATE = "OVER (PARTITION BY station, cycle ORDER BY bucket_end)"


@query(
    "windows_with_covariates",
    f"""WITH {s.grid_sql('train')}, {s.ARRIVALS_SQL}, {s.COUNTS_SQL}, {s.OBSERVATIONS_SQL}, {s.asof_sql('counted')},
    w AS (SELECT station, cycle, bucket_end, {', '.join(
        f"lag(value, {k}) {_COVARIATE} AS value_lag_{k}, lag(visibility, {k}) {_COVARIATE} AS visibility_lag_{k}" for k in range(4))},
      {', '.join(f"lead(value, {k}) {_COVARIATE} AS value_step_{k}, lead(visibility, {k}) {_COVARIATE} AS visibility_step_{k}" for k in range(1, 13))}
      FROM observed)
    SELECT * FROM w WHERE value_lag_3 IS NOT NULL AND value_step_12 IS NOT NULL""",
)
def windows_with_covariates(spark, folder):
    """Past and future weather beside the target."""
    rows = asof_observation(
        counted(spark, folder, "train"), s.observations(spark, folder), ["visibility"], [F.col("event_id")]
    )
    return series.supervised_windows(rows, ["station", "cycle"], "bucket_end", "value", ["visibility"], ["visibility"])


@query(
    "long_steps",
    f"""{_TRAIN}, {_windows_sql()}, l AS (SELECT station, cycle, bucket_end, value_lag_0, value_lag_1, value_lag_2, value_lag_3,
      unnest([{', '.join(f"{{'step': {k}, 'value': value_step_{k}}}" for k in range(1, 13))}]) AS x FROM windows)
    SELECT * EXCLUDE (x), x.step::INTEGER AS step, x.value AS value FROM l""",
)
def long_steps(spark, folder):
    windows = series.supervised_windows(counted(spark, folder, "train"), ["station", "cycle"], "bucket_end", "value")
    return series.long_steps(windows, ["station", "cycle"], "value", [])


@query(
    "minmax_by_station",
    f"""{_TRAIN}, r AS (SELECT station, min(value) AS lo, max(value) AS hi FROM counted WHERE cycle < 2 GROUP BY station)
    SELECT station, bucket_end, round((value - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END::DOUBLE, 6) + 0.0 AS value,
    cycle FROM counted JOIN r USING (station)""",
)
def minmax_by_station(spark, folder):
    """Fitted on the first cycles, applied to all."""
    rows = counted(spark, folder, "train").select("station", "bucket_end", "cycle", "value")
    params = scale.fit_minmax(rows.filter("cycle < 2"), ["value"])
    return _rounded(scale.apply_minmax(rows, params, ["value"]), ["value"])


@query("minmax_inverse", f"{_TRAIN} SELECT station, bucket_end, value::DOUBLE AS value FROM counted")
def minmax_inverse(spark, folder):
    """Scaled to (-1, 1) and back: the input again."""
    rows = counted(spark, folder, "train").select("station", "bucket_end", "value")
    params = scale.fit_minmax(rows, ["value"])
    there = scale.apply_minmax(rows, params, ["value"], to=(-1.0, 1.0))
    return _rounded(scale.invert_minmax(there, params, ["value"], to=(-1.0, 1.0)), ["value"])


@query(
    "zscore",
    """SELECT event_id, round((value - (SELECT avg(value) FROM events)) / (SELECT stddev_pop(value) FROM events), 6) + 0.0 AS value
    FROM events""",
)
def zscore(spark, folder):
    rows = table(spark, folder, "events").select("event_id", "value")
    return _rounded(scale.apply_zscore(rows, scale.fit_zscore(rows, ["value"])), ["value"])


@query(
    "chronological_split",
    f"{_TRAIN} SELECT station, bucket_end, value, CASE WHEN cycle < 3 THEN 'train' ELSE 'validation' END AS part FROM counted",
)
def chronological_split(spark, folder):
    rows = counted(spark, folder, "train")
    return rows.select("station", "bucket_end", "value", split.chronological_part(F.col("cycle"), 3).alias("part"))


@query(
    "hash_split",
    """SELECT event_id, CASE WHEN ('0x' || substr(md5('42|' || event_id), 1, 8))::BIGINT % 100 < 80
    THEN 'train' ELSE 'validation' END AS part FROM events""",
)
def hash_split(spark, folder):
    """Random by key: the same on every cluster and on a rerun."""
    return split.hash_split(table(spark, folder, "events").select("event_id"), ["event_id"])


@query(
    "full_series_only",
    f"""{_TRAIN} SELECT station, cycle, bucket_end, value FROM counted
    QUALIFY count(*) OVER (PARTITION BY station, cycle) = 576""",
)
def full_series_only(spark, folder):
    """The last, shorter cycle drops out."""
    rows = counted(spark, folder, "train").select("station", "cycle", "bucket_end", "value")
    return split.full_series(rows, ["station", "cycle"], 576).select(*rows.columns)


@query(
    "dense_series",
    f"""{_TRAIN} SELECT station, cycle, min(bucket_end) AS start, count(*)::INTEGER AS length,
    string_agg(value::VARCHAR, ',' ORDER BY bucket_end) AS value FROM counted GROUP BY station, cycle""",
)
def dense_series(spark, folder):
    """One array per station and cycle (joined to text for the comparison)."""
    rows = series.dense_series(counted(spark, folder, "train"), ["station", "cycle"], "bucket_end", ["value"])
    return rows.withColumn("value", F.array_join(F.transform("value", lambda v: v.cast("string")), ","))


@query(
    "pivot_series",
    f"""{_ALL} SELECT bucket_end, {', '.join(f"max(value) FILTER (station = '{n}') AS {n}" for n in s.STATIONS)}
    FROM counted GROUP BY bucket_end""",
)
def pivot_series(spark, folder):
    return series.pivot_series(counted(spark, folder), "bucket_end", "station", s.STATIONS, "value")


_QUANTILES = [i / 20 for i in range(1, 20)]


@query(
    "sample_quantiles",
    f"""SELECT event_type AS station, extract('hour' FROM ts)::INTEGER AS step, count(*) AS samples,
    round(sum(value), 4) AS total, round(avg(value), 6) AS mean, {', '.join(
        f"round(quantile_cont(value, {q}), 6) AS q{int(round(q * 100)):02d}" for q in _QUANTILES)}
    FROM events GROUP BY ALL""",
)
def sample_quantiles(spark, folder):
    """Mean, sum and nineteen exact quantiles of the samples of each station and step."""
    samples = table(spark, folder, "events").select(
        F.col("event_type").alias("station"), F.hour("ts").alias("step"), "value"
    )
    rows = series.exact_quantiles(samples, ["station", "step"], "value", _QUANTILES)
    names = [f"q{int(round(q * 100)):02d}" for q in _QUANTILES]
    return _rounded(_rounded(rows, ["mean", *names]), ["total"], 4)


@query(
    "scaled_quantiles",
    f"""WITH v AS (SELECT l_returnflag AS flag, l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem) AS x FROM lineitem)
    SELECT flag, count(*) AS samples, {', '.join(f"round(quantile_cont(x, {q}), 9) AS q{int(round(q * 100)):02d}" for q in _QUANTILES)}
    FROM v GROUP BY flag""",
)
def scaled_quantiles(spark, folder):
    """Nineteen exact quantiles of values that all lie between 0 and 1."""
    lines = table(spark, folder, "lineitem")
    top = lines.agg(F.max("l_extendedprice")).first()[0]
    values = lines.select(F.col("l_returnflag").alias("flag"), (F.col("l_extendedprice") / F.lit(top)).alias("x"))
    names = [f"q{int(round(q * 100)):02d}" for q in _QUANTILES]
    return _rounded(series.exact_quantiles(values, ["flag"], "x", _QUANTILES).drop("mean", "total"), names, 9)


_NAIVE = f"""{_ALL}, p AS (SELECT station, value, lag(value) OVER (PARTITION BY station ORDER BY bucket_end) AS guess FROM counted)"""


@query(
    "rmse_score",
    f"""{_NAIVE}, r AS (SELECT station, sqrt(avg(power(value - guess, 2))) AS rmse FROM p WHERE guess IS NOT NULL GROUP BY station)
    SELECT station, round(rmse, 6) AS rmse, round(exp(-rmse / 10), 6) AS score FROM r""",
)
def rmse_score(spark, folder):
    """Error and score of "as in the last quarter hour"."""
    rows = counted(spark, folder).select("station", "bucket_end", "pos", "value")
    guessed = ordered.shifted(rows, ["station"], "pos", "value", {"guess": -1}).filter(F.col("guess").isNotNull())
    errors = guessed.groupBy("station").agg(quality.rmse(F.col("value"), F.col("guess")).alias("rmse"))
    return _rounded(errors.withColumn("score", quality.score(F.col("rmse"))), ["rmse", "score"])


@query(
    "null_audit",
    f"""WITH {s.OBSERVATIONS_SQL}, t AS (
      SELECT 'temperature' AS "column", count_if(temperature IS NULL) AS nulls, count(*) AS rows FROM observations
      UNION ALL SELECT 'visibility', count_if(visibility IS NULL), count(*) FROM observations
      UNION ALL SELECT 'wind_speed', count_if(wind_speed IS NULL), count(*) FROM observations)
    SELECT "column", nulls::BIGINT AS nulls, rows FROM t""",
)
def null_audit(spark, folder):
    return quality.null_audit(s.observations(spark, folder), s.WEATHER)


@query(
    "row_count_audit",
    f"""{_ALL}, joined AS (SELECT c.station FROM counted c LEFT JOIN grid USING (station, bucket_end))
    SELECT 'spine' AS "table", count(*) AS rows FROM grid UNION ALL SELECT 'counted', count(*) FROM counted
    UNION ALL SELECT 'joined', count(*) FROM joined""",
)
def row_count_audit(spark, folder):
    """A left join onto the grid neither loses nor multiplies rows."""
    grid, counts = s.grid(spark, folder), counted(spark, folder)
    joined = counts.join(grid.select("station", "bucket_end"), ["station", "bucket_end"], "left")
    return quality.row_audit(spine=grid, counted=counts, joined=joined)


@query(
    "flight_feature_table",
    f"""WITH f AS (SELECT DISTINCT event_type AS station, ts, user_id FROM events WHERE value >= 5),
    c AS (SELECT station, time_bucket(INTERVAL 15 MINUTES, ts) AS time_bucket, count(*) AS throughput
          FROM (SELECT DISTINCT station, ts FROM f) GROUP BY ALL),
    {s.OBSERVATIONS_SQL},
    w AS (SELECT station, time_bucket(INTERVAL 15 MINUTES, datetime) AS time_bucket, temperature, wind_speed FROM observations
          QUALIFY row_number() OVER (PARTITION BY station, time_bucket(INTERVAL 15 MINUTES, datetime) ORDER BY datetime DESC) = 1),
    j AS (SELECT c.*, w.temperature, w.wind_speed FROM c LEFT JOIN w USING (station, time_bucket)),
    l AS (SELECT *, lag(throughput) OVER (PARTITION BY station ORDER BY time_bucket) AS lag_1,
          last_value(temperature IGNORE NULLS) OVER (PARTITION BY station ORDER BY time_bucket) AS t_before,
          last_value(wind_speed IGNORE NULLS) OVER (PARTITION BY station ORDER BY time_bucket) AS w_before,
          first_value(temperature IGNORE NULLS) OVER (PARTITION BY station ORDER BY time_bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t_after,
          first_value(wind_speed IGNORE NULLS) OVER (PARTITION BY station ORDER BY time_bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after
          FROM j)
    SELECT station, time_bucket, throughput, coalesce(lag_1, first_value(lag_1 IGNORE NULLS) OVER (
        PARTITION BY station ORDER BY time_bucket ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS throughput_lag_1,
      (dense_rank() OVER (ORDER BY station) - 1)::INTEGER AS arrival_airport_encoded,
      round(sin(2 * pi() * extract('hour' FROM time_bucket) / 24), 6) + 0.0 AS hour_sin,
      round(cos(2 * pi() * extract('hour' FROM time_bucket) / 24), 6) + 0.0 AS hour_cos,
      round(sin(2 * pi() * (extract('isodow' FROM time_bucket) - 1) / 7), 6) + 0.0 AS day_of_week_sin,
      round(cos(2 * pi() * (extract('isodow' FROM time_bucket) - 1) / 7), 6) + 0.0 AS day_of_week_cos,
      round(coalesce(t_before, t_after), 4) AS forecast_temperature, round(coalesce(w_before, w_after), 4) AS forecast_wind_speed
    FROM l""",
)
def flight_feature_table(spark, folder):
    """Prepared flights and forecasts to one feature row per station and bucket."""
    events = table(spark, folder, "events")
    flights = features.prepare_flights(
        events.select(
            F.col("event_type").alias("arrival_airport"),
            F.col("ts").alias("arrival_runway_actual_time"),
            (F.col("value") >= 5).alias("is_arrival"),
        ),
        narrow=False,
    )
    forecasts = features.prepare_forecasts(
        s.observations(spark, folder).withColumnRenamed("station", "station_id").drop("visibility"), narrow=False
    )
    rows = features.flight_feature_table(flights, forecasts)
    rows = _rounded(rows, ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"])
    return _rounded(rows, ["forecast_temperature", "forecast_wind_speed"], 4)
