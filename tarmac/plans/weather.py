"""Weather on the grid: as-of joins, overlay of kinds, fills."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import timebucket
from tarmac.operators import ordered
from tarmac.operators.asof import asof_observation
from tarmac.operators.counts import zero_filled_arrivals
from tarmac.operators.forecast_asof import forecast_asof, overlay_kinds
from tarmac.plans import standins as s
from tarmac.plans.registry import query

_BASE = f"WITH {s.grid_sql()}, {s.OBSERVATIONS_SQL}, {s.asof_sql()}"
_FORECAST = f"{s.FORECASTS_SQL}, {s.forecast_asof_sql()}"
_VALUES = ", ".join(s.WEATHER)


def _grid(spark, folder):
    return s.grid(spark, folder).select("station", "bucket_end")


def _observed(spark, folder, spine=None):
    spine = _grid(spark, folder) if spine is None else spine
    return asof_observation(spine, s.observations(spark, folder), s.WEATHER, [F.col("event_id")])


def _forecast(spark, folder, spine=None, legacy=False):
    spine = _grid(spark, folder) if spine is None else spine
    return forecast_asof(spine, s.forecast_lines(spark, folder), s.WEATHER, s.FORECAST_ORDER, legacy=legacy)


@query("asof_observation_6h", f"{_BASE} SELECT station, bucket_end, {_VALUES} FROM observed")
def asof_observation_6h(spark, folder):
    """Newest observation at each grid instant, at most six hours old."""
    return _observed(spark, folder)


@query(
    "forecast_asof_corrected",
    f"WITH {s.grid_sql()}, {_FORECAST} SELECT station, bucket_end, {_VALUES} FROM forecast",
)
def forecast_asof_corrected(spark, folder):
    """Forecast in force at each grid instant: started change line over base line, corrected over amended over original."""
    return _forecast(spark, folder)


@query(
    "forecast_asof_legacy",
    f"WITH {s.grid_sql()}, {s.FORECASTS_SQL}, {s.forecast_asof_sql(legacy=True)} SELECT station, bucket_end, {_VALUES} FROM forecast",
)
def forecast_asof_legacy(spark, folder):
    return _forecast(spark, folder, legacy=True)


@query(
    "kind_overlay",
    f"""WITH {s.FORECASTS_SQL}, last_line AS (
      SELECT station, validity_start::DATE AS day, kind, last({{'t': temperature, 'v': visibility}} ORDER BY issue_ts, line_no) AS x
      FROM forecasts GROUP BY ALL)
    SELECT station, day,
      coalesce(max(x.t) FILTER (kind = 'corrected'), max(x.t) FILTER (kind = 'amended'), max(x.t) FILTER (kind = 'original')) AS temperature,
      coalesce(max(x.v) FILTER (kind = 'corrected'), max(x.v) FILTER (kind = 'amended'), max(x.v) FILTER (kind = 'original')) AS visibility
    FROM last_line GROUP BY ALL""",
)
def kind_overlay(spark, folder):
    """The last line of each kind and day, overlaid field by field."""
    state = F.struct("temperature", "visibility")
    last = (
        s.forecast_lines(spark, folder)
        .groupBy("station", F.to_date("validity_start").alias("day"), "kind")
        .agg(F.max(F.struct(F.struct("issue_ts", "line_no").alias("o"), state.alias("v"))).alias("m"))
        .select("station", "day", "kind", F.col("m.v").alias("state"))
    )
    return overlay_kinds(last, ["station", "day"], ["temperature", "visibility"])


def _filled_sql(function: str, direction: str) -> str:
    fields = ", ".join(
        f"{function}({v} IGNORE NULLS) OVER (PARTITION BY station ORDER BY bucket_end ROWS BETWEEN {direction}) AS {v}"
        for v in s.WEATHER
    )
    return f"{_BASE} SELECT station, bucket_end, {fields} FROM observed"


@query("ffill_per_station", _filled_sql("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def ffill_per_station(spark, folder):
    return ordered.fill_forward(_observed(spark, folder), ["station"], "bucket_end", s.WEATHER)


@query("bfill_per_station", _filled_sql("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def bfill_per_station(spark, folder):
    return ordered.fill_backward(_observed(spark, folder), ["station"], "bucket_end", s.WEATHER)


_BLOCK = "time_bucket(INTERVAL 4 HOURS, bucket_end - INTERVAL 1 MICROSECOND)"


def _block_sql(v: str) -> str:
    later = f"last_value(CASE WHEN p >= 4 THEN f_{v} END IGNORE NULLS) OVER (PARTITION BY station, block ORDER BY p)"
    fourth = f"max(CASE WHEN p = 3 THEN o_{v} END) OVER (PARTITION BY station, block)"
    return f"CASE WHEN p < 4 THEN coalesce(f_{v}, o_{v}) ELSE coalesce({later}, {fourth}) END AS {v}"


_BLOCK_FILLED = f"""{_BASE}, {_FORECAST},
    both_kinds AS (
      SELECT f.station, f.bucket_end, {_BLOCK.replace('bucket_end', 'f.bucket_end')} AS block,
             date_diff('minute', {_BLOCK.replace('bucket_end', 'f.bucket_end')}, f.bucket_end) // 15 - 1 AS p,
             {', '.join(f'f.{v} AS f_{v}, o.{v} AS o_{v}' for v in s.WEATHER)}
      FROM forecast f JOIN observed o USING (station, bucket_end)),
    block_filled AS (SELECT station, bucket_end, {', '.join(_block_sql(v) for v in s.WEATHER)} FROM both_kinds)"""


def _block_filled(spark, folder, spine=None):
    """The rows of the spine flow through both as-of steps, so the two weather tables need no join."""
    observed = _observed(spark, folder, spine).withColumnsRenamed({v: f"{v}_observed" for v in s.WEATHER})
    both = _forecast(spark, folder, observed).withColumns(
        {"block": timebucket.block_start("bucket_end"), "block_pos": timebucket.block_pos("bucket_end")}
    )
    return ordered.block_fill(both, s.WEATHER, pos="block_pos").drop("block", "block_pos")


@query("block16_fill", f"{_BLOCK_FILLED} SELECT station, bucket_end, {_VALUES} FROM block_filled")
def block16_fill(spark, folder):
    """Forecast with observation as fallback, by block of sixteen quarter hours."""
    return _block_filled(spark, folder)


@query(
    "weather_on_targets",
    f"""{_BLOCK_FILLED}, {s.ARRIVALS_SQL}, {s.COUNTS_SQL}, joined AS (
      SELECT c.station, c.bucket_end, c.value, {_VALUES} FROM counted c LEFT JOIN block_filled USING (station, bucket_end))
    SELECT station, bucket_end, value, {', '.join(
        f"last_value({v} IGNORE NULLS) OVER (PARTITION BY station ORDER BY bucket_end) AS {v}" for v in s.WEATHER)}
    FROM joined""",
)
def weather_on_targets(spark, folder):
    """The whole path: counts, weather as of each bucket, block fill, forward fill per station."""
    counts = zero_filled_arrivals(s.grid(spark, folder), s.arrivals(spark, folder)).select("station", "bucket_end", "value")
    filled = ordered.fill_forward(_block_filled(spark, folder, counts), ["station"], "bucket_end", s.WEATHER)
    return filled.select("station", "bucket_end", "value", *s.WEATHER)


@query(
    "feature_join_on_id",
    f"""{_BASE}, {s.ARRIVALS_SQL}, {s.COUNTS_SQL}
    SELECT station, bucket_end, c.value, {_VALUES} FROM counted c LEFT JOIN observed USING (station, bucket_end)""",
)
def feature_join_on_id(spark, folder):
    """Two finished tables, targets and weather, joined on their common key."""
    counts = zero_filled_arrivals(s.grid(spark, folder), s.arrivals(spark, folder)).select("station", "bucket_end", "value")
    return counts.join(_observed(spark, folder), ["station", "bucket_end"], "left")
