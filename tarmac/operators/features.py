"""Composed feature steps of the flight table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.functions.casting import downcast, present_columns, times_from_text
from tarmac.functions.numeric import cyclic
from tarmac.functions.timebucket import floor_minutes, monday_weekday
from tarmac.operators.joins import join_weather
from tarmac.operators.ordered import category_codes, neighbours

FLIGHT_COLUMNS = [
    "arrival_runway_actual_time",
    "departure_runway_actual_time",
    "estimated_arrival_time_prediction_timestamp",
    "estimated_arrival_time",
    "estimated_departure_time_prediction_timestamp",
    "estimated_departure_time",
    "is_arrival",
    "arrival_airport",
]
FLIGHT = "gufi"
FORECAST_COLUMNS = ["datetime", "station_id", "temperature", "visibility", "wind_speed"]
FORECAST_NAMES = {
    "temperature": "forecast_temperature",
    "visibility": "forecast_visibility",
    "wind_speed": "forecast_wind_speed",
}


def prepare_flights(df: DataFrame, narrow: bool = True, legacy: bool = False) -> DataFrame:
    """Arrivals, without duplicates, with the bucket of the estimated else the actual time of each row.

    Rows of different flights are no duplicates; the legacy form, which drops the flight first, merges those of equal times.
    """
    kept = present_columns(df, FLIGHT_COLUMNS if legacy else [FLIGHT, *FLIGHT_COLUMNS])
    kept = times_from_text(kept, [c for c in kept.columns if "time" in c])
    if "is_arrival" in kept.columns:
        kept = kept.filter(F.col("is_arrival"))
    times = [F.col(c) for c in ("estimated_arrival_time", "arrival_runway_actual_time") if c in kept.columns]
    out = (
        kept.distinct()
        .withColumn("time_bucket", floor_minutes(F.coalesce(*times), codes.BUCKET_MINUTES))
        .withColumnRenamed("arrival_airport", "station")
        .dropna(subset=["station", "time_bucket"])
    )
    out = out.drop(FLIGHT)
    return downcast(out) if narrow else out


def prepare_forecasts(df: DataFrame, narrow: bool = True) -> DataFrame:
    """Forecast rows with a station and a time, bucketed, under the names the features use."""
    kept = times_from_text(present_columns(df, FORECAST_COLUMNS), ["datetime"])
    out = (
        kept.filter(F.col("station_id").rlike("^.+$"))
        .dropna(subset=["station_id", "datetime"])
        .withColumn("time_bucket", floor_minutes("datetime", codes.BUCKET_MINUTES))
        .withColumnsRenamed({**FORECAST_NAMES, "station_id": "station"})
    )
    return downcast(out) if narrow else out


def add_features(df: DataFrame, target: str = "throughput", fill: Sequence[str] = (), stations=None) -> DataFrame:
    """Category code, cyclic time, lagged target and filled weather on a table of one row per (station, time_bucket).

    The lag of a station's first row is taken from its second; gaps in ``fill`` are closed forward, then backward.
    Everything that looks along the time axis is found in one pass.
    """
    hour_sin, hour_cos = cyclic(F.hour("time_bucket"), 24)
    day_sin, day_cos = cyclic(monday_weekday("time_bucket"), 7)
    seen = neighbours(
        df, ["station"], "time_bucket", last=fill, coming=fill, before=[target], after=[target], chunk=None
    )
    has_next = F.col(f"{target}__after").isNotNull()
    first_lag = F.when(has_next, F.col(target))
    featured = seen.select(
        *[F.coalesce(f"{c}__last", f"{c}__coming").alias(c) if c in fill else F.col(c) for c in df.columns],
        F.coalesce(F.col(f"{target}__before"), first_lag).alias(f"{target}_lag_1"),
        hour_sin.alias("hour_sin"),
        hour_cos.alias("hour_cos"),
        day_sin.alias("day_of_week_sin"),
        day_cos.alias("day_of_week_cos"),
    )
    return category_codes(featured, "station", "arrival_airport_encoded", source=stations)


def flight_feature_table(flights: DataFrame, forecasts: DataFrame) -> DataFrame:
    """One row per station and bucket with flights: throughput, weather of the bucket, time and lag features.

    Flights and forecasts come prepared. Both sides are brought to one row per bucket before they meet, so the
    join cannot multiply rows.
    """
    counted = flights.groupBy("station", "time_bucket").agg(F.count("*").alias("throughput"))
    values = [c for c in FORECAST_NAMES.values() if c in forecasts.columns]
    weather = (
        forecasts.groupBy("station", "time_bucket")
        .agg(F.max(F.struct("datetime", *values)).alias("w"))
        .select("station", "time_bucket", *[F.col(f"w.{v}").alias(v) for v in values])
    )
    return add_features(join_weather(counted, weather), fill=values, stations=counted)
