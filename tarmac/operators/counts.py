"""Arrival counts per station and bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.functions.timebucket import bucket_end, floor_minutes, minute_mark
from tarmac.operators.dedup import first_seen_packed


def zero_filled_arrivals(spine: DataFrame, arrivals: DataFrame, legacy: bool = False) -> DataFrame:
    """First-seen arrivals per right-closed bucket, 0 where there is none.

    ``arrivals`` needs ``gufi, station_ord, arrival_ts``. An arrival exactly on the hour belongs to the
    bucket that ends there; the legacy form drops it but still marks its flight as seen.
    """
    seen = first_seen_packed(arrivals)
    if legacy:
        seen = seen.filter(minute_mark("arrival_ts") > 0)
    counts = seen.groupBy("station_ord", bucket_end("arrival_ts").alias("bucket_end")).agg(F.count("*").alias("n"))
    return spine.join(counts, ["station_ord", "bucket_end"], "left").select(
        *spine.columns, F.coalesce("n", F.lit(0)).cast("long").alias("value")
    )


def throughput(
    df: DataFrame, station: str = "station", at: str = "ts", minutes: int = codes.BUCKET_MINUTES
) -> DataFrame:
    """Rows per station and left-closed bucket; rows without either key are dropped."""
    return (
        df.filter(F.col(station).isNotNull() & F.col(at).isNotNull())
        .groupBy(station, floor_minutes(at, minutes).alias("time_bucket"))
        .agg(F.count("*").alias("throughput"))
    )


def with_throughput(df: DataFrame, station: str = "station", bucket: str = "time_bucket") -> DataFrame:
    """Every row with the count of its bucket.

    The count is aggregated first and joined back, rather than counted over a window, so a bucket that holds
    many rows is never gathered in one task.
    """
    counts = (
        df.filter(F.col(station).isNotNull() & F.col(bucket).isNotNull())
        .groupBy(station, bucket)
        .agg(F.count("*").alias("throughput"))
    )
    return df.join(counts, [station, bucket], "left")


def distinct_flights(
    df: DataFrame, flight: str = "gufi", station: str = "station", at: str = "ts", minutes: int = codes.BUCKET_MINUTES
) -> DataFrame:
    """Distinct flights per bucket with both ends of the bucket included.

    A time exactly on the grid lies in the bucket that starts there and in the one that ends there.
    """
    rows = flights_of_buckets(df, flight, station, at, minutes)
    return rows.distinct().groupBy(station, "time_bucket").agg(F.count(flight).alias("flights"))


def flights_of_buckets(df: DataFrame, flight: str, station: str, at: str, minutes: int) -> DataFrame:
    """``station, flight, time_bucket`` of each row, once or, on the grid, twice."""
    start = floor_minutes(at, minutes)
    step = F.expr(f"INTERVAL {minutes} MINUTES")
    buckets = F.when(start == F.col(at), F.array(start, start - step)).otherwise(F.array(start))
    return df.filter(F.col(at).isNotNull()).select(station, flight, F.explode(buckets).alias("time_bucket"))
