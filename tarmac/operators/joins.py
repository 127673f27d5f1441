"""Joins of flight, weather and template tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.functions.timebucket import floor_minutes
from tarmac.session import scratch

TRACK_KEYS = ("gufi", "is_arrival", "arrival_airport")


def tag(df: DataFrame, **literals) -> DataFrame:
    return df.withColumns({name: F.lit(value) for name, value in literals.items()})


#: A table of keys with no more rows than this is broadcast; a longer one is joined by shuffling.
FEW_ROWS = 10_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of which ``rows`` rows were counted, marked for a broadcast if these are few."""
    return F.broadcast(df) if rows <= FEW_ROWS else df


def counted_few(df: DataFrame) -> DataFrame:
    """A table of one row per key, written so that its rows can be counted, and marked if they are few."""
    spark = df.sparkSession
    path = scratch(spark, "few")
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    return few(written, written.count())


def outer_join_tracks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of two track tables that carry ``is_arrival`` as data.

    Written as the left join and the rows of the right side that it misses, since Spark splits the hot keys of these two
    but not those of a full outer join.
    """
    keys = list(TRACK_KEYS)
    missed = right.join(left.select(*keys), keys, "left_anti")
    return left.join(right, keys, "left").unionByName(missed, allowMissingColumns=True)


def merge_tracks(arrivals: DataFrame, departures: DataFrame) -> DataFrame:
    """Arrival and departure estimates in one table.

    The two sides get a different constant ``is_arrival``, which is part of the join key, so their full outer join
    can match no row: it is the union, and the union needs no shuffle. Written as a join, the constants would fold
    to a false condition and leave a nested loop over both tables.
    """
    return tag(arrivals, is_arrival=True).unionByName(tag(departures, is_arrival=False), allowMissingColumns=True)


def enrich_flights(runways: DataFrame, tracks: DataFrame, aircraft: DataFrame, legacy: bool = False) -> DataFrame:
    """Runway times, track estimates and aircraft type on (airport, flight).

    The legacy form also pairs rows whose flight is null on both sides.
    """
    keys = ["arrival_airport", "gufi"]
    if not legacy:
        return aircraft.join(runways, keys).join(tracks, keys)

    def null_safe(left: DataFrame, right: DataFrame) -> DataFrame:
        renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
        condition = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
        return left.join(renamed, condition).drop(*[f"_r_{k}" for k in keys])

    return null_safe(null_safe(aircraft, runways), tracks)


def latest_per_bucket(
    weather: DataFrame, values: Sequence[str], order: Sequence[Column], at: str = "datetime"
) -> DataFrame:
    """One weather row per station and left-closed bucket: the last one, by a partial aggregate."""
    return (
        weather.filter(F.col("station").isNotNull() & F.col(at).isNotNull())
        .groupBy("station", floor_minutes(at, codes.BUCKET_MINUTES).alias("time_bucket"))
        .agg(F.max(F.struct(F.struct(*order).alias("o"), F.struct(*[F.col(v) for v in values]).alias("v"))).alias("w"))
        .select("station", "time_bucket", *[F.col(f"w.v.{v}").alias(v) for v in values])
    )


def join_weather(flights: DataFrame, weather: DataFrame, suffix: str = "_taf") -> DataFrame:
    """Left join on (station, bucket); a weather column the flights already have gets the suffix."""
    keys = ["station", "time_bucket"]
    clashes = {c: f"{c}{suffix}" for c in weather.columns if c in flights.columns and c not in keys}
    return flights.join(weather.withColumnsRenamed(clashes), keys, "left")


def relevant_weather(weather: DataFrame, flights: DataFrame) -> DataFrame:
    """Weather whose station occurs among the flights and whose bucket does, each on its own."""
    stations = counted_few(flights.select("station").distinct())
    buckets = flights.select("time_bucket").distinct()
    return weather.join(stations, "station", "left_semi").join(buckets, "time_bucket", "left_semi")


def unprocessed(df: DataFrame, done: DataFrame, key: str = "source_file") -> DataFrame:
    return df.join(done.select(key).distinct(), key, "left_anti")


def on_template(template: DataFrame, predictions: DataFrame, key: str = "ID") -> DataFrame:
    """Every template row, in its own columns less the placeholder value, with its prediction."""
    return template.drop("Value").join(predictions, key, "left")


def union_kinds(original: DataFrame, amended: DataFrame, corrected: DataFrame) -> DataFrame:
    """The three forecast kinds in one table with the flags the as-of step asks for."""
    parts = [
        tag(original, kind="original", is_ammend=False, is_correct=False),
        tag(amended, kind="amended", is_ammend=True, is_correct=False),
        tag(corrected, kind="corrected", is_ammend=False, is_correct=True),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
