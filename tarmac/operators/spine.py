"""The complete (station x bucket) grid with its train and test cycle."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.functions.timebucket import DAY_US, HOUR_US, MINUTE_US, epoch_us, from_us

_EPOCH = datetime(1970, 1, 1)


def _hours(text: str) -> int:
    return int((datetime.fromisoformat(text) - _EPOCH).total_seconds() // 3600)


def station_order(station: Column, stations: Sequence[str]) -> Column:
    """1-based place in the fixed station list, null for a station that is not on it."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in stations]), station), F.lit(0)).cast("int")


def cycle_day(hour: Column, start: str, cycle_days: int) -> Column:
    day = F.floor((epoch_us(hour) - F.lit(_hours(start) * HOUR_US)) / DAY_US)
    return F.pmod(day, F.lit(cycle_days)).cast("int")


def cycle_no(hour: Column, start: str, cycle_days: int) -> Column:
    return F.floor((epoch_us(hour) - F.lit(_hours(start) * HOUR_US)) / (cycle_days * DAY_US)).cast("int")


def spine(
    spark: SparkSession,
    stations: Sequence[str] = tuple(codes.AIRPORTS),
    start: str = codes.CYCLE_START,
    end: str = codes.CYCLE_END_TARGET,
    part: str = "train",
    cycle_days: int = codes.CYCLE_DAYS,
    train_days: int = codes.TRAIN_DAYS,
    max_cycles: int | None = None,
) -> DataFrame:
    """Rows ``station, station_ord, hour_start, bucket_end, cycle, pos`` for every hour up to ``end`` inclusive.

    ``part`` is ``train`` (first days of each cycle), ``test`` (the rest) or ``all``. ``pos`` numbers the buckets
    of a station densely from 0, by arithmetic and without a window. Hours come from a distributed range, stations
    and quarter hours from exploded literals: no join and no shuffle.
    """
    first, last = _hours(start), _hours(end)
    hour = from_us(F.col("id") * F.lit(HOUR_US))
    day = F.floor((F.col("id") - first) / 24)
    in_cycle = F.pmod(day, F.lit(cycle_days))
    cycle = F.floor(day / cycle_days).cast("int")
    keep = {"train": in_cycle < train_days, "test": in_cycle >= train_days, "all": F.lit(True)}[part]
    days_per_cycle = {"train": train_days, "test": cycle_days - train_days, "all": cycle_days}[part]
    day_in_part = in_cycle - (train_days if part == "test" else 0)
    hours = (
        spark.range(first, last + 1)
        .select(
            hour.alias("hour_start"),
            cycle.alias("cycle"),
            ((cycle * days_per_cycle + day_in_part) * 24 + F.pmod(F.col("id") - first, F.lit(24))).alias("hour_pos"),
            keep.alias("keep"),
        )
        .filter("keep")
    )
    if max_cycles is not None:
        hours = hours.filter(F.col("cycle") < max_cycles)
    names = F.array(*[F.lit(s) for s in stations])
    steps = 60 // codes.BUCKET_MINUTES
    return (
        hours.select("*", F.posexplode(names).alias("station_idx", "station"))
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("quarter"))
        .select(
            "station",
            (F.col("station_idx") + 1).alias("station_ord"),
            "hour_start",
            from_us(epoch_us("hour_start") + F.col("quarter").cast("long") * (codes.BUCKET_MINUTES * MINUTE_US)).alias("bucket_end"),
            "cycle",
            (F.col("hour_pos") * steps + F.col("quarter") - 1).cast("long").alias("pos"),
        )
    )
