"""Which of several rows of one key stays.

All of these are aggregates with a map-side partial step, not windows: a key that holds a third of all rows
reaches the shuffle as one row per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.timebucket import epoch_us, from_us


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], aggregate) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(F.struct(*order).alias("o"), F.struct(*[F.col(c) for c in rest]).alias("v"))
    picked = df.groupBy(*keys).agg(aggregate(ranked).alias("_pick"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_pick.v.{c}").alias(c) for c in df.columns])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row that comes first in ``order`` for each key. ``order`` must be total within a key."""
    return _pick(df, keys, order, F.min)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row that comes last in ``order`` for each key."""
    return _pick(df, keys, order, F.max)


def first_seen(
    df: DataFrame,
    flight: str = "gufi",
    station_ord: str = "station_ord",
    at: str = "arrival_ts",
) -> DataFrame:
    """Each flight once over all stations: at the first station in list order, then at its earliest time.

    Rows without a station on the list, or without a time, are never seen.
    """
    seen = df.filter(F.col(flight).isNotNull() & F.col(station_ord).isNotNull() & F.col(at).isNotNull())
    return keep_first(seen, [flight], [F.col(station_ord), F.col(at)])


_HALF = 1 << 53


def packed_first_value(station_ord: str = "station_ord", at: str = "arrival_ts") -> Column:
    """Station place and time as one long, which orders as the pair does.

    Places below 256 and the years 1684 to 2255 fit; anything else stops the job.
    """
    us = epoch_us(at)
    fits = us.between(-_HALF, _HALF - 1) & F.col(station_ord).between(0, 255)
    packed = F.shiftleft(F.col(station_ord).cast("long"), 54) + us + F.lit(_HALF)
    return F.when(fits, packed).otherwise(F.raise_error(F.lit("station place or time out of range")).cast("long"))


def packed_first(
    df: DataFrame, flight: str = "gufi", station_ord: str = "station_ord", at: str = "arrival_ts"
) -> DataFrame:
    """``flight, first``: the least packed value of each flight, a plain hash aggregate without a sort."""
    seen = df.filter(F.col(flight).isNotNull() & F.col(station_ord).isNotNull() & F.col(at).isNotNull())
    return seen.groupBy(flight).agg(F.min(packed_first_value(station_ord, at)).alias("first"))


def unpacked_first(first: Column, station_ord: str = "station_ord", at: str = "arrival_ts") -> list[Column]:
    time = from_us(first.bitwiseAND(F.lit((1 << 54) - 1)) - _HALF)
    return [F.shiftright(first, 54).cast("int").alias(station_ord), time.alias(at)]


def first_seen_packed(
    df: DataFrame, flight: str = "gufi", station_ord: str = "station_ord", at: str = "arrival_ts"
) -> DataFrame:
    """``first_seen`` for the three columns alone, as ``station_ord, arrival_ts``."""
    return packed_first(df, flight, station_ord, at).select(*unpacked_first(F.col("first"), station_ord, at))
