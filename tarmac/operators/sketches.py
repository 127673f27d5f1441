"""Sketches that are stored once and merged to coarser keys without a second look at the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.operators.counts import flights_of_buckets

#: log2 of the registers of a distinct sketch, and the values a quantile sketch keeps in its levels.
DISTINCT_SIZE, QUANTILE_SIZE = 14, 800


def distinct_error(size: int = DISTINCT_SIZE) -> float:
    """Relative standard error of a merged distinct count."""
    return 1.04 / 2 ** (size / 2)


def quantile_error(size: int = QUANTILE_SIZE) -> float:
    """Error of a merged sketch's quantile, as a share of all rows, that is kept in 99 of 100 cases."""
    return 2.296 / size**0.9723


def flight_sketches(
    df: DataFrame,
    flight: str = "gufi",
    station: str = "station",
    at: str = "ts",
    minutes: int = codes.BUCKET_MINUTES,
    size: int = DISTINCT_SIZE,
) -> DataFrame:
    """``station, time_bucket, sketch`` of the flights that ``distinct_flights`` counts; a partial aggregate."""
    rows = flights_of_buckets(df, flight, station, at, minutes)
    text = F.col(flight).cast("string")
    return rows.groupBy(station, "time_bucket").agg(F.hll_sketch_agg(text, size).alias("sketch"))


def merged_flights(sketches: DataFrame, *keys: str | Column) -> DataFrame:
    """Estimated distinct flights by coarser keys, from stored sketches alone."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("flights"))


def value_sketches(df: DataFrame, keys: Sequence[str | Column], value: str, size: int = QUANTILE_SIZE) -> DataFrame:
    """One quantile sketch of a number for each key, nulls left out."""
    number = F.col(value).cast("double")
    return df.filter(number.isNotNull()).groupBy(*keys).agg(F.kll_sketch_agg_double(number, size).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: Sequence[str | Column], quantiles: Sequence[float], size: int = QUANTILE_SIZE) -> DataFrame:
    """``keys, samples`` and an estimate for each quantile (``q25`` for a quarter), from stored sketches alone."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", size).alias("_all"))
    found = [F.kll_sketch_get_quantile_double("_all", F.lit(float(q))).alias(f"q{int(round(q * 100)):02d}") for q in quantiles]
    return merged.select(*[c for c in merged.columns if c != "_all"], F.kll_sketch_get_n_double("_all").alias("samples"), *found)


def rank_errors(df: DataFrame, keys: Sequence[str], value: str, estimates: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """How far each estimate's place among all values lies from its quantile, as a share of the rows of its key."""
    joined = df.filter(F.col(value).isNotNull()).join(estimates, list(keys))

    def error(q: float) -> Column:
        name = f"q{int(round(q * 100)):02d}"
        below = F.count_if(F.col(value) < F.col(name)) / F.count("*")
        upto = F.count_if(F.col(value) <= F.col(name)) / F.count("*")
        return F.greatest(below - q, F.lit(q) - upto, F.lit(0.0)).alias(f"{name}_error")

    return joined.groupBy(*keys).agg(*[error(q) for q in quantiles])
