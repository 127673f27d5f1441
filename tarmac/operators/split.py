"""Train and validation splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import codes


def chronological_part(cycle: Column, train_cycles: int = codes.TRAIN_CYCLES) -> Column:
    """The first cycles train, the rest validate. Cycles have equal rows per station, so no sort is needed."""
    return F.when(cycle < train_cycles, F.lit("train")).otherwise(F.lit("validation"))


def hash_bucket(keys: Sequence[str], seed: int = 42, buckets: int = 10) -> Column:
    """0-based bucket from the row's key alone: the same row falls the same way on any cluster."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def hash_split(df: DataFrame, keys: Sequence[str], fraction: float = 0.8, seed: int = 42) -> DataFrame:
    bucket = hash_bucket(keys, seed, 100)
    return df.withColumn("part", F.when(bucket < int(fraction * 100), "train").otherwise("validation"))


def full_series(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Only the series that have all their rows."""
    complete = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") == rows).select(*keys)
    return df.join(complete, list(keys), "left_semi")
