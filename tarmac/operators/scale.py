"""Scaling with parameters fitted by aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.numeric import rescale, unscale
from tarmac.operators.joins import counted_few


def fit_minmax(df: DataFrame, columns: Sequence[str], key: str = "station") -> DataFrame:
    """One row per key with the least and greatest value of each column."""
    return df.groupBy(key).agg(
        *[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("lo", F.min), ("hi", F.max))]
    )


def _with_params(df: DataFrame, params: DataFrame, columns: Sequence[str], key: str, expression) -> DataFrame:
    # One parameter row per key: few are broadcast, so that the rows of ``df`` stay where they are.
    joined = df.join(counted_few(params), key, "left")
    return joined.withColumns({c: expression(c) for c in columns}).select(*df.columns)


def apply_minmax(
    df: DataFrame, params: DataFrame, columns: Sequence[str], key: str = "station", to: tuple[float, float] = (0.0, 1.0)
) -> DataFrame:
    return _with_params(
        df, params, columns, key, lambda c: rescale(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), to)
    )


def invert_minmax(
    df: DataFrame, params: DataFrame, columns: Sequence[str], key: str = "station", to: tuple[float, float] = (0.0, 1.0)
) -> DataFrame:
    return _with_params(
        df, params, columns, key, lambda c: unscale(F.col(c), F.col(f"{c}_lo"), F.col(f"{c}_hi"), to)
    )


def fit_zscore(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column over the whole table: one row, fetched as a fitted model is."""
    row = df.agg(
        *[f(c).alias(f"{c}_{name}") for c in columns for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    ).first()
    return {c: (row[f"{c}_mean"] or 0.0, row[f"{c}_std"] or 1.0) for c in columns}


def apply_zscore(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(mean)) / F.lit(std) for c, (mean, std) in fitted.items()})
