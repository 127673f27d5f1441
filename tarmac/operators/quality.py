"""Scores and audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import codes


def rmse(actual: Column, predicted: Column) -> Column:
    """Aggregate expression."""
    return F.sqrt(F.avg(F.pow(actual - predicted, F.lit(2.0))))


def score(error: Column) -> Column:
    return F.exp(-error / F.lit(codes.SCORE_SCALE))


def null_audit(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with its number of nulls, from one pass."""
    columns = list(columns or df.columns)
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count("*").alias("_rows"))
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("nulls")) for c in columns])
    return counts.select(F.explode(pairs).alias("p"), F.col("_rows").alias("rows")).select("p.*", "rows")


def row_audit(**tables: DataFrame) -> DataFrame:
    """Name and number of rows of each table."""
    out = None
    for name, df in tables.items():
        counted = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = counted if out is None else out.unionByName(counted)
    return out
