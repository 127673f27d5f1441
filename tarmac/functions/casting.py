"""Projections and casts that follow the schema at hand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.timebucket import lenient_timestamp


def present_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Only the wanted columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Exactly the columns and types of ``target``; what is missing or unreadable becomes null."""
    return df.select(
        *[
            (F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in target.fields
        ]
    )


def downcast(df: DataFrame) -> DataFrame:
    """Half-width numbers: long to int, double to float. A long out of range becomes null."""
    narrow = {T.LongType(): "int", T.DoubleType(): "float"}
    return df.select(
        *[
            F.col(f.name).try_cast(narrow[f.dataType]).alias(f.name) if f.dataType in narrow else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def numbers_to_double(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.NumericType) else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def times_from_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: lenient_timestamp(c) for c in columns if c in df.columns})


def expand_struct(df: DataFrame, column: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], f"{column}.*")


def null_not_nan(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column, so that null rules see all gaps."""
    return df.select(
        *[
            F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
