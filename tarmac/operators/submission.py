"""Predictions to the submission template."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions.numeric import clip_round
from tarmac.functions.timebucket import submission_id
from tarmac.operators.joins import on_template
from tarmac.operators.ordered import fill_forward
from tarmac.operators.scale import invert_minmax


def template_rows(spine: DataFrame) -> DataFrame:
    """The template a test spine implies: per station and 4-hour block the twelve buckets after its first hour."""
    from tarmac.functions.timebucket import block_pos

    return spine.filter(block_pos("bucket_end") >= 4).select(
        submission_id("station", F.col("bucket_end")).alias("ID"), F.lit(0).alias("Value"), "station", "bucket_end"
    )


def to_submission(predictions: DataFrame, params: DataFrame | None = None, value: str = "prediction") -> DataFrame:
    """``station, at, prediction`` to ``ID, Value``: undo the scaling, clip, round, name."""
    df = predictions.withColumnRenamed(value, "Value")
    if params is not None:
        df = invert_minmax(df, params, ["Value"])
    return df.select(submission_id("station", F.col("at")).alias("ID"), clip_round(F.col("Value")).alias("Value"))


def complete_submission(template: DataFrame, submission: DataFrame) -> DataFrame:
    """Template rows with their value; the few without one take the last value of the same station."""
    joined = on_template(template, submission)
    return fill_forward(joined, ["station"], "bucket_end", ["Value"])
