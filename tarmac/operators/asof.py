"""Latest observation at each grid instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.functions.timebucket import HOUR_US, MINUTE_US, ceil_us, epoch_us, floor_us, on_grid


def asof_observation(
    spine: DataFrame,
    observations: DataFrame,
    values: Sequence[str],
    order: Sequence[Column],
    *,
    station: str = "station",
    at: str = "bucket_end",
    observed: str = "datetime",
    tolerance_hours: int = codes.OBSERVATION_TOLERANCE_HOURS,
    minutes: int = codes.BUCKET_MINUTES,
) -> DataFrame:
    """Each spine row with the values of the newest observation at or before it, at most the tolerance old.

    The whole newest row is taken, nulls included; equal times are decided by ``order``. Spine instants must lie
    on the ``minutes`` grid (others fail), which makes two reductions exact:

    1. of all observations between two grid instants only the newest can ever be taken, so a partial aggregate
       leaves at most one per station and bucket, however dense or skewed the input is;
    2. an answer is never older than the tolerance, so a station's history falls into slots of that length that
       need only the slot before. The window is over (station, slot), a few dozen rows, not over a station.
    """
    grid, slot_us = minutes * MINUTE_US, tolerance_hours * HOUR_US
    newest = (
        observations.filter(F.col(station).isNotNull() & F.col(observed).isNotNull())
        .groupBy(F.col(station).alias("_st"), ceil_us(epoch_us(observed), grid).alias("_us"))
        .agg(
            F.max(
                F.struct(
                    epoch_us(observed).alias("seen_us"),
                    F.struct(*order).alias("o"),
                    F.struct(*[F.col(v) for v in values]).alias("v"),
                )
            ).alias("_obs")
        )
    )
    slot = floor_us(F.col("_us"), slot_us)
    observed_rows = newest.select(
        "_st", "_us", F.explode(F.array(slot, slot + slot_us)).alias("_slot"), "_obs", F.lit(None).alias("_row")
    )
    asked = spine.select(
        F.col(station).alias("_st"),
        on_grid(epoch_us(at), grid).alias("_us"),
        F.struct(*[F.col(c) for c in spine.columns]).alias("_row"),
    ).withColumn("_slot", floor_us(F.col("_us"), slot_us))
    both = observed_rows.unionByName(asked, allowMissingColumns=True)
    history = (
        W.partitionBy("_st", "_slot")
        .orderBy("_us", F.col("_row").isNotNull())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    found = both.withColumn("_obs", F.last("_obs", ignorenulls=True).over(history)).filter(F.col("_row").isNotNull())
    fresh = F.col("_obs.seen_us") >= F.col("_us") - slot_us
    return found.select("_row.*", *[F.when(fresh, F.col(f"_obs.v.{v}")).alias(v) for v in values])
