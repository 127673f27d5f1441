"""Forecast values at each grid instant: newest report, its change and base lines, and the overlay of kinds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.functions.timebucket import DAY_US, HOUR_US, MINUTE_US, ceil_us, epoch_us, floor_us, on_grid

KINDS = ("original", "amended", "corrected")
LOOKBACK_HOURS = 6
REACH_HOURS = 30


def _line(order: Sequence[str], values: Sequence[str]) -> Column:
    return F.struct(
        F.struct(*[F.col(c) for c in order]).alias("o"), F.struct(*[F.col(v) for v in values]).alias("v")
    )


def report_states(
    lines: DataFrame,
    values: Sequence[str],
    order: Sequence[str],
    change_starts: Sequence[str] = ("from_time", "tempo_start", "becmg_start"),
    minutes: int = codes.BUCKET_MINUTES,
    legacy: bool = False,
) -> DataFrame:
    """One row per report group (station, kind, validity start): its base line and its steps.

    A step is ``(eff_us, line)``: the last change line, in file order, of those that start in one grid bucket. A
    report is asked for at most 30 hours, so a group has at most 121 steps whatever number of lines it holds; both
    parts are partial aggregates. The legacy form also keeps, per step, the last base line above it.
    """
    grid = minutes * MINUTE_US
    valid_us = epoch_us("validity_start")
    start_us = F.least(*[epoch_us(c) for c in change_starts])
    group = ["station", "kind", "valid_us"]
    usable = (
        lines.filter(F.col("station").isNotNull() & F.col("validity_start").isNotNull())
        .select("station", "kind", valid_us.alias("valid_us"), start_us.alias("start_us"), _line(order, values).alias("line"))
        .withColumn("is_base", F.col("start_us").isNull())
        .withColumn(
            "eff_us", ceil_us(F.greatest(F.coalesce("start_us", "valid_us"), F.col("valid_us")), grid)
        )
        .withColumn("in_reach", F.col("is_base") | (F.col("eff_us") <= F.col("valid_us") + REACH_HOURS * HOUR_US))
        # A line out of reach still makes its report the newest one, so it stays as an empty step.
        .withColumn("eff_us", F.when(F.col("in_reach"), F.col("eff_us")).otherwise(ceil_us(F.col("valid_us"), grid)))
    )
    steps = usable.groupBy(*group, "eff_us").agg(
        F.max(F.when(~F.col("is_base") & F.col("in_reach"), F.col("line"))).alias("change"),
        F.max(F.when(F.col("is_base"), F.col("line"))).alias("base"),
    )
    states = steps.groupBy(*group).agg(
        F.max("base").alias("base"),
        F.collect_list(F.when(F.col("change").isNotNull(), F.struct("eff_us", "change"))).alias("steps"),
    )
    if not legacy:
        return states

    # Last base line above each change line. A base line matters only to the first step line below it, so each
    # is sent to that one line, reduced there, and carried on over the at most 121 step lines of the group.
    marks = states.select(*group, F.transform("steps", lambda s: s["change"]["o"]).alias("marks"))
    below = F.array_min(F.filter("marks", lambda m: m > F.col("line.o")))
    above = (
        usable.filter("is_base")
        .join(marks, group)
        .withColumn("mark", below)
        .filter(F.col("mark").isNotNull())
        .groupBy(*group, "mark")
        .agg(F.max("line").alias("above"))
        .groupBy(*group)
        .agg(F.collect_list(F.struct("mark", "above")).alias("aboves"))
    )
    return states.join(above, group, "left")


def _in_force(state: Column, at_us: Column, values: Sequence[str], legacy: bool) -> list[Column]:
    """The values of a report group at an instant, from its base line and its steps."""
    started = F.filter(state["steps"], lambda s: s["eff_us"] <= at_us)
    change = F.array_max(F.transform(started, lambda s: s["change"]))
    sources = [change, state["base"]]
    if legacy:
        upward = F.filter(state["aboves"], lambda a: a["mark"] <= change["o"])
        sources = [state["base"], change, F.array_max(F.transform(upward, lambda a: a["above"]))]
    return [F.coalesce(*[source["v"][v] for source in sources]) for v in values]


def newest_reports(spine: DataFrame, states: DataFrame, at: str = "bucket_end", minutes: int = codes.BUCKET_MINUTES) -> DataFrame:
    """Spine rows with, per kind, the state of the newest report that is valid at them, begun at most 6 hours before their day.

    Adds ``at_us`` and one struct for each kind. Only the newest start of a grid bucket can be the answer, which leaves at
    most one row per station and bucket. The window is over (station, day); starts of a day's last six hours are copied
    to the next day. The states themselves travel with the rows, so that nothing is joined afterwards.
    """
    grid = minutes * MINUTE_US
    parts = [c for c in states.columns if c not in ("station", "kind")]
    starts = (
        states.withColumn("state", F.struct(*parts))
        .groupBy("station", ceil_us(F.col("valid_us"), grid).alias("at_us"), floor_us(F.col("valid_us"), DAY_US).alias("day"))
        .agg(*[F.max_by(F.when(F.col("kind") == k, F.col("state")), F.when(F.col("kind") == k, F.col("valid_us"))).alias(k) for k in KINDS])
    )
    evening = F.col("day") + F.lit(DAY_US - LOOKBACK_HOURS * HOUR_US)

    def still_valid(kind: str) -> Column:
        return F.when((F.col("to") == F.col("day")) | (F.col(kind)["valid_us"] >= evening), F.col(kind)).alias(kind)

    latest = F.greatest(*[F.col(k)["valid_us"] for k in KINDS])
    days = F.when(latest >= evening, F.array(F.col("day"), F.col("day") + F.lit(DAY_US))).otherwise(F.array("day"))
    starts = starts.select("*", F.explode(days).alias("to")).select(
        "station", "at_us", F.col("to").alias("day"), *[still_valid(k) for k in KINDS], F.lit(None).alias("row")
    )
    asked = spine.select(
        "station",
        on_grid(epoch_us(at), grid).alias("at_us"),
        floor_us(epoch_us(at), DAY_US).alias("day"),
        F.struct(*[F.col(c) for c in spine.columns]).alias("row"),
    )
    history = (
        W.partitionBy("station", "day")
        .orderBy("at_us", F.col("row").isNotNull())
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    both = starts.unionByName(asked, allowMissingColumns=True)
    return (
        both.withColumns({k: F.last(k, ignorenulls=True).over(history) for k in KINDS})
        .filter(F.col("row").isNotNull())
        .select("row.*", "at_us", F.struct(*KINDS).alias("newest"))
    )


def overlay_kinds(df: DataFrame, keys: Sequence[str], values: Sequence[str], state: str = "state") -> DataFrame:
    """One row per key from one per kind: corrected over amended over original, field by field."""
    picks = {k: F.max(F.when(F.col("kind") == k, F.col(state))) for k in KINDS}
    wide = df.groupBy(*keys).agg(*[pick.alias(kind) for kind, pick in picks.items()])
    return wide.select(
        *keys, *[F.coalesce(*[F.col(f"{k}.{v}") for k in reversed(KINDS)]).alias(v) for v in values]
    )


def forecast_asof(
    spine: DataFrame,
    lines: DataFrame,
    values: Sequence[str],
    order: Sequence[str] = ("issue_ts", "source_file", "block_no", "line_no"),
    *,
    at: str = "bucket_end",
    change_starts: Sequence[str] = ("from_time", "tempo_start", "becmg_start"),
    minutes: int = codes.BUCKET_MINUTES,
    legacy: bool = False,
) -> DataFrame:
    """Spine rows with the forecast values in force; equal rows stay apart.

    ``lines`` needs ``station, kind, validity_start``, the change starts, the order columns and the values. A change line
    that has started wins over the base line; the legacy form lets the base line win. Field by field a corrected report
    wins over an amended one, that one over the original. Spine instants must lie on the ``minutes`` grid; others fail.
    """
    states = report_states(lines, values, order, change_starts, minutes, legacy)
    found = newest_reports(spine, states, at, minutes)
    by_kind = [_in_force(F.col("newest")[k], F.col("at_us"), values, legacy) for k in reversed(KINDS)]
    merged = [F.coalesce(*picks).alias(v) for v, picks in zip(values, zip(*by_kind))]
    return found.select(*[F.col(c) for c in spine.columns], *merged)
