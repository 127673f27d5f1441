"""Grid rows to series, windows of past and future steps, and quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dense_series(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row per series: start, length and an array per value column.

    A series is one cycle of one station on the time grid, so its length is fixed by the grid. Times must be
    unique within a series.
    """
    points = F.sort_array(F.collect_list(F.struct(order, *values)))
    return (
        df.groupBy(*keys)
        .agg(points.alias("points"))
        .select(
            *keys,
            F.element_at("points", 1)[order].alias("start"),
            F.size("points").alias("length"),
            *[F.col(f"points.{v}").alias(v) for v in values],
        )
    )


def pivot_series(df: DataFrame, index: str, series: str, names: Sequence[str], value: str) -> DataFrame:
    """One column per series, the largest value where an index has several; the names are given, so no pass looks them up."""
    return df.groupBy(index).pivot(series, list(names)).agg(F.max(value))


def supervised_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    target: str,
    past: Sequence[str] = (),
    future: Sequence[str] = (),
    lags: int = 4,
    horizon: int = 12,
) -> DataFrame:
    """Rows that have ``lags`` past steps and ``horizon`` future ones in the same series.

    A key is one series of fixed grid length, so a window holds at most one series.
    """
    window = W.partitionBy(*keys).orderBy(order)
    columns: dict[str, Column] = {}
    for k in range(lags):
        for c in (target, *past):
            columns[f"{c}_lag_{k}"] = F.lag(c, k).over(window)
    for k in range(1, horizon + 1):
        columns[f"{target}_step_{k}"] = F.lead(target, k).over(window)
        for c in future:
            columns[f"{c}_step_{k}"] = F.lead(c, k).over(window)
    columns["_before"] = F.lag(F.lit(1), lags - 1).over(window)
    columns["_after"] = F.lead(F.lit(1), horizon).over(window)
    return (
        df.select(*keys, order, *[e.alias(n) for n, e in columns.items()])
        .filter(F.col("_before").isNotNull() & F.col("_after").isNotNull())
        .drop("_before", "_after")
    )


def long_steps(windows: DataFrame, keys: Sequence[str], target: str, future: Sequence[str], horizon: int = 12):
    """One row per future step instead of one column, with the step number as a feature."""
    steps = F.array(
        *[
            F.struct(
                F.lit(k).alias("step"),
                F.col(f"{target}_step_{k}").alias(target),
                *[F.col(f"{c}_step_{k}").alias(c) for c in future],
            )
            for k in range(1, horizon + 1)
        ]
    )
    stepped = {f"{target}_step_{k}" for k in range(1, horizon + 1)}
    stepped |= {f"{c}_step_{k}" for c in future for k in range(1, horizon + 1)}
    kept = [c for c in windows.columns if c not in stepped]
    return windows.select(*kept, F.explode(steps).alias("s")).select(*kept, "s.*")


def horizon_rows(df: DataFrame, station: str = "station", start: str = "start", steps: int = 12) -> DataFrame:
    """One row per forecast step of every context block, with its instant."""
    from tarmac.functions.timebucket import forecast_steps

    return df.select(station, start, F.posexplode(forecast_steps(start, steps)).alias("step", "at")).withColumn(
        "step", F.col("step") + 1
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], ranges_per_key: int = 64
) -> DataFrame:
    """Mean, sum and interpolated quantiles per key, exact for groups of any size and values of any scale.

    Equal values are counted first. Approximate percentiles cut each key into ranges of about equal weight; ranks are
    running counts inside a range plus the totals of the ranges below, so no task sorts or holds a whole group. The cuts
    only deal the work, so their error doesn't reach the result.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    cuts = F.percentile_approx("_v", F.array(*[F.lit(i / ranges_per_key) for i in range(1, ranges_per_key)]), F.lit(1000))
    bounds = counts.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(cuts.alias("_cuts"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    placed = counts.join(bounds, same, "left").select(*keys, "_v", "_n", "_cuts")
    counted = placed.withColumn("_c", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    ranges = counted.groupBy(*keys, "_c").agg(
        F.sum("_n").alias("_size"), F.sum(F.col("_v") * F.col("_n")).alias("_total")
    )
    over_key = W.partitionBy(*keys)
    below = over_key.orderBy("_c").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(
        *keys,
        "_c",
        F.coalesce(F.sum("_size").over(below), F.lit(0)).alias("_below"),
        F.sum("_size").over(over_key).alias("_count"),
        F.sum("_total").over(over_key).alias("_sum"),
    )
    inside = W.partitionBy(*keys, "_c").orderBy("_v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = counted.join(ranges, [*keys, "_c"]).withColumn("_last", F.col("_below") + F.sum("_n").over(inside))

    def at_rank(rank: Column) -> Column:
        return F.max(F.when((rank > F.col("_last") - F.col("_n")) & (rank <= F.col("_last")), F.col("_v")))

    aggregates = [F.max("_count").alias("samples"), F.max("_sum").alias("total")]
    for i, q in enumerate(quantiles):
        place = (F.col("_count") - 1) * F.lit(float(q))
        aggregates.append(at_rank(F.floor(place) + 1).alias(f"_lo{i}"))
        aggregates.append(at_rank(F.ceil(place) + 1).alias(f"_hi{i}"))
    wide = ranked.groupBy(*keys).agg(*aggregates)
    place = lambda q: (F.col("samples") - 1) * F.lit(float(q))
    return wide.select(
        *keys,
        "samples",
        "total",
        (F.col("total") / F.col("samples")).alias("mean"),
        *[
            (
                F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place(q) - F.floor(place(q)))
            ).alias(f"q{int(round(q * 100)):02d}")
            for i, q in enumerate(quantiles)
        ],
    )
