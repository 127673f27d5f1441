"""Fills, lags and leads over long ordered histories.

A history (one station, all years) is cut into chunks, by default days. Windows run inside a chunk; what a chunk
needs from its neighbours comes from one summary row per chunk. So the unit of work is a chunk, not a station,
and the only window over a whole station is over its chunk summaries.

Tables come with one row per key and time, that is, already counted or reduced to the grid; a day of a station then has
96 rows however many events lie behind them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarmac.functions.timebucket import DAY_US, epoch_us, floor_us
from tarmac.operators.joins import few
from tarmac.session import scratch


def day_chunk(order: str, days: int = 1) -> Column:
    return floor_us(epoch_us(order), days * DAY_US)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    last: Sequence[str] = (),
    coming: Sequence[str] = (),
    before: Sequence[str] = (),
    after: Sequence[str] = (),
    chunk: Column | None = None,
) -> DataFrame:
    """For each row, along ``order`` within its key, in one pass:

    ``c__last``    last value of ``c`` up to the row, nulls passed over, for each column of ``last``
    ``c__coming``  first value from the row on, nulls passed over
    ``c__before``  value of the row before, null or not
    ``c__after``   value of the row after

    The summary holds, per chunk, its first and last row (or value) of each column.
    """
    asked = [
        *[(c, f"{c}__last", True, False) for c in last],
        *[(c, f"{c}__coming", False, False) for c in coming],
        *[(c, f"{c}__before", True, True) for c in before],
        *[(c, f"{c}__after", False, True) for c in after],
    ]
    chunked = df.withColumn("_chunk", day_chunk(order) if chunk is None else chunk)

    def edge(column: str, backward: bool, nulls: bool) -> Column:
        row = F.struct(F.col(order).alias("o"), F.col(column).alias("v"))
        return (F.max if backward else F.min)(row if nulls else F.when(F.col(column).isNotNull(), row))

    summary = chunked.groupBy(*keys, "_chunk").agg(*[edge(c, b, n).alias(name) for c, name, b, n in asked])
    chunks = W.partitionBy(*keys).orderBy("_chunk")
    earlier, later = chunks.rowsBetween(W.unboundedPreceding, -1), chunks.rowsBetween(1, W.unboundedFollowing)
    carry = summary.select(
        *keys,
        "_chunk",
        *[
            (F.last(name, ignorenulls=True).over(earlier) if b else F.first(name, ignorenulls=True).over(later))["v"].alias(
                f"{name}_carry"
            )
            for _, name, b, _ in asked
        ],
    )

    rows = W.partitionBy(*keys, "_chunk").orderBy(order)

    def inside(column: str, name: str, backward: bool, nulls: bool) -> Column:
        outside = F.col(f"{name}_carry")
        if nulls:
            at_edge = (F.lag if backward else F.lead)(F.lit(1)).over(rows).isNull()
            return F.when(at_edge, outside).otherwise((F.lag if backward else F.lead)(column).over(rows))
        if backward:
            found = F.last(column, ignorenulls=True).over(rows.rowsBetween(W.unboundedPreceding, W.currentRow))
        else:
            found = F.first(column, ignorenulls=True).over(rows.rowsBetween(W.currentRow, W.unboundedFollowing))
        return F.coalesce(found, outside)

    joined = chunked.join(carry, [*keys, "_chunk"], "left")
    return joined.select(*df.columns, *[inside(c, name, b, n).alias(name) for c, name, b, n in asked])


def _replaced(df: DataFrame, columns: Sequence[str], value) -> list[Column]:
    return [value(c).alias(c) if c in columns else F.col(c) for c in df.columns]


def fill_forward(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], chunk: Column | None = None
) -> DataFrame:
    """Nulls take the last value before them within the key."""
    found = neighbours(df, keys, order, last=columns, chunk=chunk)
    return found.select(*_replaced(df, columns, lambda c: F.col(f"{c}__last")))


def fill_backward(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], chunk: Column | None = None
) -> DataFrame:
    """Nulls take the next value after them within the key."""
    found = neighbours(df, keys, order, coming=columns, chunk=chunk)
    return found.select(*_replaced(df, columns, lambda c: F.col(f"{c}__coming")))


def fill_both(
    df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], chunk: Column | None = None
) -> DataFrame:
    """Forward, then backward for what is left at the start."""
    found = neighbours(df, keys, order, last=columns, coming=columns, chunk=chunk)
    return found.select(*_replaced(df, columns, lambda c: F.coalesce(f"{c}__last", f"{c}__coming")))


def previous(
    df: DataFrame, keys: Sequence[str], order: str, column: str, name: str, chunk: Column | None = None
) -> DataFrame:
    """Value of the row before, within the key, however far back it lies."""
    found = neighbours(df, keys, order, before=[column], chunk=chunk)
    return found.select(*df.columns, F.col(f"{column}__before").alias(name))


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    column: str,
    offsets: dict[str, int],
    chunk_rows: int = 2304,
) -> DataFrame:
    """Values ``offsets`` rows ahead (positive) or behind (negative), for rows numbered densely by ``pos``.

    Chunks are ranges of ``pos``; rows near an edge are copied into the neighbouring chunk for its window and
    dropped afterwards.
    """
    ahead = max([0, *offsets.values()])
    behind = max([0, *[-o for o in offsets.values()]])
    home = F.floor(F.col(pos) / chunk_rows)
    copies = F.array_distinct(
        F.array(home, F.floor((F.col(pos) - ahead) / chunk_rows), F.floor((F.col(pos) + behind) / chunk_rows))
    )
    window = W.partitionBy(*keys, "_chunk").orderBy(pos)
    return (
        df.select("*", home.alias("_home"), F.explode(copies).alias("_chunk"))
        .withColumns({name: F.lead(column, offset).over(window) for name, offset in offsets.items()})
        .filter(F.col("_chunk") == F.col("_home"))
        .drop("_home", "_chunk")
    )


def block_fill(
    df: DataFrame,
    columns: Sequence[str],
    *,
    block: Sequence[str] = ("station", "block"),
    pos: str = "pos",
    observed_suffix: str = "_observed",
) -> DataFrame:
    """Fill forecast columns by block of 16 rows.

    First four rows: the forecast, else the observation. Other rows: the last forecast among rows 4 to here, else
    the observation of row 3. Each column has its observation beside it under the suffix.
    """
    later = F.col(pos) >= 4
    whole = W.partitionBy(*block)
    running = W.partitionBy(*block).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)

    def filled(c: str) -> Column:
        observed = F.col(f"{c}{observed_suffix}")
        fourth = F.max(F.when(F.col(pos) == 3, observed)).over(whole)
        since_four = F.last(F.when(later, F.col(c)), ignorenulls=True).over(running)
        return F.when(later, F.coalesce(since_four, fourth)).otherwise(F.coalesce(F.col(c), observed))

    return df.withColumns({c: filled(c) for c in columns}).drop(*[f"{c}{observed_suffix}" for c in columns])


def category_codes(df: DataFrame, column: str, name: str, source: DataFrame | None = None) -> DataFrame:
    """0-based rank of each label among the sorted distinct labels of ``source``, by default ``df`` itself.

    The labels are dealt to ranges by their order and written, so that a range stays what it was when its rows are ranked;
    a label's code is its rank within its range plus the sizes of the ranges before, of which there are as many as shuffle
    partitions. No task sorts all labels.
    """
    spark = df.sparkSession
    path = scratch(spark, "labels")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    labels = (df if source is None else source).select(F.col(column).alias("_label")).filter("_label IS NOT NULL").distinct()
    labels.repartitionByRange(ranges, "_label").withColumn("_range", F.spark_partition_id()).write.parquet(path)
    labels = spark.read.schema(labels.withColumn("_range", F.lit(0)).schema).parquet(path)
    before, total = {}, 0
    for place, size in sorted(labels.groupBy("_range").count().collect()):
        before[place], total = total, total + size
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_range")) if before else F.lit(0)
    rank = F.row_number().over(W.partitionBy("_range").orderBy("_label"))
    ranked = labels.select("_label", (start + rank - 1).cast("int").alias(name))
    return df.join(few(ranked, total), F.col(column) == F.col("_label"), "left").select(*df.columns, name)
