"""Latest row of another table at each instant, wherever the instants lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarmac.functions.timebucket import epoch_us, floor_us
from tarmac.operators.joins import few
from tarmac.session import scratch

#: A slot of more instants than this is split by time.
SLOT_ROWS = 1_000_000
#: Cells of a slot, between which it can be split. The instants of a cell are whole microseconds and so bounded.
CELLS = 4096


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def asof_any(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    order: Sequence[Column],
    *,
    on: str = "station",
    at: str = "ts",
    seen: str = "datetime",
    tolerance_us: int,
    age: str | None = None,
    slot_rows: int = SLOT_ROWS,
) -> DataFrame:
    """Each left row with ``values`` of the newest right row of its key at or before it, at most the tolerance old.

    The whole newest row is taken, nulls included; rows of one instant are decided by ``order``. ``age`` names a column for
    the microseconds between the two. Left rows without key or instant, or with nothing in reach, get nulls.

    1. Both tables are reduced to one row per key and instant, by a partial aggregate: whether it is asked for, and the
       right row that stands there. A burst of equal instants is one row from here on.
    2. An answer is never older than the tolerance, so a key's history falls into slots of that length. A slot with too
       many instants is split by time, at a count of its cells; slots and their parts are the windows, never a key.
    3. Of every part only its last right row can be wanted by later parts of this slot and the next; these summaries, one
       row a part, are carried over.
    4. Answers go back to the left rows by a join on key and instant, whose hot keys are split at runtime.
    """
    asked = left.select(F.col(on).alias("_k"), epoch_us(at).alias("_us"), F.lit(None).alias("_row"))
    given = right.select(
        F.col(on).alias("_k"),
        epoch_us(seen).alias("_us"),
        F.struct(F.struct(*order).alias("o"), F.struct(*[F.col(v) for v in values]).alias("v")).alias("_row"),
    )
    instants = (
        asked.unionByName(given)
        .filter(F.col("_k").isNotNull() & F.col("_us").isNotNull())
        .groupBy("_k", "_us")
        .agg(F.max("_row").alias("_row"), F.max(F.col("_row").isNull()).alias("_asked"))
    )
    slot, cell_us = floor_us(F.col("_us"), tolerance_us), max(1, tolerance_us // CELLS)
    instants = instants.withColumns({"_slot": slot, "_cell": floor_us(F.col("_us") - slot, cell_us)})
    instants = _with_parts(_written(instants, "instants"), slot_rows)

    last = F.max(F.when(F.col("_row").isNotNull(), F.struct("_us", "_row"))).alias("_last")
    summaries = instants.groupBy("_k", "_slot", "_part").agg(last)
    reach = summaries.withColumn("_at", F.explode(F.array("_slot", F.col("_slot") + tolerance_us)))
    earlier = W.partitionBy("_k", "_at").orderBy("_slot", "_part").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        reach.withColumn("_last", F.last("_last", ignorenulls=True).over(earlier))
        .filter("_slot = _at AND _last IS NOT NULL")
        .select("_k", "_slot", "_part", F.col("_last._us").alias("_us"), F.col("_last._row").alias("_row"), F.lit(False).alias("_asked"))
    )
    both = instants.select("_k", "_slot", "_part", "_us", "_row", "_asked").unionByName(carried)
    history = W.partitionBy("_k", "_slot", "_part").orderBy("_us").rowsBetween(W.unboundedPreceding, W.currentRow)
    row = F.last(F.when(F.col("_row").isNotNull(), F.struct("_us", "_row")), ignorenulls=True).over(history)
    found = both.withColumn("_found", row).filter(F.col("_asked") & (F.col("_us") - F.col("_found._us") <= tolerance_us))
    answers = found.select("_k", "_us", (F.col("_us") - F.col("_found._us")).alias("_age"), F.col("_found._row.v").alias("_v"))

    keyed = left.withColumns({"_k": F.col(on), "_us": epoch_us(at)})
    extra = [F.col("_age").alias(age)] if age else []
    return keyed.join(answers, ["_k", "_us"], "left").select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values], *extra)


def _with_parts(instants: DataFrame, slot_rows: int) -> DataFrame:
    """``_part`` numbers the parts of each slot; slots that are not split are one part."""
    cells = instants.groupBy("_k", "_slot", "_cell").agg(F.count("*").alias("n"))
    slots = W.partitionBy("_k", "_slot")
    before = F.sum("n").over(slots.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    parted = cells.withColumns({"_part": F.floor(F.coalesce(before, F.lit(0)) / slot_rows), "_all": F.sum("n").over(slots)})
    split = _written(parted.filter(F.col("_all") > slot_rows).select("_k", "_slot", "_cell", "_part"), "split-slots")
    joined = instants.join(few(split, split.count()), ["_k", "_slot", "_cell"], "left")
    return joined.withColumn("_part", F.coalesce("_part", F.lit(0)))
