"""Codes of labels that stay when labels arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarmac import schemas
from tarmac.operators.joins import few
from tarmac.session import path_exists, scratch
from tarmac.sources.tables import write_table

CODES = schemas.schema("label:string code:long run:int")
#: The code of a label that no run has seen.
UNSEEN = 0


def codes_of(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """``label, code`` of all runs, or of those before one."""
    known = spark.read.schema(CODES).parquet(table) if path_exists(spark, table) else spark.createDataFrame([], CODES)
    return (known if before is None else known.filter(F.col("run") < before)).select("label", "code")


def extend_codes(labels: DataFrame, column: str, table: str, run: int) -> None:
    """Give codes to the labels of one run that the table below ``table`` lacks; codes once given are never changed.

    New labels follow the largest code in their own order. They are dealt to ranges, written and ranked within a range; the
    ranges' sizes give each its start. No task and no driver holds all labels. A run that was lost is repeated under its
    number and gives the same codes.
    """
    spark = labels.sparkSession
    known = codes_of(spark, table, run)
    new = labels.select(F.col(column).alias("label")).filter("label IS NOT NULL").distinct().join(known, "label", "left_anti")
    path = scratch(spark, "new-labels")
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    new.repartitionByRange(ranges, "label").withColumn("_range", F.spark_partition_id()).write.parquet(path)
    new = spark.read.schema("label string, _range int").parquet(path)
    last = known.agg(F.max("code")).first()[0] or UNSEEN
    sizes = new.groupBy("_range").agg(F.count("*").alias("n"))  # a row a range
    before = F.sum("n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    rank = F.row_number().over(W.partitionBy("_range").orderBy("label"))
    coded = new.withColumn("_rank", rank).join(F.broadcast(starts), "_range")
    coded = coded.select("label", (F.lit(last) + F.col("_start") + F.col("_rank")).alias("code"), F.lit(run).alias("run"))
    write_table(coded, table, partition_by=["run"])


def with_codes(df: DataFrame, column: str, name: str, table: str) -> DataFrame:
    """Each row with the code of its label; null and unseen labels share the place kept for them."""
    known = codes_of(df.sparkSession, table).withColumnRenamed("label", "_label")
    coded = df.join(few(known, known.count()), F.col(column) == F.col("_label"), "left")
    return coded.select(*df.columns, F.coalesce("code", F.lit(UNSEEN)).alias(name))
