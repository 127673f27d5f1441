"""Process only files that were not processed before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tarmac.operators.joins import unprocessed
from tarmac.session import path_exists
from tarmac.sources.tables import write_table


def append_new(df: DataFrame, sink: str, key: str = "source_file") -> None:
    """Batch form: add the rows of the sources the sink does not have yet."""
    spark = df.sparkSession
    # Read under the table's own schema; a sink that was never written has no rows.
    seen = spark.read.schema(df.schema).parquet(sink) if path_exists(spark, sink) else spark.createDataFrame([], df.schema)
    write_table(unprocessed(df, seen, key), sink, mode="append")


def stream_new_files(
    spark: SparkSession,
    source: str,
    sink: str,
    schema: T.StructType,
    checkpoint: str,
    preprocess: Callable[[DataFrame], DataFrame] = lambda df: df,
    files_per_batch: int = 1000,
) -> None:
    """File-stream form: the checkpoint remembers the files done, each call handles what is new and ends.

    The checkpoint must lie in a folder all executors share; a rerun after a lost job repeats no file.
    """
    query = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(source)
        .transform(preprocess)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", sink)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
