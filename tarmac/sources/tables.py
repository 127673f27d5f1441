"""Parquet and CSV tables in, Parquet and CSV tables out."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac import schemas
from tarmac.functions.casting import conform
from tarmac.sources.records import cells, csv_records

# Brotli is not among the codecs Spark ships with; zstd comes closest in size.
CODEC = "zstd"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the known tables, with its declared schema: no inference job, pruned to the columns used."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{folder}/{name}.parquet")


def read_parts(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All part files of a folder as one table under a declared schema, also where their columns differ.

    A file that lacks a column gives nulls. Zero-byte files have no splits and so no rows; any other file that cannot be
    read fails the job, since its rows would be lost.
    """
    return (
        spark.read.schema(schema)
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", True)
        .parquet(folder)
    )


#: More parts than this that give no row are no accident: the probe fails.
FEW_BROKEN = 1000


def probe_parts(spark: SparkSession, folder: str) -> DataFrame:
    """``path, length, reason`` of the part files of a folder that are not Parquet.

    Footers are read, no column, by the tasks that the files are dealt to. Of the files that gave no row the first and
    last bytes are looked at: one without the marks of the format, or with a footer longer than itself, is listed. All
    others stay in the scan, where a fault fails the job, so that nothing is passed over in silence.
    """

    def files(kind: str):
        return spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")

    file = F.col("_metadata.file_path").alias("path")
    with_rows = files("parquet").schema("_none int").option("ignoreCorruptFiles", True).load(folder).select(file).distinct()
    silent = files("binaryFile").load(folder).select(file, F.col("path").alias("place")).join(with_rows, "path", "left_anti")
    places = [r["place"] for r in silent.select("place").limit(FEW_BROKEN + 1).collect()]
    if len(places) > FEW_BROKEN:
        raise ValueError(f"more than {FEW_BROKEN} files below {folder} give no row")
    if not places:
        return spark.createDataFrame([], "path string, length bigint, reason string")
    bytes_ = spark.read.format("binaryFile").load(places).select(file, "length", "content")
    tail = F.hex(F.substring("content", -8, 8))
    footer = F.conv(F.concat(*[F.substring(tail, at, 2) for at in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    mark = F.lit("50415231")  # the format's four letters
    reason = (
        F.when(F.col("length") < 12, "too short")
        .when(F.hex(F.substring("content", 1, 4)) != mark, "no mark at the start")
        .when(F.substring(tail, 9, 8) != mark, "no mark at the end")
        .when(footer + 12 > F.col("length"), "footer longer than the file")
    )
    return bytes_.select("path", "length", reason.alias("reason")).filter("reason IS NOT NULL")


def read_sound_parts(spark: SparkSession, folder: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """``read_parts`` without the files that ``probe_parts`` lists, and that list. Listed files are not opened."""
    rejected = probe_parts(spark, folder)
    paths = [r["path"] for r in rejected.collect()]  # at most FEW_BROKEN
    parts = read_parts(spark, folder, schema)
    return (parts.filter(~F.col("_metadata.file_path").isin(paths)) if paths else parts), rejected


def transform_table(
    spark: SparkSession,
    source: str,
    sink: str,
    preprocess: Callable[[DataFrame], DataFrame],
    schema: T.StructType,
) -> None:
    """Read the columns asked for, apply a table function, replace the sink."""
    write_table(read_parts(spark, source, schema).transform(preprocess), sink)


def write_table(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    max_records_per_file: int = 0,
    codec: str = CODEC,
) -> None:
    writer = df.write.mode(mode).option("compression", codec)
    if mode == "overwrite" and partition_by:
        # Replace only the partitions that are written.
        writer = writer.option("partitionOverwriteMode", "dynamic")
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def compact(spark: SparkSession, source: str, sink: str, schema: T.StructType, target_bytes: int = 128 << 20) -> None:
    """Rewrite many small files as fewer, each about as large as asked for, without a shuffle.

    The size of the input comes from the plan's own statistics, so that no list of files is gathered.
    """
    df = read_parts(spark, source, schema)
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    write_table(df.coalesce(max(1, math.ceil(int(str(size)) / target_bytes))), sink)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Fields are written as they are, white space included; quotes are doubled, as ``csv_rows`` and others read them."""
    exact = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode(mode).option("header", True).options(**exact).csv(path)


def csv_rows(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Records of CSV files cut into cells: ``source_path, header, cells``, two arrays of text in the same order.

    Every file has a header of its own, its first record. Cells beyond the header are left out, cells that are missing are
    null; empty lines are no rows. Quoted cells may hold line breaks; files are read by splits all the same.
    """
    names = F.transform(cells(F.regexp_replace("header", "^\ufeff", "")), lambda n: F.trim(n))
    return csv_records(spark, path, glob).select("source_path", names.alias("header"), cells(F.col("record")).alias("cells"))


def pick_cells(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns of ``csv_rows`` as text, each found in the header of its own file, beside ``source_path``."""
    place = lambda name: F.array_position("header", name).cast("int")
    return rows.select(
        "source_path", *[F.when(place(n) > 0, F.get("cells", place(n) - 1)).alias(n) for n in names]
    )


def read_csv(spark: SparkSession, path: str, target: T.StructType) -> DataFrame:
    """CSV files under a declared schema. Columns are found by each file's own header, unreadable values are null."""
    return conform(pick_cells(csv_rows(spark, path), target.names), target)


def read_template(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.TEMPLATE)


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygon leaves, one row each: the file they come from, their place in its hierarchy, their coordinates."""
    return spark.read.schema(schemas.POLYGONS).parquet(path)


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


def only_stations(df: DataFrame, stations: Sequence[str], column: str = "station_id") -> DataFrame:
    return df.filter(F.col(column).isin(*stations))
