"""What the operators share: reading, picking columns, cutting lineage, batches of rows."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.session import configure, scratch

DOCUMENT_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}

#: Rows and bytes of text that Python tasks work on at once; a longer text is a batch of its own.
BATCH = 512
BATCH_BYTES = 1 << 20


#: Rows that Spark hands to a Python task at once; with texts of a few thousand characters some megabytes.
ARROW_ROWS = 2000
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def settle(spark: SparkSession) -> SparkSession:
    """The settings that the queries of this part rely on."""
    configure(spark)
    spark.conf.set(_ARROW_ROWS, str(ARROW_ROWS))
    return spark


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand so many rows to a Python task at once."""
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns only. Columns are found by place, so other columns may have any name, even the same in other
    letters; a column that is missing is null."""
    places = {}
    for place, name in enumerate(df.columns):
        places.setdefault(name, place)
    plain = df.toDF(*[f"_{place}" for place in range(len(df.columns))])
    return plain.select(
        *[
            (F.col(f"_{places[name]}") if name in places else F.lit(None)).cast(DOCUMENT_COLUMNS.get(name, "bigint")).alias(name)
            for name in names
        ]
    )


def documents(df: DataFrame) -> DataFrame:
    return pick(df, *DOCUMENT_COLUMNS)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back, so that lost executors cost a re-read only."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_rows(df: DataFrame, function: Callable[[dict[str, list]], dict[str, list]], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Apply ``function`` to batches of rows: lists by column in, lists by column out, as ``schema`` names them.

    ``keep`` are columns that pass unchanged, in front; the function then returns as many rows as it gets.
    """
    kept = df.select(*keep).schema.simpleString()[len("struct<") : -1] if keep else ""
    full = ", ".join(x for x in (kept.replace(":", " "), schema) if x)
    target = _arrow_schema(df.sparkSession, full)
    given = [c for c in df.columns if c not in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                made = function({c: part.column(c).to_pylist() for c in given})
                columns = [part.column(f.name).cast(f.type) if f.name in keep else _array(made[f.name], f.type) for f in target]
                yield pa.RecordBatch.from_arrays(columns, schema=target)
        give_back()

    return df.mapInArrow(run, full)


#: What a module holds for one task only: called at the end of each.
FORGET: list[Callable[[], None]] = []


def give_back() -> None:
    """Hand freed memory back to the system at the end of a task, since a Python worker lives on for other tasks."""
    for forget in FORGET:
        forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library keeps its own counsel
        pass


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of few rows and few megabytes."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if row > start and (row - start >= BATCH or held + size > BATCH_BYTES):
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    if start < batch.num_rows:
        yield batch.slice(start)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int, low_bits: int = 0) -> Iterator[pa.Table]:
    """Rows that come sorted by ``key`` as tables of about so many rows, none of which splits a group: equal keys, or keys
    that are equal but for so many bits at the end."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy() >> low_bits
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield table.slice(0, end).combine_chunks()
            held = table.slice(end).combine_chunks().to_batches()
            count = table.num_rows - end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


#: A list of ids with no more rows than this is broadcast (8 MB); a longer one is joined by shuffling.
FEW_IDS = 1_000_000


def with_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on doc_id with a written table of ids, without moving the rows where the ids are few."""
    few = ids.count() <= FEW_IDS
    return df.join(F.broadcast(ids) if few else ids, "doc_id", how)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the ends of edges (a, b): the smallest node that can be reached.

    Every node takes the smallest of itself and its neighbours, edges are drawn anew between what the nodes took, until
    none is left: logarithmically many rounds. Minima are partial sums before the shuffle, so a node with many
    neighbours is no burden; every round is written, so that lost executors cost a re-read.
    """
    spark = edges.sparkSession
    links = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    nodes = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        taken = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")), "taken")
        if nodes is None:
            nodes = taken
        else:
            later = taken.select(F.col("node").alias("component"), F.col("component").alias("_next"))
            nodes = cut(nodes.join(later, "component", "left").select("node", F.coalesce("_next", "component").alias("component")), "nodes")
        left = taken.select(F.col("node").alias("a"), F.col("component").alias("_a"))
        right = taken.select(F.col("node").alias("b"), F.col("component").alias("_b"))
        moved = links.join(left, "a").join(right, "b").filter("_a <> _b")
        links = cut(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
    return nodes if nodes is not None else spark.createDataFrame([], "node bigint, component bigint")
