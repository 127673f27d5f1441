"""Records of several lines out of text files that are read by splits.

A file is read by as many tasks as it has splits, so a record may begin in one split and end in a later one. Lines are
numbered within their split. What a split must know of those before it (how many records began, whether a quote is open)
is one summary row a split, summed up along the file. Records that lie in one split are put together where their lines
are; only the pieces at the edges of splits, two a split at most, are joined across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.functions.text import strip

_SPLIT = ["source_path", "split"]


def numbered_lines(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """``source_path, split, id, line``: every line below the folder; ids ascend within a split, the first is the least.

    Lines end at a line feed; a carriage return before it stays.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .option("lineSep", "\n")
        .text(folder)
        .select(
            F.col("_metadata.file_path").alias("source_path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("id"),
            F.col("value").alias("line"),
        )
    )


def whole_records(lines: DataFrame, order: list[str]) -> DataFrame:
    """``source_path, record_no, record``: lines (``begins`` says where a record starts) joined to records.

    Record 0 is what stands before the first beginning of a file and may be missing; the others count from 1.
    """
    at = W.partitionBy(*_SPLIT).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    local = lines.withColumn("_local", F.sum(F.col("begins").cast("int")).over(at).cast("long"))
    keep = [*order, "line"]
    # grouped where the window left them: same partitioning, no further shuffle
    joined = local.groupBy(*_SPLIT, "_local").agg(F.array_sort(F.collect_list(F.struct(*keep))).alias("_lines"))
    pieces = joined.select(*_SPLIT, "_local", F.array_join(F.transform("_lines", lambda x: x["line"]), "\n").alias("record"))
    began = lines.groupBy(*_SPLIT).agg(F.sum(F.col("begins").cast("int")).cast("long").alias("_n"))
    earlier = W.partitionBy("source_path").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    offsets = began.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    placed = pieces.join(offsets, _SPLIT).withColumn("record_no", F.col("_before") + F.col("_local"))
    inside = placed.filter("_local > 0 AND _local < _n").select("source_path", "record_no", "record")
    edges = placed.filter("_local = 0 OR _local = _n").groupBy("source_path", "record_no")
    across = edges.agg(F.array_sort(F.collect_list(F.struct("split", "record"))).alias("_parts"))
    across = across.select("source_path", "record_no", F.array_join(F.transform("_parts", lambda x: x["record"]), "\n").alias("record"))
    return inside.unionByName(across)


# Report blocks


def read_blocks(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """``source_file, block_no, block``: the report blocks of a folder's files, which are read by splits.

    The same rows as reading each file whole and cutting it before every date stamp, for files of any size.
    """
    lines = numbered_lines(spark, folder, glob)
    # a line can hold several stamps; its parts are lines of their own, of which all but the first begin a block
    parts = lines.select(*_SPLIT, "id", F.posexplode(F.split("line", codes.BLOCK_START)).alias("part", "line"))
    parts = parts.withColumn("begins", F.col("line").rlike(f"^{codes.BLOCK_DATE}"))
    first = F.min(F.struct("id", "part", "begins"))["begins"]
    heads = parts.filter("split = 0").groupBy("source_path").agg(first.alias("_stamped"))
    blocks = whole_records(parts, ["id", "part"]).join(heads, "source_path")
    number = (F.col("record_no") - F.col("_stamped").cast("int")).cast("int")
    return (
        blocks.select(F.col("source_path").alias("source_file"), number.alias("block_no"), strip(F.col("record")).alias("block"))
        .filter(F.length("block") > 0)
    )


# CSV records

_QUOTED = r'"(?:[^"]++|"")*+"[^,]*+'
_FIELD = rf'(?:{_QUOTED}|(?!")[^,]*+)'
#: A line that starts outside quotes, or inside, and leaves none open.
CLOSED = rf"^{_FIELD}(?:,{_FIELD})*+$"
CLOSED_INSIDE = rf'^(?:[^"]++|"")*+"[^,]*+(?:,{_FIELD})*+$'
_CELL = rf"(?s),({_QUOTED}|[^,]*+)"


def _carried(df: DataFrame, keys: list[str], order: str, state: str) -> DataFrame:
    """``state`` before each row, given what each row does to it: ``closed`` and ``inside_closed`` say whether the row leaves
    no quote open when none was open before it, and when one was. ``_constant``, if any, is the state after the last row
    that ends the same way in either case; ``_flips`` counts the rows since then that turn the state over."""
    constant = F.when(F.col("closed") == F.col("inside_closed"), ~F.col("closed"))
    flips = (~F.col("closed") & F.col("inside_closed")).cast("int")
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    counted = df.withColumns({"_c": constant, "_f": F.coalesce(F.sum(flips).over(before), F.lit(0)), "_own": flips})
    last = F.last(F.when(F.col("_c").isNotNull(), F.struct("_c", "_f")), ignorenulls=True).over(before)
    marked = counted.withColumn("_last", last)
    since = F.col("_f") - F.coalesce("_last._f", F.lit(0))
    return marked.withColumns({f"{state}_constant": F.col("_last._c"), f"{state}_flipped": since % 2 == 1}).drop("_last", "_f")


def csv_records(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``source_path, header, record``: the records of CSV files, each with the first record of its file, the header.

    A quoted field may hold commas, doubled quotes and line breaks; a quote within an unquoted field is text. Empty lines are
    no records. One pass finds each file's header and whether a quote is ever left open at the end of a line. Files
    where none is (the usual case) have a record a line and are not moved; the lines of the others are put together.
    """
    lines = numbered_lines(spark, folder, glob).withColumn("line", F.regexp_replace("line", "\r$", ""))
    lines = lines.withColumn("closed", F.col("line").rlike(CLOSED))
    head = F.min(F.when((F.col("split") == 0) & (F.col("line") != ""), F.struct("id", "line")))
    files = lines.groupBy("source_path").agg(head.alias("_head"), F.min("closed").alias("_plain"))
    with_file = lines.join(files, "source_path")
    plain = with_file.filter("_plain AND line <> '' AND NOT (split = 0 AND id = _head.id)")
    plain = plain.select("source_path", F.col("_head.line").alias("header"), F.col("line").alias("record"))

    broken = with_file.filter("NOT _plain").select(*_SPLIT, "id", "line", "closed")
    states = broken.withColumn("inside_closed", F.col("line").rlike(CLOSED_INSIDE))
    states = _carried(states, _SPLIT, "id", "line")
    # what a whole split does to the state, from its last line
    last = F.max(F.struct("id", "_c", "_own", "line_constant", "line_flipped")).alias("z")
    ends = states.groupBy(*_SPLIT).agg(last)
    own = F.col("z._own") == 1
    fixed = F.coalesce("z._c", F.when(F.col("z.line_constant").isNotNull(), F.col("z.line_constant") != (F.col("z.line_flipped") != own)))
    turned = F.col("z.line_flipped") != own
    ends = ends.select(*_SPLIT, F.coalesce(~fixed, ~turned).alias("closed"), F.coalesce(~fixed, turned).alias("inside_closed"))
    starts = _carried(ends, ["source_path"], "split", "split")
    starts = starts.select(*_SPLIT, _state("split", F.lit(False)).alias("_open"))
    begun = states.join(starts, _SPLIT).withColumn("begins", ~_state("line", F.col("_open")))
    records = whole_records(begun.select(*_SPLIT, "id", "line", "begins"), ["id"]).filter("record <> ''")
    first = records.groupBy("source_path").agg(F.min(F.struct("record_no", "record")).alias("_head"))
    records = records.join(first, "source_path").filter("record_no > _head.record_no")
    return plain.unionByName(records.select("source_path", F.col("_head.record").alias("header"), "record"))


def _state(name: str, start: Column) -> Column:
    return F.coalesce(f"{name}_constant", start) != F.col(f"{name}_flipped")


def cells(record: Column) -> Column:
    """The fields of a record. An empty field is null, an empty one in quotes is empty text."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1))

    def plain(field: Column) -> Column:
        inner = F.regexp_extract(field, r'(?s)^"((?:[^"]++|"")*+)"(.*)$', 1)
        rest = F.regexp_extract(field, r'(?s)^"((?:[^"]++|"")*+)"(.*)$', 2)
        unquoted = F.concat(F.replace(inner, F.lit('""'), F.lit('"')), rest)
        return F.when(field.startswith('"'), unquoted).otherwise(F.nullif(field, F.lit("")))

    return F.transform(fields, plain)
