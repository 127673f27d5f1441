"""Text helpers for report files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import codes

_WHITESPACE = " \t\r\n"


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """Capture group of the first match, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def all_matches(text: Column, pattern: str, limit: int) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), 1, limit)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_WHITESPACE))


def split_blocks(df: DataFrame, text: str = "value", block: str = "block", block_no: str = "block_no") -> DataFrame:
    """One row per report block: the text is cut before every date stamp; ``block_no`` keeps the file order."""
    others = [c for c in df.columns if c != text]
    return (
        df.select(*others, F.posexplode(F.split(F.col(text), codes.BLOCK_START)).alias(block_no, block))
        .withColumn(block, strip(F.col(block)))
        .filter(F.length(block) > 0)
    )


def split_lines(df: DataFrame, block: str = "block", line: str = "line", line_no: str = "line_no") -> DataFrame:
    """One row per line of a block, in order; one null line where there is no block."""
    others = [c for c in df.columns if c != block]
    return df.select(*others, F.posexplode_outer(F.split(F.col(block), "\n")).alias(line_no, line))


def clean_forecast_block(block: Column) -> Column:
    """Trim each line, drop the report type word and the blank lines."""
    lines = F.transform(F.split(block, "\n"), lambda line: F.replace(strip(line), F.lit("TAF"), F.lit("")))
    return F.regexp_replace(F.array_join(lines, "\n"), "\n{2,}", "\n")


def with_kinds(df: DataFrame, block: str = "block", kind: str = "kind") -> DataFrame:
    """One row per kind of a block; one with both marker words is amended and corrected at once."""
    marked = df.withColumns(
        {
            "_amended": F.col(block).rlike(rf"(?i)\b{codes.AMENDMENT_WORD}\b"),
            "_corrected": F.col(block).rlike(rf"(?i)\b{codes.CORRECTION_WORD}\b"),
        }
    )
    original, amended, corrected = (F.array(F.lit(k)) for k in ("original", "amended", "corrected"))
    kinds = (
        F.when(F.col("_amended") & F.col("_corrected"), F.concat(amended, corrected))
        .when(F.col("_amended"), amended)
        .when(F.col("_corrected"), corrected)
        .otherwise(original)
    )
    return marked.select(*df.columns, F.explode(kinds).alias(kind))


def strip_markers(block: Column) -> Column:
    """Remove the marker words and codes, and the blanks they leave at line ends."""
    words = "|".join(
        [codes.AMENDMENT_WORD, codes.AMENDMENT_CODE, codes.CORRECTION_WORD, codes.CORRECTION_CODE]
    )
    return F.regexp_replace(F.regexp_replace(block, rf"(?i)\b({words})\b", ""), r"(?m)^[ \t\r]+|[ \t\r]+$", "")


def signed_number(text: Column) -> Column:
    """``M05`` is minus five, ``M00`` plain zero."""
    return F.nullif(F.replace(text, F.lit("M"), F.lit("-")), F.lit("")).try_cast("int").cast("double")
