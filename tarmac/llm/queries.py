"""One query for each operator, over its whole table, with production parameters; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarmac.llm import credentials, digest, lexical, lines, mixing, neardup, packing, pieces, quality, repeats, runs, tokens, toxicity
from tarmac.llm.common import read, settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(settle(spark), folder)

    QUERIES[function.__name__] = run
    return function


@query
def op1_line_dedup(spark, folder):
    return lines.dedup_lines(read(spark, folder, "documents"))


ORACLES["op1_line_dedup"] = lines.LINES_SQL


@query
def op2_secret_scan(spark, folder):
    return credentials.secrets(read(spark, folder, "documents"))


@query
def op3_suffix_array_dedup(spark, folder):
    return repeats.remove_repeats(read(spark, folder, "documents")).drop("kept")


@query
def op4_document_fingerprints(spark, folder):
    return digest.fingerprints(read(spark, folder, "documents"))


@query
def op5_quality_rules(spark, folder):
    return quality.quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op6_source_mixing(spark, folder):
    return mixing.mix(read(spark, folder, "documents"))


ORACLES["op6_source_mixing"] = mixing.MIX_SQL


@query
def op7_minhash_near_dedup(spark, folder):
    return neardup.near_duplicates(read(spark, folder, "documents"))


ORACLES["op7_minhash_near_dedup"] = neardup.NEAR_SQL


@query
def op8_toxicity(spark, folder):
    return toxicity.toxicity(read(spark, folder, "documents"), read(spark, folder, "labels"))


@query
def op9_token_counts(spark, folder):
    return tokens.token_counts(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_sentencepiece(spark, folder):
    return pieces.encode(read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op11_lexical_search(spark, folder):
    return lexical.search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


ORACLES["op11_lexical_search"] = lexical.SEARCH_SQL


@query
def op12_periodic_runs(spark, folder):
    return runs.periodic_runs(read(spark, folder, "documents"), rewrite=True)


@query
def op13_packing(spark, folder):
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
