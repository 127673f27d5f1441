"""Mixing sources to target weights by Poisson replication; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.llm.common import cut, documents, partitions

SEED = 20

#: A table of rates with no more numbers than this is broadcast (8 MB); a larger one, by its sources or by the lengths of
#: their distribution functions, is joined by shuffling.
FEW_NUMBERS = 1_000_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) that depends on the parts alone: the first 52 bits of their MD5."""
    digest = F.md5(F.concat_ws(":", *parts).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def poisson_cdf(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... as an array, as far as a double tells it from 1.

    Terms are carried as logarithms, so that no rate makes them vanish.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("logp"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("cdf"))

    def step(state: Column, k: Column) -> Column:
        logp = state["logp"] + F.ln(rate) - F.ln(k.cast("double"))
        total = state["total"] + F.exp(logp)
        return F.struct(logp.alias("logp"), total.alias("total"), F.concat(state["cdf"], F.array(total)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step)["cdf"])


def source_rates(docs: DataFrame, weights: DataFrame | None = None, expected: float = 1.0) -> DataFrame:
    """(source, rate, cdf): how often a document of each source is to be repeated on average.

    The wanted share of a source is its weight over the sum of the weights of the sources that occur. ``weights`` is a
    table (source, weight); a source it lacks, or gives a null or negative weight, gets none of the mix. Without
    ``weights`` the weight is the square root of the number of documents, which draws large and small sources together.
    A null source is a source of its own.
    """
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighted = counts.withColumn("weight", F.sqrt(F.col("n").cast("double")))
    else:
        given = weights.groupBy(F.col("source").alias("_source")).agg(F.max(F.col("weight").cast("double")).alias("weight"))
        weighted = counts.join(given, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        weighted = weighted.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    weighted = cut(weighted, "source-weights")
    total = weighted.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).first()
    share = F.col("weight") / F.lit(total.weight or 1.0)
    rate = F.lit(expected) * F.lit(float(total.n or 0)) * share / F.col("n").cast("double")
    return weighted.select("source", rate.alias("rate")).withColumn("cdf", poisson_cdf(F.col("rate")))


def mix(docs: DataFrame, weights: DataFrame | None = None, expected: float = 1.0, seed: int = SEED) -> DataFrame:
    """Repeat every document a Poisson number of times, so that sources reach their target weights, and shuffle all.

    The number of copies is the inverse of the Poisson distribution function at a number that depends on seed and doc_id
    alone: the same on every run and every cluster. The result has the columns of documents, ``copy_no`` (1, 2, ...) and
    ``shuffle_key``, by which partitions are dealt and sorted; it is ``expected`` times as long as the input on average.

    Null doc_id: the text takes its place. Null or empty text: as any other. Repeated rows: each is repeated on its own,
    with equal counts. Empty table: empty result. Other columns are left out.
    """
    docs = documents(docs)
    rates = cut(source_rates(docs, weights, expected), "source-rates").withColumnRenamed("source", "_source")
    numbers = rates.agg(F.sum(F.lit(2) + F.coalesce(F.size("cdf"), F.lit(0)))).first()[0] or 0
    if numbers <= FEW_NUMBERS:
        rates = F.broadcast(rates)
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    draw = uniform(F.lit(f"{seed}"), name)
    copies = F.size(F.filter("cdf", lambda c: c <= F.col("_draw")))
    drawn = (
        docs.withColumns({"_name": name, "_draw": draw})
        .join(rates, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_copies", F.when(F.col("cdf").isNull(), 0).otherwise(copies))
        .filter("_copies > 0")
    )
    repeated = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.col("_name"), F.col("copy_no").cast("string")).cast("binary"))
    return (
        repeated.select(*docs.columns, "copy_no", key.alias("shuffle_key"))
        .repartition(partitions(docs.sparkSession), "shuffle_key")
        .sortWithinPartitions("shuffle_key")
    )


MIX_SQL = f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n) FROM counts)::DOUBLE * (sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM counts)) / n::DOUBLE AS rate
  FROM counts
),
cdf AS (
  SELECT source, rate, 0 AS k, -rate AS logp, exp(-rate) AS total FROM rates
  UNION ALL
  SELECT source, rate, k + 1, logp + ln(rate) - ln((k + 1)::DOUBLE), total + exp(logp + ln(rate) - ln((k + 1)::DOUBLE))
  FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)
),
draws AS (
  SELECT *, (CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM documents
),
drawn AS (
  SELECT d.*, (SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.total <= d.u) AS copies FROM draws d
)
SELECT doc_id, text, lang, source, n_chars, copy_no::INTEGER AS copy_no, md5('{SEED}:order:' || doc_id || ':' || copy_no) AS shuffle_key
FROM (SELECT *, unnest(generate_series(1, copies)) AS copy_no FROM drawn)
"""
