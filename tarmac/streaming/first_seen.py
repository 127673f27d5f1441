"""First-seen arrival counts while flights keep arriving: as stored state of batch runs, and as an event-time stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tarmac import schemas
from tarmac.functions.timebucket import DAY_US, bucket_end, epoch_us, from_us
from tarmac.operators.dedup import packed_first, packed_first_value, unpacked_first
from tarmac.operators.joins import FEW_ROWS, unprocessed
from tarmac.session import path_exists, settings
from tarmac.sources.tables import write_table

# Batch runs


MINIMA = schemas.schema("gufi:string first:long run:int")
COUNTS = schemas.schema("station_ord:int bucket_end:ts n:long run:int day:int")
SOURCES = schemas.schema("source:string run:int")
MOVED = schemas.schema("gufi:string first:long was:long run:int")
DELTAS = schemas.schema("station_ord:int bucket_end:ts n:long day:int run:int")


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)


def update_first_seen(arrivals: DataFrame, state: str, run: int, source: str | None = None) -> None:
    """Take the arrivals of one run (``gufi, station_ord, arrival_ts``) into the state below ``state``.

    ``source`` names a column with the file each row comes from; files that an earlier run took are passed over.

    The state holds, by run, each flight's packed first arrival where the run made it earlier (the minimum over runs is
    the flight's first arrival), and the counts of each touched day. A flight that is new adds one to its bucket; one that
    moves to an earlier station or time also takes one from its old bucket. Only days that hold such a bucket are read and
    written again. Runs are numbered upwards; one that was lost half-way is repeated under its number, which replaces
    whatever it had written, since it reads older runs only.
    """
    spark = arrivals.sparkSession
    minima, counts, sources = (f"{state}/{name}" for name in ("minima", "counts", "sources"))
    if source:
        done = _read(spark, sources, SOURCES).filter(F.col("run") < run)
        arrivals = unprocessed(arrivals, done.withColumnRenamed("source", source), source)
        _replace(arrivals.select(F.col(source).alias("source")).distinct(), sources, run)
    new = packed_first(arrivals)
    old = _read(spark, minima, MINIMA).filter(F.col("run") < run)
    old = old.join(new.select("gufi"), "gufi", "left_semi").groupBy("gufi").agg(F.min("first").alias("was"))
    moved = new.join(old, "gufi", "left").filter("was IS NULL OR first < was")
    _replace(moved.select("gufi", "first", "was"), f"{state}/moved", run)
    moved = _read(spark, f"{state}/moved", MOVED).filter(F.col("run") == run)

    steps = F.array(F.struct(F.col("first").alias("at"), F.lit(1).alias("n")), F.struct(F.col("was").alias("at"), F.lit(-1).alias("n")))
    steps = moved.select(F.explode(steps).alias("s")).filter("s.at IS NOT NULL").select(*unpacked_first(F.col("s.at")), F.col("s.n").alias("n"))
    deltas = steps.groupBy("station_ord", bucket_end("arrival_ts").alias("bucket_end")).agg(F.sum("n").alias("n"))
    deltas = deltas.withColumn("day", F.floor(epoch_us("bucket_end") / DAY_US).cast("int"))
    _replace(deltas, f"{state}/deltas", run)
    deltas = _read(spark, f"{state}/deltas", DELTAS).filter(F.col("run") == run)
    before = touched_counts(_read(spark, counts, COUNTS).filter(F.col("run") < run), deltas)
    after = before.select("station_ord", "bucket_end", "n", "day").unionByName(deltas.select("station_ord", "bucket_end", "n", "day"))
    _replace(after.groupBy("station_ord", "bucket_end", "day").agg(F.sum("n").alias("n")), counts, run, "day")
    # last, so that a run without minima has done nothing that counts
    _replace(moved.select("gufi", "first"), minima, run)


def touched_counts(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """The newest counts of the days that have a delta; other days are not read."""
    days = [r["day"] for r in deltas.select("day").distinct().limit(FEW_ROWS + 1).collect()]
    if len(days) <= FEW_ROWS:
        return newest_counts(counts.filter(F.col("day").isin(days)))
    return newest_counts(counts.join(deltas.select("day").distinct(), "day", "left_semi"))


def newest_counts(counts: DataFrame) -> DataFrame:
    """Of each day the rows of the last run that wrote it."""
    newest = counts.groupBy("day").agg(F.max("run").alias("run"))
    return counts.join(newest, ["day", "run"])


def first_seen_counts(spark: SparkSession, state: str) -> DataFrame:
    """``station_ord, bucket_end, n`` as of the last run that ended; buckets that lost all their flights are gone."""
    done = _read(spark, f"{state}/minima", MINIMA).agg(F.max("run")).first()[0]
    counts = _read(spark, f"{state}/counts", COUNTS).filter(F.col("run") <= F.lit(done))
    return newest_counts(counts).filter("n > 0").select("station_ord", "bucket_end", "n")


def _replace(df: DataFrame, path: str, run: int, *more: str) -> None:
    write_table(df.withColumn("run", F.lit(run)), path, partition_by=["run", *more])


# Stream


#: Station place of the rows that close a stream; those of stations begin at 1.
_CLOSING = 0
ARRIVALS = schemas.schema("gufi:string station_ord:int arrival_ts:ts")
STATE_CONF = {
    # rows of a flight are merged before the shuffle, so a flight with a third of all rows is no burden
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def sort_out_late(spark: SparkSession, source: str, state: str, delay_us: int, files_per_batch: int = 1000) -> None:
    """Stream new arrival files into a table of punctual and late rows, ``sorted`` below ``state``.

    A row is late if it is older by more than the delay than the newest arrival of the batches before its own. Each batch
    writes both tables and its newest arrival under its own number, so a batch that is repeated replaces itself.
    """
    heights = "batch int, newest long"

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = _read(session, f"{state}/newest", heights).filter(F.col("batch") < number)
        newest = known.agg(F.max("newest")).first()[0]
        us = epoch_us("arrival_ts")
        is_late = F.lit(False) if newest is None else F.coalesce(us < newest - delay_us, F.lit(False))
        rows = batch.select("gufi", "station_ord", "arrival_ts", is_late.alias("is_late"), F.lit(number).alias("batch"))
        write_table(rows, f"{state}/sorted", partition_by=["batch", "is_late"])
        written = session.read.schema("arrival_ts timestamp_ntz, batch int, is_late boolean").parquet(f"{state}/sorted")
        height = written.filter(F.col("batch") == number).agg(F.max(us).alias("newest")).withColumn("batch", F.lit(number))
        write_table(height.filter("newest IS NOT NULL"), f"{state}/newest", partition_by=["batch"])

    stream = spark.readStream.schema(ARRIVALS).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{state}/checkpoint-sort").trigger(availableNow=True).start()
    query.awaitTermination()


def late_arrivals(spark: SparkSession, state: str) -> DataFrame:
    rows = _read(spark, f"{state}/sorted", "gufi string, station_ord int, arrival_ts timestamp_ntz, batch int, is_late boolean")
    return rows.filter("is_late").drop("is_late")


def count_stream(spark: SparkSession, state: str, delay_us: int, gap_us: int) -> StreamingQuery:
    """Count the flights of the punctual rows that are complete, up to what has arrived; ends by itself.

    A flight is complete once the watermark has passed its last row by ``gap_us``; a row after that is a new flight. A
    flight's state is one packed minimum, taken over a session window; complete flights are counted by station and bucket
    in a second stateful step. Counts are appended, and add up: see ``streamed_counts``.
    """
    rows = (
        spark.readStream.schema("gufi string, station_ord int, arrival_ts timestamp_ntz, batch int, is_late boolean")
        .parquet(f"{state}/sorted")
        .filter(f"NOT is_late AND arrival_ts IS NOT NULL AND (station_ord = {_CLOSING} OR station_ord IS NOT NULL AND gufi IS NOT NULL)")
        .withColumn("at", F.col("arrival_ts").cast("timestamp"))
        .withWatermark("at", f"{delay_us} microseconds")
    )
    flights = rows.groupBy(F.session_window("at", f"{gap_us} microseconds").alias("seen"), "gufi").agg(F.min(packed_first_value()).alias("first"))
    complete = flights.select(F.window_time("seen").alias("done_at"), *unpacked_first(F.col("first")))
    # a condition on the minimum, which stays above the watermark
    complete = complete.filter(F.col("station_ord") != _CLOSING)
    counts = complete.groupBy(
        F.window("done_at", "15 minutes").alias("done"), "station_ord", bucket_end("arrival_ts").alias("bucket_end")
    ).agg(F.count("*").alias("n"))
    with settings(spark, STATE_CONF):
        query = (
            counts.select("station_ord", "bucket_end", "n", F.col("done.end").alias("done_until"))
            .writeStream.format("parquet")
            .outputMode("append")
            .option("checkpointLocation", f"{state}/checkpoint-count")
            .option("path", f"{state}/streamed")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return query


def close_stream(spark: SparkSession, state: str, delay_us: int, gap_us: int) -> None:
    """End of the season: a row of no flight, far enough in the future, completes every flight."""
    newest = _read(spark, f"{state}/newest", "batch int, newest long").agg(F.max("newest")).first()[0]
    if newest is None:
        return
    row = spark.range(1).select(
        F.lit("").alias("gufi"), F.lit(_CLOSING).alias("station_ord"), from_us(F.lit(newest + delay_us + gap_us + DAY_US)).alias("arrival_ts"),
        F.lit(-1).alias("batch"), F.lit(False).alias("is_late"),
    )
    write_table(row, f"{state}/sorted", partition_by=["batch", "is_late"])
    count_stream(spark, state, delay_us, gap_us)


def streamed_counts(spark: SparkSession, state: str) -> DataFrame:
    """``station_ord, bucket_end, n`` of the flights that were complete when the stream last ended."""
    parts = _read(spark, f"{state}/streamed", "station_ord int, bucket_end timestamp_ntz, n long, done_until timestamp")
    return parts.groupBy("station_ord", "bucket_end").agg(F.sum("n").alias("n"))
