"""Queries that write files to the shared folder and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac import schemas
from tarmac.functions.timebucket import lenient_timestamp
from tarmac.operators.counts import throughput
from tarmac.plans.registry import query
from tarmac.plans.reports import _FORECAST_LINES, _KINDS_SQL, _OBSERVATION_LINES, STATIONS, forecast_texts, observation_texts
from tarmac.session import scratch, settings
from tarmac.sources import flights, reports
from tarmac.sources.records import read_blocks
from tarmac.sources.tables import (
    compact,
    read_csv,
    read_parts,
    read_sound_parts,
    read_template,
    table,
    transform_table,
    write_csv,
    write_table,
)
from tarmac.streaming.ingest import append_new, stream_new_files


@query(
    "directory_merge_schema",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, CASE WHEN l_returnflag <> 'A' THEN l_tax END AS l_tax FROM lineitem""",
)
def directory_merge_schema(spark, folder):
    """Part files with different columns, read as one table."""
    path = scratch(spark, "parts")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_tax")
    write_table(lines.filter("l_returnflag = 'A'").drop("l_tax"), f"{path}/narrow")
    write_table(lines.filter("l_returnflag <> 'A'"), f"{path}/wide")
    return read_parts(spark, path, lines.schema)


@query("compacted_rewrite", "SELECT *, 20 AS files_before, 1 AS files_after FROM orders")
def compacted_rewrite(spark, folder):
    """Many small files to few, same rows, with the numbers of files."""
    path = scratch(spark, "compact")
    orders = table(spark, folder, "orders")
    write_table(orders.repartition(20), f"{path}/small")
    compact(spark, f"{path}/small", f"{path}/large", orders.schema)
    files = [
        spark.read.schema(orders.schema).parquet(f"{path}/{name}").agg(F.count_distinct("_metadata.file_path").cast("int").alias(alias))
        for name, alias in (("small", "files_before"), ("large", "files_after"))
    ]
    before, after = (df.first()[0] for df in files)
    large = spark.read.schema(orders.schema).parquet(f"{path}/large")
    return large.withColumns({"files_before": F.lit(before), "files_after": F.lit(after)})


@query(
    "partitioned_by_kind",
    "SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'O' THEN 'original' WHEN 'P' THEN 'amended' ELSE 'corrected' END AS kind FROM orders",
)
def partitioned_by_kind(spark, folder):
    """One table with a directory per kind instead of three files."""
    path = scratch(spark, "kinds")
    kind = F.when(F.col("o_orderstatus") == "O", "original").when(F.col("o_orderstatus") == "P", "amended").otherwise("corrected")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", kind.alias("kind"))
    write_table(rows, path, partition_by=["kind"])
    return spark.read.schema(rows.schema).parquet(path)


@query(
    "replaced_partition",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders",
)
def replaced_partition(spark, folder):
    """A rerun replaces the partitions it writes and leaves the others."""
    path = scratch(spark, "replace")
    rows = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    write_table(rows, path, partition_by=["o_orderstatus"])
    again = rows.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 2)
    write_table(again, path, partition_by=["o_orderstatus"])
    return spark.read.schema(rows.schema).parquet(path)


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip(spark, folder):
    path = scratch(spark, "csv")
    customers = table(spark, folder, "customer")
    write_csv(customers, path)
    return read_csv(spark, path, schemas.TABLES["customer"])


@query(
    "transformed_copy",
    """SELECT event_type AS station, time_bucket(INTERVAL 15 MINUTES, ts) AS time_bucket, count(*) AS throughput
    FROM events GROUP BY ALL""",
)
def transformed_copy(spark, folder):
    """Read some columns, apply a table function, write, read."""
    path = scratch(spark, "copy")

    def preprocess(df):
        return throughput(df.withColumnRenamed("event_type", "station"))

    transform_table(spark, f"{folder}/events.parquet", path, preprocess, schemas.schema("event_type:string ts:ts"))
    return spark.read.parquet(path)


@query("incremental_ingest", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS source_file, value FROM events")
def incremental_ingest(spark, folder):
    """Three runs over growing input; a source that is done is not taken again."""
    path = scratch(spark, "ingest")
    rows = table(spark, folder, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("source_file"), "value")
    for done in (F.col("source_file") <= "2024-01-09", F.col("source_file") <= "2024-01-20", F.lit(True)):
        append_new(rows.filter(done), path)
    return spark.read.schema(rows.schema).parquet(path)


@query("stream_ingest", "SELECT * FROM orders")
def stream_ingest(spark, folder):
    """The same with a file stream: its checkpoint knows which files are done."""
    path = scratch(spark, "stream")
    orders = table(spark, folder, "orders")
    for status in ("O", "P", "F"):
        write_table(orders.filter(F.col("o_orderstatus") == status), f"{path}/in", mode="append")
        stream_new_files(spark, f"{path}/in", f"{path}/out", orders.schema, f"{path}/checkpoint")
    return spark.read.schema(orders.schema).parquet(f"{path}/out")


@query(
    "whole_text_scan",
    f"""WITH {_OBSERVATION_LINES} SELECT substr(line, 1, 4) AS station_id, datetime,
    try_cast(nullif(regexp_extract(line, '(\\d{{3}})(\\d{{2}})(?:G(\\d{{2}}))?KT', 2), '') AS DOUBLE) AS wind_speed, line[-5:] AS pressure,
    count(*) AS events, sum(split_part(source_file, '/', 1)::BIGINT)::BIGINT AS event_ids
    FROM lines WHERE substr(line, 1, 4) IN ({', '.join(repr(n) for n in STATIONS)}) GROUP BY ALL""",
)
def whole_text_scan(spark, folder):
    """Report files of a folder, each read whole, cut into blocks and parsed; the event's number ends each line, so that
    lost or doubled rows would show."""
    path = scratch(spark, "texts")
    event = F.split("source_file", "/")[0]
    texts = observation_texts(spark, folder).select(F.regexp_replace("value", "(?m)(Z .*)$", F.concat(F.lit("$1 RMK "), event)).alias("value"))
    texts.write.option("maxRecordsPerFile", 500).text(path)
    blocks = reports.observation_blocks(reports.read_texts(spark, path))
    parsed = reports.parse_observations(reports.read_texts(spark, path), STATIONS)
    said = F.split("line", " RMK ")
    ends = blocks.select("source_file", "block_no", F.right(said[0], F.lit(5)).alias("pressure"), F.get(said, F.lit(1)).cast("bigint").alias("event"))
    return (
        parsed.join(ends, ["source_file", "block_no"])
        .groupBy("station_id", "datetime", F.col("wind_speed").cast("double").alias("wind_speed"), "pressure")
        .agg(F.count("*").alias("events"), F.sum("event").alias("event_ids"))
    )


#: Splits of report files in the queries: far smaller than on a cluster, so that a file has several.
_SPLITS = {"spark.sql.files.maxPartitionBytes": "200k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.files.minPartitionNum": "64"}


@query(
    "split_report_scan",
    f"""WITH {_OBSERVATION_LINES}, kept AS (SELECT *, split_part(source_file, '/', 1)::BIGINT AS event FROM lines)
    SELECT event, substr(line, 1, 4) AS station_id, datetime,
    try_cast(nullif(regexp_extract(line, '(\\d{{3}})(\\d{{2}})(?:G(\\d{{2}}))?KT', 2), '') AS DOUBLE) AS wind_speed,
    (SELECT count(*) FROM events) * 2 AS blocks, true AS numbered
    FROM kept WHERE substr(line, 1, 4) IN ({', '.join(repr(n) for n in STATIONS)})""",
)
def split_report_scan(spark, folder):
    """All reports in one file of many splits, read by blocks: each event's number comes back, and the blocks are numbered
    without gaps."""
    path = scratch(spark, "texts")
    event = F.split("source_file", "/")[0]
    texts = observation_texts(spark, folder).select(F.regexp_replace("value", "(?m)(Z .*)$", F.concat(F.lit("$1 RMK "), event)).alias("value"))
    texts.coalesce(1).write.text(path)
    with settings(spark, _SPLITS):
        write_table(read_blocks(spark, path), f"{path}-blocks")
    blocks = spark.read.schema("source_file string, block_no int, block string").parquet(f"{path}-blocks")
    size, last, files = blocks.agg(F.count("*"), F.max("block_no"), F.count_distinct("source_file", "block_no")).first()
    said = F.get(F.split("line", " RMK "), F.lit(1)).cast("bigint")
    ends = reports.observation_blocks(blocks).select("source_file", "block_no", said.alias("event"))
    parsed = reports.parse_observations(blocks, STATIONS).join(ends, ["source_file", "block_no"])
    return parsed.select(
        "event", "station_id", "datetime", F.col("wind_speed").cast("double").alias("wind_speed"),
        F.lit(size).cast("bigint").alias("blocks"), F.lit(last + 1 == size == files).alias("numbered"),
    )


@query(
    "forecast_file_scan",
    f"""WITH {_FORECAST_LINES}, k AS (SELECT *, unnest({_KINDS_SQL}) AS kind FROM roles)
    SELECT kind, upper(substr(event_type, 1, 4)) AS station_id, base AS datetime, base + INTERVAL 24 HOURS AS validity_end, from_time, tempo_start,
      tempo_end, becmg_start, becmg_end, visibility, altimeter_tenths_hpa, temperature, wind_direction, wind_speed, cover_type_1, altitude_1, count(*) AS lines
    FROM k GROUP BY ALL""",
)
def forecast_file_scan(spark, folder):
    """Forecast files, one folder for each hour of issue and many reports to a file, read by splits and parsed."""
    path = scratch(spark, "forecasts")
    name = F.regexp_extract("source_file", r"taf\.(\d{8}\.\d{2}Z)", 1)
    forecast_texts(spark, folder).select("value", name.alias("issued")).repartition("issued").write.partitionBy("issued").text(path)
    issue = reports.issue_time_of_file(F.concat(F.lit("taf."), F.regexp_extract("source_file", "issued=([^/]+)/", 1), F.lit(".txt")))
    parsed = reports.parse_forecasts(read_blocks(spark, path), issue)
    keys = ["kind", "station_id", "datetime", "validity_end", "from_time", "tempo_start", "tempo_end", "becmg_start", "becmg_end"]
    values = ["visibility", "altimeter_tenths_hpa", "temperature", "wind_direction", "wind_speed", "cover_type_1", "altitude_1"]
    return parsed.groupBy(*keys, *values).agg(F.count("*").alias("lines"))


@query(
    "quoted_csv_records",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderpriority || CASE o_orderkey % 5 WHEN 0 THEN chr(10) || 'o_orderkey,note' || chr(10)
      WHEN 1 THEN ' "quoted, twice"' WHEN 2 THEN chr(10) || '"' ELSE '' END END AS note FROM orders""",
)
def quoted_csv_records(spark, folder):
    """Fields with line breaks, quotes and a line that equals the header, in files of several splits."""
    path = scratch(spark, "quoted")
    odd = F.col("o_orderkey") % 5
    more = F.when(odd == 0, "\no_orderkey,note\n").when(odd == 1, ' "quoted, twice"').when(odd == 2, '\n"').otherwise("")
    note = F.when(odd != 4, F.concat("o_orderpriority", more))
    write_csv(table(spark, folder, "orders").select("o_orderkey", note.alias("note")).repartition(2, "o_orderkey"), path)
    with settings(spark, _SPLITS):
        write_table(read_csv(spark, path, schemas.schema("o_orderkey:long note:string")), f"{path}-rows")
    return spark.read.schema(schemas.schema("o_orderkey:long note:string")).parquet(f"{path}-rows")


@query(
    "unreadable_parts",
    """SELECT p_partkey, p_name, NULL AS reason FROM part WHERE p_partkey % 5 <> 3
    UNION ALL SELECT NULL, NULL, unnest(['too short', 'no mark at the start', 'no mark at the end', 'footer longer than the file'])""",
)
def unreadable_parts(spark, folder):
    """Five parts of which one is broken in four ways: the others are read, the broken files are a table with reasons."""
    path = scratch(spark, "parts")
    parts = table(spark, folder, "part").select("p_partkey", "p_name")
    for place in (0, 1, 2, 4):
        write_table(parts.filter(F.col("p_partkey") % 5 == place), f"{path}/{place}")
    for place, content in enumerate((b"PAR1", b"these are no columns", b"PAR1 and no end mark", b"PAR1 xxxx\xff\xff\xff\x7fPAR1")):
        file = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/3/broken-{place}.parquet")
        out = file.getFileSystem(spark._jsc.hadoopConfiguration()).create(file)
        out.write(bytearray(content))
        out.close()
    sound, rejected = read_sound_parts(spark, path, parts.schema)
    return sound.withColumn("reason", F.lit(None).cast("string")).unionByName(rejected.select("reason"), allowMissingColumns=True)


@query(
    "flight_file_names",
    """SELECT event_id, CASE WHEN user_id % 4 < 2 THEN 'K' || upper(substr(event_type, 1, 3)) END AS arrival_airport,
    CASE WHEN user_id % 4 < 2 THEN ts::DATE END AS file_date,
    CASE user_id % 4 WHEN 0 THEN 'runways_data_set' WHEN 1 THEN 'ETD_data_set' END AS dataset_type FROM events""",
)
def flight_file_names(spark, folder):
    """Airport, date and type out of a file name; names of several days and foreign names give null."""
    day = F.date_format("ts", "yyyy-MM-dd")
    airport = F.concat(F.lit("K"), F.upper(F.substring("event_type", 1, 3)))
    name = (
        F.when(F.col("user_id") % 4 == 0, F.concat(airport, F.lit("_"), day, F.lit(".runways_data_set.csv")))
        .when(F.col("user_id") % 4 == 1, F.concat(airport, F.lit("_"), day, F.lit(".ETD_data_set.csv")))
        .when(F.col("user_id") % 4 == 2, F.concat(airport, F.lit("_"), day, F.lit("_"), day, F.lit(".runways_data_set.csv")))
        .otherwise(F.lit("notes.txt"))
    )
    parts = flights.file_parts(name)
    return table(spark, folder, "events").select("event_id", *[e.alias(n) for n, e in parts.items()])


@query(
    "forecast_file_times",
    "SELECT event_id, CASE WHEN user_id % 3 <> 0 THEN date_trunc('hour', ts)::TIMESTAMP END AS issued FROM events",
)
def forecast_file_times(spark, folder):
    name = F.when(F.col("user_id") % 3 == 0, F.lit("taf.latest.txt")).otherwise(
        F.concat(F.lit("taf."), F.date_format("ts", "yyyyMMdd.HH"), F.lit("Z.txt"))
    )
    return table(spark, folder, "events").select("event_id", reports.issue_time_of_file(name).alias("issued"))


@query(
    "encoding_fallback",
    "SELECT doc_id, md5(text) AS digest, length(text)::INTEGER AS size FROM documents",
)
def encoding_fallback(spark, folder):
    """Whole texts, stored as ISO-8859-1 where that can hold them and as UTF-8 elsewhere, read back by one rule."""
    latin = F.col("text").rlike(r"^[\x00-\xFF]*$")
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    decoded = table(spark, folder, "documents").select("doc_id", reports.decode_text(content).alias("text"))
    return decoded.select("doc_id", F.md5(F.col("text")).alias("digest"), F.length("text").alias("size"))


@query(
    "consolidated_filter",
    "SELECT event_id, ts, event_type AS station_id FROM events WHERE event_type IN ('view', 'click')",
)
def consolidated_filter(spark, folder):
    """Batches of a folder, read together and cut to the stations of interest."""
    from tarmac.sources.tables import only_stations

    path = scratch(spark, "batches")
    rows = table(spark, folder, "events").select("event_id", "ts", F.col("event_type").alias("station_id"))
    write_table(rows, path, max_records_per_file=5000)
    return only_stations(read_parts(spark, path, rows.schema), ["view", "click"]).select("event_id", "ts", "station_id")


@query(
    "lenient_flight_times",
    """SELECT event_id::VARCHAR AS gufi, CASE WHEN user_id % 6 <> 0 THEN date_trunc('second', ts)::TIMESTAMP END AS arrival_runway_actual_time,
    user_id % 6 <> 0 AS is_arrival FROM events""",
)
def lenient_flight_times(spark, folder):
    """Runway rows as they come from CSV, text times included, to the flight table."""
    text = F.when(F.col("user_id") % 6 == 0, F.lit("unknown")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    raw = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("gufi"),
        F.lit("KDEN").alias("arrival_airport"),
        lenient_timestamp(text).alias("arrival_runway_actual_time"),
        F.lit(None).cast("timestamp_ntz").alias("departure_runway_actual_time"),
    )
    return flights.runway_flights(raw).select("gufi", "arrival_runway_actual_time", "is_arrival")


_ETD_FOLDERS = r"/arrival_airport=([^/]+)/file_date=(\d{4}-\d{2}-\d{2})/dataset_type=(\w+)/[^/]+$"


@query(
    "daily_flight_files",
    """SELECT event_id::VARCHAR AS gufi, 'K' || upper(substr(event_type, 1, 3)) AS arrival_airport,
    CASE WHEN user_id % 6 <> 0 THEN date_trunc('second', ts)::TIMESTAMP END AS departure_runway_estimated_time,
    date_trunc('second', ts)::TIMESTAMP AS timestamp FROM events WHERE user_id % 5 <> 0""",
)
def daily_flight_files(spark, folder):
    """Daily CSV files by airport, date and type: two orders of columns, one with an extra column, and files of two days,
    which are passed over."""
    path = scratch(spark, "daily")
    day, second = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, folder, "events").select(
        F.col("event_id").cast("string").alias("gufi"),
        F.when(F.col("user_id") % 6 == 0, F.lit("unknown")).otherwise(second).alias("departure_runway_estimated_time"),
        second.alias("timestamp"),
        F.concat(F.lit("a, "), F.col("event_type")).alias("remark"),
        F.concat(F.lit("K"), F.upper(F.substring("event_type", 1, 3))).alias("arrival_airport"),
        F.when(F.col("user_id") % 5 == 0, F.concat_ws("_", day, day)).otherwise(day).alias("file_date"),
        F.lit("ETD_data_set").alias("dataset_type"),
        (F.col("user_id") % 2).alias("form"),
    )
    places = ["arrival_airport", "file_date", "dataset_type"]
    forms = {0: ["gufi", "departure_runway_estimated_time", "timestamp"], 1: ["timestamp", "remark", "gufi", "departure_runway_estimated_time"]}
    for form, names in forms.items():
        part = rows.filter(F.col("form") == form).select(*names, *places).repartition(*places)
        part.write.mode("append").option("header", True).partitionBy(*places).csv(path)
    daily = flights.read_daily(spark, path, "ETD_data_set", _ETD_FOLDERS, "*.csv")
    return daily.select("gufi", "arrival_airport", "departure_runway_estimated_time", "timestamp")


@query("template_from_csv", """SELECT o_orderpriority || '_' || o_orderkey AS "ID", o_custkey::INTEGER AS "Value" FROM orders""")
def template_from_csv(spark, folder):
    """A submission template whose columns stand in another order, beside one that is not wanted."""
    path = scratch(spark, "template")
    id_ = F.concat_ws("_", "o_orderpriority", "o_orderkey")
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("Value"), F.col("o_orderstatus").alias("other"), id_.alias("ID"))
    write_csv(rows, path)
    return read_template(spark, path)


@query("parts_with_empty_files", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name END AS p_name FROM part")
def parts_with_empty_files(spark, folder):
    """Part files of two forms and one of no bytes; nothing that has rows is passed over."""
    path = scratch(spark, "parts")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_size")
    write_table(parts.filter("p_size > 25").select("p_partkey", "p_name"), f"{path}/a")
    write_table(parts.filter("p_size <= 25").select("p_partkey"), f"{path}/b")
    empty = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/b/part-empty.parquet")
    empty.getFileSystem(spark._jsc.hadoopConfiguration()).create(empty).close()
    return read_parts(spark, path, parts.select("p_partkey", "p_name").schema)
