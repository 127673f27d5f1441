"""Bucket IDs, time parts and the submission format."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import numeric, timebucket
from tarmac.operators import submission
from tarmac.operators.counts import zero_filled_arrivals
from tarmac.operators.joins import on_template
from tarmac.plans import standins as s
from tarmac.plans.registry import query
from tarmac.sources.tables import table

_END = """CASE WHEN time_bucket(INTERVAL 15 MINUTES, ts) = ts THEN ts
          ELSE time_bucket(INTERVAL 15 MINUTES, ts) + INTERVAL 15 MINUTES END"""


@query(
    "bucket_id_roundtrip",
    f"""WITH t AS (SELECT event_id, event_type AS station, {_END} AS bucket_end FROM events),
    h AS (SELECT *, date_trunc('hour', bucket_end - INTERVAL 1 MICROSECOND) AS hour_start FROM t)
    SELECT event_id, station || '_' || strftime(hour_start, '%y-%m-%d_%H00_')
      || date_diff('minute', hour_start, bucket_end) AS id, station AS parsed_station, bucket_end AS parsed_end
    FROM h""",
)
def bucket_id_roundtrip(spark, folder):
    """ID of each event's bucket, read back; minute 60 belongs to the next hour."""
    ids = table(spark, folder, "events").select(
        "event_id", timebucket.bucket_id(F.col("event_type"), timebucket.bucket_end("ts")).alias("id")
    )
    return ids.select(
        "*",
        timebucket.station_of_id("id").alias("parsed_station"),
        timebucket.end_of_id("id").alias("parsed_end"),
    )


@query(
    "broken_ids",
    """SELECT event_id, CASE user_id % 4 WHEN 2 THEN TIMESTAMP '2024-01-02 04:15:00' END AS parsed_end,
    CASE user_id % 4 WHEN 0 THEN 'no id' WHEN 1 THEN 'view' ELSE 'view' END AS parsed_station FROM events""",
)
def broken_ids(spark, folder):
    """Text that is no ID gives null, not an error."""
    kinds = F.array(*[F.lit(x) for x in ("no id", "view_24-13-45_0400_15", "view_24-01-02_0400_15", "view_24-01-02")])
    text = F.element_at(kinds, (F.col("user_id") % 4 + 1).cast("int"))
    return table(spark, folder, "events").select(
        "event_id", timebucket.end_of_id(text).alias("parsed_end"), timebucket.station_of_id(text).alias("parsed_station")
    )


_SUBMISSION_SQL = """
    SELECT {cols}, {station} || '_' || strftime(block, '%y%m%d_%H00_') || (ceil(date_diff('second', block, {t}) / 900.0) * 15)::BIGINT AS ID
    FROM (SELECT *, to_timestamp(ceil(epoch(date_trunc('hour', {t} - INTERVAL 4 HOURS)) / 14400) * 14400)::TIMESTAMP
                    + INTERVAL 1 HOUR AS block FROM {source})"""


@query(
    "submission_id",
    "WITH t AS (SELECT event_id, event_type AS station, "
    + _END
    + " AS ends FROM events)"
    + _SUBMISSION_SQL.format(cols="event_id", station="station", t="ends", source="t"),
)
def submission_id(spark, folder):
    ends = table(spark, folder, "events").select(
        "event_id", F.col("event_type").alias("station"), timebucket.bucket_end("ts").alias("at")
    )
    return ends.select("event_id", timebucket.submission_id("station", F.col("at")).alias("ID"))


@query(
    "minute_marks",
    """SELECT event_id, (ceil(((epoch_us(ts) - epoch_us(date_trunc('hour', ts))) / 900000000.0)) * 15)::INTEGER AS mark,
    extract('hour' FROM ts)::INTEGER AS hour, (extract('isodow' FROM ts) - 1)::INTEGER AS weekday,
    (floor(extract('hour' FROM ts) / 4) * 4 + 1)::INTEGER AS legacy_block_hour, date_trunc('day', ts)::TIMESTAMP AS day
    FROM events""",
)
def minute_marks(spark, folder):
    return table(spark, folder, "events").select(
        "event_id",
        timebucket.minute_mark("ts").alias("mark"),
        F.hour("ts").alias("hour"),
        timebucket.monday_weekday("ts").alias("weekday"),
        timebucket.legacy_block_hour("ts").alias("legacy_block_hour"),
        timebucket.floor_minutes("ts", 24 * 60).alias("day"),
    )


@query(
    "time_formats",
    """SELECT event_id, date_trunc('minute', ts)::TIMESTAMP AS short_year, date_trunc('minute', ts)::TIMESTAMP AS slashed,
    date_trunc('day', ts)::TIMESTAMP AS dashed, date_trunc('hour', ts)::TIMESTAMP AS of_file FROM events""",
)
def time_formats(spark, folder):
    """The four text forms times come in."""
    forms = {
        "short_year": ("yy-MM-dd HHmm", None),
        "slashed": ("yyyy/MM/dd HH:mm", None),
        "dashed": ("yyyy-MM-dd", None),
        "of_file": ("yyyyMMddHH", None),
    }
    return table(spark, folder, "events").select(
        "event_id",
        *[timebucket.lenient_timestamp(F.date_format("ts", fmt), fmt).alias(name) for name, (fmt, _) in forms.items()],
    )


@query(
    "clip_round_half_even",
    """WITH t AS (SELECT event_id, floor(value) / 2 - 20 AS raw FROM events)
    SELECT event_id, raw, round_even(greatest(raw, 0), 0)::INTEGER AS n FROM t""",
)
def clip_round_half_even(spark, folder):
    raw = (F.floor("value") / 2 - 20).alias("raw")
    return table(spark, folder, "events").select("event_id", raw).withColumn("n", numeric.clip_round(F.col("raw")))


def _predictions_sql(keep: str) -> str:
    body = _SUBMISSION_SQL.format(cols="value, station, bucket_end", station="station", t="bucket_end", source="counted")
    return f"""{s.counts_sql('test')},
    named AS ({body}),
    template AS (SELECT ID, station, bucket_end FROM named
      WHERE date_diff('minute', time_bucket(INTERVAL 4 HOURS, bucket_end - INTERVAL 1 MICROSECOND), bucket_end) > 60),
    predicted AS (SELECT ID, round_even(greatest(value * 1.5 - 0.25, 0), 0)::INTEGER AS Value FROM named WHERE {keep})"""


def _template_and_predictions(spark, folder):
    counts = zero_filled_arrivals(s.grid(spark, folder, "test"), s.arrivals(spark, folder))
    template = submission.template_rows(s.grid(spark, folder, "test"))
    later = timebucket.block_pos("bucket_end") >= 4
    predictions = counts.filter(later).select(
        "station", F.col("bucket_end").alias("at"), (F.col("value") * 1.5 - 0.25).alias("prediction")
    )
    return template, predictions


_LATER = "date_diff('minute', time_bucket(INTERVAL 4 HOURS, bucket_end - INTERVAL 1 MICROSECOND), bucket_end) > 60"


@query(
    "template_left_join",
    _predictions_sql(f"{_LATER} AND extract('hour' FROM bucket_end) <> 6")
    + " SELECT ID, station, bucket_end, Value FROM template LEFT JOIN predicted USING (ID)",
)
def template_left_join(spark, folder):
    """Template rows with the prediction of their ID; those without one stay, empty."""
    template, predictions = _template_and_predictions(spark, folder)
    made = submission.to_submission(predictions.filter(F.hour("at") != 6))
    return on_template(template, made).select("ID", "station", "bucket_end", "Value")


@query(
    "complete_submission",
    _predictions_sql(f"{_LATER} AND extract('hour' FROM bucket_end) <> 6")
    + """ SELECT ID, station, bucket_end, last_value(Value IGNORE NULLS) OVER (PARTITION BY station ORDER BY bucket_end) AS Value
    FROM template LEFT JOIN predicted USING (ID)""",
)
def complete_submission(spark, folder):
    template, predictions = _template_and_predictions(spark, folder)
    made = submission.to_submission(predictions.filter(F.hour("at") != 6))
    return submission.complete_submission(template, made).select("ID", "station", "bucket_end", "Value")


@query(
    "submission_in_order",
    _predictions_sql(_LATER) + " SELECT ID, Value FROM predicted ORDER BY ID",
)
def submission_in_order(spark, folder):
    """The finished table sorted by ID, as the CSV is written."""
    _, predictions = _template_and_predictions(spark, folder)
    return submission.to_submission(predictions).orderBy("ID")
