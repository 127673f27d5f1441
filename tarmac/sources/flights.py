"""Daily flight files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac import schemas
from tarmac.functions import codes
from tarmac.functions.casting import conform, times_from_text
from tarmac.functions.text import first_match
from tarmac.functions.timebucket import floor_minutes
from tarmac.operators.dedup import keep_first
from tarmac.sources.tables import csv_rows, pick_cells

TIME_COLUMNS = {
    "runways_data_set": ["arrival_runway_actual_time", "departure_runway_actual_time"],
    "TFM_track_data_set": ["arrival_runway_estimated_time", "timestamp"],
    "ETD_data_set": ["departure_runway_estimated_time", "timestamp"],
    "MFS_data_set": [],
}
RENAMES = {
    "TFM_track_data_set": {
        "arrival_runway_estimated_time": "estimated_arrival_time",
        "timestamp": "estimated_arrival_time_prediction_timestamp",
    },
    "ETD_data_set": {
        "departure_runway_estimated_time": "estimated_departure_time",
        "timestamp": "estimated_departure_time_prediction_timestamp",
    },
}


def file_parts(name: Column, pattern: str = codes.FLIGHT_FILE) -> dict[str, Column]:
    """Airport, date and dataset type of a daily file; null parts for a name of another form.

    ``pattern`` has these three as its groups; it may as well be one for whole paths.
    """
    return {
        "arrival_airport": first_match(name, pattern, 1),
        "file_date": first_match(name, pattern, 2).try_cast("date"),
        "dataset_type": first_match(name, pattern, 3),
    }


def read_daily(
    spark: SparkSession, folder: str, dataset_type: str, pattern: str = codes.FLIGHT_FILE, glob: str | None = None
) -> DataFrame:
    """All single-day files of one type, typed, with the airport that their place names.

    Columns are found by each file's own header, so extra columns and another column order do no harm. By default the
    place is the file name; a ``pattern`` with a slash is matched with the whole path, for folders by airport, date and
    type. Files of several days match no pattern and are passed over.
    """
    rows = csv_rows(spark, folder, glob or f"*.{dataset_type}.csv")
    names = [*schemas.FLIGHT_FILES[dataset_type].names]
    path = F.url_decode("source_path")
    place = path if "/" in pattern else F.regexp_extract(path, "([^/]+)$", 1)
    parts = file_parts(place, pattern)
    named = pick_cells(rows, names).withColumns({"source_file": place, **parts})
    daily = named.filter((F.col("dataset_type") == dataset_type) & F.col("file_date").isNotNull())
    kept = daily.select(*names, "arrival_airport", "source_file")
    return times_from_text(kept, TIME_COLUMNS[dataset_type])


def runway_flights(runways: DataFrame) -> DataFrame:
    """The flight table: four columns and the arrival flag."""
    flagged = runways.withColumn("is_arrival", F.col("arrival_runway_actual_time").isNotNull())
    return conform(flagged, schemas.FLIGHTS)


def thin_out(
    df: DataFrame,
    times: Sequence[str],
    order: Sequence[Column],
    minutes: int = 7,
    keys: Sequence[str] = ("arrival_airport", "gufi"),
    legacy: bool = False,
) -> DataFrame:
    """Floor the times to ``minutes`` and keep the first row of each (flight, floored times).

    The legacy form compares the times alone, which drops other flights of the same minute.
    """
    floored = df.withColumns({c: floor_minutes(c, minutes) for c in times})
    return keep_first(floored, list(times) if legacy else [*keys, *times], order)


def renamed_tracks(df: DataFrame, dataset_type: str) -> DataFrame:
    return df.withColumnsRenamed(RENAMES.get(dataset_type, {}))
