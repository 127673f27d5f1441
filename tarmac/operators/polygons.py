"""Weather polygons: hierarchy keys to columns and centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.functions.numeric import half_mean
from tarmac.functions.text import first_match


def stamp_of_file(name):
    """Issue time in a polygon file name, null when it has none."""
    parts = [first_match(name, codes.POLYGON_FILE, i).try_cast("int") for i in range(1, 6)]
    return F.try_make_timestamp_ntz(*parts, F.lit(0))


LEVEL = "/Deviation Probability[^/]*/FCST[^/]*/FLVL[^/]*/[^/]*Contour[^/]*/TRSH[^/]*/POLY"


def rejected_polygons(leaves: DataFrame) -> DataFrame:
    """Polygons whose coordinates are odd in number, so that they have no two halves."""
    return leaves.filter(F.concat(F.lit("/"), F.col("path")).rlike(LEVEL) & (F.size("coords") % 2 == 1))


def polygon_rows(leaves: DataFrame) -> DataFrame:
    """``source_file, path, coords`` to one row per polygon.

    A path reads ``Deviation Probability/FCST060/FLVL250/Contour/TRSH070/POLY003``; other leaves are passed over,
    as are polygons without points. Coordinates of odd number go to ``rejected_polygons``.
    """
    path = F.concat(F.lit("/"), F.col("path"))
    lat, lon = half_mean(F.col("coords"))
    return leaves.filter(path.rlike(LEVEL) & (F.size("coords") > 1) & (F.size("coords") % 2 == 0)).select(
        stamp_of_file(F.col("source_file")).alias("datetime_utc"),
        first_match(path, r"/FCST\D*(\d+)").cast("int").alias("forecast_offset_min"),
        (first_match(path, r"/FLVL\D*(\d+)").cast("int") * 100).alias("flight_level_ft"),
        first_match(path, r"/TRSH\D*(\d+)").cast("int").alias("threshold_pct"),
        first_match(path, r"/(POLY[^/]*)$").alias("polygon_id"),
        F.round(lat, 6).alias("centroid_lat"),
        F.round(lon, 6).alias("centroid_lon"),
    )
