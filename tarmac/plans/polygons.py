"""Weather polygons, with an embedding as the flat coordinate array of one polygon."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import numeric
from tarmac.operators.polygons import polygon_rows, stamp_of_file
from tarmac.plans.registry import query
from tarmac.sources.tables import table


@query(
    "polygon_centroid",
    """SELECT vec_id, round(list_avg(list_transform(embedding[1:32], lambda x: x::DOUBLE)), 6) + 0.0 AS centroid_lat,
    round(list_avg(list_transform(embedding[33:64], lambda x: x::DOUBLE)), 6) + 0.0 AS centroid_lon FROM embeddings""",
)
def polygon_centroid(spark, folder):
    lat, lon = numeric.half_mean(F.col("embedding"))
    return table(spark, folder, "embeddings").select(
        "vec_id",
        (F.round(lat, 6) + F.lit(0.0)).alias("centroid_lat"),
        (F.round(lon, 6) + F.lit(0.0)).alias("centroid_lon"),
    )


def _leaves(spark, folder):
    """One leaf per vector: every fifth name has no time, every seventh path is no polygon."""
    vec = F.col("vec_id")
    stamp = F.date_format(F.timestamp_micros(vec * F.lit(900_000_000) + F.lit(1_661_990_400_000_000)), "yyyy_MM_dd_HH_mm")
    name = F.when(vec % 5 == 0, F.lit("latest.h5")).otherwise(F.concat(stamp, F.lit("_GMT.Forecast.h5")))
    root = F.when(vec % 7 == 0, F.lit("Echo Tops")).otherwise(F.lit("Deviation Probability"))
    path = F.concat(
        root, F.lit("/FCST"), F.lpad((F.col("label") * 15).cast("string"), 3, "0"),
        F.lit("/FLVL"), ((vec % 30 + 10) * 10).cast("string"), F.lit("/Contour/TRSH"),
        F.lpad((vec % 10 * 10).cast("string"), 3, "0"), F.lit("/POLY"), vec.cast("string"),
    )
    return table(spark, folder, "embeddings").select(
        name.alias("source_file"), path.alias("path"), F.col("embedding").cast("array<double>").alias("coords")
    )


@query(
    "polygon_levels",
    """SELECT CASE WHEN vec_id % 5 <> 0 THEN TIMESTAMP '2022-09-01' + to_minutes(vec_id * 15) END AS datetime_utc,
    (label * 15)::INTEGER AS forecast_offset_min, ((vec_id % 30 + 10) * 10 * 100)::INTEGER AS flight_level_ft,
    (vec_id % 10 * 10)::INTEGER AS threshold_pct, 'POLY' || vec_id AS polygon_id,
    round(list_avg(list_transform(embedding[1:32], lambda x: x::DOUBLE)), 6) + 0.0 AS centroid_lat,
    round(list_avg(list_transform(embedding[33:64], lambda x: x::DOUBLE)), 6) + 0.0 AS centroid_lon
    FROM embeddings WHERE vec_id % 7 <> 0""",
)
def polygon_levels(spark, folder):
    """Hierarchy path and file name to columns, with the centroid."""
    rows = polygon_rows(_leaves(spark, folder))
    return rows.withColumns({c: F.col(c) + F.lit(0.0) for c in ("centroid_lat", "centroid_lon")})


@query(
    "polygon_file_times",
    """SELECT vec_id % 5 = 0 AS unnamed, CASE WHEN vec_id % 5 <> 0 THEN TIMESTAMP '2022-09-01' + to_minutes(vec_id * 15) END AS issued
    FROM embeddings""",
)
def polygon_file_times(spark, folder):
    return _leaves(spark, folder).select(
        (F.col("source_file") == "latest.h5").alias("unnamed"), stamp_of_file(F.col("source_file")).alias("issued")
    )
