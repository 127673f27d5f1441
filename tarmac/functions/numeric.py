"""Small numeric and cloud expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.functions import codes


def code_lookup(table: dict, key: Column) -> Column:
    """Value of a fixed code; null for a code the table lacks."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.create_map(*pairs)[key]


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def whole_miles(metres: Column, first_version: bool = False) -> Column:
    """Metres to whole statute miles, 7 and more reported as 6 (the first version only up to 10)."""
    miles = F.floor(metres / codes.METRES_PER_STATUTE_MILE).cast("double")
    over = miles.between(7, 10) if first_version else miles >= 7
    return F.when(over, float(codes.VISIBILITY_CAP_MILES)).otherwise(miles)


def cloud_severity(layers: Sequence[tuple[Column, Column, Column]], legacy: bool = False) -> Column:
    """``(log10(sum of cover * multiplier / altitude) + 5) / 5``; 0 where nothing is reported."""
    total = F.lit(0.0)
    for cover, altitude, cloud in layers:
        oktas = F.coalesce(code_lookup(codes.COVER_OKTAS, cover), F.lit(0))
        # The legacy multiplier looks the cloud type up among the cover codes.
        table = codes.COVER_OKTAS if legacy else {"CB": codes.CB_MULTIPLIER}
        multiplier = F.coalesce(code_lookup(table, cloud), F.lit(1))
        height = F.when(altitude != 0, altitude.cast("double")).when(altitude == 0, F.lit(1000.0))
        total = total + F.coalesce(oktas * multiplier / height, F.lit(0.0))
    return F.when(total > 0, (F.log10(total) + 5) / 5).otherwise(F.lit(0.0))


def cloud_bands(layers: Sequence[tuple[Column, Column, Column]], legacy: bool = False) -> dict[str, Column]:
    """Per altitude band: cover in oktas and flags for towering clouds; a later layer overrides the cover.

    Bands are left-open; corrected bands let the lowest include altitude 0 and count an unknown cover as 0.
    """
    edges = codes.CLOUD_BAND_EDGES_FT
    out: dict[str, Column] = {}
    for low, high in zip(edges, edges[1:]):
        suffix = f"{low}_{high}"
        cover = F.lit(0)
        flags = {cloud: F.lit(0) for cloud in codes.CLOUD_TYPES}
        for layer_cover, altitude, cloud_type in layers:
            inside = (altitude > low) & (altitude <= high)
            if low == 0 and not legacy:
                inside = (altitude >= low) & (altitude <= high)
            oktas = code_lookup(codes.COVER_OKTAS, layer_cover)
            cover = F.when(inside, oktas if legacy else F.coalesce(oktas, F.lit(0))).otherwise(cover)
            for cloud in flags:
                flags[cloud] = F.when(inside & (cloud_type == cloud), F.lit(1)).otherwise(flags[cloud])
        out[f"cover_{suffix}"] = cover
        for cloud, flag in flags.items():
            out[f"{cloud}_{suffix}"] = flag
    if legacy:
        out[codes.MISSPELT_BAND] = F.lit(0)
    return out


def layer_columns(prefix: str = "") -> list[tuple[Column, Column, Column]]:
    return [
        tuple(F.col(f"{prefix}{part}_{i}") for part in ("cover_type", "altitude", "cloud_type")) for i in (1, 2, 3)
    ]


def clip_round(value: Column) -> Column:
    """Negative counts to 0, halves to the even neighbour."""
    return F.bround(F.greatest(value, F.lit(0.0)), 0).cast("int")


def rescale(value: Column, low: Column, high: Column, to: tuple[float, float] = (0.0, 1.0)) -> Column:
    """Min-max scaling; a constant column goes to the lower end."""
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (value - low) / span * (to[1] - to[0]) + to[0]


def unscale(value: Column, low: Column, high: Column, to: tuple[float, float] = (0.0, 1.0)) -> Column:
    span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
    return (value - to[0]) / (to[1] - to[0]) * span + low


def half_mean(values: Column) -> tuple[Column, Column]:
    """Means of the first and the second half of a flat coordinate array; null for one of odd length, which has no halves."""
    half = F.floor(F.size(values) / 2).cast("int")

    def mean(part: Column) -> Column:
        total = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
        return F.when((half > 0) & (F.size(values) % 2 == 0), total / half)

    return mean(F.slice(values, F.lit(1), half)), mean(F.slice(values, half + 1, half))
