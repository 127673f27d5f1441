"""Report text to typed fields, as native expressions.

Fields are read in steps, each a set of columns: first the raw pieces, every pattern searched at most once per line
and only where its marker occurs, then numbers and times out of those short pieces. Catalyst keeps the steps apart
because later ones use a piece more than once, so no search is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import codes
from tarmac.functions.text import all_matches, first_match, signed_number
from tarmac.functions.timebucket import day_hour, month_frame


def _piece(text: Column, marker: str, pattern: str, group: int = 1) -> Column:
    """Capture group, empty where the pattern does not match and null where not even the marker occurs."""
    return F.when(F.contains(text, F.lit(marker)), F.regexp_extract(text, pattern, group))


def _int(piece: Column) -> Column:
    # Empty text is set to null first: a cast that fails costs an exception for every row.
    return F.nullif(piece, F.lit("")).try_cast("int")


def _number(piece: Column) -> Column:
    return _int(piece).cast("double")


def _digits(piece: Column, start: int, length: int = 2) -> Column:
    return _int(F.substring(piece, start, length))


def cloud_layers(layers: Column) -> dict[str, Column]:
    """Cover, altitude in feet and cloud type of the first three layers."""
    out: dict[str, Column] = {}
    for i in range(3):
        layer = F.get(layers, F.lit(i))
        out[f"cover_type_{i + 1}"] = F.substring(layer, 1, 3)
        out[f"altitude_{i + 1}"] = _digits(layer, 4, 3) * 100
        out[f"cloud_type_{i + 1}"] = F.nullif(F.substring(layer, 7, 99), F.lit(""))
    return out


def layers_of(line: Column) -> Column:
    return all_matches(line, codes.CLOUD_LAYER, 3)


def _wind(piece: Column, gust_after_unit: bool = False) -> dict[str, Column]:
    gust = F.get(F.split(piece, "G"), F.lit(1))
    return {
        "wind_direction": _number(F.substring(piece, 1, 3)),
        "wind_speed": _number(F.substring(piece, 4, 2)),
        "wind_gust": _number(gust if gust_after_unit else F.substring(gust, 1, 2)),
    }


def _degrees(piece: Column) -> dict[str, Column]:
    parts = F.split(piece, "/")
    return {name: signed_number(F.get(parts, F.lit(i))) for i, name in enumerate(("temperature", "dew_point"))}


def _miles(fraction: Column, whole: Column) -> Column:
    """``1 1/2`` or ``1/2`` or a whole number of statute miles."""
    words = F.split(fraction, " ")
    ratio = F.split(F.element_at(words, -1), "/")
    top, bottom = (_number(F.get(ratio, F.lit(i))) for i in (0, 1))
    ahead = F.when(F.size(words) > 1, _number(F.get(words, F.lit(0)))).otherwise(F.lit(0.0))
    return F.coalesce(ahead + F.try_divide(top, bottom), _number(whole))


def _inches(piece: Column) -> Column:
    tenths = _number(piece) / 10 * codes.TENTHS_HPA_PER_TENTH_INCH
    return F.bround(tenths, 0).cast("int")


def _clock(piece: Column, period: bool) -> Column:
    """Two-digit numbers of a ``DDHH/DDHH`` period or a ``DDHHMM`` moment, by place."""
    places = {"a": 1, "b": 3, "d": 6, "e": 8} if period else {"a": 1, "b": 3, "c": 5}
    return F.struct(*[_digits(piece, start).alias(name) for name, start in places.items()])


def _period(clock: str, legacy: bool) -> tuple[Column, Column]:
    """Start and end of a ``DDHH/DDHH`` piece."""
    start = day_hour("_frame", f"{clock}.a", f"{clock}.b", legacy="start" if legacy else None)
    end = day_hour("_frame", f"{clock}.d", f"{clock}.e", legacy="end" if legacy else None)
    return start, end


def _moment(clock: str, legacy: bool = False) -> Column:
    """A ``DDHHMM`` piece."""
    return day_hour("_frame", f"{clock}.a", f"{clock}.b", f"{clock}.c", legacy="start" if legacy else None)


def with_validity(df: DataFrame, block: str = "block", base: str = "issue_ts", legacy: bool = False) -> DataFrame:
    """Validity of a forecast block, and the month frame of its issue time as ``_frame``."""
    pieces = df.withColumns({"_frame": month_frame(base), "_validity": F.regexp_extract(block, codes.VALIDITY, 1)})
    start, end = _period("_validity", legacy)
    return (
        pieces.withColumn("_validity", _clock(F.col("_validity"), True))
        .withColumns({"validity_start": start, "validity_end": end})
        .drop("_validity")
    )


def observation_fields(df: DataFrame, line: str = "line", base: str = "base", legacy: bool = False) -> DataFrame:
    """Adds all fields of one observation line.

    The legacy form reads visibility from any four-digit word, the first pair of two-digit numbers as temperatures,
    and finds a gust only behind the unit.
    """
    text = F.col(line)
    none = F.lit(None).cast("string")
    pieces = {
        "_frame": month_frame(base),
        "_time": _piece(text, "Z", codes.REPORT_TIME),
        "_metres": F.regexp_extract(text, codes.METRES if legacy else codes.METRES_WORD, 1),
        "_fraction": none if legacy else _piece(text, "SM", codes.MILES_FRACTION),
        "_whole": none if legacy else _piece(text, "SM", codes.MILES_WHOLE),
        "_q": _piece(text, "Q", codes.ALTIMETER_Q),
        "_a": none if legacy else _piece(text, "A", codes.ALTIMETER_A),
        "_degrees": _piece(text, "/", codes.TEMPERATURE_LOOSE if legacy else codes.TEMPERATURE_WORD),
        "_wind": _piece(text, "KT", codes.WIND_GUST_AFTER_UNIT if legacy else codes.WIND, 0),
        "_layers": layers_of(text),
    }
    metres = _number(F.col("_metres"))
    fields = {
        "station_id": first_match(text, codes.OBSERVATION_STATION),
        "datetime": _moment("_time"),
        "visibility": F.coalesce(metres, _miles(F.col("_fraction"), F.col("_whole")) * codes.METRES_PER_STATUTE_MILE),
        "altimeter_tenths_hpa": F.coalesce(_int(F.col("_q")) * 10, _inches(F.col("_a"))),
        **_degrees(F.col("_degrees")),
        **_wind(F.col("_wind"), gust_after_unit=legacy),
        **cloud_layers(F.col("_layers")),
    }
    clocks = {"_time": _clock(F.col("_time"), False)}
    return df.withColumns(pieces).withColumns(clocks).withColumns(fields).drop(*pieces)


def forecast_fields(df: DataFrame, line: str = "line", legacy: bool = False) -> DataFrame:
    """Adds all fields of one forecast line; ``_frame`` and the block's own fields come from ``with_validity``.

    A temperature is a pair that stands as a word, else the highest the line announces (``TX``), else the lowest (``TN``).
    The legacy form loses the top of a fraction of a mile, takes the first pair of two-digit numbers as temperatures
    and reads no pressure but inches.
    """
    text = F.col(line)
    none = F.lit(None).cast("string")
    pieces = {
        "_most": none if legacy else _piece(text, "TX", codes.TEMPERATURE_MOST),
        "_least": none if legacy else _piece(text, "TN", codes.TEMPERATURE_LEAST),
        "_from": _piece(text, "FM", codes.FROM_TIME),
        "_tempo": _piece(text, "TEMPO", codes.TEMPO),
        "_becmg": _piece(text, "BECMG", codes.BECMG),
        "_loose": F.regexp_extract(text, codes.MILES_LOOSE, 1) if legacy else _piece(text, "9999", codes.MILES_UNLIMITED),
        "_fraction": none if legacy else _piece(text, "SM", codes.MILES_FRACTION),
        "_whole": none if legacy else _piece(text, "SM", codes.MILES_WHOLE),
        "_inches": _piece(text, "INS", codes.ALTIMETER_INCHES),
        "_hpa": none if legacy else _piece(text, "HPA", codes.ALTIMETER_HPA),
        "_a": none if legacy else _piece(text, "A", codes.ALTIMETER_A),
        "_degrees": _piece(text, "/", codes.TEMPERATURE_LOOSE if legacy else codes.TEMPERATURE_WORD),
        "_wind": _piece(text, "KT", codes.WIND, 0),
        "_layers": layers_of(text),
    }
    tempo_start, tempo_end = _period("_tempo", legacy)
    becmg_start, becmg_end = _period("_becmg", legacy)
    cap = F.lit(float(codes.VISIBILITY_CAP_MILES))
    fields = {
        "from_time": _moment("_from", legacy),
        "tempo_start": tempo_start,
        "tempo_end": tempo_end,
        "becmg_start": becmg_start,
        "becmg_end": becmg_end,
        "visibility": F.when(F.col("_loose") == "9999", cap).otherwise(
            _number(F.replace(F.col("_loose"), F.lit("SM"), F.lit("")))
            if legacy
            else _miles(F.col("_fraction"), F.col("_whole"))
        ),
        "altimeter_tenths_hpa": F.coalesce(
            _int(F.col("_hpa")) * 10, _inches(F.col("_inches")), _inches(F.col("_a"))
        ),
        **_degrees(F.col("_degrees")),
        "temperature": F.coalesce(
            _degrees(F.col("_degrees"))["temperature"], signed_number(F.col("_most")), signed_number(F.col("_least"))
        ),
        **_wind(F.col("_wind")),
        **cloud_layers(F.col("_layers")),
    }
    clocks = {name: _clock(F.col(name), name != "_from") for name in ("_from", "_tempo", "_becmg")}
    return df.withColumns(pieces).withColumns(clocks).withColumns(fields).drop(*pieces)
