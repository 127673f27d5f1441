"""Time grid arithmetic on timestamps without zone.

Everything is integer arithmetic on epoch microseconds, so it stays inside generated code and is exact to
the microsecond. The session zone must be UTC (see ``tarmac.session``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarmac.functions import codes

MINUTE_US = 60_000_000
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_us(ts) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def from_us(us) -> Column:
    return F.timestamp_micros(_col(us).cast("long")).cast("timestamp_ntz")


def floor_us(us: Column, step: int) -> Column:
    return us - F.pmod(us, F.lit(step))


def ceil_us(us: Column, step: int) -> Column:
    return us + F.pmod(-us, F.lit(step))


def on_grid(us: Column, step: int) -> Column:
    """The instant itself; one that is no multiple of ``step`` fails the job, where a rule holds for grid instants only."""
    return F.when(us % step != 0, F.raise_error(F.lit("an instant does not lie on the grid")).cast("bigint")).otherwise(us)


def floor_minutes(ts, minutes: int) -> Column:
    """Left-closed bucket start, aligned to the epoch."""
    return from_us(floor_us(epoch_us(ts), minutes * MINUTE_US))


def bucket_end(ts, minutes: int = codes.BUCKET_MINUTES) -> Column:
    """End of the right-closed bucket ``(end - minutes, end]`` that holds ``ts``."""
    return from_us(ceil_us(epoch_us(ts), minutes * MINUTE_US))


def hour_start_of_bucket(end) -> Column:
    """The hour whose 15/30/45/60 minute mark ``end`` is."""
    us = epoch_us(end)
    return from_us(ceil_us(us, HOUR_US) - HOUR_US)


def minute_of_bucket(end) -> Column:
    us = epoch_us(end)
    return ((us - ceil_us(us, HOUR_US) + HOUR_US) / MINUTE_US).cast("int")


def minute_mark(ts, minutes: int = codes.BUCKET_MINUTES) -> Column:
    """Minutes since the clock hour, rounded up to the grid: 0 exactly on the hour, else up to 60."""
    since_hour = F.pmod(epoch_us(ts), F.lit(HOUR_US))
    return (ceil_us(since_hour, minutes * MINUTE_US) / MINUTE_US).cast("int")


def bucket_id(station, end) -> Column:
    """``KDEN_22-09-25_1300_60`` for the bucket that ends at 14:00."""
    hour = hour_start_of_bucket(end)
    return F.concat_ws(
        "_",
        _col(station),
        F.date_format(hour, "yy-MM-dd"),
        F.concat(F.lpad(F.hour(hour).cast("string"), 2, "0"), F.lit("00")),
        minute_of_bucket(end).cast("string"),
    )


def station_of_id(bucket) -> Column:
    return F.get(F.split(_col(bucket), "_"), F.lit(0))


def end_of_id(bucket) -> Column:
    """Bucket end of an ID; minute 60 runs into the next hour; text that is no ID gives null."""
    parts = F.split(_col(bucket), "_")
    day = F.try_to_timestamp(F.get(parts, F.lit(1)), F.lit("yy-MM-dd")).cast("timestamp_ntz")
    hours = F.substring(F.get(parts, F.lit(2)), 1, 2).try_cast("int")
    minutes = F.get(parts, F.lit(3)).try_cast("int")
    return day + F.make_dt_interval(F.lit(0), hours, minutes, F.lit(0))


def submission_id(station, t) -> Column:
    """ID of the 4-hour block whose last three hours hold ``t``: ``KDEN_220925_0100_15``."""
    us = epoch_us(t)
    block = ceil_us(floor_us(us - 4 * HOUR_US, HOUR_US), 4 * HOUR_US) + HOUR_US
    minutes = ceil_us(us - block, codes.BUCKET_MINUTES * MINUTE_US) / MINUTE_US
    start = from_us(block)
    return F.concat_ws(
        "_",
        _col(station),
        F.date_format(start, "yyMMdd"),
        F.concat(F.lpad(F.hour(start).cast("string"), 2, "0"), F.lit("00")),
        minutes.cast("long").cast("string"),
    )


def block_start(ts, hours: int = codes.BLOCK_HOURS) -> Column:
    """Start of the block of ``hours`` (from midnight) that the bucket ending at ``ts`` lies in."""
    return from_us(floor_us(epoch_us(ts) - 1, hours * HOUR_US))


def block_pos(end, hours: int = codes.BLOCK_HOURS, minutes: int = codes.BUCKET_MINUTES) -> Column:
    """0-based position of a bucket inside its block."""
    us = epoch_us(end)
    return ((us - floor_us(us - 1, hours * HOUR_US)) / (minutes * MINUTE_US) - 1).cast("int")


def legacy_block_hour(ts) -> Column:
    """Start hour ``floor(hour / 4) * 4 + 1`` of the older test layout."""
    return (F.floor(F.hour(_col(ts)) / 4) * 4 + 1).cast("int")


def monday_weekday(ts) -> Column:
    return F.weekday(_col(ts))


def forecast_steps(start, steps: int = 12, lead_minutes: int = 45) -> Column:
    """The ``steps`` grid instants that follow the four context rows beginning at ``start``."""
    first = epoch_us(start) + (lead_minutes + codes.BUCKET_MINUTES) * MINUTE_US
    step = codes.BUCKET_MINUTES * MINUTE_US
    return F.transform(F.sequence(first, first + (steps - 1) * step, F.lit(step)), from_us)


def lenient_timestamp(text, fmt: str | None = None) -> Column:
    """Text to a timestamp without zone; unreadable text gives null."""
    text = _col(text)
    if fmt is None:
        return text.try_cast("timestamp_ntz")
    return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")


def month_frame(base) -> Column:
    """What ``day_hour`` needs to know of its base time: first day and length of the month before, this and after.

    Computed once per report and passed to every time field of it.
    """
    base = _col(base)
    first = [F.add_months(F.trunc(base, "month"), shift) for shift in (-1, 0, 1)]
    parts = [epoch_us(base).alias("us")]
    for name, day in zip(("before", "here", "after"), first):
        parts.append(F.unix_date(day).alias(f"{name}_first"))
        parts.append(F.dayofmonth(F.last_day(day)).alias(f"{name}_days"))
    return F.struct(*parts)


def day_hour(frame: str, day: str, hour: str, minute: str = "0", legacy: str | None = None) -> Column:
    """Day-of-month and hour, as reports write them, to a full timestamp near the base of ``frame``.

    ``frame`` names a column made by ``month_frame``; the others are SQL expressions. The month is the one that puts
    the result nearest to the base; hour 24 is midnight of the next day. The legacy forms stay in the month of the
    base and wrap hour 24 to 0 of the same day: ``"start"`` gives null for a day the month lacks, ``"end"`` moves
    such a day to the next month.
    """
    shown = f"pmod({hour}, 24)" if legacy else f"({hour})"
    readable = f"{day} >= 1 AND {hour} BETWEEN 0 AND 24 AND {minute} BETWEEN 0 AND 59"

    def at(month: str) -> str:
        us = f"({frame}.{month}_first + {day} - 1) * {DAY_US}L + {shown} * {HOUR_US}L + ({minute}) * {MINUTE_US}L"
        return f"CASE WHEN {readable} AND {day} <= {frame}.{month}_days THEN {us} END"

    if legacy == "start":
        return from_us(F.expr(at("here")))
    if legacy == "end":
        return from_us(F.expr(f"CASE WHEN {day} > {frame}.here_days THEN {at('after')} ELSE {at('here')} END"))

    # Earliest wins among equally near months by the order of the structs' second field.
    options = ", ".join(
        f"CASE WHEN {at(m)} IS NOT NULL THEN named_struct('gap', abs({at(m)} - {frame}.us), 'us', {at(m)}) END"
        for m in ("here", "after", "before")
    )
    return from_us(F.expr(f"least({options}).us"))
