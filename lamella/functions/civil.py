"""Civil dates and nanosecond timestamps as Catalyst expressions.

The file format counts days from 1970-01-01 and timestamps as whole seconds from 2015-01-01 plus nanoseconds. Nothing here depends on the session's zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from 1970-01-01 to 2015-01-01: a fixed value of the format.
EPOCH_DAY = 16_436
NANOS = 1_000_000_000


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_to_date(day: Column | str) -> Column:
    """struct(year, month, day) of a day number, proleptic Gregorian. Null in, null out; years beyond 0001..9999 are outside Spark's dates."""
    d = F.date_from_unix_date(_col(day).cast("int"))
    return F.when(_col(day).isNotNull(), F.struct(F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day")))


def date_to_day(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """The day number of a civil date; an impossible date raises, as in ANSI mode."""
    return F.unix_date(F.make_date(_col(year), _col(month), _col(day))).cast("bigint")


def timestamp_to_datetime(seconds: Column | str, nanos: Column | str) -> Column:
    """struct(date, nano_of_day) of seconds since 2015-01-01 and nanoseconds. Floors, so moments before 2015 come out right."""
    s = _col(seconds)
    day = (F.floor(s / 86_400) + EPOCH_DAY).cast("int")
    nano = F.pmod(s, F.lit(86_400).cast("bigint")) * NANOS + F.coalesce(_col(nanos), F.lit(0))
    return F.when(s.isNotNull(), F.struct(F.date_from_unix_date(day).alias("date"), nano.cast("bigint").alias("nano_of_day")))


def datetime_to_timestamp(date: Column | str, nano_of_day: Column | str) -> Column:
    """struct(seconds, nanos) since 2015-01-01 of a date and the nanosecond of its day: the inverse of timestamp_to_datetime."""
    n = _col(nano_of_day)
    whole = F.floor(n / NANOS)
    seconds = (F.unix_date(_col(date)) - EPOCH_DAY).cast("bigint") * 86_400 + whole
    return F.when(_col(date).isNotNull(), F.struct(seconds.cast("bigint").alias("seconds"), (n - whole * NANOS).cast("bigint").alias("nanos")))


def moment_to_timestamp(ts: Column | str) -> Column:
    """struct(seconds, nanos) of a zone-less timestamp, microsecond precision."""
    us = _micros(_col(ts))
    seconds = F.floor(us / 1_000_000)
    return F.when(_col(ts).isNotNull(), F.struct((seconds - EPOCH_DAY * 86_400).cast("bigint").alias("seconds"), ((us - seconds * 1_000_000) * 1_000).cast("bigint").alias("nanos")))


def _micros(ts: Column) -> Column:
    """Microseconds since 1970-01-01 of a zone-less timestamp, whatever the session's zone."""
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", base, ts)


def encode_nanoseconds(nanos: Column | str) -> Column:
    """The scaled form: with two or more trailing zeros these go, and their number less one stands in the low three bits."""
    n = _col(nanos).cast("bigint")
    s = n.cast("string")
    zeros = F.length(s) - F.length(F.regexp_replace(s, "0+$", ""))
    k = F.least(zeros, F.lit(8))
    short = F.substring(s, F.lit(1), F.length(s) - k).try_cast("bigint")
    return F.when(n == 0, F.lit(0).cast("bigint")).when(k >= 2, F.shiftleft(short, 3).bitwiseOR((k - 1).cast("bigint"))).otherwise(F.shiftleft(n, 3))


def decode_nanoseconds(code: Column | str) -> Column:
    """The inverse of encode_nanoseconds."""
    c = _col(code).cast("bigint")
    z, r = c.bitwiseAND(F.lit(7).cast("bigint")), F.shiftright(c, 3)
    return F.when(z == 0, r).otherwise(r * F.pow(F.lit(10), z + 1).cast("bigint"))
