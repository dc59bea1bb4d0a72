"""Time expressions. Every function that needs the present takes it as `as_of`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import Text, col


def parse(value: Text) -> Column:
    """An ISO-8601 text as a timestamp, without offset read as UTC; null where it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(col(value), "Z$", "+00:00"))


def normalize(value: Text) -> Column:
    """struct(ts, changed, error) of a raw time: null and empty pass; digits are seconds, from 13 digits on milliseconds; else ISO-8601."""
    v = col(value)
    number = v.try_cast("long")
    digits = v.rlike("^[0-9]+$")
    in_range = F.abs(number) < F.when(F.length(v) >= 13, F.lit(253402300800000)).otherwise(F.lit(253402300800))
    epoch = F.when(F.length(v) >= 13, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    ts = F.when(digits & F.coalesce(in_range, F.lit(False)), epoch).when(~digits, parse(v))
    given = F.coalesce(v, F.lit("")) != ""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    error = F.when(given & ts.isNull(), F.when(digits, "unparseable_unix_timestamp").otherwise("unparseable_timestamp"))
    return F.struct(F.when(given, F.coalesce(text, v)).otherwise(v).alias("value"), F.coalesce(given & ts.isNotNull() & (text != v), F.lit(False)).alias("changed"), error.alias("error"))


def whole_days(since: Text, as_of: Column) -> Column:
    """Whole days between, rounded down."""
    return F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(col(since))) / 86400).cast("long")


def time_ago(since: Text, as_of: Column, to_zero: bool = False) -> Column:
    """Days ago in words. Of a time to come the days are rounded down, or (to_zero) the part of a day is left out, as of one that is past."""
    d = whole_days(since, as_of)
    if to_zero:
        d = F.when(d < 0, -whole_days(as_of, col(since))).otherwise(d)
    return F.when(col(since).isNull(), "未知").when(d == 0, "今天").otherwise(F.concat(d.cast("string"), F.lit("天前")))


def week_label(ts: Text) -> Column:
    """ISO year and week: the year is that of the week's Thursday."""
    return F.concat(F.year(F.date_add(F.trunc(F.to_date(col(ts)), "week"), 3)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(col(ts)).cast("string"), 2, "0"))


def month_label(ts: Text) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def quarter_label(ts: Text) -> Column:
    return F.concat(F.year(col(ts)).cast("string"), F.lit("-Q"), F.quarter(col(ts)).cast("string"))
