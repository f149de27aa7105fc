"""Time columns: parsing ladders, periods and their labels, bounds of text windows. All naive, in UTC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Text formats that are tried after ISO, in this order.
FORMATS = (
    "MM/dd/yyyy hh:mm:ss a", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm", "MM/dd/yyyy", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy",
    "dd-MMM-yyyy", "dd MMM yyyy", "MMM dd, yyyy", "MMMM dd, yyyy", "yyyyMMdd", "yyyyMMdd HH:mm:ss", "yyyy-MM", "MMM yyyy",
)
UNITS = ("hour", "day", "week", "month", "quarter", "year")


def in_years(ts: Column) -> Column:
    """The timestamp, or null outside the years 1678 to 2262."""
    return F.when(F.year(ts).between(1678, 2262), ts)


def from_number(value: Column) -> Column:
    """Timestamp from a number: a year, YYYYMMDD, epoch seconds or epoch milliseconds, by its size; else null."""
    v = value.cast("double")
    whole = v.cast("long")
    year = F.try_to_timestamp(F.lpad(whole.cast("string"), 4, "0"), F.lit("yyyy"))
    day = F.try_to_timestamp(whole.cast("string"), F.lit("yyyyMMdd"))
    ts = (
        F.when(v.between(1000, 3000), year).when(v.between(10000101, 30001231), day)
        .when(v.between(1e8, 1e11), F.timestamp_seconds(v)).when(v.between(1e11, 1e14), F.timestamp_millis(whole))
    )
    return in_years(ts.cast("timestamp_ntz"))


def iso(text: Column) -> Column:
    """ISO text to naive UTC, offsets applied; else null."""
    shaped = F.when(F.trim(text).rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), F.trim(text))
    return in_years(shaped.try_cast("timestamp").cast("timestamp_ntz"))


def parse_text(df: DataFrame, column: str, out: str = "parsed") -> tuple[DataFrame, str]:
    """``df`` with the column read by the one format that reads most of its rows, and that format's name.

    All formats are tried in a single aggregate; the choice is one row on the driver. Ties go to the earlier.
    """
    tries = {"iso": iso(F.col(column))} | {f: in_years(F.try_to_timestamp(F.trim(column), F.lit(f)).cast("timestamp_ntz")) for f in FORMATS}
    row = df.agg(*[F.count(c).alias(f"c{k}") for k, c in enumerate(tries.values())]).first()
    best = max(range(len(tries)), key=lambda k: (row[k], -k))
    name = list(tries)[best]
    return df.withColumn(out, tries[name]), name


def period_start(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def period_label(ts: Column, unit: str) -> Column:
    """Text of a period: hours to the minute, weeks by their Monday, quarters as YYYYQn."""
    if unit == "quarter":
        return F.concat(F.year(ts), F.lit("Q"), F.quarter(ts))
    form = {"hour": "yyyy-MM-dd HH:00", "day": "yyyy-MM-dd", "week": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}[unit]
    return F.date_format(F.date_trunc(unit, ts), form)


def bound(text: Column, is_end: bool) -> Column:
    """First or last microsecond of the period that a text names by its precision; null if it names none."""
    t = F.trim(text)
    start = (
        F.when(t.rlike(r"^\d{4}$"), F.try_to_timestamp(F.concat(t, F.lit("-01-01"))))
        .when(t.rlike(r"^\d{4}-\d{2}$"), F.try_to_timestamp(F.concat(t, F.lit("-01"))))
        .when(t.rlike(r"^\d{4}[qQ][1-4]$"), F.try_to_timestamp(F.concat(F.substring(t, 1, 4), F.lit("-"), F.lpad((F.substring(t, 6, 1).try_cast("int") * 3 - 2).cast("string"), 2, "0"), F.lit("-01"))))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_timestamp(t))
    )
    if not is_end:
        return start.cast("timestamp_ntz")
    end = (
        F.when(t.rlike(r"^\d{4}$"), start + F.expr("INTERVAL 1 YEAR")).when(t.rlike(r"^\d{4}-\d{2}$"), start + F.expr("INTERVAL 1 MONTH"))
        .when(t.rlike(r"^\d{4}[qQ][1-4]$"), start + F.expr("INTERVAL 3 MONTH")).when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), start + F.expr("INTERVAL 1 DAY"))
    )
    return F.coalesce(end - F.expr("INTERVAL 1 MICROSECOND"), start).cast("timestamp_ntz")


def granularity(df: DataFrame, ts: str) -> DataFrame:
    """One row: the finest unit used, first and last time, and how many rows have one."""
    at = F.col(ts)
    finest = (
        F.when(F.max((F.second(at) != 0).cast("int")) == 1, "second").when(F.max((F.minute(at) != 0).cast("int")) == 1, "minute")
        .when(F.max((F.hour(at) != 0).cast("int")) == 1, "hour").when(F.max((F.dayofmonth(at) != 1).cast("int")) == 1, "day")
        .when(F.max((F.month(at) != 1).cast("int")) == 1, "month").otherwise("year")
    )
    return df.agg(finest.alias("granularity"), F.min(at).alias("first"), F.max(at).alias("last"), F.count(at).alias("n"))
