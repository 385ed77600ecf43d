"""Dates and timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.numeric import as_col

LOCAL_ZONE = "Asia/Shanghai"


def loose_date(c: Column | str) -> Column:
    """YYYYMMDD or YYYY-MM-DD text to a date, null when unreadable."""
    return F.to_date(F.try_to_timestamp(F.replace(as_col(c).cast("string"), F.lit("-"), F.lit("")), F.lit("yyyyMMdd")))


def loose_timestamp(c: Column | str) -> Column:
    """Seconds, minutes, days or ISO text; null (never *now*) when unreadable."""
    c = F.trim(as_col(c).cast("string"))
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats], c.try_cast("timestamp"))


def epoch_ms_local(c: Column | str, zone: str = LOCAL_ZONE) -> Column:
    """Epoch milliseconds to the wall clock of a zone. Right whatever the session zone is."""
    stamp = F.timestamp_millis(as_col(c).cast("bigint"))
    return F.convert_timezone(F.current_timezone(), F.lit(zone), stamp.cast("timestamp_ntz"))


def visible_time(ts: Column | str) -> Column:
    """A stamp of exactly midnight only names a day: treat it as just after the 15:00 cutoff."""
    ts = as_col(ts)
    midnight = ts == F.date_trunc("day", ts)
    return F.when(midnight, ts + F.expr("INTERVAL '15:00:01' HOUR TO SECOND")).otherwise(ts)


def session_open(ts: Column | str) -> Column:
    """Weekday between 09:25 and 11:30 or 13:00 and 15:00."""
    ts = as_col(ts)
    minute = F.hour(ts) * 60 + F.minute(ts)
    weekday = ~F.dayofweek(ts).isin(1, 7)
    return weekday & (minute.between(9 * 60 + 25, 11 * 60 + 30) | minute.between(13 * 60, 15 * 60))


def after_close(ts: Column | str) -> Column:
    ts = as_col(ts)
    return ~F.dayofweek(ts).isin(1, 7) & (F.hour(ts) * 60 + F.minute(ts) >= 15 * 60)


def age_days(now: Column, ts: Column | str) -> Column:
    return (F.unix_micros(now) - F.unix_micros(as_col(ts))) / F.lit(86_400_000_000.0)


def month_chunks(ranges: DataFrame, months: int = 1, start: str = "start", end: str = "end") -> DataFrame:
    """Split each [start, end] into pieces of whole months counted from start."""
    step = max(1, months)
    n = F.floor(F.months_between(F.col(end), F.col(start)) / step).cast("int") + 1
    df = ranges.withColumn("__k", F.explode(F.sequence(F.lit(0), n)))
    df = df.withColumns({
        "chunk_start": F.add_months(F.col(start), F.col("__k") * step),
        "chunk_end": F.least(F.date_sub(F.add_months(F.col(start), (F.col("__k") + 1) * step), 1), F.col(end)),
    })
    return df.where(F.col("chunk_start") <= F.col(end)).drop("__k")


def day_chunks(ranges: DataFrame, days: int, start: str = "start", end: str = "end") -> DataFrame:
    """Split each [start, end] into pieces of ``days`` days."""
    step = max(1, days)
    df = ranges.withColumn("chunk_start", F.explode(
        F.sequence(F.col(start), F.col(end), F.expr(f"INTERVAL {step} DAYS"))))
    return df.withColumn("chunk_end", F.least(F.date_add("chunk_start", step - 1), F.col(end)))


def quarter_ends(ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Every quarter end within [start, end]."""
    first = F.trunc(F.col(start), "quarter")
    df = ranges.withColumn("quarter_end", F.explode(
        F.sequence(first, F.trunc(F.col(end), "quarter"), F.expr("INTERVAL 3 MONTHS"))))
    df = df.withColumn("quarter_end", F.last_day(F.add_months("quarter_end", 2)))
    return df.where(F.col("quarter_end").between(F.col(start), F.col(end)))
