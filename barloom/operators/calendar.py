"""Trading calendar. Calendars hold one row per day, so their ordered windows run in one
partition by construction; they never see panel rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import as_col

# Exchange holidays used when no calendar source is at hand.
HOLIDAYS = (
    "2026-01-01", "2026-01-02", "2026-01-26", "2026-01-27", "2026-01-28",
    "2026-01-29", "2026-01-30", "2026-01-31", "2026-02-01", "2026-02-02",
    "2026-04-03", "2026-04-04", "2026-04-05", "2026-04-06",
    "2026-05-01", "2026-05-02", "2026-05-03", "2026-05-04", "2026-05-05",
    "2026-06-22", "2026-06-23", "2026-06-24", "2026-06-25",
    "2026-09-28", "2026-09-29", "2026-09-30", "2026-10-01",
    "2026-10-02", "2026-10-03", "2026-10-04", "2026-10-05", "2026-10-06",
    "2026-10-07", "2026-10-08",
    "2027-01-01", "2027-01-02", "2027-01-03",
    "2027-02-15", "2027-02-16", "2027-02-17", "2027-02-18",
    "2027-02-19", "2027-02-20", "2027-02-21",
    "2027-04-05", "2027-04-06",
    "2027-05-01", "2027-05-02", "2027-05-03", "2027-05-04", "2027-05-05",
    "2027-06-19", "2027-06-20", "2027-06-21",
    "2027-10-01", "2027-10-02", "2027-10-03", "2027-10-04",
    "2027-10-05", "2027-10-06", "2027-10-07",
)


def build_calendar(panel: DataFrame, date: str = "trade_date") -> DataFrame:
    """Distinct dates with a 0-based index."""
    days = panel.select(F.col(date).alias("trade_date")).where(F.col(date).isNotNull()).distinct()
    return days.withColumn("idx", F.row_number().over(Window.orderBy("trade_date")) - 1)


def weekday_calendar(spans: DataFrame, holidays: Iterable[str] = HOLIDAYS, *, start: str = "start",
                     end: str = "end") -> DataFrame:
    """Weekdays between two dates except holidays; the fallback without a calendar source."""
    closed = [F.lit(h).cast("date") for h in holidays]
    days = spans.select(F.explode(F.sequence(F.col(start), F.col(end), F.expr("INTERVAL 1 DAY"))).alias("trade_date"))
    days = days.where(~F.dayofweek("trade_date").isin(1, 7))
    if closed:
        days = days.where(~F.col("trade_date").isin(*closed))
    return build_calendar(days)


def calendar_or_fallback(listed: DataFrame, spans: DataFrame, holidays: Iterable[str] = HOLIDAYS) -> DataFrame:
    """Listed trading days (weekends are always closed); days after the last listed one come
    from the weekday rule."""
    listed = listed.where(~F.dayofweek("trade_date").isin(1, 7)).select("trade_date").distinct()
    last = listed.agg(F.max("trade_date")).first()[0]
    rest = weekday_calendar(spans, holidays).select("trade_date")
    if last is not None:
        rest = rest.where(F.col("trade_date") > F.lit(last))
    return build_calendar(listed.unionByName(rest))


def calendar_map(calendar: DataFrame) -> DataFrame:
    """Every calendar day from the first to the last trading day: the trading day it belongs
    to (itself or the next one) and the trading day after that day."""
    span = calendar.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 DAY"))).alias("day"))
    marked = days.join(calendar.select(F.col("trade_date").alias("day"), F.col("trade_date")), "day", "left")
    order = Window.orderBy(F.desc("day"))
    ahead = F.last("trade_date", ignorenulls=True)
    return marked.select(
        "day",
        F.col("trade_date").isNotNull().alias("open_day"),
        ahead.over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("this_or_next"),
        ahead.over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("next_day"))


def map_to_trading_day(events: DataFrame, calendar: DataFrame, ts: str, cutoff: str = "15:00:00",
                       name: str = "feature_date") -> DataFrame:
    """Trading day on which an event is usable: same day up to the cutoff (inclusive), else
    the next one. Events outside the calendar are dropped. An equi join on the day; the map has one row per calendar
    day between the first and the last trading day (36,525 a century), so it is broadcast and raw events stay where they are."""
    stamp = as_col(ts)
    in_time = stamp <= F.to_timestamp(F.concat_ws(" ", F.col("day").cast("string"), F.lit(cutoff))).cast(
        events.schema[ts].dataType)
    joined = events.withColumn("day", F.to_date(stamp)).join(F.broadcast(calendar_map(calendar)), "day")
    target = (F.when(~F.col("open_day"), F.col("this_or_next"))
              .when(in_time, F.col("day")).otherwise(F.col("next_day")))
    return (joined.withColumn(name, target).where(F.col(name).isNotNull())
            .drop("day", "open_day", "this_or_next", "next_day"))


def warmup_start(calendar: DataFrame, start, rows: int):
    """Trading day ``rows`` before the first trading day on or after ``start`` (one value)."""
    begin = F.lit(start).cast("date")
    first = calendar.where(F.col("trade_date") >= begin).agg(F.min("idx")).first()[0]
    if first is None:
        return None
    return calendar.where(F.col("idx") >= max(0, first - rows)).agg(F.min("trade_date")).first()[0]


def grid_with_warmup(panel: DataFrame, calendar: DataFrame, start=None, end=None, codes: Iterable[str] | None = None,
                     rows: int = 20) -> DataFrame:
    """(trade_date, code) grid for an output range plus the rows before it that rolling
    features need. The date bound is a literal, so it reaches the scan."""
    grid = panel.select("trade_date", "code").distinct()
    if codes is not None:
        grid = grid.where(F.col("code").isin(*list(codes)))
    if start is not None:
        grid = grid.where(F.col("trade_date") >= F.lit(warmup_start(calendar, start, rows)))
    if end is not None:
        grid = grid.where(F.col("trade_date") <= F.lit(end).cast("date"))
    return grid
