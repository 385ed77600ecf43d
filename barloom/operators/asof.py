"""As-of joins and joins from a signal to the bars that follow it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Row with the highest version per key: one map-side combined aggregation, no sort."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(*version) if len(version) > 1 else F.col(version[0])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def asof_left(left: DataFrame, right: DataFrame, *, left_ts: str, right_ts: str, values: Sequence[str],
              by: str = "code", strict: bool = True, max_age_days: int | None = None,
              tie: Sequence[str] = (), bucket: str | None = "year", left_unique: bool = False) -> DataFrame:
    """Newest right row before each left row (``strict`` excludes an equal time).

    Both sides are merged in time order, no range join. Time is cut into buckets (``bucket``:
    year, month, day): a window partition is one key in one bucket, and the last right row
    before the bucket is carried in from a small per-bucket summary. A key with a large share
    of the rows is therefore spread over its buckets. ``tie`` orders right rows of equal time.
    Values older than ``max_age_days`` become null; the match time stays as ``asof_ts``.

    Unless ``left_unique`` promises one left row per key and time, the distinct (key, time) pairs
    are resolved and attached by an equi join, so repeated left rows never meet in one window.
    """
    if not left_unique:
        keys = left.select(by, left_ts).distinct()
        found = asof_left(keys, right, left_ts=left_ts, right_ts=right_ts, values=values, by=by, strict=strict,
                          max_age_days=max_age_days, tie=tie, bucket=bucket, left_unique=True)
        return left.drop(*values).join(found, [by, left_ts], "left").select(
            *[c for c in left.columns if c not in values], "asof_ts", *values)
    facts = right.where(F.col(right_ts).isNotNull()).select(
        F.col(by), F.col(right_ts).cast("timestamp").alias("__ts"),
        F.struct(F.col(right_ts).cast("timestamp").alias("asof_ts"), *[F.col(v) for v in values]).alias("__fact"),
        *[F.col(t).alias(f"__tie_{t}") for t in tie])
    if tie:
        facts = latest_per_key(facts, [by, "__ts"], [f"__tie_{t}" for t in tie]).select(by, "__ts", "__fact")
    slot = F.trunc(F.to_date("__ts"), bucket) if bucket in ("year", "month") else (
        F.to_date("__ts") if bucket == "day" else F.lit(None).cast("date"))
    facts = facts.withColumn("__slot", slot)
    rows = left.withColumn("__ts", F.col(left_ts).cast("timestamp")).withColumn("__slot", slot)

    both = rows.withColumn("__side", F.lit(1)).unionByName(
        facts.withColumn("__side", F.lit(2 if strict else 0)), allowMissingColumns=True)
    frame = (Window.partitionBy(by, "__slot").orderBy("__ts", "__side")
             .rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__hit", F.last("__fact", ignorenulls=True).over(frame)).where(F.col("__side") == 1)

    if bucket:
        # last fact of each bucket, then the last one before each bucket that holds left rows
        closing = facts.groupBy(by, "__slot").agg(F.max_by("__fact", "__ts").alias("__closing"))
        slots = rows.select(by, "__slot").distinct().join(closing, [by, "__slot"], "full")
        before = Window.partitionBy(by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
        carried = slots.select(by, "__slot", F.last("__closing", ignorenulls=True).over(before).alias("__carried"))
        found = (found.join(carried, [by, "__slot"], "left")
                 .withColumn("__hit", F.coalesce("__hit", "__carried")))
    if max_age_days is not None:
        age = F.datediff(F.to_date("__ts"), F.to_date("__hit.asof_ts"))
        found = found.withColumn("__hit", F.when(age <= max_age_days, F.col("__hit")))
    names = [c for c in left.columns if c not in values]
    return found.select(*[F.col(c) for c in names], F.col("__hit.asof_ts").alias("asof_ts"),
                        *[F.col(f"__hit.{v}").alias(v) for v in values])


def number_bars(bars: DataFrame, by: str = "code", date: str = "trade_date") -> DataFrame:
    return bars.withColumn("bar_no", F.row_number().over(Window.partitionBy(by).orderBy(date)))


def next_bars(signals: DataFrame, bars: DataFrame, horizon: int, *, run_date: str = "run_date",
              by: str = "code", price: str = "close") -> DataFrame:
    """Entry on the first bar strictly after the signal date, exit ``horizon`` bars later.

    Works on distinct (code, date) pairs merged with the bars in date order, so its windows are
    bounded by the calendar however many signals a code has; the signals are then attached by
    an equi join. Entry or exit prices that are missing or not positive give null.
    """
    prices = bars.select(by, F.col("trade_date").alias("__day"), F.col(price).alias("__px"))
    order = Window.partitionBy(by).orderBy("__day")
    prices = prices.withColumn("__exit", F.lead("__px", horizon).over(order))
    asked = signals.select(F.col(by), F.col(run_date).cast("date").alias("__day")).distinct()
    both = prices.withColumn("__bar", F.struct(F.col("__day").alias("entry_date"), F.col("__px").alias("entry_price"),
                                               F.col("__exit").alias("exit_price"))).unionByName(
        asked.withColumn("__asked", F.lit(True)), allowMissingColumns=True)
    # newest first: the question stands before a bar of its own day, so only later bars precede
    # it (a running frame; one that reaches forward would be re-read for every row)
    later = (Window.partitionBy(by).orderBy(F.desc("__day"), F.col("__asked").desc_nulls_last())
             .rowsBetween(Window.unboundedPreceding, -1))
    entry = (both.withColumn("__next", F.last("__bar", ignorenulls=True).over(later))
             .where("__asked").select(by, "__day", "__next.*"))
    out = signals.withColumn("__day", F.col(run_date).cast("date")).join(entry, [by, "__day"], "left").drop("__day")
    good = (F.col("entry_price") > 0) & (F.col("exit_price") > 0)
    return out.withColumn("forward_return", F.when(good, (F.col("exit_price") / F.col("entry_price") - 1) * 100))


def following_bars(signals: DataFrame, bars: DataFrame, length: int, *, run_date: str = "run_date",
                   by: str = "code", slack_days: int = 7) -> DataFrame:
    """Reference bar on or after the signal date, then the extremes and last close of the next
    ``length`` bars, all within 3·length + 7 days of the signal."""
    order = Window.partitionBy(by).orderBy("trade_date")
    ahead = order.rowsBetween(1, length)
    pre = bars.select(
        by, F.col("trade_date").alias("__day"),
        F.struct(F.col("trade_date").alias("ref_date"), F.col("close").alias("ref_close"),
                 F.max(F.coalesce("high", F.lit(0.0))).over(ahead).alias("max_high"),
                 F.min(F.coalesce("low", F.lit(0.0))).over(ahead).alias("min_low"),
                 F.lead("close", length).over(order).alias("end_close"),
                 F.lead("trade_date", length).over(order).alias("end_date"),
                 ).alias("__bar"))
    asked = signals.select(F.col(by), F.col(run_date).cast("date").alias("__day")).distinct()
    both = pre.unionByName(asked.withColumn("__asked", F.lit(True)), allowMissingColumns=True)
    # newest first, a bar of the same day stands before the question
    onward = (Window.partitionBy(by).orderBy(F.desc("__day"), F.col("__asked").asc_nulls_first())
              .rowsBetween(Window.unboundedPreceding, -1))
    found = (both.withColumn("__ref", F.last("__bar", ignorenulls=True).over(onward))
             .where("__asked").select(by, "__day", "__ref.*"))
    limit = F.date_add("__day", length * 3 + slack_days)
    complete = F.col("end_date").isNotNull() & (F.col("end_date") <= limit)
    out = signals.withColumn("__day", F.col(run_date).cast("date")).join(found, [by, "__day"], "left")
    cols = ["ref_date", "ref_close", "max_high", "min_low", "end_close"]
    return out.withColumns({c: F.when(complete, F.col(c)) for c in cols}).drop("__day", "end_date")


def fill_missing_keys(primary: DataFrame, secondary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Primary rows, plus secondary rows for keys the primary lacks."""
    return primary.unionByName(secondary.join(primary.select(*keys).distinct(), list(keys), "left_anti"),
                               allowMissingColumns=True)
