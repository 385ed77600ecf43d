"""Watch rules on streams: alerts once a day, news once per key, ticks to bars."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.dates import after_close, session_open
from barloom.functions.rules import (
    enabled_levels, heavy_sell_pressure, news_level, position_alert, price_alert_level, price_triggered, sentiment_direction)
from barloom.functions.text import is_major_news, news_key


def in_session(quotes: DataFrame, ts: str = "quote_time") -> DataFrame:
    return quotes.where(session_open(ts))


def triggered_alerts(quotes: DataFrame, alerts: DataFrame, *, ts: str = "quote_time") -> DataFrame:
    """Quotes meeting a price alert (stream-static join, or batch). Alerts already notified on
    the quote's day are silent."""
    df = quotes.join(alerts.where(F.col("status") == "active").drop("status"), "code")
    quiet = F.coalesce(F.to_date("last_notified_at") == F.to_date(ts), F.lit(False))
    heavy = heavy_sell_pressure("buy_volume_5", "sell_volume_5", "outer_volume", "inner_volume", "pct_change")
    hit = df.where(~quiet & price_triggered("close", "trigger_price", "direction"))
    return hit.select("alert_id", "code", F.col(ts).alias("at"), F.col("close").alias("price"), "trigger_price",
                      "direction", price_alert_level("direction", heavy).alias("level"))


def triggered_positions(quotes: DataFrame, positions: DataFrame, *, ts: str = "quote_time") -> DataFrame:
    """Quotes meeting a position rule. Positions carry the latest signal (action, confidence)."""
    df = quotes.join(positions.where(F.col("status") == "active").drop("status"), "code")
    reason = position_alert("close", "stop_loss", "target_price", "action", "confidence", "last_notified_at", F.to_date(ts))
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "alert_id", "code", F.col(ts).alias("at"), F.col("close").alias("price"), "reason")


def first_per_day(hits: DataFrame, key: str = "alert_id", at: str = "at") -> DataFrame:
    """Batch twin of ``once_a_day``: the earliest hit of a key on each day."""
    rest = [c for c in hits.columns if c != key]
    day = F.to_date(at).alias("day")
    return hits.groupBy(key, day).agg(F.min_by(F.struct(*rest), at).alias("r")).select(key, "r.*")


def once_a_day(hits: DataFrame, key: str = "alert_id", at: str = "at", delay: str = "2 days") -> DataFrame:
    """At most one notice per key and day: the first one to arrive. Keyed state is dropped once
    the watermark has passed the day."""
    return (hits.withColumn("day", F.to_date(at)).withWatermark(at, delay)
            .dropDuplicatesWithinWatermark([key, "day"]))


def classify_news(news: DataFrame, *, code: str = "code", ts: str = "ts", title: str = "title",
                  score: str = "score") -> DataFrame:
    """Event key, kind (major_news or news_seen), direction and level of each item."""
    major = is_major_news(title, score)
    return news.withColumns({
        "event_key": news_key(code, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), title),
        "kind": F.when(major, "major_news").otherwise("news_seen"),
        "direction": sentiment_direction(F.coalesce(score, F.lit(0.0))),
        "level": F.when(major, news_level(score)),
    })


def new_items(items: DataFrame, *, key: str = "event_key", ts: str = "ts", delay: str = "1 day") -> DataFrame:
    """Each key once within the delay (the source's own id for messages, the item key for news)."""
    return items.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def news_outcome(levels: Iterable[str] | str = "critical,warning,info") -> Column:
    """What becomes of a classified item: major_news (told), news_filtered (major, but its level is switched off) or news_seen."""
    told = F.col("level").isin(*enabled_levels(levels))
    return F.when(F.col("kind") != "major_news", "news_seen").when(told, "major_news").otherwise("news_filtered")


LEDGER = "event_key string, code string, ts timestamp, title string, score double, direction string, level string, outcome string, day date, batch_id bigint"


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The ledger of a news scan; empty where nothing was written yet."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").partitionBy("day", "batch_id").parquet(folder)
    return spark.read.schema(LEDGER).parquet(folder)


def news_batches(folder: str, handle: Callable[[DataFrame], None] | None = None, *,
                 levels: Iterable[str] | str = "critical,warning,info") -> Callable[[DataFrame, int], None]:
    """foreachBatch body of the news scan: every item not yet in the ledger gets one of three outcomes and is entered.

    The ledger is the state across batches. Its partitions are (day of the item, batch): an item's key holds its time,
    so a batch is compared with the days it holds only, and a batch that comes again (after a failure between writing
    and committing) leaves its own earlier entries out of the comparison and writes the same partitions over. Nothing
    is lost or entered twice, however late it comes. ``handle`` gets the batch's new major items that are told; after a
    failure it may get them again, under the same ``event_key``.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        items = classify_news(batch).select("event_key", "code", "ts", "title", "score", "direction", "level", "kind")
        once = items.groupBy("event_key").agg(F.min(F.struct("code", "ts", "title", "score", "direction", "level", "kind")).alias("r")).select("event_key", "r.*")
        once = once.withColumn("day", F.to_date("ts"))
        known = read_ledger(spark, folder).where(F.col("batch_id") != batch_id).select("day", "event_key")
        fresh = once.join(known, ["day", "event_key"], "left_anti")
        rows = fresh.withColumns({"outcome": news_outcome(levels), "batch_id": F.lit(batch_id).cast("bigint")}).drop("kind")
        (rows.select(*[c.split()[0] for c in LEDGER.split(", ")]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day", "batch_id").parquet(folder))
        if handle is not None:
            handle(read_ledger(spark, folder).where((F.col("batch_id") == batch_id) & (F.col("outcome") == "major_news")))
    return run


def close_summary(now_ts, ledger: DataFrame, pushed: DataFrame, decisions: DataFrame) -> DataFrame:
    """One summary row after the close, once a day and only when nothing was pushed."""
    now = F.lit(now_ts).cast("timestamp")
    counts = decisions.agg(F.count("*").alias("checked"), F.count_if(F.col("action") == "HOLD").alias("holding"))
    due = counts.withColumn("event_key", F.concat(F.lit("after_close_summary:"), F.to_date(now).cast("string")))
    due = due.where(after_close(now)).join(ledger.select("event_key"), "event_key", "left_anti")
    any_push = pushed.limit(1).select(F.lit(1).alias("one"))
    return due.withColumn("one", F.lit(1)).join(any_push, "one", "left_anti").drop("one")


def tick_bars(ticks: DataFrame, closes: DataFrame | None = None, *, delay: str = "1 hour", ts: str = "ts", price: str = "price",
              size: str = "size", order: str = "event_id") -> DataFrame:
    """Daily bars from ticks: windowed aggregation with a watermark, append mode.

    A day's bar comes out once, when the watermark (newest time seen, less ``delay``) has passed the day. ``closes`` is a
    stream of times alone, such as closing notices: they move the watermark without being ticks, so a day, the last one
    too, closes without a later tick. A tick up to ``delay`` behind the newest time counts; one that is later still
    counts while its day is open, and is dropped after."""
    if closes is not None:
        ticks = ticks.unionByName(closes.select(F.col(ts)), allowMissingColumns=True)
    at = F.struct(ts, order)
    # the condition reads the time, so the optimizer keeps it above the watermark, which closing notices must reach
    is_tick = F.when(F.col("code").isNotNull(), F.col(ts)).isNotNull()
    return (ticks.withWatermark(ts, delay).where(is_tick).groupBy(F.window(ts, "1 day"), "code").agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, at).alias("close"), F.sum(size).alias("volume"), F.sum(F.col(price) * F.col(size)).alias("amount"))
        .select("code", F.to_date("window.start").alias("trade_date"), "open", "high", "low", "close", "volume", "amount"))
