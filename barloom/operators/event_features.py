"""Point-in-time news and announcement features on an instrument-by-trading-day grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.dates import visible_time
from barloom.functions.text import ANNOUNCEMENT_CLASSES, keyword_class
from barloom.operators.calendar import map_to_trading_day
from barloom.operators.rolling import rows_window

NEWS_WINDOWS = (1, 3, 7)
POSITIVE, NEGATIVE = 0.08, -0.08


def news_on_days(news: DataFrame, calendar: DataFrame) -> DataFrame:
    """News mapped to the trading day on which it was visible (rows never visible are dropped)."""
    seen = news.withColumn("visible_at", F.coalesce("available_at", "fetched_at")).where(F.col("visible_at").isNotNull())
    return map_to_trading_day(seen, calendar, "visible_at")


def announcements_on_days(announcements: DataFrame, calendar: DataFrame,
                          classes: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    seen = announcements.withColumns({
        "visible_at": visible_time("published_at"),
        "ann_type": keyword_class("title", classes),
    }).where(F.col("published_at").isNotNull())
    return map_to_trading_day(seen, calendar, "visible_at")


def daily_news(mapped: DataFrame) -> DataFrame:
    """One row per (code, day). The rollup combines map-side, so one busy code or source
    does not load a single task."""
    score = F.col("score")
    return mapped.groupBy("code", F.col("feature_date").alias("trade_date")).agg(
        F.count("*").alias("news_event_count"),
        F.count(score).alias("news_scored_count"),
        F.coalesce(F.sum(score), F.lit(0.0)).alias("news_score_sum"),
        F.count_if(score > POSITIVE).alias("news_pos_daily"),
        F.count_if(score < NEGATIVE).alias("news_neg_daily"),
        F.max(F.abs(score)).alias("news_absmax_daily"))


def daily_announcements(mapped: DataFrame, kinds: Sequence[str] = (*ANNOUNCEMENT_CLASSES, "other")) -> DataFrame:
    return mapped.groupBy("code", F.col("feature_date").alias("trade_date")).agg(
        F.count("*").alias("ann_event_count"),
        *[F.count_if(F.col("ann_type") == k).alias(f"ann_{k}") for k in kinds])


def index_grid(grid: DataFrame, calendar: DataFrame) -> DataFrame:
    return grid.join(F.broadcast(calendar.select("trade_date", F.col("idx").alias("trade_idx"))), "trade_date")  # one row per date


def _recent(col: str | Column, w: int, how=F.sum) -> Column:
    return how(col).over(rows_window().rowsBetween(-(w - 1), 0))


def _age(count_col: str, limit: int) -> Column:
    seen = F.when(F.col(count_col) > 0, F.col("trade_idx"))
    last = F.last(seen, ignorenulls=True).over(rows_window().rowsBetween(Window.unboundedPreceding, 0))
    age = F.col("trade_idx") - last
    return F.when(age <= limit, age)


def news_features(grid: DataFrame, daily: DataFrame) -> DataFrame:
    """Nine news features per grid row (grid needs ``trade_idx``)."""
    counts = ["news_event_count", "news_scored_count", "news_score_sum", "news_pos_daily", "news_neg_daily"]
    df = grid.join(daily, ["code", "trade_date"], "left").fillna(0, subset=counts)
    scores = {}
    for w in NEWS_WINDOWS:
        scored = _recent("news_scored_count", w)
        scores[f"news_score_{w}d"] = F.when(scored > 0, F.try_divide(_recent("news_score_sum", w), scored))
    return df.withColumns({
        **scores,
        "news_count_7d": _recent("news_event_count", 7),
        "news_pos_count_7d": _recent("news_pos_daily", 7),
        "news_neg_count_7d": _recent("news_neg_daily", 7),
        "news_absmax_7d": _recent("news_absmax_daily", 7, F.max),
        "news_latest_age_days": _age("news_event_count", 7),
    }).withColumn("has_news_7d", (F.col("news_count_7d") > 0).cast("int")).drop(*counts, "news_absmax_daily")


def announcement_features(grid: DataFrame, daily: DataFrame,
                          kinds: Sequence[str] = (*ANNOUNCEMENT_CLASSES, "other")) -> DataFrame:
    """Counts over 7 and 20 trading-day rows, per class over 20, and the age of the newest one."""
    cols = ["ann_event_count", *[f"ann_{k}" for k in kinds]]
    df = grid.join(daily, ["code", "trade_date"], "left").fillna(0, subset=cols)
    return df.withColumns({
        "ann_count_7d": _recent("ann_event_count", 7),
        "ann_count_20d": _recent("ann_event_count", 20),
        "ann_latest_age_days": _age("ann_event_count", 20),
        **{f"ann_{k}_count_20d": _recent(f"ann_{k}", 20) for k in kinds},
    }).withColumn("has_ann_7d", (F.col("ann_count_7d") > 0).cast("int")).drop(*cols)
