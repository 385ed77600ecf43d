"""News and announcement features for a panel's grid over an output date range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.calendar import build_calendar, grid_with_warmup
from barloom.operators.event_features import (
    announcement_features, announcements_on_days, daily_announcements, daily_news, index_grid, news_features,
    news_on_days)
from barloom.session import cut_lineage


def event_panel(panel: DataFrame, news: DataFrame | None = None, announcements: DataFrame | None = None, *,
                start=None, end=None, codes=None, classes=None, calendar: DataFrame | None = None) -> DataFrame:
    """One row per (trade_date, code) of the output range. Rolling windows see 20 trading days
    before it."""
    calendar = build_calendar(panel) if calendar is None else calendar
    if start is not None:
        calendar = cut_lineage(calendar)
    grid = index_grid(grid_with_warmup(panel, calendar, start, end, codes), calendar)
    if news is not None:
        grid = news_features(grid, daily_news(news_on_days(news, calendar)))
    if announcements is not None:
        kinds = (*(classes or {}), "other") if classes else None
        mapped = announcements_on_days(announcements, calendar, classes)
        daily = daily_announcements(mapped, kinds) if kinds else daily_announcements(mapped)
        grid = announcement_features(grid, daily, kinds) if kinds else announcement_features(grid, daily)
    if start is not None:
        grid = grid.where(F.col("trade_date") >= F.lit(start).cast("date"))
    return grid.drop("trade_idx")
