"""Schemas of the canonical tables, as DDL (usable for readers as they are)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

BARS = (
    "code string, trade_date date, open double, high double, low double, close double, volume double, amount double")
QUOTES = (
    "code string, name string, open double, high double, low double, close double, volume double, pct_change double, "
    "quote_time timestamp, outer_volume double, inner_volume double, buy_volume_5 double, sell_volume_5 double")
NEWS = (
    "code string, title string, content string, source string, ts timestamp, score double, fetched_at timestamp, "
    "available_at timestamp, sentiment_model_version string")
ANNOUNCEMENTS = (
    "source string, announcement_id string, code string, name string, title string, published_at timestamp, "
    "url string, org_id string, fetched_at timestamp")
FETCH_PROGRESS = (
    "code string, chunk_start date, chunk_end date, status string, attempts int, fetched_count int, error string, "
    "updated_at timestamp")
FUNDAMENTALS = (
    "code string, available_at timestamp, report_period date, ocf_to_eps double, roe double, gross_margin double")
SIGNALS = (
    "id bigint, run_id string, run_ts timestamp, code string, name string, action string, confidence double, "
    "raw_confidence double, calibrated_confidence double, target_price double, stop_loss double, "
    "reasons array<string>, risks array<string>, resolved_at timestamp, success int, one_liner string")
CALIBRATION_MODELS = (
    "action string, trained_at timestamp, sample_size bigint, coef double, intercept double, auc double, notes string")
POSITIONS = (
    "user_id string, code string, name string, buy_price double, quantity double, stop_loss double, "
    "target_price double, status string, opened_at timestamp, closed_at timestamp, last_notified_at timestamp")
PRICE_ALERTS = (
    "alert_id string, user_id string, code string, trigger_price double, direction string, status string, "
    "created_at timestamp, last_notified_at timestamp")


def check(df: DataFrame, ddl: str) -> DataFrame:
    """Raise on a missing column or another type; extra columns are allowed."""
    schema = T.StructType.fromDDL(ddl)
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name)} is not {f.dataType.simpleString()}" for f in schema
             if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("; ".join(wrong))
    return df
