import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators.asof import asof_left, following_bars, next_bars
from barloom.operators.calendar import build_calendar, calendar_or_fallback, map_to_trading_day, weekday_calendar
from barloom.operators.event_features import announcements_on_days
from barloom.operators.labels import benchmark_forward
from barloom.operators.regime import current_trend, trend_flags
from barloom.plans.event_panel import event_panel


def d(s):
    return dt.date.fromisoformat(s)


def ts(s):
    return dt.datetime.fromisoformat(s)


DAYS = [d(x) for x in ("2024-01-02", "2024-01-03", "2024-01-04", "2024-01-05", "2024-01-08", "2024-01-09")]


@pytest.fixture
def calendar(spark):
    return build_calendar(spark.createDataFrame([(x,) for x in DAYS], "trade_date date"))


@pytest.mark.parametrize("stamp,day", [
    ("2024-01-03 14:59:59", "2024-01-03"), ("2024-01-03 15:00:00", "2024-01-03"), ("2024-01-03 15:00:01", "2024-01-04"),
    ("2024-01-06 10:00:00", "2024-01-08"), ("2024-01-09 15:00:01", None), ("2024-01-01 10:00:00", None),
    ("2024-01-05 16:00:00", "2024-01-08")])
def test_usable_day(spark, calendar, stamp, day):
    rows = map_to_trading_day(spark.createDataFrame([(ts(stamp),)], "at timestamp"), calendar, "at").collect()
    assert [r.feature_date for r in rows] == ([d(day)] if day else [])


def test_midnight_filing_counts_from_the_next_day(spark, calendar):
    rows = spark.createDataFrame([("1", "年度报告", ts("2024-01-03 00:00:00"))], "code string, title string, published_at timestamp")
    got = announcements_on_days(rows, calendar).collect()[0]
    assert (got.feature_date, got.ann_type) == (d("2024-01-04"), "earnings")


def test_shifted_news_shifts_the_feature_by_one_trading_day(spark, calendar):
    grid = spark.createDataFrame([(x, "1") for x in DAYS], "trade_date date, code string")

    def first_day(stamp):
        news = spark.createDataFrame([("1", ts(stamp), None, 0.7, "t")], "code string, available_at timestamp, fetched_at timestamp, score double, title string")
        df = event_panel(grid, news, calendar=calendar).where("has_news_7d = 1")
        return df.agg(F.min("trade_date")).first()[0]

    assert first_day("2024-01-03 10:00:00") == d("2024-01-03")
    assert first_day("2024-01-04 10:00:00") == d("2024-01-04")
    assert first_day("2024-01-05 15:30:00") == d("2024-01-08")


def test_weekday_calendar_and_fallback(spark):
    span = spark.createDataFrame([(d("2026-04-01"), d("2026-04-08"))], "start date, end date")
    days = [r.trade_date for r in weekday_calendar(span).orderBy("idx").collect()]
    assert days == [d("2026-04-01"), d("2026-04-02"), d("2026-04-07"), d("2026-04-08")]
    listed = spark.createDataFrame([(d("2026-04-03"),), (d("2026-04-04"),)], "trade_date date")
    got = [r.trade_date for r in calendar_or_fallback(listed, span).orderBy("idx").collect()]
    assert got == [d("2026-04-03"), d("2026-04-07"), d("2026-04-08")]


def test_asof_is_strict_and_goes_stale(spark):
    panel = spark.createDataFrame([("1", d("2020-01-01")), ("1", d("2020-01-02")), ("1", d("2021-02-04")), ("1", d("2021-02-05"))], "code string, trade_date date")
    facts = spark.createDataFrame([("1", ts("2020-01-01 00:00:00"), 0.5)], "code string, at timestamp, v double")
    got = asof_left(panel, facts, left_ts="trade_date", right_ts="at", values=["v"], max_age_days=400)
    assert [r.v for r in got.orderBy("trade_date").collect()] == [None, 0.5, 0.5, None]


@pytest.mark.parametrize("bucket", [None, "year", "month", "day"])
@pytest.mark.parametrize("strict", [True, False])
def test_asof_against_brute_force(spark, bucket, strict):
    rng = random.Random(5)
    at = [ts("2020-01-01") + dt.timedelta(hours=rng.randrange(24 * 700)) for _ in range(120)]
    # one hot key, equal times, several facts at one time
    left = [(("a" if i % 3 else "b"), at[rng.randrange(120)], i) for i in range(150)]
    right = [(("a" if i % 3 else "c"), at[rng.randrange(120)], i, float(i)) for i in range(90)]
    got = asof_left(spark.createDataFrame(left, "code string, t timestamp, id int"),
                    spark.createDataFrame(right, "code string, u timestamp, k int, v double"),
                    left_ts="t", right_ts="u", values=["v"], strict=strict, tie=["k"], bucket=bucket)
    want = {}
    for code, t, i in left:
        ok = [(u, k, v) for c, u, k, v in right if c == code and (u < t or (not strict and u == t))]
        want[i] = max(ok)[2] if ok else None
    assert {r.id: r.v for r in got.collect()} == want


def test_entry_is_the_next_bar(spark):
    bars = spark.createDataFrame([("1", d(f"2024-01-0{i + 1}"), 10.0 + i, 10.0 + i, 10.0 + i) for i in range(4)],
                                 "code string, trade_date date, close double, high double, low double")
    signals = spark.createDataFrame([("1", d("2024-01-01"), 1), ("1", d("2024-01-04"), 2), ("1", d("2023-12-31"), 3)], "code string, run_date date, id int")
    got = {r.id: r.forward_return for r in next_bars(signals, bars, 1).collect()}
    assert got[1] == pytest.approx((12 / 11 - 1) * 100) and got[2] is None and got[3] == pytest.approx(10.0)
    after = {r.id: (r.ref_close, r.max_high, r.end_close) for r in following_bars(signals, bars, 2).collect()}
    assert after == {1: (10.0, 12.0, 12.0), 2: (None, None, None), 3: (10.0, 12.0, 12.0)}


def test_benchmark_follows_the_holding_period(spark):
    market = spark.createDataFrame([(d(f"2024-01-{i + 1:02d}"), 10.0 + i) for i in range(10)], "trade_date date, close double")
    assert benchmark_forward(market, 5).orderBy("trade_date").first().bench_return == pytest.approx(0.5)


@pytest.mark.parametrize("step,trend", [(1.0, "bull"), (-1.0, "bear")])
def test_trend(spark, step, trend):
    rows = [(d("2023-01-01") + dt.timedelta(days=i), 1000 + step * i) for i in range(250)]
    market = spark.createDataFrame(rows, "trade_date date, close double")
    assert current_trend(market).first().trend == trend
    assert not trend_flags(market).orderBy("trade_date").first().bull
    assert current_trend(market.limit(100)).first().trend == "bull"
