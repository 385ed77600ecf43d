"""Canonical tables (bars, news, signals, ...) derived from a folder of sales and event tables.

Instrument = supplier, price = line price per unit, one bar per supplier and ship date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.asof import following_bars
from barloom.operators.calendar import build_calendar, weekday_calendar
from barloom.session import tune


class DriverTables:
    """Reads the folder's parquet tables and derives the canonical views from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        tune(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def bars(self, *, key: str = "l_suppkey") -> DataFrame:
        """One bar per key and ship date. The rollup is the only pass over raw lines and it
        combines map-side, so a supplier with a third of all lines is no hot spot."""
        li = self.table("lineitem").select(
            F.lpad(F.col(key).cast("string"), 6, "0").alias("code"),
            F.to_date("l_shipdate").alias("trade_date"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"),
            "l_quantity", "l_extendedprice",
            F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("k"))
        return li.groupBy("code", "trade_date").agg(
            F.min_by("p", "k").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
            F.max_by("p", "k").alias("close"), F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount"))

    def market_bars(self) -> DataFrame:
        """One series over all lines: close is the volume-weighted price of the date."""
        li = self.table("lineitem").select(
            F.to_date("l_shipdate").alias("trade_date"), "l_quantity", "l_extendedprice",
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
        return li.groupBy("trade_date").agg(
            F.min("p").alias("low"), F.max("p").alias("high"), F.sum("l_quantity").alias("volume"),
            F.sum("l_extendedprice").alias("amount")).withColumn("close", F.col("amount") / F.col("volume"))

    def calendar(self) -> DataFrame:
        return build_calendar(self.table("lineitem").select(F.to_date("l_shipdate").alias("trade_date")))

    def sectors(self) -> DataFrame:
        """Sector of a supplier = region of its nation."""
        nation = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
            F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.col("r_name").alias("sector"))

    def fundamentals(self) -> DataFrame:
        """Per supplier and quarter: net over gross revenue, available 30 days after quarter end."""
        li = self.table("lineitem").select(
            F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("code"),
            F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2)).alias("report_period"),
            "l_extendedprice", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))
        return li.groupBy("code", "report_period").agg(
            (F.sum("net") / F.sum("l_extendedprice")).alias("ocf_to_eps")).withColumn(
            "available_at", F.date_add("report_period", 30).cast("timestamp"))

    def _order_suppliers(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_suppkey").distinct()
        return self.table("orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).withColumn(
            "code", F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))

    def announcements(self) -> DataFrame:
        """One filing per order and supplier, stamped with the (midnight) order date."""
        return self._order_suppliers().select(
            F.lit("orders").alias("source"), F.concat_ws("-", "o_orderkey", "code").alias("announcement_id"), "code",
            F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("timestamp").alias("published_at"))

    # Classes of the order priorities, first match wins.
    priority_classes = {"earnings": ("1-URGENT",), "holding": ("2-HIGH",), "inquiry": ("3-MEDIUM",),
                        "risk": ("4-NOT",)}

    def signals(self) -> DataFrame:
        """One signal per order and supplier; action from the order status."""
        key = F.col("o_orderkey")
        return self._order_suppliers().select(
            (key * 100000 + F.col("l_suppkey")).alias("id"), "code",
            F.col("o_orderdate").cast("timestamp").alias("run_ts"),
            F.when(F.col("o_orderstatus") == "F", "BUY").when(F.col("o_orderstatus") == "O", "SELL").otherwise("HOLD").alias("action"),
            (0.5 + (key % 50) / 100).alias("confidence"))

    def priced_signals(self, bars: DataFrame | None = None) -> DataFrame:
        """Signals with target and stop five percent around the first close on or after the date."""
        signals = self.signals().withColumn("run_date", F.to_date("run_ts"))
        first = following_bars(signals, self.bars() if bars is None else bars, 1, slack_days=10000)
        up = F.when(F.col("action") == "SELL", 0.95).otherwise(1.05)
        return first.select("id", "code", "run_ts", "action", "confidence",
                            (F.col("ref_close") * up).alias("target_price"),
                            (F.col("ref_close") * (2 - up)).alias("stop_loss"))

    def news(self) -> DataFrame:
        """Events as news: score from the value and the sign of the event type."""
        kind = F.col("event_type")
        sign = F.when(kind.isin("purchase", "signup"), 1.0).when(kind == "error", -1.0).when(kind == "view", 0.0)
        bounded = F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            "event_id", F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"), ts.alias("ts"),
            ts.alias("available_at"), F.lit(None).cast("timestamp").alias("fetched_at"), kind.alias("title"),
            (bounded * sign).alias("score"))

    def news_calendar(self) -> DataFrame:
        """Weekdays from the first to the last event day."""
        span = self.table("events").agg(F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("end"))
        return weekday_calendar(span, holidays=())

    def news_panel(self) -> DataFrame:
        """Every code with news on every trading day of the news calendar."""
        lo, hi = self.news_calendar().agg(F.min("trade_date"), F.max("trade_date")).first()
        days = F.sequence(F.lit(lo), F.lit(hi), F.expr("INTERVAL 1 DAY"))
        grid = self.news().select("code").distinct().select("code", F.explode(days).alias("trade_date"))
        return grid.where(~F.dayofweek("trade_date").isin(1, 7))

    def alerts(self) -> DataFrame:
        """One price alert per event user: trigger 50, direction by parity."""
        users = self.table("events").select("user_id").distinct()
        return users.select(
            F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"), F.concat(F.lit("a"), "user_id").alias("alert_id"),
            F.lit(50.0).alias("trigger_price"), F.when(F.col("user_id") % 2 == 0, "above").otherwise("below").alias("direction"),
            F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("last_notified_at"))

    def quotes(self, events: DataFrame | None = None) -> DataFrame:
        """Events as quotes of their user's code."""
        ev = self.table("events") if events is None else events
        ts = F.col("ts").cast("timestamp")
        return ev.select(
            F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"), "event_id", ts.alias("quote_time"),
            F.col("value").alias("close"), F.lit(1.0).alias("buy_volume_5"),
            F.when(F.col("event_type") == "error", 2.0).otherwise(1.0).alias("sell_volume_5"),
            F.lit(1.0).alias("outer_volume"), F.lit(1.0).alias("inner_volume"), F.lit(0.0).alias("pct_change"))
