"""Non-overlapping top-k portfolio backtest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.cross_section import decile


def rebalance_dates(scored: DataFrame, hold: int, split_date: str | None = None) -> DataFrame:
    """Every ``hold``-th date of the in-sample and of the out-of-sample segment."""
    days = scored.select("trade_date").distinct()
    segment = (F.when(F.col("trade_date") < F.lit(split_date).cast("date"), "train").otherwise("test")
               if split_date else F.lit("all"))
    order = Window.partitionBy("segment").orderBy("trade_date")
    numbered = days.withColumn("segment", segment).withColumn("__i", F.row_number().over(order) - 1)
    return numbered.where(F.col("__i") % hold == 0).select("trade_date", "segment")


def _usable(scored: DataFrame, dates: DataFrame, k: int, target: str) -> DataFrame:
    """Rebalance dates with at least 2k rows and a score that varies, numbered per segment."""
    per = scored.join(dates, "trade_date").groupBy("segment", "trade_date").agg(
        F.count("*").alias("n"), (F.min("score") < F.max("score")).alias("varies"),
        F.avg(target).alias("universe"))
    per = per.where((F.col("n") >= 2 * k) & F.col("varies"))
    return per.withColumn("period", F.row_number().over(Window.partitionBy("segment").orderBy("trade_date")))


def baskets(scored: DataFrame, dates: DataFrame, k: int, target: str) -> DataFrame:
    """The k best scores of every usable rebalance date (ties by code)."""
    order = Window.partitionBy("trade_date").orderBy(F.desc("score"), "code")
    top = (scored.join(dates.select("trade_date"), "trade_date", "left_semi")
           .select("trade_date", "code", "score", target)
           .withColumn("place", F.row_number().over(order)).where(F.col("place") <= k))
    return top.join(dates, "trade_date")


def turnover(basket: DataFrame, k: int) -> DataFrame:
    """Share of the basket that was not in the previous usable one; the first basket is all new."""
    prev = basket.select("segment", "code", (F.col("period") + 1).alias("period")).withColumn("kept", F.lit(1))
    return basket.join(prev, ["segment", "code", "period"], "left").groupBy("segment", "period").agg(
        F.when(F.col("period") == 1, 1.0).otherwise(1 - F.coalesce(F.sum("kept"), F.lit(0)) / k).alias("turnover"))


def backtest_periods(scored: DataFrame, target: str, *, bench: DataFrame | None = None, hold: int = 20, k: int = 50,
                     cost: float = 0.003, rf: float = 0.02, bear_exposure: float = 1.0,
                     split_date: str | None = None) -> DataFrame:
    """One row per usable rebalance: portfolio, universe and benchmark return.

    ``scored`` has trade_date, code, score, the target return and optionally ``bull``;
    ``bench`` has trade_date, bench_return. Where the benchmark is missing the universe stands in.
    """
    rf_per = rf * hold / 252
    usable = _usable(scored, rebalance_dates(scored, hold, split_date), k, target)
    basket = baskets(scored, usable, k, target)
    top = basket.groupBy("segment", "period", "trade_date").agg(F.avg(target).alias("top_return"),
                                                               F.first("universe").alias("universe"))
    df = top.join(turnover(basket, k), ["segment", "period"])
    if "bull" in scored.columns:
        flags = scored.groupBy("trade_date").agg(F.max("bull").alias("bull"))
        df = df.join(flags, "trade_date", "left")
    else:
        df = df.withColumn("bull", F.lit(True))
    df = (df.join(bench, "trade_date", "left") if bench is not None
          else df.withColumn("bench_return", F.lit(None).cast("double")))
    exposure = F.when(F.coalesce("bull", F.lit(True)), 1.0).otherwise(bear_exposure)
    basket_return = F.col("top_return") - F.col("turnover") * cost
    return df.select(
        "segment", "period", "trade_date", "turnover", "top_return",
        (exposure * basket_return + (1 - exposure) * rf_per).alias("port"),
        "universe", F.coalesce("bench_return", "universe").alias("bench"))


def _growth(r: str) -> Column:
    """Product of 1 + r. A total loss (r = -1) is a factor of zero."""
    safe = F.when(F.col(r) > -1, F.log1p(r)).otherwise(0.0)
    return F.when(F.min(r) <= -1, 0.0).otherwise(F.exp(F.sum(safe)))


def backtest_metrics(periods: DataFrame, *, hold: int = 20, rf: float = 0.02) -> DataFrame:
    """Metrics per segment. Periods are rebalances (a few hundred rows), so the compounded path
    is one ordered window per segment."""
    rf_per, per_year = rf * hold / 252, 252 / hold
    upto = Window.partitionBy("segment").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    path = periods.withColumn("wealth", F.exp(F.sum(F.log1p("port")).over(upto)))
    path = path.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(upto) - 1)

    def cagr(r: str) -> Column:
        return F.pow(_growth(r), F.lit(per_year) / F.count("*")) - 1

    def beats(other: Column) -> Column:
        return F.avg((F.col("port") > other).cast("double"))

    return path.groupBy("segment").agg(
        F.count("*").alias("periods"), cagr("port").alias("cagr"), cagr("bench").alias("bench_cagr"),
        cagr("universe").alias("universe_cagr"),
        (F.stddev_pop("port") * per_year ** 0.5).alias("ann_vol"),
        F.coalesce(F.try_divide(F.avg(F.col("port") - rf_per), F.stddev_pop("port")) * per_year ** 0.5,
                   F.lit(0.0)).alias("sharpe"),
        F.min("drawdown").alias("max_drawdown"), F.avg("turnover").alias("avg_turnover"),
        beats(F.lit(rf_per)).alias("beat_rf"), beats(F.col("bench")).alias("beat_bench"),
        beats(F.col("universe")).alias("beat_universe"))


def backtest_deciles(scored: DataFrame, target: str, *, hold: int = 20, k: int = 50,
                     split_date: str | None = None) -> DataFrame:
    """Mean target per average-rank decile over the usable rebalance dates."""
    usable = _usable(scored, rebalance_dates(scored, hold, split_date), k, target)
    rows = scored.join(usable.select("trade_date", "segment"), "trade_date")
    ranked = decile(rows, "score", "trade_date", method="average")
    return (ranked.groupBy("segment", "trade_date", "decile").agg(F.avg(target).alias("m"))
            .groupBy("segment", "decile").agg(F.avg("m").alias("mean_return"), F.count("*").alias("dates")))


def backtest(scored: DataFrame, target: str, **options) -> tuple[DataFrame, DataFrame]:
    periods = backtest_periods(scored, target, **options)
    return periods, backtest_metrics(periods, hold=options.get("hold", 20), rf=options.get("rf", 0.02))
