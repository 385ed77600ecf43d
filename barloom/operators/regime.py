"""Market and sector state. Index series hold one row per date; sector series one row per
sector and date."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.rules import confidence_floor, volatility_regime
from barloom.operators.asof import latest_per_key

TREND_WINDOW = 200


def trend_flags(market: DataFrame, window: int = TREND_WINDOW, order: str = "trade_date") -> DataFrame:
    """``bull`` = close above its moving average. While the average is undefined the flag is
    False, as a comparison with a missing value is."""
    frame = Window.orderBy(order).rowsBetween(-(window - 1), 0)
    mean = F.when(F.count("close").over(frame) == window, F.avg("close").over(frame))
    return market.withColumn("bull", F.coalesce(F.col("close") > mean, F.lit(False)))


def current_trend(market: DataFrame, window: int = TREND_WINDOW) -> DataFrame:
    """Newest trend as one row; with less than ``window`` bars the neutral answer is bull."""
    last = trend_flags(market, window).agg(F.max_by("bull", "trade_date").alias("bull"), F.count("*").alias("bars"))
    return last.select(F.when((F.col("bars") < window) | F.col("bull"), "bull").otherwise("bear").alias("trend"))


def trend_by_date(market: DataFrame, window: int = TREND_WINDOW) -> DataFrame:
    """(trade_date, trend): ``current_trend`` as seen on every date, so bull while the average is undefined."""
    rows = F.count("*").over(Window.orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))
    flags = trend_flags(market, window).withColumn("__rows", rows)
    return flags.select("trade_date", F.when((F.col("__rows") < window) | F.col("bull"), "bull").otherwise("bear").alias("trend"))


def only_regime(df: DataFrame, flags: DataFrame, bull: bool) -> DataFrame:
    """Rows on dates of one regime; dates the index lacks match neither."""
    return df.join(flags.where(F.col("bull") == bull).select("trade_date"), "trade_date", "left_semi")


def volatility_history(market: DataFrame, window: int = 20, *, min_bars: int = 60, min_vols: int = 500,
                       point_in_time: bool = False) -> DataFrame:
    """20-day annualised volatility, its percentile and the regime per date.

    The default percentile compares with the whole sample, later dates included; this looks
    ahead and is meant for the newest row. ``point_in_time`` compares with earlier dates only.
    Empty when there is too little history."""
    order = Window.orderBy("trade_date")
    frame = order.rowsBetween(-(window - 1), 0)
    past = F.last("close", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = market.withColumn("__past", past).withColumn(
        "ret", F.try_divide(F.coalesce("close", "__past"), F.col("__past")) - 1)
    df = df.withColumn("vol_20d", F.when(F.count("ret").over(frame) == window, F.stddev_samp("ret").over(frame)
                                         * F.sqrt(F.lit(252.0))))
    df = df.withColumn("__bars", F.count("*").over(Window.partitionBy(F.lit(0))))
    vols = df.where(F.col("vol_20d").isNotNull())
    if point_in_time:
        before = F.array_sort(F.collect_list("vol_20d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        pct = F.size(F.filter(before, lambda v: v <= F.col("vol_20d"))) / F.size(before)
    else:
        pct = F.cume_dist().over(Window.orderBy("vol_20d"))
    vols = vols.withColumns({"percentile": pct, "__vols": F.count("*").over(Window.partitionBy(F.lit(0)))})
    vols = vols.where((F.col("__bars") >= min_bars) & (F.col("__vols") >= min_vols))
    return vols.select("trade_date", "vol_20d", "percentile", volatility_regime("percentile").alias("regime"),
                       confidence_floor("percentile").alias("confidence_floor"))


def current_regime(history: DataFrame) -> DataFrame:
    """Newest regime as one row; normal with floor 0.6 when there is no history."""
    last = history.agg(F.max_by(F.struct("trade_date", "vol_20d", "percentile", "regime", "confidence_floor"),
                                "trade_date").alias("r"))
    return last.select("r.trade_date", "r.vol_20d", "r.percentile",
                       F.coalesce("r.regime", F.lit("normal")).alias("regime"),
                       F.coalesce("r.confidence_floor", F.lit(0.6)).alias("confidence_floor"))


def sector_index(bars: DataFrame, sectors: DataFrame) -> DataFrame:
    """Sector series from its members: mean member return per date, compounded. The level is
    kept as a logarithm, so a long history cannot overflow."""
    spec = Window.partitionBy("code").orderBy("trade_date")
    rets = bars.withColumn("ret", F.try_divide(F.col("close"), F.lag("close").over(spec)) - 1).where(
        F.col("ret").isNotNull())
    daily = rets.join(sectors.select("code", "sector"), "code").groupBy("sector", "trade_date").agg(
        F.avg("ret").alias("ret"))
    upto = Window.partitionBy("sector").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return daily.withColumn("log_close", F.sum(F.log1p("ret")).over(upto))


def sector_strength(sector_bars: DataFrame, market: DataFrame, days: int = 5) -> DataFrame:
    """``days``-bar return of each sector per date and its excess over the benchmark's return on
    that date. Sector bars have ``close`` (supplied series) or ``log_close``."""
    spec = Window.partitionBy("sector").orderBy("trade_date")
    bench = market.select("trade_date", F.coalesce(
        F.try_divide(F.col("close"), F.lag("close", days).over(Window.orderBy("trade_date"))) - 1,
        F.lit(0.0)).alias("bench"))
    if "log_close" in sector_bars.columns:
        move = F.exp(F.col("log_close") - F.lag("log_close", days).over(spec)) - 1
    else:
        move = F.try_divide(F.col("close"), F.lag("close", days).over(spec)) - 1
    own = sector_bars.withColumn("return_5d", move)
    return own.join(bench, "trade_date", "left").where(F.col("return_5d").isNotNull()).select(
        "sector", "trade_date", "return_5d",
        (F.col("return_5d") - F.coalesce("bench", F.lit(0.0))).alias("excess_return_5d"))


def latest_strength(strength: DataFrame) -> DataFrame:
    return latest_per_key(strength, ["sector"], ["trade_date"])


def sector_context(codes: DataFrame, sectors: DataFrame, latest: DataFrame) -> DataFrame:
    """Sector and strength of each code; unknown sector and 0 where nothing is mapped."""
    df = codes.join(sectors.select("code", "sector"), "code", "left").join(
        latest.select("sector", "excess_return_5d"), "sector", "left")
    excess = F.coalesce("excess_return_5d", F.lit(0.0))
    return df.select("code", F.coalesce("sector", F.lit("unknown")).alias("sector"), excess.alias("excess_return_5d"),
                     F.when(excess > 0, "stronger").when(excess < 0, "weaker").otherwise("level").alias("versus_market"))


def index_snapshot(index_bars: DataFrame) -> DataFrame:
    """Newest close, day change, 5- and 20-bar return per index, and the tone of the mean
    day change over all of them."""
    spec = Window.partitionBy("code").orderBy("trade_date")

    def move(n: int):
        return F.round((F.try_divide(F.col("close"), F.lag("close", n).over(spec)) - 1) * 100, 2)

    moved = index_bars.select("code", "trade_date", "close", move(1).alias("pct_change"),
                              move(5).alias("return_5d"), move(20).alias("return_20d"))
    last = latest_per_key(moved, ["code"], ["trade_date"])
    mean = last.agg(F.avg("pct_change")).first()[0]  # one number
    tone = "mixed" if mean is None or abs(mean) < 0.4 else "firm" if mean > 0 else "soft"
    return last.withColumn("tone", F.lit(tone))
