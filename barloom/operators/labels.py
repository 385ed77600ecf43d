"""Forward-looking labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.rolling import rows_window

HORIZONS = (5, 20, 60)


def forward_returns(bars: DataFrame, horizons: Sequence[int] = HORIZONS, by: str = "code") -> DataFrame:
    frame = rows_window(by)
    return bars.withColumns({
        f"forward_{h}d_return": F.try_divide(F.lead("close", h).over(frame), F.col("close")) - 1 for h in horizons})


def forward_drawdown(bars: DataFrame, horizon: int, by: str = "code") -> DataFrame:
    """Worst later close within the horizon against today's close."""
    worst = F.min("close").over(rows_window(by).rowsBetween(1, horizon))
    return bars.withColumn(f"forward_{horizon}d_drawdown", F.try_divide(worst, F.col("close")) - 1)


def forward_labels(bars: DataFrame, horizons: Sequence[int] = HORIZONS, label_horizon: int = 20,
                   penalty: float = 0.5) -> DataFrame:
    """Forward returns, the drawdown on the label horizon and ``label_score`` = return + penalty * drawdown."""
    spans = sorted({*horizons, label_horizon})
    df = forward_drawdown(forward_returns(bars, spans), label_horizon)
    return df.withColumn("label_score", F.col(f"forward_{label_horizon}d_return")
                         + penalty * F.col(f"forward_{label_horizon}d_drawdown"))


def benchmark_forward(market: DataFrame, hold: int) -> DataFrame:
    """Benchmark return over the holding period per date (index rows only: one per date)."""
    order = Window.orderBy("trade_date")
    return market.select("trade_date", (F.try_divide(F.lead("close", hold).over(order), F.col("close")) - 1)
                         .alias("bench_return"))


def split_history(bars: DataFrame, min_rows: int, by: str = "code") -> tuple[DataFrame, DataFrame]:
    """(instruments with enough rows, skip list with row counts and reason). Row counts are
    aggregated map-side and joined back."""
    counts = bars.groupBy(by).agg(F.count("*").alias("rows"))
    kept = bars.join(counts.where(F.col("rows") >= min_rows).select(by), by, "left_semi")
    skipped = counts.where(F.col("rows") < min_rows).withColumn("reason", F.lit(f"<{min_rows}"))
    return kept, skipped


def drop_warmup(df: DataFrame, rows: int, by: str = "code") -> DataFrame:
    n = F.row_number().over(rows_window(by))
    return df.withColumn("__n", n).where(F.col("__n") > rows).drop("__n")
