"""Registry of queries and SQL building blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from barloom.functions.numeric import half_up
from barloom.sources.driver_views import DriverTables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 4):
    """Register a function of DriverTables; doubles of the result are rounded."""
    def register(fn: Callable[[DriverTables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return rounded(fn(DriverTables(spark, folder)), digits)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[half_up(f"`{f.name}`" if "." in f.name else f.name, digits).alias(f.name)
                       if isinstance(f.dataType, DoubleType) else F.col(f.name) for f in df.schema])


def r(expr: str, name: str | None = None, digits: int = 4) -> str:
    """SQL twin of the rounding, with an alias."""
    value = f"round(CAST({expr} AS DOUBLE), {digits})"
    return f"(CASE WHEN {value} = 0 THEN CAST(0 AS DOUBLE) ELSE {value} END) AS {name or expr}"


_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "bars": ("""SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS trade_date,
        first(p ORDER BY l_orderkey, l_linenumber, l_partkey) AS open, max(p) AS high, min(p) AS low,
        last(p ORDER BY l_orderkey, l_linenumber, l_partkey) AS close,
        sum(l_quantity) AS volume, sum(l_extendedprice) AS amount
        FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2""", ()),
    "market": ("""SELECT CAST(l_shipdate AS DATE) AS trade_date, sum(l_extendedprice) / sum(l_quantity) AS close
        FROM lineitem GROUP BY 1""", ()),
    "cal": ("""SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS trade_date FROM lineitem)""", ()),
    "sectors": ("""SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, r_name AS sector FROM supplier
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""", ()),
    "funds": ("""SELECT code, report_period, sum(net) / sum(l_extendedprice) AS ocf_to_eps,
        report_period + 30 AS available_at FROM (
          SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code,
            last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS report_period,
            l_extendedprice, l_extendedprice * (1 - l_discount) AS net FROM lineitem) GROUP BY 1, 2""", ()),
    "pairs": ("""SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem""", ()),
    "anns": ("""SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, o_orderpriority AS title,
        o_orderdate AS published_at, o_orderkey FROM orders JOIN pairs ON o_orderkey = l_orderkey""", ("pairs",)),
    "signals": ("""SELECT o_orderkey * 100000 + l_suppkey AS id, lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code,
        o_orderdate AS run_ts, CAST(o_orderdate AS DATE) AS run_date,
        CASE o_orderstatus WHEN 'F' THEN 'BUY' WHEN 'O' THEN 'SELL' ELSE 'HOLD' END AS action,
        0.5::DOUBLE + (o_orderkey % 50) / 100::DOUBLE AS confidence
        FROM orders JOIN pairs ON o_orderkey = l_orderkey""", ("pairs",)),
    "news": ("""SELECT event_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, ts, event_type AS title,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 1::DOUBLE WHEN event_type = 'error' THEN -1::DOUBLE
             WHEN event_type = 'view' THEN 0::DOUBLE END * least(greatest(value / 100, 0), 1) AS score
        FROM events""", ()),
    "ncal": ("""SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx FROM (
        SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS trade_date FROM (
          SELECT date_trunc('day', min(ts)) AS lo, date_trunc('day', max(ts)) AS hi FROM events))
        WHERE isodow(trade_date) < 6""", ()),
    "ngrid": ("""SELECT code, trade_date, idx FROM (SELECT DISTINCT code FROM news), ncal""", ("news", "ncal")),
    # series derived from the bars, with market returns
    "fx": ("""SELECT *, c / c1 - 1 AS ret, c - c1 AS dc, lv - lv1 AS dlv, volume - v1 AS dv, c * volume AS cv,
          volume / v1 - 1 AS vp, c / c1 - 1 - m AS rel
        FROM (SELECT b.*, b.close AS c, ln(volume) AS lv, coalesce(mr.m, 0) AS m,
            row_number() OVER p AS rn, lag(b.close) OVER p AS c1, lag(ln(volume)) OVER p AS lv1, lag(volume) OVER p AS v1
          FROM bars b LEFT JOIN (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS m
            FROM market) mr USING (trade_date)
          WINDOW p AS (PARTITION BY code ORDER BY trade_date))""", ("bars", "market")),
    # score, label and forward return used by the evaluation queries
    "scored": ("""SELECT code, trade_date, close, volume, ret20 AS score, fwd5, fwd20,
          fwd20 + 0.5 * dd20 AS label_score
        FROM (SELECT code, trade_date, close, volume, close / lag(close, 20) OVER p - 1 AS ret20,
            lead(close, 5) OVER p / close - 1 AS fwd5, lead(close, 20) OVER p / close - 1 AS fwd20,
            min(close) OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)
              / close - 1 AS dd20
          FROM bars WINDOW p AS (PARTITION BY code ORDER BY trade_date))
        WHERE ret20 IS NOT NULL AND fwd5 IS NOT NULL""", ("bars",)),
}


def with_ctes(*names: str, **extra: str) -> str:
    """``WITH`` clause holding the named building blocks (and what they need), then extras."""
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _CTES[n][1]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS MATERIALIZED ({_CTES[n][0]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    return "WITH " + ", ".join(parts) + " "
