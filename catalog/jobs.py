"""Technical, streaming, model and composite-job queries."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from barloom.operators import research as rs
from barloom.operators import technical as tc
from barloom.plans.models import (
    calendar_split, evaluation_bundle, feature_gains, fraction_split, mark_split, train_ranker)
from barloom.plans.training_panel import training_panel
from barloom.session import cut_lineage, ensure_checkpoint_dir
from barloom.streaming import watch as wt
from catalog.behaviour import PROP_COLUMNS, prop_ctes, stored
from catalog.factors import ALL, UNITS, factor_ctes, in_units
from catalog.panel import P, scored
from catalog.registry import query, r, with_ctes

LAST = "QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1"


def _w(n: int) -> str:
    return f"OVER ({P} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(e: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {_w(n)} = {n} THEN {e} END"


def _ewm(x: str, src: str, decay: float, name: str) -> str:
    """Weighted mean over all earlier rows, for every row."""
    return (f"SELECT a.code, a.trade_date, sum(b.{x} * pow({decay!r}, a.i - b.i)) / sum(pow({decay!r}, a.i - b.i)) AS {name} FROM {src} a JOIN {src} b "
            f"ON a.code = b.code AND b.i <= a.i WHERE b.{x} IS NOT NULL GROUP BY 1, 2")


D12, D26, D9, D3 = 1 - 2 / 13, 1 - 2 / 27, 1 - 2 / 10, 1 - 2 / 6
TECH = {
    "tb": f"SELECT *, row_number() OVER ({P}) AS i, count(*) OVER (PARTITION BY code) AS n, close - lag(close) OVER ({P}) AS delta FROM bars",
    "ti": "SELECT *, " + ", ".join(f"{_full(f'avg(close) {_w(k)}', 'close', k)} AS ma{k}" for k in (5, 10, 20, 60, 250))
          + f", {_full(f'avg(greatest(delta, 0)) {_w(14)}', 'delta', 14)} AS gain, {_full(f'avg(greatest(-delta, 0)) {_w(14)}', 'delta', 14)} AS loss, "
            f"{_full(f'(close - min(low) {_w(9)}) / (max(high) {_w(9)} - min(low) {_w(9)} + 1e-9)', 'low', 9)} AS rsv, "
            f"{_full(f'(close - avg(close) {_w(20)} + 2 * stddev_samp(close) {_w(20)}) / (4 * stddev_samp(close) {_w(20)} + 1e-9)', 'close', 20)} AS bbp, "
            f"{_full(f'avg(volume) {_w(5)}', 'volume', 5)} AS vol5, (close / lag(close) OVER ({P}) - 1) * 100 AS pc FROM tb",
    "e12": _ewm("close", "tb", D12, "v"), "e26": _ewm("close", "tb", D26, "v"),
    "df": "SELECT tb.code, tb.trade_date, i, e12.v - e26.v AS dif FROM tb JOIN e12 USING (code, trade_date) JOIN e26 USING (code, trade_date)",
    "ea": "SELECT a.code, max_by(a.dif, a.i) AS dif, sum(a.dif * pow({d!r}, m.mi - a.i)) / sum(pow({d!r}, m.mi - a.i)) AS dea FROM df a JOIN (SELECT code, max(i) AS mi FROM df GROUP BY 1) m USING (code) GROUP BY 1".format(d=D9),
    "kk": _ewm("rsv", "ti", D3, "k"),
    "kd": "SELECT a.code, max_by(k, i) AS k, sum(k * pow({d!r}, mi - i)) / sum(pow({d!r}, mi - i)) AS d FROM (SELECT kk.*, ti.i FROM kk JOIN ti USING (code, trade_date) WHERE ti.i >= 9) a JOIN (SELECT code, max(i) AS mi FROM ti GROUP BY 1) m USING (code) GROUP BY 1".format(d=D3),
    "tl": "SELECT ti.*, dif, dea, (dif - dea) * 2 AS bar, 100 - 100 / (1 + gain / nullif(loss, 0)) AS rsi, k, d, 3 * k - 2 * d AS j, volume / nullif(vol5, 0) AS vr "
          f"FROM (SELECT * FROM ti {LAST}) ti JOIN ea USING (code) JOIN kd USING (code)",
    "ts": "SELECT *, CASE WHEN ma5 > ma20 AND ma10 > ma20 THEN 'golden' WHEN NOT ma5 > ma20 AND NOT ma10 > ma20 THEN 'death' END AS ma_cross FROM tl",
    "tz": "SELECT *, greatest(-1, least(1, CASE ma_cross WHEN 'golden' THEN 0.2 WHEN 'death' THEN -0.2 ELSE 0 END + CASE WHEN bar > 0 THEN 0.15 ELSE -0.15 END "
          "+ CASE WHEN rsi > 70 THEN -0.15 WHEN rsi < 30 THEN 0.15 WHEN rsi > 50 THEN 0.05 ELSE -0.05 END + CASE WHEN j > 80 THEN -0.1 WHEN j < 20 THEN 0.1 ELSE 0 END "
          "+ CASE WHEN bbp > 0.9 THEN -0.1 WHEN bbp < 0.1 THEN 0.1 ELSE 0 END + CASE WHEN vr > 2 THEN 0.1 ELSE 0 END + CASE WHEN n >= 250 THEN CASE WHEN close > ma250 THEN 0.15 ELSE -0.15 END ELSE 0 END "
          "+ CASE WHEN pc >= 9.5 THEN 0.2 WHEN pc <= -9.5 THEN -0.2 ELSE 0 END)) AS score FROM ts"}


@query("tech_w40_score", with_ctes("bars", **TECH) + "SELECT code, trade_date, " + ", ".join(
    r(e, n) for e, n in (("dif", "macd_dif"), ("dea", "macd_dea"), ("bar", "macd_bar"), ("rsi", "rsi14"), ("k", "kdj_k"), ("d", "kdj_d"), ("bbp", "bbp"), ("vr", "vol_ratio"), ("score", "score"))) + ", ma_cross FROM tz")
def w40(t):
    return tc.technical_score(t.bars()).select("code", "trade_date", "macd_dif", "macd_dea", "macd_bar", "rsi14", "kdj_k", "kdj_d", "bbp", "vol_ratio", "score", "ma_cross")


@query("tech_f19_summary", with_ctes("bars", **TECH, s="SELECT code, list_filter([CASE ma_cross WHEN 'golden' THEN 'averages above 20-day' WHEN 'death' THEN 'averages below 20-day' END, "
       "CASE WHEN bar > 0 THEN 'macd positive' WHEN bar IS NOT NULL THEN 'macd negative' END, CASE WHEN rsi >= 70 THEN 'rsi hot' WHEN rsi <= 30 THEN 'rsi oversold' WHEN rsi >= 50 THEN 'rsi firm' WHEN rsi IS NOT NULL THEN 'rsi soft' END, "
       "CASE WHEN bbp >= 0.9 THEN 'near upper band' WHEN bbp <= 0.1 THEN 'near lower band' END, CASE WHEN vr >= 2 THEN 'volume up' WHEN vr <= 0.7 THEN 'volume down' END], lambda m: m IS NOT NULL) AS x FROM tz")
       + "SELECT code, array_to_string(x[1:4], '; ') AS tech_summary FROM s")
def f19(t):
    return tc.technical_summary(tc.technical_score(t.bars())).select("code", "tech_summary")


@query("tech_r14_ewm", with_ctes("bars", tb=TECH["tb"], e=f"SELECT code, sum(close * pow({D12!r}, n - i)) / sum(pow({D12!r}, n - i)) AS v FROM tb GROUP BY 1") + f"SELECT code, {r('v', 'ewm')} FROM e")
def ewm(t):
    return tc.ewm_last(t.bars(), "close", span=12)


RECENT = {"rb": "SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS i FROM bars",
          "lv": "SELECT r.code, any_value(p.close) AS px, max(r.low) FILTER (WHERE r.low <= p.close) AS s, min(r.high) FILTER (WHERE r.high >= p.close) AS h, min(r.low) AS lo, max(r.high) AS hi FROM rb r JOIN rb p ON r.code = p.code AND p.i = 1 WHERE r.i <= 20 GROUP BY 1",
          "tr": f"SELECT code, trade_date, greatest(high - low, abs(high - lag(close) OVER ({P})), abs(low - lag(close) OVER ({P}))) AS t FROM bars",
          "atrs": "SELECT code, avg(t) AS atr FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS i FROM tr) WHERE i <= 14 GROUP BY 1"}


@query("tech_w53_levels", with_ctes("bars", **RECENT) + f"SELECT code, {r('px', 'price', 8)}, " + ", ".join(
    r(f"round({e}, 2)", n, 2) for e, n in (("coalesce(s, lo)", "support_price"), ("coalesce(h, hi)", "resistance_price"), ("lo", "low_20d"), ("hi", "high_20d"))) + " FROM lv", 8)
def w53(t):
    return tc.recent_levels(t.bars())


@query("tech_w54_atr", with_ctes("bars", **RECENT) + f"SELECT code, {r('atr')} FROM atrs")
def w54(t):
    return tc.average_true_range(t.bars())


def _mv(n: int) -> str:
    return f"max(close) FILTER (WHERE i = 1) / max(close) FILTER (WHERE i = {n + 1}) * 100 - 100"


@query("tech_w55_trend", with_ctes("bars", rb=RECENT["rb"], x=f"SELECT code, {_mv(5)} AS wk, max(high) FILTER (WHERE i <= 6) AS wh, min(low) FILTER (WHERE i <= 6) AS wl, min(low) FILTER (WHERE i <= 10) AS su, "
       f"max(high) FILTER (WHERE i <= 10) AS re, {_mv(20)} AS r20, {_mv(60)} AS r60, {_mv(120)} AS r120, max(close) FILTER (WHERE i = 1) / max(high) FILTER (WHERE i <= 120) * 100 - 100 AS dd, "
       "avg(volume) FILTER (WHERE i <= 5) / avg(volume) FILTER (WHERE i BETWEEN 7 AND 11) AS vr FROM rb GROUP BY 1")
       + "SELECT code, " + ", ".join(r(e, n, 2) for e, n in (("wk", "week_pct"), ("wh", "week_high"), ("wl", "week_low"), ("su", "support"), ("re", "resistance"), ("r20", "return_20d"), ("r60", "return_60d"), ("r120", "return_120d"), ("dd", "drawdown_120d")))
       + ", CASE WHEN vr >= 1.15 THEN 'larger' WHEN vr <= 0.85 THEN 'smaller' ELSE 'level' END AS volume_trend FROM x", 2)
def w55(t):
    return tc.trend_summary(t.bars()).drop("last_close", "vol_ratio")


@query("tech_w56_risk_plan", with_ctes("bars", **RECENT, c="SELECT lv.code, px, px * 0.95 AS co, round(coalesce(s, lo), 2) AS su, round(coalesce(h, hi), 2) AS re, atr FROM lv JOIN atrs USING (code)",
       x="SELECT *, list_filter([co * 0.93, co * 0.9, px * 0.97, su * 0.99, CASE WHEN atr > 0 THEN px - 2 * atr ELSE 0 END], lambda p: p > 0 AND p < px) AS rk, "
         "list_filter([co * 1.1, co + 2 * (co - co * 0.93), re, CASE WHEN atr > 0 THEN px + 2 * atr ELSE 0 END, px * 1.05], lambda p: p > 0 AND p > px) AS pk FROM c")
       + f"SELECT code, {r('coalesce(rk[1], px * 0.97)', 'risk_price', 2)}, {r('coalesce(pk[1], px * 1.05)', 'pressure_price', 2)}, len(list_distinct(list_transform(rk, lambda p: round(p, 2)))) AS risks, "
         "len(list_distinct(list_transform(pk, lambda p: round(p, 2)))) AS pressures FROM x", 2)
def w56(t):
    levels = tc.recent_levels(t.bars()).select("code", "price", F.col("support_price").alias("support"), F.col("resistance_price").alias("resistance"))
    df = levels.join(tc.average_true_range(t.bars()), "code").withColumn("cost", F.col("price") * 0.95)
    return tc.risk_plan(df).select("code", "risk_price", "pressure_price", F.size("risk_candidates").cast("bigint").alias("risks"), F.size("pressure_candidates").cast("bigint").alias("pressures"))


# ---- research lookups ---------------------------------------------------------------------

FLOW = {"fl": "SELECT code, trade_date, amount - 50000 AS net, volume AS ratio, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS i FROM bars"}


@query("research_a19_fund_flow", with_ctes("bars", **FLOW) + f"SELECT code, max(trade_date) AS date, {r('max(net) FILTER (WHERE i = 1)', 'latest_net', 2)}, {r('max(ratio) FILTER (WHERE i = 1)', 'latest_ratio', 2)}, "
       f"{r('sum(net) FILTER (WHERE i <= 5)', 'net_5d', 2)}, {r('sum(net) FILTER (WHERE i <= 20)', 'net_20d', 2)} FROM fl GROUP BY 1", 2)
def a19(t):
    return rs.fund_flow(t.bars().select("code", "trade_date", (F.col("amount") - 50000).alias("net"), F.col("volume").alias("ratio")))


@query("research_t05_top_net_buys", with_ctes("bars", f="SELECT code, sum(amount) AS net_buy FROM bars GROUP BY 1") + f"SELECT code, {r('net_buy', 'net_buy', 1)} FROM f ORDER BY f.net_buy DESC, code LIMIT 10", 1)
def t05(t):
    return rs.top_net_buys(t.bars().groupBy("code").agg(F.sum("amount").alias("net_buy")))


@query("research_t06_hot_pool", "WITH a AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS up, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS down, "
       "row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS first, s_nationkey FROM supplier), u AS (SELECT code, 0 AS source, up AS place FROM a WHERE up <= 15 UNION ALL SELECT code, 1, s_nationkey FROM a WHERE first = 1 "
       "UNION ALL SELECT code, 2, down FROM a WHERE down <= 10) SELECT code, source, place FROM u QUALIFY row_number() OVER (PARTITION BY code ORDER BY source, place) = 1 ORDER BY source, place, code LIMIT 30")
def t06(t):
    s = t.table("supplier").withColumn("code", F.concat(F.lit("sh"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")))
    top = s.orderBy(F.desc("s_acctbal"), "s_suppkey").limit(15)
    low = s.orderBy("s_acctbal", "s_suppkey").limit(10)
    def placed(df, *order):
        from pyspark.sql import Window
        return df.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint")).select("code", "place")
    lead = s.groupBy("s_nationkey").agg(F.min_by("code", "s_suppkey").alias("code")).select("code", F.col("s_nationkey").cast("bigint").alias("place"))
    return rs.hot_pool(placed(top, F.desc("s_acctbal"), "s_suppkey"), lead, placed(low, "s_acctbal", "s_suppkey"))


@query("research_s23_filings", with_ctes("anns", f="SELECT DISTINCT code, CAST(published_at AS DATE) AS date, title FROM anns WHERE published_at BETWEEN TIMESTAMP '1998-11-17' AND TIMESTAMP '1999-01-01'",
       k="SELECT code, CAST(published_at AS DATE) AS date, title, row_number() OVER (PARTITION BY code ORDER BY published_at DESC, title) AS i FROM anns WHERE published_at BETWEEN TIMESTAMP '1998-11-17' AND TIMESTAMP '1999-01-01'")
       + "SELECT code, date, title FROM k WHERE i <= 6 GROUP BY 1, 2, 3")
def s23(t):
    return rs.filings_for_question(t.announcements(), "1999-01-01").select("code", "date", "title")


@query("research_a25_run_counters", "SELECT count(*) AS analysed, count(*) FILTER (WHERE o_orderstatus = 'F') AS pushed, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS ok FROM orders")
def a25(t):
    return rs.run_counters(t.table("orders").select((F.col("o_orderstatus") == "F").cast("int").alias("pushed"), (F.col("o_orderpriority") == "5-LOW").cast("int").alias("push_ok")))


# ---- streaming ----------------------------------------------------------------------------

def run_stream(t, stream, *, mode: str = "append"):
    """Run a stream over the landed files to its end and read back what it wrote."""
    base = f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"
    (stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/state")
     .trigger(availableNow=True).start(out).awaitTermination())
    return t.spark.read.schema(stream.schema).parquet(out)


def event_stream(t):
    """The events file as a file stream."""
    schema = t.table("events").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)


class Landing:
    """A folder that fills up part by part; each landing is followed by a run of the stream from its checkpoint to its
    end, so state and ledger live on across runs."""

    def __init__(self, t, schema):
        self.t, self.schema = t, schema
        self.base = f"{ensure_checkpoint_dir(t.spark)}/landing-{uuid.uuid4().hex}"
        self.paths = {}

    def stream(self, name: str = "in", schema=None):
        path = self.paths.setdefault(name, f"{self.base}/{name}")
        schema = self.schema if schema is None else schema
        self.t.spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return self.t.spark.readStream.schema(schema).parquet(path)

    def add(self, df, name: str = "in") -> None:
        df.write.mode("append").parquet(self.paths[name])

    def run(self, writer) -> None:
        writer.option("checkpointLocation", f"{self.base}/state").trigger(availableNow=True).start().awaitTermination()


def by_time(df, parts: int = 3):
    """df cut at equal steps of its time span."""
    lo, hi = df.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    step = (hi - lo) // parts + 1
    return [df.where(F.floor((F.unix_micros("ts") - lo) / step) == i) for i in range(parts)]


HITS = ("SELECT 'a' || user_id AS alert_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, ts, CAST(ts AS DATE) AS day FROM events WHERE value > 0 AND CASE WHEN user_id % 2 = 0 THEN value >= 50 ELSE value <= 50 END")


@query("stream_st1_price_alerts", f"SELECT DISTINCT alert_id, code, day FROM ({HITS})")
def st1(t):
    hits = wt.triggered_alerts(t.quotes(event_stream(t)), t.alerts())
    return run_stream(t, wt.once_a_day(hits)).select("alert_id", "code", "day")


@query("stream_st1_batch_twin", "SELECT alert_id, code, min(ts) AS at, arg_min(level, ts) AS level FROM (SELECT 'a' || user_id AS alert_id, lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, ts, CAST(ts AS DATE) AS day, "
       "CASE WHEN user_id % 2 = 0 OR event_type = 'error' THEN 'warning' ELSE 'info' END AS level FROM events WHERE value > 0 AND CASE WHEN user_id % 2 = 0 THEN value >= 50 ELSE value <= 50 END) GROUP BY 1, 2, day")
def st1b(t):
    hits = wt.triggered_alerts(t.quotes(), t.alerts())
    return wt.first_per_day(hits).select("alert_id", "code", F.col("at").cast("timestamp_ntz").alias("at"), "level")


def positions(t):
    k = F.col("code").cast("int")
    return t.alerts().drop("trigger_price", "direction").withColumns({
        "stop_loss": F.lit(20.0), "target_price": F.lit(60.0), "action": F.when(k % 3 == 0, "SELL").otherwise("HOLD"), "confidence": F.lit(0.7)})


@query("stream_st2_position_alerts", "SELECT DISTINCT 'a' || user_id AS alert_id, CAST(ts AS DATE) AS day FROM events WHERE value > 0 AND (value <= 20 OR value >= 60 * 0.98 OR user_id % 3 = 0)")
def st2(t):
    hits = wt.triggered_positions(t.quotes(event_stream(t)), positions(t))
    return run_stream(t, wt.once_a_day(hits)).select("alert_id", "day")


@query("stream_st2_batch_twin", "SELECT alert_id, min(ts) AS at, arg_min(reason, ts) AS reason FROM (SELECT 'a' || user_id AS alert_id, ts, CASE WHEN value <= 20 THEN 'stop' WHEN value >= 60 * 0.98 THEN 'target' "
       "WHEN user_id % 3 = 0 THEN 'sell' END AS reason FROM events WHERE value > 0) WHERE reason IS NOT NULL GROUP BY alert_id, CAST(ts AS DATE)")
def st2b(t):
    """Rule order of the position alerts: the first notice of each day and why."""
    hits = wt.triggered_positions(t.quotes(), positions(t))
    return wt.first_per_day(hits).select("alert_id", F.col("at").cast("timestamp_ntz").alias("at"), "reason")


@query("stream_st3_news_scan", with_ctes("news") + "SELECT DISTINCT code, ts, title, CASE WHEN coalesce(abs(score) >= 0.8, false) THEN CASE WHEN score < -0.08 THEN 'major_news' ELSE 'news_filtered' END ELSE 'news_seen' END AS outcome, "
       "CASE WHEN score > 0.08 THEN 'positive' WHEN score < -0.08 THEN 'negative' ELSE 'neutral' END AS direction, CASE WHEN abs(score) >= 0.8 THEN CASE WHEN score < -0.08 THEN 'critical' ELSE 'info' END END AS level FROM news")
def st3(t):
    """All news in three landings, each holding half of the one before again; the stream restarts after each."""
    news = t.news().select("event_id", "code", "ts", "title", "score")
    land = Landing(t, news.schema)
    ledger = f"{land.base}/ledger"
    stream, before = land.stream(), None
    for part in by_time(news):
        land.add(part if before is None else part.unionByName(before.where("event_id % 2 = 0")))
        land.run(stream.writeStream.foreachBatch(wt.news_batches(ledger, levels="critical")))
        before = part
    return wt.read_ledger(t.spark, ledger).select("code", F.col("ts").cast("timestamp_ntz").alias("ts"), "title", "outcome", "direction", "level")


@query("stream_st5_distinct_messages", "SELECT event_id FROM events")
def st5(t):
    doubled = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return run_stream(t, wt.new_items(doubled, key="event_id")).select("event_id")


@query("stream_st6_session_filter", "SELECT event_id FROM events WHERE isodow(ts) < 6 AND (hour(ts) * 60 + minute(ts) BETWEEN 565 AND 690 OR hour(ts) * 60 + minute(ts) BETWEEN 780 AND 900)")
def st6(t):
    return run_stream(t, wt.in_session(t.quotes(event_stream(t)))).select("event_id")


@query("stream_st7_tick_bars", "SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS code, CAST(ts AS DATE) AS trade_date, " + ", ".join(
    r(e, n, 2) for e, n in (("first(value ORDER BY ts, event_id)", "open"), ("max(value)", "high"), ("min(value)", "low"), ("last(value ORDER BY ts, event_id)", "close"), ("count(*)", "volume"), ("sum(value)", "amount")))
    + " FROM events GROUP BY 1, 2", 2)
def st7(t):
    """All ticks in three landings, then a closing notice that ends the last day."""
    ticks = t.table("events").select(F.lpad(F.col("user_id").cast("string"), 6, "0").alias("code"), F.col("ts").cast("timestamp").alias("ts"),
                                     F.col("value").alias("price"), F.lit(1.0).alias("size"), "event_id")
    land = Landing(t, ticks.schema)
    bars = wt.tick_bars(land.stream(), land.stream("closes", "ts timestamp"))
    out = f"{land.base}/out"
    for part in by_time(ticks):
        land.add(part)
        land.run(bars.writeStream.format("parquet").outputMode("append").option("path", out))
    land.add(ticks.agg((F.date_trunc("day", F.max("ts")) + F.expr("INTERVAL '1 02' DAY TO HOUR")).alias("ts")), "closes")
    land.run(bars.writeStream.format("parquet").outputMode("append").option("path", out))
    return t.spark.read.schema(bars.schema).parquet(out).withColumn("amount", F.round("amount", 2))


@query("stream_st4_close_summary", "SELECT count(*) AS checked, count(*) FILTER (WHERE o_orderstatus = 'P') AS holding, 'after_close_summary:2001-08-01' AS event_key FROM orders")
def st4(t):
    sig = t.table("orders").select(F.when(F.col("o_orderstatus") == "P", "HOLD").otherwise("BUY").alias("action"))
    ledger = t.table("orders").select(F.concat(F.lit("after_close_summary:"), F.date_sub(F.to_date("o_orderdate"), 2).cast("string")).alias("event_key")).distinct()
    return wt.close_summary("2001-08-01 15:30:00", ledger, sig.where(F.lit(False)), sig)


# ---- training panel, models, daily run ------------------------------------------------------

PANEL_FACTORS = ("RET20", "MA20", "VOLZ20", "QTLD20")
PANEL_PROP = dict(volz_window=60, volz_min_count=5, min_corr=0.05, max_leaders=4)


def small_panel(t, **kw):
    bars = cut_lineage(t.bars().select("code", "trade_date", "close", "volume"))  # all that these factors read
    return training_panel(bars, t.market_bars(), t.fundamentals(), names=list(PANEL_FACTORS), propagation_options=PANEL_PROP, **kw)[0]


PANEL = {
    "pn": f"SELECT code, trade_date, close, volume, lead(close, 5) OVER ({P}) / close - 1 AS f5, lead(close, 20) OVER ({P}) / close - 1 AS f20, lead(close, 60) OVER ({P}) / close - 1 AS f60, "
          f"min(close) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / close - 1 AS dd, row_number() OVER ({P}) AS i, count(*) OVER (PARTITION BY code) AS n, "
          f"close / lag(close, 20) OVER ({P}) - 1 AS r20, avg(close) OVER ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) / close AS m20 FROM bars",
    "pk": "SELECT *, f20 + 0.5 * dd AS ls FROM pn WHERE n >= 320 AND i > 250 AND f20 IS NOT NULL",
    "pf": "SELECT p.*, coalesce(CASE WHEN p.trade_date - f.available_at <= 400 THEN f.ocf_to_eps END, 0) AS o FROM pk p ASOF LEFT JOIN funds f ON p.code = f.code AND p.trade_date > f.available_at"}


@query("panel_b02_training_set", with_ctes("bars", "funds", **PANEL) + "SELECT trade_date, code, CAST(least(9, floor(row_number() OVER (PARTITION BY trade_date ORDER BY ls, code) * 10 / count(*) OVER (PARTITION BY trade_date))) AS INTEGER) AS label, "
       + ", ".join(r(e, n) for e, n in (("ls", "label_score"), ("f5", "forward_5d_return"), ("f60", "forward_60d_return"), ("r20", "RET20"), ("m20", "MA20"), ("o", "ocf_to_eps"))) + " FROM pf")
def b02(t):
    return small_panel(t).select("trade_date", "code", "label", "label_score", "forward_5d_return", "forward_60d_return", "RET20", "MA20", "ocf_to_eps")


FULL_PANEL = {
    **factor_ctes(ALL), **PANEL, "pc": "SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS idx FROM (SELECT DISTINCT trade_date FROM pk)", **prop_ctes("pk", "pc"),
    "pl": "SELECT trade_date, code, ls, f5, f20, f60, dd, o, least(9, floor(row_number() OVER (PARTITION BY trade_date ORDER BY ls, code) * 10 / count(*) OVER (PARTITION BY trade_date))) AS label FROM pf"}
FULL_VALUES = {"label": "label", "label_score": "ls", "forward_5d_return": "f5", "forward_20d_return": "f20", "forward_60d_return": "f60", "forward_20d_drawdown": "pl.dd",
               **{n: f"fa.{n} / {UNITS.get(n, 1.0)!r}" for n in ALL}, **{n: f"pv.{c}" for n, c in PROP_COLUMNS.items()}, "ocf_to_eps": "o"}


@query("panel_b02_full_training_set", with_ctes("fx", "market", "funds").rstrip() + ", " + stored(FULL_PANEL) + " SELECT year(pl.trade_date) AS year, count(*) AS rows, "
       + ", ".join(r(f"avg({e})", n) for n, e in FULL_VALUES.items()) + " FROM pl JOIN fa ON fa.code = pl.code AND fa.trade_date = pl.trade_date "
         "JOIN pv ON pv.code = pl.code AND pv.trade_date = pl.trade_date GROUP BY 1")
def b02_full(t):
    """The whole panel (300 factors, labels, propagation, fundamentals): the mean of every column per year."""
    panel, _ = training_panel(cut_lineage(t.bars()), t.market_bars(), t.fundamentals(), propagation_options=PANEL_PROP)
    others = [c for c in FULL_VALUES if c not in ALL]
    stats = panel.select(F.year("trade_date").alias("year"), *others, in_units().alias("values")).groupBy("year").agg(
        F.count("*").alias("rows"), *[F.avg(c).alias(c) for c in others], vector_to_array(Summarizer.mean(F.col("values"))).alias("means"))
    place = {n: i for i, n in enumerate(ALL)}
    return stats.select("year", "rows", *[F.col("means")[place[c]].alias(c) if c in place else c for c in FULL_VALUES])


@query("ml_m02_calendar_split", with_ctes("scored", d="SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i FROM (SELECT DISTINCT trade_date FROM scored)",
       b="SELECT max(trade_date) AS m FROM d", v="SELECT (SELECT min(i) FROM d, b WHERE trade_date >= m - INTERVAL 12 MONTH) AS vi, (SELECT min(i) FROM d, b WHERE trade_date >= m - INTERVAL 6 MONTH) AS ti",
       p="SELECT (SELECT trade_date FROM d WHERE i = greatest(0, vi - 20)) AS te, (SELECT trade_date FROM d WHERE i = vi) AS vs, (SELECT trade_date FROM d WHERE i = greatest(vi, ti - 20)) AS ve, (SELECT trade_date FROM d WHERE i = ti) AS ts FROM v",
       q="SELECT CASE WHEN trade_date < te THEN 'train' WHEN trade_date >= vs AND trade_date < ve THEN 'val' WHEN trade_date >= ts THEN 'test' END AS part FROM scored, p") + "SELECT part, count(*) AS rows FROM q GROUP BY 1")
def m02(t):
    df = scored(t)
    return mark_split(df, calendar_split(df, 20)).groupBy("part").agg(F.count("*").alias("rows"))


@query("ml_m03_fraction_split", with_ctes("scored", d="SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT trade_date FROM scored)",
       v="SELECT CAST(floor(max(n) * 0.7) AS BIGINT) AS vi, CAST(floor(max(n) * 0.85) AS BIGINT) AS ti FROM d",
       p="SELECT (SELECT trade_date FROM d WHERE i = greatest(0, vi - 20)) AS te, (SELECT trade_date FROM d WHERE i = vi) AS vs, (SELECT trade_date FROM d WHERE i = greatest(vi + 1, ti - 20)) AS ve, (SELECT trade_date FROM d WHERE i = ti) AS ts FROM v",
       q="SELECT CASE WHEN trade_date < te THEN 'train' WHEN trade_date >= vs AND trade_date < ve THEN 'val' WHEN trade_date >= ts THEN 'test' END AS part FROM scored, p") + "SELECT part, count(*) AS rows FROM q GROUP BY 1")
def m03(t):
    df = scored(t)
    return mark_split(df, fraction_split(df, 20)).groupBy("part").agg(F.count("*").alias("rows"))


FEATURES = ("RET20", "MA20", "VOLZ20", "QTLD20", "ocf_to_eps")


EVALUATED = ("label", "label_score", "forward_20d_return")


def ranker(t):
    """The panel with the columns that training and evaluation read, the model and the scored panel."""
    panel = cut_lineage(small_panel(t, columns=(*EVALUATED, "ocf_to_eps")))
    bounds = calendar_split(panel, 20)
    return panel, *train_ranker(panel, list(FEATURES), bounds, min_rows=20)


@query("ml_m01_m04_ranker_evaluation")
def m01(t):
    """Boosted trees on the decile label, evaluated on the test part (learned: no SQL twin)."""
    _, _, out = ranker(t)
    test = cut_lineage(out.where(F.col("part") == "test").select("trade_date", "code", *EVALUATED, "score"))
    return evaluation_bundle(test, "score", "forward_20d_return", ks=(2, 3))


@query("ml_m05_feature_gains")
def m05(t):
    panel, model, _ = ranker(t)
    return feature_gains(model, list(FEATURES), panel)
