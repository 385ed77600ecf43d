"""Smaller operators: regime dates, joins of features, progress scans, samples, display lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions import dates as dt
from barloom.operators import propagation as pr
from barloom.operators import regime as rg
from barloom.operators import signals as sg
from barloom.sources import merge as mg
from barloom.sources import scans as sc
from barloom.operators.labels import split_history
from barloom.session import ensure_checkpoint_dir
from catalog.behaviour import PROP, PROP_COLUMNS, prop_ctes, stored
from catalog.panel import BULL, P
from catalog.registry import query, r, with_ctes


@query("regime_j07_bear_rows", with_ctes("bars", "market").rstrip() + ", " + BULL + f" SELECT code, trade_date, {r('close', 'close', 8)} FROM bars JOIN bull USING (trade_date) WHERE NOT bull", 8)
def j07(t):
    return rg.only_regime(t.bars(), rg.trend_flags(t.market_bars()), False).select("code", "trade_date", "close")


@query("prop_w51_volume_z", with_ctes("bars") + f"SELECT code, trade_date, {r('CASE WHEN count(volume) OVER w >= 10 THEN (volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0) END', 'volz', 6)} "
       f"FROM bars WINDOW w AS ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)", 6)
def w51(t):
    return pr.volume_zscore(t.bars()).select("code", "trade_date", "volz")


@query("prop_w51_latest_volume_z", with_ctes("bars", k="SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS i FROM bars")
       + f"SELECT code, {r('coalesce((max(volume) FILTER (WHERE i = 1) - avg(volume)) / nullif(stddev_samp(volume), 0), 0)', 'volz', 6)} FROM k WHERE i <= 20 GROUP BY 1", 6)
def w51_latest(t):
    return pr.latest_volume_z(t.bars())


@query("prop_j01_feature_join", with_ctes("bars", "cal").rstrip() + ", " + stored(prop_ctes()) + f" SELECT b.code, b.trade_date, "
       + ", ".join(r(f"CASE WHEN b.trade_date >= DATE '1998-01-01' THEN {c} ELSE 0 END", n) for n, c in PROP_COLUMNS.items()) + " FROM bars b JOIN pv USING (code, trade_date)")
def j01(t):
    """Features joined to the panel: every bar is kept once with its features; rows without any (here before 1998) get 0."""
    features = pr.propagation_features(t.bars(), t.calendar(), **PROP).where(F.col("trade_date") >= F.lit("1998-01-01").cast("date"))
    return pr.add_propagation(t.bars(), features).select("code", "trade_date", *pr.FEATURES)


CHUNKS = ("SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, CAST(d AS DATE) AS chunk_start, CASE WHEN d < DATE '2000-06-05' OR s_acctbal > 5000 THEN 'done' ELSE 'failed' END AS status FROM supplier, "
          "(SELECT unnest(generate_series(TIMESTAMP '2000-01-05', TIMESTAMP '2000-11-20', INTERVAL 1 MONTH)) AS d)")
SOME_CODES = ("000001", "000004", "000007")


@query("scan_s09_progress", f"SELECT code, chunk_start, status, 'some' AS scan FROM ({CHUNKS}) WHERE code IN {SOME_CODES} UNION ALL SELECT code, chunk_start, status, 'failed' FROM ({CHUNKS}) WHERE status = 'failed'")
def s09(t):
    """Progress scans over all suppliers' chunks: of some codes, and of all failed chunks."""
    s = t.table("supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), "s_acctbal", F.lit("2000-01-05").cast("date").alias("start"), F.lit("2000-11-20").cast("date").alias("end"))
    done = (F.col("chunk_start") < F.lit("2000-06-05").cast("date")) | (F.col("s_acctbal") > 5000)
    progress = dt.month_chunks(s, 1).select("code", "chunk_start", F.when(done, "done").otherwise("failed").alias("status"))
    return sc.chunk_progress(progress, SOME_CODES).withColumn("scan", F.lit("some")).unionByName(sc.chunk_progress(progress, status="failed").withColumn("scan", F.lit("failed")))


def folder(t, name: str) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("bars_k01_k02_panel_files", with_ctes("bars") + f"SELECT code, trade_date, CAST(year(trade_date) AS INTEGER) AS year, {r('CASE WHEN year(trade_date) = 1997 THEN close * 2 ELSE close END', 'close', 8)} FROM bars "
       "UNION ALL SELECT 'added', DATE '1997-02-03', 1997, 5.0", 8)
def k01(t):
    """The panel written by year, one year of it merged with updates and a new code and written over, and read back."""
    path = folder(t, "panel")
    mg.write_panel(t.bars().select("code", "trade_date", "close"), path)
    stored = t.spark.read.parquet(path)
    updates = stored.where("year = 1997").select("code", "trade_date", (F.col("close") * 2).alias("close"), F.lit(1).alias("seq"))
    updates = updates.unionByName(t.spark.range(1).select(F.lit("added").alias("code"), F.lit("1997-02-03").cast("date").alias("trade_date"), F.lit(5.0).alias("close"), F.lit(1).alias("seq")))
    merged = mg.merge_latest(stored.drop("year"), updates, ["code", "trade_date"], sequence="seq").drop("seq")
    mg.refresh_partitions(t.spark, merged, updates, path)
    return t.spark.read.parquet(path).select("code", "trade_date", F.col("year").cast("int").alias("year"), "close")


@query("merge_k04_announcements", with_ctes("anns", u="SELECT o_orderkey, code, published_at, CASE WHEN o_orderkey % 3 = 0 THEN 'corrected ' || title ELSE title END AS title FROM anns")
       + "SELECT o_orderkey || '-' || code AS announcement_id, code, title, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 0 END AS seq FROM u "
         "UNION ALL SELECT 'new-' || o_orderkey || '-' || code, code, title, 1 FROM anns WHERE o_orderkey % 7 = 0")
def k04(t):
    """Keyed upsert of all announcements: a third is corrected twice (the later correction counts), some are new."""
    base = t.announcements().select("announcement_id", "code", "title", F.lit(0).alias("seq"))
    key = F.split("announcement_id", "-")[0].cast("long")
    twice = base.where(key % 3 == 0)
    updates = twice.withColumns({"title": F.concat(F.lit("corrected "), "title"), "seq": F.lit(2)}).unionByName(
        twice.withColumns({"title": F.lit("draft"), "seq": F.lit(1)})).unionByName(
        base.where(key % 7 == 0).withColumns({"announcement_id": F.concat(F.lit("new-"), "announcement_id"), "seq": F.lit(1)}))
    return mg.merge_latest(base, updates, ["announcement_id", "code"], sequence="seq")


@query("merge_k08_decision_log", with_ctes("signals") + f"SELECT CASE action WHEN 'BUY' THEN 'r1' WHEN 'SELL' THEN 'r2' ELSE 'r3' END AS run_id, id, {r('confidence')} FROM signals")
def k08(t):
    """Three runs added to the log, the second one twice: the repeated run replaces itself."""
    path = folder(t, "log")
    for run, action in (("r1", "BUY"), ("r2", "SELL"), ("r3", "HOLD"), ("r2", "SELL")):
        mg.append_log(t.signals().where(F.col("action") == action).select("id", "confidence"), path, run)
    return t.spark.read.parquet(path).select("run_id", "id", "confidence")


@query("merge_k09_run_report", with_ctes("bars", c="SELECT code, count(*) AS n FROM bars GROUP BY 1") + "SELECT 'date' AS kind, CAST(trade_date AS VARCHAR) AS name, count(DISTINCT code) AS n, NULL AS reason FROM bars GROUP BY 2 "
       "UNION ALL SELECT 'skipped', code, n, '<540' FROM c WHERE n < 540")
def k09(t):
    """Report of a run as JSON lines: codes per date and the instruments left out, read back."""
    path = folder(t, "report")
    bars = t.bars()
    dates = bars.groupBy("trade_date").agg(F.count_distinct("code").alias("n")).select(F.lit("date").alias("kind"), F.col("trade_date").cast("string").alias("name"), "n", F.lit(None).cast("string").alias("reason"))
    skipped = split_history(bars, 540)[1].select(F.lit("skipped").alias("kind"), F.col("code").alias("name"), F.col("rows").alias("n"), "reason")
    report = dates.unionByName(skipped)
    mg.write_report(report, path)
    return t.spark.read.schema(report.schema).json(path)


@query("signal_s12_samples", with_ctes("signals", s="SELECT *, row_number() OVER (PARTITION BY action ORDER BY run_ts, id) AS sample_no, count(*) OVER (PARTITION BY action) AS n FROM signals WHERE action <> 'HOLD'")
       + "SELECT id, sample_no, sample_no <= least(greatest(1, floor(n * 0.8)), n - 1) AS in_train FROM s")
def s12(t):
    marked = t.signals().where(F.col("action") != "HOLD").withColumn("success", (F.col("id") % 2).cast("int"))
    return sg.calibration_samples(marked).select("id", "sample_no", "in_train")


@query("scan_s07_visible_news", with_ctes("news") + "SELECT event_id FROM news WHERE event_id % 3 <> 0 OR title = 'view'")
def s07(t):
    hidden = F.col("event_id") % 3 == 0
    news = t.news().withColumns({"available_at": F.when(~hidden, F.col("ts")), "fetched_at": F.when(F.col("title") == "view", F.col("ts"))})
    return sc.visible_news(news).select("event_id")


@query("merge_k10_added_column", with_ctes("bars") + f"SELECT code, trade_date, {r('close', 'close', 8)}, CAST(NULL AS VARCHAR) AS note FROM bars", 8)
def k10(t):
    return mg.align_schema(t.bars().select("code", "trade_date", "close"), {"note": "string", "close": "double"})


@query("merge_st_alert_ledger", "SELECT DISTINCT user_id, event_type FROM events")
def ledger(t):
    """Insert-if-absent ledger: the second delivery of a key adds nothing."""
    keys = t.table("events").select("user_id", "event_type")
    first = mg.insert_absent(keys.where(F.lit(False)), keys, ["user_id", "event_type"])
    return mg.insert_absent(first, keys, ["user_id", "event_type"])
