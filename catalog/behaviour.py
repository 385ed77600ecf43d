"""Event-feature, signal, propagation, regime and sector queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import rules as ru
from barloom.operators import event_features as ef
from barloom.operators import propagation as pr
from barloom.operators import regime as rg
from barloom.operators import research as rs
from barloom.operators import signals as sg
from barloom.operators import structured_events as se
from barloom.operators.asof import latest_per_key
from barloom.operators.evaluate import coverage, evaluate_features, event_study, feature_deciles
from barloom.operators.labels import forward_returns
from barloom.plans.event_panel import event_panel
from barloom.plans.models import apply_calibration, fit_calibration
from catalog.panel import P, pct
from barloom.session import cut_lineage
from catalog.registry import query, r, with_ctes

KINDS = ("earnings", "holding", "inquiry", "risk", "other")

# ---- calendar mapping and event features ---------------------------------------------------

NMAP = {"nm": "SELECT n.*, (SELECT min(trade_date) FROM ncal c WHERE c.trade_date > CAST(n.ts AS DATE) OR (c.trade_date = CAST(n.ts AS DATE) "
              "AND CAST(n.ts AS TIME) <= TIME '15:00:00')) AS feature_date FROM news n WHERE CAST(n.ts AS DATE) >= (SELECT min(trade_date) FROM ncal)"}
AMAP = {"am": "SELECT a.code, a.title, c.trade_date AS feature_date, CASE WHEN title LIKE '1-URGENT%' THEN 'earnings' WHEN title LIKE '2-HIGH%' THEN 'holding' "
              "WHEN title LIKE '3-MEDIUM%' THEN 'inquiry' WHEN title LIKE '4-NOT%' THEN 'risk' ELSE 'other' END AS ann_type "
              "FROM anns a ASOF JOIN cal c ON CAST(a.published_at AS DATE) < c.trade_date WHERE CAST(a.published_at AS DATE) >= (SELECT min(trade_date) FROM cal)"}


@query("events_j08_news_days", with_ctes("news", "ncal", **NMAP) + "SELECT event_id, feature_date FROM nm WHERE feature_date IS NOT NULL")
def j08(t):
    return ef.news_on_days(t.news(), t.news_calendar()).select("event_id", "feature_date")


@query("events_j08_p07_filing_days", with_ctes("anns", "cal", **AMAP) + "SELECT code, feature_date, ann_type, count(*) AS n FROM am GROUP BY 1, 2, 3")
def filing_days(t):
    mapped = ef.announcements_on_days(t.announcements(), t.calendar(), t.priority_classes)
    return mapped.groupBy("code", "feature_date", "ann_type").agg(F.count("*").alias("n"))


DN = {"dn": "SELECT code, feature_date AS trade_date, count(*) AS ec, count(score) AS sc, coalesce(sum(score), 0) AS ss, count(*) FILTER (WHERE score > 0.08) AS ps, "
            "count(*) FILTER (WHERE score < -0.08) AS ng, max(abs(score)) AS mx FROM nm WHERE feature_date IS NOT NULL GROUP BY 1, 2"}
DA = {"da": "SELECT code, feature_date AS trade_date, count(*) AS ec, " + ", ".join(f"count(*) FILTER (WHERE ann_type = '{k}') AS {k}" for k in KINDS) + " FROM am GROUP BY 1, 2"}


@query("events_a01_daily_news", with_ctes("news", "ncal", **NMAP, **DN) + f"SELECT code, trade_date, ec AS news_event_count, sc AS news_scored_count, {r('ss', 'news_score_sum', 6)}, "
       f"ps AS news_pos_daily, ng AS news_neg_daily, {r('mx', 'news_absmax_daily', 6)} FROM dn", 6)
def a01(t):
    return ef.daily_news(ef.news_on_days(t.news(), t.news_calendar()))


@query("events_a02_daily_filings", with_ctes("anns", "cal", **AMAP, **DA) + "SELECT code, trade_date, ec AS ann_event_count, " + ", ".join(f"{k} AS ann_{k}" for k in KINDS) + " FROM da")
def a02(t):
    return ef.daily_announcements(ef.announcements_on_days(t.announcements(), t.calendar(), t.priority_classes), KINDS)


def roll(x: str, w: int, how: str = "sum") -> str:
    return f"{how}({x}) OVER ({P} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def age(limit: int) -> str:
    a = f"idx - last_value(CASE WHEN ec > 0 THEN idx END IGNORE NULLS) OVER ({P})"
    return f"CASE WHEN {a} <= {limit} THEN {a} END"


NF = {"nf": "SELECT g.code, g.trade_date, g.idx, coalesce(ec, 0) AS ec, coalesce(sc, 0) AS sc, coalesce(ss, 0) AS ss, coalesce(ps, 0) AS ps, coalesce(ng, 0) AS ng, mx "
            "FROM ngrid g LEFT JOIN dn USING (code, trade_date)"}
NEWS_COLS = ", ".join([*(r(f"{roll('ss', w)} / nullif({roll('sc', w)}, 0)", f"news_score_{w}d", 9) for w in (1, 3, 7)),
                       f"CAST({roll('ec', 7)} AS BIGINT) AS news_count_7d", f"CAST({roll('ps', 7)} AS BIGINT) AS news_pos_count_7d",
                       f"CAST({roll('ng', 7)} AS BIGINT) AS news_neg_count_7d", r(roll("mx", 7, "max"), "news_absmax_7d", 9),
                       f"{age(7)} AS news_latest_age_days", f"CAST({roll('ec', 7)} > 0 AS INTEGER) AS has_news_7d"])


@query("events_b03_w45_news_features", with_ctes("ngrid", **NMAP, **DN, **NF) + f"SELECT code, trade_date, {NEWS_COLS} FROM nf", 9)
def w45(t):
    return event_panel(t.news_panel(), t.news(), calendar=t.news_calendar())


@query("events_p06_news_features_from_start", with_ctes("ngrid", **NMAP, **DN, **NF) + f"SELECT * FROM (SELECT code, trade_date, {NEWS_COLS} FROM nf) WHERE trade_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-26'", 9)
def p06(t):
    """Output range with warm-up rows before it: same values as the full grid."""
    return event_panel(t.news_panel(), t.news(), calendar=t.news_calendar(), start="2024-01-16", end="2024-01-26")


AF = {"af": "SELECT b.code, b.trade_date, c.idx, coalesce(ec, 0) AS ec, " + ", ".join(f"coalesce({k}, 0) AS {k}" for k in KINDS)
            + " FROM bars b JOIN cal c USING (trade_date) LEFT JOIN da USING (code, trade_date)"}
ANN_COLS = ", ".join([f"CAST({roll('ec', 7)} AS BIGINT) AS ann_count_7d", f"CAST({roll('ec', 20)} AS BIGINT) AS ann_count_20d", f"{age(20)} AS ann_latest_age_days",
                      *(f"CAST({roll(k, 20)} AS BIGINT) AS ann_{k}_count_20d" for k in KINDS), f"CAST({roll('ec', 7)} > 0 AS INTEGER) AS has_ann_7d"])


def ann_panel(t):
    return event_panel(t.bars(), None, t.announcements(), classes=t.priority_classes, calendar=t.calendar())


@query("events_b03_w47_filing_features", with_ctes("bars", "anns", "cal", **AMAP, **DA, **AF) + f"SELECT code, trade_date, {ANN_COLS} FROM af")
def w47(t):
    return ann_panel(t)


LAB = {"fw": f"SELECT code, trade_date, lead(close, 20) OVER ({P}) / close - 1 AS y FROM bars",
       "fe": f"SELECT code, trade_date, {ANN_COLS} FROM af", "ev": "SELECT fe.*, y FROM fe JOIN fw USING (code, trade_date) WHERE y IS NOT NULL",
       "dmn": "SELECT trade_date, avg(y) AS dm FROM ev GROUP BY 1",
       "lg": " UNION ALL ".join(f"SELECT trade_date, code, y AS ret, y - dm AS excess, 'ann_{k}_count_20d' AS event_class FROM ev JOIN dmn USING (trade_date) WHERE ann_{k}_count_20d > 0" for k in KINDS)}


def labelled_events(t):
    labels = forward_returns(t.bars(), (20,)).select("code", "trade_date", F.col("forward_20d_return").alias("y")).where(F.col("y").isNotNull())
    return ann_panel(t).join(labels, ["code", "trade_date"])


def _dist(v: str) -> str:
    q = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    return (f"count({v}) AS {v}_count, {r(f'avg({v})', f'{v}_mean')}, {r(f'stddev_samp({v})', f'{v}_std')}, {r(f'avg(CASE WHEN {v} > 0 THEN 1.0 ELSE 0 END)', f'{v}_positive_rate')}, "
            + ", ".join(r(f"quantile_cont({v}, {p})", f"{v}_{n}") for n, p in q.items()))


@query("eval_a10_event_study", with_ctes("bars", "anns", "cal", **AMAP, **DA, **AF, **LAB) + f"SELECT event_class, count(*) AS rows, count(DISTINCT trade_date) AS dates, count(DISTINCT code) AS codes, {_dist('ret')}, {_dist('excess')} FROM lg GROUP BY 1")
def a10(t):
    classes = [f"ann_{k}_count_20d" for k in KINDS]
    return event_study(cut_lineage(labelled_events(t).select("code", "trade_date", *classes, "y")), classes, "y")


FEATS = ["ann_count_7d", "ann_count_20d", "ann_latest_age_days"]


@query("eval_a12_coverage", with_ctes("bars", "anns", "cal", **AMAP, **DA, **AF, **LAB) + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS non_null_rows, {r(f'count({c}) / count(*)', 'coverage')}, {r(f'count({c}) FILTER (WHERE has_ann_7d > 0) / count(*)', 'conditional_coverage')} FROM ev" for c in FEATS))
def a12(t):
    return coverage(labelled_events(t), FEATS, "y", "has_ann_7d")


def feature_rows(t):
    return labelled_events(t).select("code", "trade_date", *FEATS, "has_ann_7d", "y")


def _ic_part(f: str, scope: str, cond: str) -> str:
    return (f"SELECT '{f}' AS feature, '{scope}' AS scope, trade_date, covar_pop(rs, rt) / nullif(stddev_pop(rs) * stddev_pop(rt), 0) AS ic FROM (SELECT trade_date, {f} AS s, y AS t, "
            f"{pct(f, 'trade_date')} AS rs, {pct('y', 'trade_date')} AS rt FROM (SELECT * FROM ev WHERE {f} IS NOT NULL AND {cond})) GROUP BY trade_date HAVING count(*) >= 5 AND min(s) < max(s) AND min(t) < max(t)")


SCOPES = (("all", "true"), ("conditional", "has_ann_7d > 0"))


@query("eval_b04_feature_report", with_ctes("bars", "anns", "cal", **AMAP, **DA, **AF, **LAB, ics=" UNION ALL ".join(_ic_part(f, s, c) for f in FEATS for s, c in SCOPES),
    cv=" UNION ALL ".join(f"SELECT '{f}' AS feature, '{s}' AS scope, count({f}) AS known_rows, count({f}) / count(*) AS coverage FROM ev WHERE {c}" for f in FEATS for s, c in SCOPES),
    sm="SELECT feature, scope, avg(ic) AS mean, stddev_samp(ic) AS std, avg(ic) / nullif(stddev_samp(ic), 0) AS icir, median(ic) AS median, "
       "avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0 END) AS positive_rate, count(*) AS days FROM ics WHERE ic IS NOT NULL GROUP BY 1, 2")
    + f"SELECT feature, scope, known_rows, {r('coverage', 'coverage')}, " + ", ".join(r(c, c) for c in ("mean", "std", "icir", "median", "positive_rate")) + ", days FROM cv LEFT JOIN sm USING (feature, scope)")
def b04(t):
    """IC and coverage of every feature, over all rows and over rows with recent filings."""
    return evaluate_features(cut_lineage(feature_rows(t)), FEATS, "y", min_per_date=5, conditions={f: "has_ann_7d" for f in FEATS})


@query("eval_b04_feature_deciles", with_ctes("bars", "anns", "cal", **AMAP, **DA, **AF, **LAB, al=" UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{s}' AS scope, trade_date, code, {f} AS v, y FROM ev WHERE {f} IS NOT NULL AND {c}" for f in FEATS for s, c in SCOPES),
    dc="SELECT *, least(9, floor(row_number() OVER (PARTITION BY feature, scope, trade_date ORDER BY v, code) * 10 / count(*) OVER w)) AS decile, count(*) OVER w AS n, min(v) OVER w < max(v) OVER w AS varies FROM al "
       "WINDOW w AS (PARTITION BY feature, scope, trade_date)",
    dm2="SELECT feature, scope, trade_date, decile, avg(y) AS m FROM dc WHERE n >= 10 AND varies GROUP BY 1, 2, 3, 4")
    + f"SELECT feature, scope, CAST(decile AS INTEGER) AS decile, {r('avg(m)', 'mean_return')}, count(*) AS dates FROM dm2 GROUP BY 1, 2, 3")
def b04_deciles(t):
    """Mean return by decile of every feature and scope."""
    return feature_deciles(cut_lineage(feature_rows(t)), FEATS, "y", min_per_date=10, conditions={f: "has_ann_7d" for f in FEATS})


@query("events_a18_clock_profile", f"SELECT count(*) AS rows, count(DISTINCT user_id) AS codes, {r('avg(CASE WHEN CAST(ts AS TIME) = TIME $$00:00:00$$ THEN 1.0 ELSE 0 END)', 'midnight_rate')}, "
       f"{r('avg(CASE WHEN hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) <= 54000 THEN 1.0 ELSE 0 END)', 'before_or_at_15_rate')} FROM events")
def a18(t):
    return rs.clock_profile(t.news(), "ts").select("rows", "codes", "midnight_rate", "before_or_at_15_rate")


@query("events_a18_top_clocks", "SELECT strftime(ts, '%H:%M:%S') AS clock, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def clocks(t):
    return rs.top_clocks(t.news(), "ts")


@query("events_a16_decayed_sentiment", with_ctes("news", n="SELECT *, row_number() OVER (PARTITION BY code ORDER BY ts DESC, event_id) AS k FROM news",
       w="SELECT code, coalesce(score, 0) AS s, exp(-0.15 * (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 86400000000.0) AS w FROM n WHERE k <= 15")
       + f"SELECT code, {r('round(sum(s * w) / sum(w), 4)', 'sentiment')}, count(*) AS scored_count FROM w GROUP BY 1")
def a16(t):
    return rs.decayed_sentiment(t.news(), F.lit("2024-01-31").cast("timestamp"))


@query("events_t04_strongest_news", with_ctes("news") + "SELECT code, event_id, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY abs(score) DESC, ts DESC, event_id) AS k FROM news WHERE score IS NOT NULL) WHERE k <= 3")
def t04(t):
    return rs.strongest_news(t.news()).select("code", "event_id", F.col("row_no").alias("place"))


@query("events_p10_labels", with_ctes("news") + "SELECT event_id, CASE WHEN score >= 0.3 THEN 'strong_positive' WHEN score >= 0.08 THEN 'positive' WHEN score <= -0.3 THEN 'strong_negative' WHEN score <= -0.08 THEN 'negative' ELSE 'neutral' END AS label FROM news")
def p10(t):
    return t.news().select("event_id", ru.sentiment_label("score").alias("label"))


# ---- signals ------------------------------------------------------------------------------

NX = {"nb": f"SELECT code, trade_date, close, lead(close, 5) OVER ({P}) AS exit_price FROM bars",
      "nx": "SELECT s.*, b.close AS entry_price, b.exit_price, (b.exit_price / b.close - 1) * 100 AS fr FROM signals s ASOF LEFT JOIN nb b ON s.code = b.code AND s.run_date < b.trade_date"}


@query("signal_j09_next_bars", with_ctes("bars", "signals", **NX) + f"SELECT id, {r('entry_price', 'entry_price', 8)}, {r('exit_price', 'exit_price', 8)}, {r('fr', 'forward_return', 8)} FROM nx", 8)
def j09(t):
    from barloom.operators.asof import next_bars
    df = next_bars(t.signals().withColumn("run_date", F.to_date("run_ts")), t.bars(), 5)
    return df.select("id", "entry_price", "exit_price", "forward_return")


REPORT = {"gr": "SELECT action, CASE WHEN confidence >= 0.75 THEN '>=75%' WHEN confidence >= 0.60 THEN '60%-75%' ELSE '<60%' END AS bucket, "
                "CASE action WHEN 'BUY' THEN fr > 0 WHEN 'SELL' THEN fr < 0 ELSE abs(fr) <= 2 END AS hit, round(fr, 2) AS fr FROM nx WHERE fr IS NOT NULL"}


@query("signal_b05_a13_report", with_ctes("bars", "signals", **NX, **REPORT) + "SELECT CASE WHEN grouping(action) = 0 THEN 'action' WHEN grouping(bucket) = 0 THEN 'bucket' ELSE 'overall' END AS grouping, "
       f"coalesce(action, bucket, 'all') AS key, count(*) AS count, {r('avg(CASE WHEN hit THEN 1.0 ELSE 0 END)', 'hit_rate')}, {r('avg(fr)', 'avg_return')}, {r('median(fr)', 'median_return')} FROM gr GROUP BY GROUPING SETS ((), (action), (bucket))")
def b05(t):
    return sg.signal_report(sg.graded_signals(t.signals(), t.bars(), 5))


@query("signal_p11_p12_p14_rules", with_ctes("signals") + "SELECT id, CASE WHEN confidence >= 0.75 THEN '>=75%' WHEN confidence >= 0.60 THEN '60%-75%' ELSE '<60%' END AS bucket, "
       "CASE WHEN action = 'SELL' AND confidence >= 0.75 THEN 'critical' WHEN action IN ('BUY', 'SELL') THEN 'warning' ELSE 'info' END AS level, "
       "CASE WHEN action <> 'HOLD' AND confidence >= 0.75 THEN 'strong' WHEN action <> 'HOLD' AND confidence >= 0.6 THEN 'watch' WHEN action = 'HOLD' AND confidence >= 0.65 THEN 'hold_note' END AS display_group, "
       "confidence >= 0.7 AS will_push FROM signals")
def rules(t):
    return t.signals().select("id", ru.confidence_bucket("confidence").alias("bucket"), ru.signal_level("action", "confidence").alias("level"),
                              ru.display_group("action", "confidence").alias("display_group"),
                              ru.will_push("confidence", F.lit(0.6), F.lit(0.7)).alias("will_push"))


def fol(n: int) -> dict[str, str]:
    return {"fb": f"SELECT code, trade_date, close, max(high) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) AS mh, min(low) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING) AS ml, "
                  f"lead(close, {n}) OVER ({P}) AS ec, lead(trade_date, {n}) OVER ({P}) AS ed FROM bars",
            "fo": "SELECT s.*, b.trade_date AS bd, b.close AS rc, b.mh, b.ml, b.ec, b.ed FROM signals s ASOF LEFT JOIN fb b ON s.code = b.code AND s.run_date <= b.trade_date"}


@query("signal_j10_following_bars", with_ctes("bars", "signals", **fol(5)) + "SELECT id, " + ", ".join(
    r(f"CASE WHEN ed <= run_date + 50 THEN {c} END", n, 8) for c, n in (("rc", "ref_close"), ("mh", "max_high"), ("ml", "min_low"), ("ec", "end_close"))) + " FROM fo", 8)
def j10(t):
    from barloom.operators.asof import following_bars
    df = following_bars(t.signals().withColumn("run_date", F.to_date("run_ts")), t.bars(), 5, slack_days=35)
    return df.select("id", "ref_close", "max_high", "min_low", "end_close")


def resolved(t):
    return sg.resolve_outcomes(t.priced_signals(), t.bars(), 2)


@query("signal_m07_outcomes", with_ctes("bars", "signals", fb=f"SELECT code, trade_date, close, lead(trade_date, 1) OVER ({P}) AS d1, max(high) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS mh, "
       f"min(low) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS ml, lead(close, 2) OVER ({P}) AS ec, lead(trade_date, 2) OVER ({P}) AS ed FROM bars",
       fo="SELECT s.*, b.d1, b.close AS c0, b.mh, b.ml, b.ec, b.ed FROM signals s ASOF LEFT JOIN fb b ON s.code = b.code AND s.run_date <= b.trade_date",
       f2="SELECT *, CASE WHEN d1 <= run_date + 10003 THEN c0 END AS px, CASE WHEN ed <= run_date + 13 THEN c0 END AS rc, CASE WHEN ed <= run_date + 13 THEN ec END AS e FROM fo",
       f3="SELECT id, action, rc, e, mh, ml, px * CASE WHEN action = 'SELL' THEN 0.95 ELSE 1.05 END AS tg, px * CASE WHEN action = 'SELL' THEN 1.05 ELSE 0.95 END AS st FROM f2 WHERE action <> 'HOLD'",
       f4="SELECT id, rc, e, CASE WHEN action = 'BUY' THEN (tg > 0 AND mh >= tg) OR e > rc * 1.03 ELSE (tg > 0 AND ml <= tg) OR e < rc * 0.98 END AS win, "
          "CASE WHEN action = 'BUY' THEN (st > 0 AND ml <= st) OR e < rc * 0.98 ELSE (st > 0 AND mh >= st) OR e > rc * 1.03 END AS loss FROM f3 WHERE rc > 0 AND e IS NOT NULL")
       + "SELECT id, CASE WHEN win AND NOT loss THEN 1 WHEN loss AND NOT win THEN 0 END AS success FROM f4 WHERE win <> loss")
def m07(t):
    return resolved(t).where(F.col("success").isNotNull()).select("id", "success")


@query("signal_m08_calibration")
def m08(t):
    """Logistic calibration per action (learned, so no SQL twin)."""
    samples = cut_lineage(resolved(t).select("id", "action", "run_ts", "confidence", "success"))  # read once to count, once to place
    return fit_calibration(sg.calibration_samples(samples), min_samples=20)


@query("signal_m09_apply_calibration", with_ctes("signals") + f"SELECT id, {r('CASE action WHEN $$BUY$$ THEN 1 / (1 + exp(-(2 * confidence - 1))) WHEN $$SELL$$ THEN confidence ELSE confidence END', 'calibrated_confidence')} FROM signals")
def m09(t):
    acts = t.signals().select("action").distinct()
    models = acts.select("action", F.when(F.col("action") == "SELL", 10).otherwise(100).alias("sample_size"), F.lit(2.0).alias("coef"), F.lit(-1.0).alias("intercept"))
    return apply_calibration(t.signals(), models).select("id", "calibrated_confidence")


@query("signal_p18_p19_prices", with_ctes("bars", "signals", lb="SELECT code, close AS px, low AS sup, high AS res FROM bars QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1",
       a="SELECT id, action, px, CASE WHEN action = 'BUY' THEN CASE WHEN res > px THEN res ELSE px * 1.05 END WHEN action = 'SELL' THEN CASE WHEN sup > 0 AND sup < px THEN sup ELSE px * 0.97 END ELSE 0 END AS t1, "
         "CASE WHEN action = 'SELL' THEN CASE WHEN res > px THEN res ELSE px * 1.03 END ELSE px * (id % 3) END AS s1 FROM signals JOIN lb USING (code)",
       b="SELECT id, action, px, CASE WHEN action = 'BUY' AND s1 > 0 AND t1 <= s1 THEN round(greatest(px, s1) * 1.05, 2) ELSE t1 END AS t2, s1 FROM a",
       c="SELECT *, CASE WHEN action = 'BUY' AND s1 <= 0 THEN round(px * 0.93, 2) ELSE s1 END AS s3 FROM b")
       + f"SELECT id, {r('t2', 'target', 1)}, {r('s3', 'stop', 1)} FROM c", 1)
def p19(t):
    last = latest_per_key(t.bars().select("code", "trade_date", "close", "low", "high"), ["code"], ["trade_date"])
    df = t.signals().join(last, "code").withColumn("s0", F.when(F.col("action") == "SELL", 0.0).otherwise(F.col("close") * (F.col("id") % 3)))
    target, stop = ru.repaired_target("action", F.lit(0.0), "s0", "close", "low", "high")
    return df.select("id", target.alias("target"), ru.fallback_stop("action", stop, "close").alias("stop"))


# ---- propagation --------------------------------------------------------------------------

# Suppliers trade on about one day in five, so the volume test and the pair count are eased.
PROP = dict(volz_window=60, volz_min_count=5, lookback=60, min_pairs=20, min_corr=0.05, max_leaders=4)

def prop_ctes(rows: str = "bars", days: str = "cal") -> dict[str, str]:
    """Propagation features of ``rows`` (code, trade_date, close, volume) over the calendar ``days``, in steps that are
    stored one by one; the last is ``pv`` (trade_date, code and the features as lret to score)."""
    return {
        "pb": f"SELECT b.code, b.trade_date, idx, close, volume, close / lag(close) OVER ({P}) - 1 AS ret, min(idx) OVER (PARTITION BY code) AS fp, "
              f"CASE WHEN count(volume) OVER z >= 5 THEN (volume - avg(volume) OVER z) / nullif(stddev_samp(volume) OVER z, 0) END AS volz FROM {rows} b JOIN {days} d USING (trade_date) "
              "WINDOW z AS (PARTITION BY code ORDER BY idx RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)",
        "ld": "SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY ret DESC, code) AS k FROM pb WHERE ret >= 0.04 AND volz >= 1 AND idx >= 2 QUALIFY k <= 4",
        # one row per (leader date, leader, slot): the leader's return of the day before the slot
        "l1": "SELECT trade_date, code AS leader, ret AS lret, volz AS lvolz, k, fp, idx - 60 + unnest(range(0, 60)) AS slot FROM ld",
        "l2": "SELECT * FROM l1 WHERE slot >= 1 AND slot - 1 > fp",
        "sl": "SELECT l.trade_date, l.leader, lret, lvolz, k, slot, coalesce(p.ret, 0) AS y FROM l2 l LEFT JOIN pb p ON p.code = l.leader AND p.idx = l.slot - 1",
        "ln": "SELECT trade_date, leader, count(*) AS n FROM sl GROUP BY 1, 2",
        "cd": "SELECT trade_date, code, fp FROM pb",
        "p1": "SELECT sl.trade_date, leader, slot, y, c.code FROM sl JOIN cd c ON c.trade_date = sl.trade_date AND slot > c.fp",
        "p2": "SELECT p1.trade_date, leader, p1.code, y, coalesce(x.ret, 0) AS x FROM p1 LEFT JOIN pb x ON x.code = p1.code AND x.idx = p1.slot",
        "p3": "SELECT trade_date, leader, code, count(*) AS n, covar_pop(y, x) / nullif(stddev_pop(y) * stddev_pop(x), 0) AS c FROM p2 GROUP BY 1, 2, 3",
        "sc": "SELECT p3.trade_date, p3.code, lret, lvolz, k, CASE WHEN leader = p3.code OR ln.n < 20 OR p3.n < 20 THEN 0 ELSE greatest(0, coalesce(c, 0)) END AS corr "
              "FROM p3 JOIN ln USING (trade_date, leader) JOIN (SELECT trade_date, code AS leader, ret AS lret, volz AS lvolz, k FROM ld) USING (trade_date, leader)",
        "sr2": "SELECT *, corr * lret * (1 + greatest(0, lvolz)) AS raw FROM sc",
        "cn": "SELECT trade_date, code, count(*) FILTER (WHERE corr >= 0.05) AS n FROM sr2 GROUP BY 1, 2",
        "bs": "SELECT * FROM sr2 WHERE raw > 0 QUALIFY row_number() OVER (PARTITION BY trade_date, code ORDER BY raw DESC, k) = 1",
        "dd2": "SELECT DISTINCT trade_date, true AS led FROM ld",
        "fx2": "SELECT b.trade_date, b.code, coalesce(s.lret, 0) AS lret, coalesce(s.lvolz, 0) AS lvolz, coalesce(s.corr, 0) AS corr, coalesce(s.raw, 0) AS raw, coalesce(cn.n, 0) AS n, "
               "CASE WHEN led THEN greatest(0, coalesce(s.lret, 0) - coalesce(b.ret, 0)) ELSE 0 END AS under, coalesce(b.ret, 0) AS now "
               "FROM pb b LEFT JOIN bs s USING (trade_date, code) LEFT JOIN cn USING (trade_date, code) LEFT JOIN dd2 USING (trade_date)",
        "pv": "SELECT trade_date, code, lret, lvolz, corr, raw, under, n, raw * (1 + least(0.12, under)) * CASE WHEN now <= 0.025 THEN 1 ELSE 0 END AS score FROM fx2"}


PROP_COLUMNS = dict(zip(pr.FEATURES, ("lret", "lvolz", "corr", "raw", "under", "n", "score")))


def stored(ctes: dict[str, str]) -> str:
    return ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in ctes.items())


PROP_SQL = (with_ctes("bars", "cal").rstrip() + ", " + stored(prop_ctes()) + " SELECT trade_date, code, "
            + ", ".join(r(c, n) for n, c in PROP_COLUMNS.items()) + " FROM pv")


@query("prop_l01_panel_features", PROP_SQL)
def l01(t):
    return pr.propagation_features(t.bars(), t.calendar(), **PROP)


LATEST_SQL = {
    "rt": f"SELECT code, trade_date, close / lag(close) OVER ({P}) - 1 AS ret FROM bars",
    "lq": f"SELECT code, ret AS mv FROM rt QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1",
    "le": "SELECT *, row_number() OVER (ORDER BY mv DESC, code) AS k FROM lq WHERE mv >= 0.04 QUALIFY k <= 8",
    "ly": f"SELECT code AS leader, trade_date, lag(ret) OVER ({P}) AS y FROM rt WHERE code IN (SELECT code FROM le)",
    "pp": "SELECT leader, rt.code, ret, y, row_number() OVER (PARTITION BY leader, rt.code ORDER BY trade_date DESC) AS i, count(*) OVER (PARTITION BY leader, rt.code) AS n "
          "FROM rt JOIN ly USING (trade_date) WHERE y IS NOT NULL AND ret IS NOT NULL AND leader <> rt.code",
    "co": "SELECT leader, code, CASE WHEN max(n) >= 20 THEN greatest(0, coalesce(covar_samp(ret, y) / nullif(stddev_samp(ret) * stddev_samp(y), 0), 0)) ELSE 0 END AS corr FROM pp WHERE i <= {lb} GROUP BY 1, 2"}


def _quotes(t, bars=None):
    moves = latest_per_key(pr.finite_returns(t.bars() if bars is None else bars), ["code"], ["trade_date"])
    return moves.select("code", (F.col("ret") * 100).alias("pct_change"))


@query("prop_l02_latest_features", with_ctes("bars", **{k: v.format(lb=60) for k, v in LATEST_SQL.items()},
       vz="SELECT code, (max(CASE WHEN i = 1 THEN volume END) - avg(volume)) / nullif(stddev_samp(volume), 0) AS vz FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) AS i FROM bars) WHERE i <= 20 GROUP BY 1",
       sw="SELECT co.*, le.mv AS lret, coalesce(vz, 0) AS vz, le.k, coalesce(q.mv, 0) AS now FROM co JOIN le ON le.code = co.leader LEFT JOIN vz ON vz.code = co.leader LEFT JOIN lq q ON q.code = co.code",
       s2="SELECT *, corr * lret * (1 + greatest(0, vz)) AS raw, greatest(0, lret - now) AS under FROM sw",
       s3="SELECT *, raw * (1 + least(0.12, under)) * CASE WHEN now > 0.025 THEN 0.35 ELSE 1 END AS score, count(*) FILTER (WHERE corr >= 0.15) OVER (PARTITION BY code) AS n FROM s2",
       s4="SELECT * FROM s3 QUALIFY row_number() OVER (PARTITION BY code ORDER BY score DESC, k) = 1")
       + f"SELECT lq.code, CASE WHEN score > 0 THEN leader END AS leader, {r('CASE WHEN score > 0 THEN lret ELSE 0 END', pr.FEATURES[0])}, {r('CASE WHEN score > 0 THEN vz ELSE 0 END', pr.FEATURES[1])}, "
         f"{r('CASE WHEN score > 0 THEN corr ELSE 0 END', pr.FEATURES[2])}, {r('CASE WHEN score > 0 THEN raw ELSE 0 END', pr.FEATURES[3])}, {r('CASE WHEN score > 0 THEN under ELSE 0 END', pr.FEATURES[4])}, "
         f"{r('coalesce(n, 0)', pr.FEATURES[5])}, {r('CASE WHEN score > 0 THEN score ELSE 0 END', pr.FEATURES[6])} FROM lq LEFT JOIN s4 USING (code)")
def l02(t):
    quotes = _quotes(t)
    return pr.latest_propagation(t.bars(), quotes, quotes.select("code"))


@query("prop_l03_related_candidates", with_ctes("bars", **{k: v.format(lb=120) for k, v in LATEST_SQL.items()},
       sw="SELECT co.code, co.leader, corr, greatest(0, le.mv - coalesce(q.mv, 0)) AS u, corr * le.mv * (1 + least(0.12, greatest(0, le.mv - coalesce(q.mv, 0)))) AS score FROM co JOIN le ON le.code = co.leader "
          "JOIN lq q ON q.code = co.code WHERE corr >= 0.01 AND co.code NOT IN (SELECT code FROM le)")
       + f"SELECT code, leader, {r('corr')}, {r('u', 'underreaction')}, {r('score')} FROM (SELECT * FROM sw WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY code ORDER BY score DESC, leader DESC) = 1) ORDER BY sw.score DESC, code LIMIT 10".replace("sw.score", "score"))
def l03(t):
    from barloom.operators.cross_section import leaders
    quotes = _quotes(t).select("code", (F.col("pct_change") / 100).alias("ret")).withColumn("all", F.lit(0))
    led = leaders(quotes, volz=None, by="all").select("code", "ret")
    return pr.related_candidates(t.bars(), led, led.where(F.lit(False)).select("code"), min_corr=0.01)


# ---- regime and sectors ---------------------------------------------------------------------

@query("regime_w49_trend_flags", with_ctes("market") + "SELECT trade_date, coalesce(close > CASE WHEN count(*) OVER w = 200 THEN avg(close) OVER w END, false) AS bull FROM market "
       "WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)")
def w49(t):
    return rg.trend_flags(t.market_bars()).select("trade_date", "bull")


VOL = {"mv": "SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS ret FROM market",
       "vv": "SELECT trade_date, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w * sqrt(252) END AS v FROM mv WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
       "vp": "SELECT trade_date, v, cume_dist() OVER (ORDER BY v) AS p FROM vv WHERE v IS NOT NULL"}
REG = "CASE WHEN p > 0.9 THEN 'crisis' WHEN p > 0.7 THEN 'volatile' WHEN p <= 0.3 THEN 'calm' ELSE 'normal' END"


@query("regime_w50_volatility", with_ctes("market", **VOL) + f"SELECT trade_date, {r('v', 'vol_20d')}, {r('p', 'percentile', 6)}, {REG} AS regime, {r('CASE WHEN p > 0.9 THEN 0.8 WHEN p > 0.7 THEN 0.7 ELSE 0.6 END', 'confidence_floor')} FROM vp".replace("4) END) AS vol_20d", "4) END) AS vol_20d"), 6)
def w50(t):
    return rg.volatility_history(t.market_bars()).withColumn("vol_20d", F.round("vol_20d", 4))


@query("regime_w50_current", with_ctes("market", **VOL) + f"SELECT trade_date, {r('v', 'vol_20d')}, {r('p', 'percentile')}, {REG} AS regime, {r('CASE WHEN p > 0.9 THEN 0.8 WHEN p > 0.7 THEN 0.7 ELSE 0.6 END', 'confidence_floor')} FROM vp ORDER BY trade_date DESC LIMIT 1")
def w50c(t):
    return rg.current_regime(rg.volatility_history(t.market_bars()))


SEC = {"sr": f"SELECT code, trade_date, close / lag(close) OVER ({P}) - 1 AS ret FROM bars",
       "sd": "SELECT sector, trade_date, avg(ret) AS ret FROM sr JOIN sectors USING (code) WHERE ret IS NOT NULL GROUP BY 1, 2",
       "si": "SELECT sector, trade_date, sum(ln(1 + ret)) OVER (PARTITION BY sector ORDER BY trade_date) AS lc FROM sd",
       "sb": "SELECT trade_date, coalesce(close / lag(close, 5) OVER (ORDER BY trade_date) - 1, 0) AS b FROM market",
       "ss": "SELECT sector, trade_date, exp(lc - lag(lc, 5) OVER (PARTITION BY sector ORDER BY trade_date)) - 1 AS x FROM si",
       "st": "SELECT sector, trade_date, x, x - b AS e FROM ss JOIN sb USING (trade_date) WHERE x IS NOT NULL",
       "sl": "SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY sector ORDER BY trade_date DESC) = 1"}


def strength(t):
    return rg.sector_strength(rg.sector_index(t.bars(), t.sectors()), t.market_bars())


@query("sector_w52_strength", with_ctes("bars", "market", "sectors", **SEC) + f"SELECT sector, trade_date, {r('x', 'return_5d')}, {r('e', 'excess_return_5d')} FROM st")
def w52(t):
    return strength(t)


@query("sector_j12_context", with_ctes("bars", "market", "sectors", **SEC) + f"SELECT s.code, s.sector, {r('e', 'excess_return_5d')}, CASE WHEN e > 0 THEN 'stronger' WHEN e < 0 THEN 'weaker' ELSE 'level' END AS versus_market FROM sectors s JOIN sl USING (sector)")
def j12(t):
    return rg.sector_context(t.sectors().select("code"), t.sectors(), rg.latest_strength(strength(t)))


# Raw sources as they land, many rows a code, all text: lock-ups and insider trades are sales lines, pre-announcements and
# buy-backs are orders. Dates come in two forms or unreadable, codes without leading zeros, numbers with gaps.
AS_OF = "2000-06-30"
_DAY = "CASE WHEN l_linenumber = 1 THEN strftime(l_shipdate, '%Y%m%d') WHEN l_linenumber = 5 THEN 'unknown' ELSE strftime(l_shipdate, '%Y-%m-%d') END"
_TYPES = (("1-URGENT", "预减"), ("2-HIGH", "首亏"), ("3-MEDIUM", "预增"), ("4-NOT SPECIFIED", "扭亏"))
_ETYPE = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{e}'" for p, e in _TYPES) + " END"
_LINE = "SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(l_shipdate AS DATE) AS d, l_discount * 100 AS pct, l_linenumber AS ln, CASE l_returnflag WHEN 'R' THEN -l_quantity ELSE l_quantity END AS shares FROM lineitem WHERE l_linenumber <> 5"
_FILED = f"SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS code, CAST(o_orderdate AS DATE) AS d, {_ETYPE} AS etype, o_orderstatus AS st FROM orders JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON o_orderkey = l_orderkey"
STRUCTURED_SQL = (
    f"SELECT code, 'lockup' AS type, d AS date, CASE WHEN d >= DATE '{AS_OF}' AND pct >= 3 THEN 'warning' ELSE 'info' END AS level FROM ({_LINE}) WHERE d BETWEEN DATE '{AS_OF}' - 30 AND DATE '{AS_OF}' + 45 "
    f"UNION ALL SELECT code, 'preannouncement', d, CASE WHEN etype IN ('预减', '首亏') THEN 'warning' ELSE 'info' END FROM (SELECT * FROM ({_FILED}) WHERE etype IS NOT NULL QUALIFY row_number() OVER (PARTITION BY code ORDER BY d DESC, etype DESC) = 1) "
    f"UNION ALL SELECT code, CASE WHEN net > 0 THEN 'insider_buy' ELSE 'insider_sell' END, NULL, CASE WHEN net > 0 THEN 'info' ELSE 'warning' END FROM (SELECT code, sum(shares) AS net FROM ({_LINE}) WHERE ln <> 6 AND d >= DATE '{AS_OF}' - 30 GROUP BY 1) WHERE net <> 0 "
    f"UNION ALL SELECT DISTINCT code, 'buyback', CAST(NULL AS DATE), 'info' FROM ({_FILED}) WHERE st = 'P' AND d >= DATE '{AS_OF}' - 30")


def structured_rows(t):
    """Typed events of all suppliers from the raw sources."""
    line = F.col("l_linenumber")
    lines = t.table("lineitem").select(
        F.concat(F.lit(" "), F.col("l_suppkey").cast("string")).alias("code"), (F.col("l_discount") * 100).cast("string").alias("float_pct"),
        F.when(line == 1, F.date_format("l_shipdate", "yyyyMMdd")).when(line == 5, "unknown").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("day"),
        F.when(line == 6, "--").otherwise(F.concat(F.when(F.col("l_returnflag") == "R", "-").otherwise(""), F.col("l_quantity").cast("string"))).alias("shares"))
    etype = F.lit(None).cast("string")
    for priority, name in _TYPES:
        etype = F.when(F.col("o_orderpriority") == priority, name).otherwise(etype)
    filed = t._order_suppliers().select(F.col("l_suppkey").cast("string").alias("code"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("adate"), etype.alias("etype"), "o_orderstatus")
    return se.structured_events(
        AS_OF, lockups=se.cleaned(lines, "day").select("code", F.col("day").alias("release_date"), F.col("float_pct").try_cast("double").alias("float_pct")),
        preannouncements=se.cleaned(filed, "adate", text="etype"),
        insider=se.cleaned(lines, "day", "shares", since=AS_OF).withColumnRenamed("day", "adate"),
        buybacks=se.cleaned(filed.where("o_orderstatus = 'P'"), "adate", since=AS_OF))


WATCHED = "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code FROM supplier WHERE s_acctbal > 0"


@query("sector_j13_peer_events", with_ctes("sectors", e=STRUCTURED_SQL, w=WATCHED, tp="SELECT * FROM e WHERE code NOT IN (SELECT code FROM w) QUALIFY row_number() OVER (PARTITION BY code ORDER BY CASE level WHEN 'warning' THEN 0 ELSE 1 END, type, date NULLS FIRST) = 1",
       pe="SELECT tp.*, sector, row_number() OVER (PARTITION BY sector ORDER BY code) AS k FROM tp JOIN sectors USING (code) QUALIFY k <= 2")
       + "SELECT w.code, s.sector, pe.code AS peer, pe.type AS peer_type, pe.date, pe.k AS link_no FROM w JOIN sectors s USING (code) JOIN pe USING (sector)")
def j13(t):
    """Links of every watched supplier to peers with events; a peer has many events, and only its most severe counts."""
    watch = t.table("supplier").where("s_acctbal > 0").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"))
    return se.peer_events(structured_rows(t), t.sectors(), watch)


@query("events_t07_first_events", f"WITH e AS ({STRUCTURED_SQL}), k AS (SELECT *, CASE level WHEN 'warning' THEN 0 ELSE 1 END AS sev, row_number() OVER (PARTITION BY code ORDER BY CASE level WHEN 'warning' THEN 0 ELSE 1 END, type, date NULLS FIRST) AS i FROM e) "
       "SELECT code, list(type || ' ' || coalesce(CAST(date AS VARCHAR), '-') ORDER BY i) AS types FROM k WHERE i <= 6 GROUP BY 1")
def t07(t):
    first = se.events_by_code(structured_rows(t), 6)
    return first.select("code", F.transform("events", lambda e: F.concat_ws(" ", e["type"], F.coalesce(e["date"].cast("string"), F.lit("-")))).alias("types"))


@query("events_b07_structured", STRUCTURED_SQL)
def b07(t):
    return structured_rows(t).select("code", "type", "date", "level")


@query("regime_a20_index_snapshot", with_ctes("bars", m=f"SELECT code, trade_date, close, round((close / lag(close) OVER ({P}) - 1) * 100, 2) AS p1, round((close / lag(close, 5) OVER ({P}) - 1) * 100, 2) AS p5, "
       f"round((close / lag(close, 20) OVER ({P}) - 1) * 100, 2) AS p20 FROM bars", l="SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1")
       + f"SELECT code, trade_date, {r('p1', 'pct_change', 2)}, {r('p5', 'return_5d', 2)}, {r('p20', 'return_20d', 2)}, CASE WHEN avg(p1) OVER () >= 0.4 THEN 'firm' WHEN avg(p1) OVER () <= -0.4 THEN 'soft' ELSE 'mixed' END AS tone FROM l", 2)
def a20(t):
    return rg.index_snapshot(t.bars()).drop("close")
