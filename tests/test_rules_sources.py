import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.functions import dates as fd
from barloom.functions import numeric as fn
from barloom.functions import rules as ru
from barloom.functions import text as tx
from barloom.operators import research as rs
from barloom.operators import structured_events as se
from barloom.operators import technical as tc
from barloom.operators.signals import calibration_samples, resolve_outcomes
from barloom.plans.models import apply_calibration, best_round, fit_calibration, train_ranker
from barloom.schemas import BARS, check
from barloom.sources import merge as mg
from barloom.sources import payloads as pl
from barloom.sources import scans as sc


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


@pytest.mark.parametrize("action,conf,note,level", [
    ("SELL", 0.80, "", "critical"), ("SELL", 0.60, "", "warning"), ("BUY", 0.90, "", "warning"), ("HOLD", 0.9, "", "info"),
    ("HOLD", 0.5, "跌破止损", "critical")])
def test_signal_level(spark, action, conf, note, level):
    assert one(spark, ru.signal_level(F.lit(action), F.lit(conf), F.lit(note))) == level


@pytest.mark.parametrize("price,stop,target,action,conf,last,reason", [
    (10.0, 10.5, None, "HOLD", 0.5, None, "stop"), (10.0, 10.5, None, "HOLD", 0.5, "2024-01-02 09:00:00", None),
    (10.0, 0.0, 10.1, "HOLD", 0.5, "2024-01-01 09:00:00", "target"), (10.0, 9.0, 12.0, "SELL", 0.6, None, "sell"),
    (10.0, 9.0, 12.0, "SELL", 0.59, None, None)])
def test_position_alert(spark, price, stop, target, action, conf, last, reason):
    got = one(spark, ru.position_alert(F.lit(price), F.lit(stop).cast("double"), F.lit(target).cast("double"), F.lit(action), F.lit(conf),
                                       F.lit(last).cast("timestamp"), F.lit("2024-01-02").cast("date")))
    assert got == reason


def test_small_rules(spark):
    assert one(spark, ru.forced_hold(F.lit(9.5), F.lit("x"), F.lit(100))) == "limit_up"
    assert one(spark, ru.forced_hold(F.lit(1.0), F.lit("*ST x"), F.lit(100))) == "special_treatment"
    assert one(spark, ru.forced_hold(F.lit(1.0), F.lit("x"), F.lit(59))) == "short_history"
    assert one(spark, ru.heavy_sell_pressure(F.lit(0.0), F.lit(5.0), F.lit(0.0), F.lit(9.0), F.lit(-1.0))) is False
    assert one(spark, ru.heavy_sell_pressure(F.lit(10.0), F.lit(18.0), F.lit(1.0), F.lit(1.0), F.lit(0.0))) is True
    assert ru.enabled_levels("red,orange") == ["critical", "warning"] and len(ru.enabled_levels("")) == 3
    target, stop = ru.repaired_target(F.lit("BUY"), F.lit(9.0), F.lit(9.5), F.lit(10.0), F.lit(0.0), F.lit(0.0))
    assert one(spark, target) == pytest.approx(10.5)
    assert one(spark, ru.fallback_stop(F.lit("BUY"), F.lit(0.0), F.lit(10.0))) == pytest.approx(9.3)
    assert set(ru.POSITIVE_PREANNOUNCE).isdisjoint(ru.NEGATIVE_PREANNOUNCE)


def test_text_and_number_helpers(spark):
    assert one(spark, tx.keyword_class(F.lit("关于减持与业绩的公告"))) == "earnings"
    assert one(spark, tx.keyword_class(F.lit("hello"))) == "other"
    assert one(spark, tx.is_major_news(F.lit("收到立案通知"))) is True
    assert one(spark, tx.pad_code(F.lit("12"))) == "000012" and one(spark, tx.pad_code(F.lit("1234567"))) == "1234567"
    assert one(spark, tx.six_digits(F.lit("x1234567"), standalone=True)) is None
    assert one(spark, tx.last_number(F.lit("[3] score: -0.7"))) == -0.7 and one(spark, tx.last_number(F.lit("none"))) == 0
    assert one(spark, tx.comparable_name(F.lit("ａｂ c，<b>D</b>"))) == "ABCD"
    assert one(spark, fn.lenient_double(F.lit("1,234.5%"))) == 1234.5 and one(spark, fn.lenient_double(F.lit("-"))) == 0
    assert one(spark, fn.cashflow_ratio(F.lit(5.0), F.lit(0.0))) is None and one(spark, fn.cashflow_ratio(F.lit(50.0), F.lit(1.0))) == 10
    assert one(spark, fd.loose_timestamp(F.lit("2024-01-02 03:04"))) == dt.datetime(2024, 1, 2, 3, 4)
    assert one(spark, fd.loose_timestamp(F.lit("soon"))) is None
    assert one(spark, fd.epoch_ms_local(F.lit(0))) == dt.datetime(1970, 1, 1, 8)
    assert one(spark, tx.json_items(F.lit('["a","b","c"]'), 2)) == ["a", "b"]


def test_merges(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, v int, s string")
    up = spark.createDataFrame([("b", 2, None), ("c", 3, "z")], "k string, v int, s string")
    assert sorted(tuple(r) for r in mg.merge_latest(base, up, ["k"]).collect()) == [("a", 1, "x"), ("b", 2, None), ("c", 3, "z")]
    older = spark.createDataFrame([("a", 0, "old"), ("b", 1, "first"), ("b", 1, "second")], "k string, v int, s string").withColumn("q", F.col("s"))
    merged = mg.merge_latest(base, older, ["k"], "v", "q")
    assert {r.k: (r.v, r.s) for r in merged.collect()} == {"a": (1, "x"), "b": (1, "second")}
    twice = mg.merge_filling(base, older.drop("v"), ["k"], ["s"], "q")
    assert sorted((r.k, r.s) for r in twice.collect()) == [("a", "old"), ("b", "second")]
    assert {r.k: (r.v, r.s) for r in mg.merge_filling(base, up, ["k"], ["v", "s"]).collect()} == {"a": (1, "x"), "b": (2, "y")}
    assert {r.k: r.v for r in mg.insert_absent(base, up, ["k"]).collect()} == {"a": 1, "b": 1, "c": 3}
    at = [dt.datetime(2024, 1, i) for i in range(1, 6)]
    log = spark.createDataFrame([("u", "open", at[0], 1.0), ("u", "open", at[1], 2.0), ("w", "open", at[0], 1.0), ("w", "close", at[2], None),
                                 ("z", "close", at[0], None)], "u string, command string, at timestamp, price double")
    assert {r.u: (r.price, r.status) for r in mg.fold_commands(log, ["u"]).collect()} == {"u": (2.0, "active"), "w": (1.0, "closed")}


def test_panel_sink_rewrites_only_touched_years(spark, tmp_path):
    path = str(tmp_path / "bars")
    rows = spark.createDataFrame([("a", dt.date(2023, 5, 1), 1.0), ("a", dt.date(2024, 5, 1), 2.0)], "code string, trade_date date, close double")
    mg.write_panel(rows, path)
    update = spark.createDataFrame([("a", dt.date(2024, 5, 1), 9.0)], "code string, trade_date date, close double")
    stored = spark.read.parquet(path).drop("year")
    merged = spark.createDataFrame(mg.merge_latest(stored, update, ["code", "trade_date"]).collect(), stored.schema)
    before = {p.name for p in (tmp_path / "bars" / "year=2023").iterdir()}
    mg.refresh_partitions(spark, merged, update, path)
    assert {p.name for p in (tmp_path / "bars" / "year=2023").iterdir()} == before
    assert sorted(r.close for r in spark.read.parquet(path).collect()) == [1.0, 9.0]


def test_code_from_file_name_and_schema_check(spark, tmp_path):
    spark.createDataFrame([(dt.date(2024, 1, 1), 1.0)], "trade_date date, close double").toPandas().to_parquet(tmp_path / "600001.parquet")
    got = sc.read_bars(spark, str(tmp_path), ["code", "close", "absent"], code_from_file=True).first()
    assert (got.code, got.close) == ("600001", 1.0)
    with pytest.raises(ValueError):
        check(spark.range(1), BARS)


def test_payloads(spark):
    text = 'kline={"data":{"sh600001":{"qfqday":[],"day":[["2024-01-02","1","2","3","0.5","10"],["2024-01-03","x","2","3","1","1"],["short"]]}}}'
    rows = pl.parse_bar_payloads(spark.createDataFrame([(text,)], "payload string")).collect()
    assert [(r.code, r.open, r.close, r.high, r.low, r.volume) for r in rows] == [("600001", 1.0, 2.0, 3.0, 0.5, 10.0)]
    assert pl.parse_quote_lines(spark.createDataFrame([('v_sh600001="a~b~c";',)], "payload string")).count() == 0


def test_events_and_peers(spark):
    day = dt.date(2024, 1, 31)
    lock = spark.createDataFrame([("1", dt.date(2024, 2, 10), 5.0), ("1", dt.date(2024, 1, 20), 5.0), ("1", dt.date(2024, 6, 1), 5.0)],
                                 "code string, release_date date, float_pct double")
    assert sorted(r.level for r in se.lockup_events(lock, day).collect()) == ["info", "warning"]
    events = spark.createDataFrame([("p", "buyback", None, "info"), ("q", "lockup", None, "warning"), ("r", "buyback", None, "info")],
                                   "code string, type string, date date, level string")
    sectors = spark.createDataFrame([(c, "s1") for c in "wpqr"] + [("x", "s2")], "code string, sector string")
    links = se.peer_events(events, sectors, spark.createDataFrame([("w",), ("x",)], "code string")).collect()
    assert sorted((r.code, r.peer) for r in links) == [("w", "p"), ("w", "q")]
    ordered = se.events_by_code(events.withColumn("code", F.lit("c")).withColumn("note", F.lit("")), 2).first().events
    assert [e.level for e in ordered] == ["warning", "info"]


def test_technical_score_bounds_and_short_history(spark):
    import numpy as np
    rng = np.random.default_rng(42)
    close = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, 80)))
    rows = [(c, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(x), float(x * 1.01), float(x * 0.99), 1000.0)
            for c, n in (("a", 80), ("b", 10)) for i, x in enumerate(close[:n])]
    got = {r.code: r for r in tc.technical_score(spark.createDataFrame(
        rows, "code string, trade_date date, close double, high double, low double, volume double")).collect()}
    assert -1 <= got["a"].score <= 1 and got["b"].score == 0

    def ewm(x, a):
        w = (1 - a) ** np.arange(len(x))[::-1]
        return (x * w).sum() / w.sum()
    dif = np.array([ewm(close[:i + 1], 2 / 13) - ewm(close[:i + 1], 2 / 27) for i in range(80)])
    assert got["a"].macd_bar == pytest.approx(2 * (dif[-1] - ewm(dif, 0.2)), abs=1e-9)


def test_outcomes_and_calibration(spark):
    bars = spark.createDataFrame([("1", dt.date(2024, 1, i + 1), 10.0 + i, 10.5 + i, 9.9 + i) for i in range(4)],
                                 "code string, trade_date date, close double, high double, low double")
    sig = spark.createDataFrame([(1, "1", dt.datetime(2024, 1, 1), "BUY", 0.7, 11.0, 9.0), (2, "1", dt.datetime(2024, 1, 1), "SELL", 0.7, 9.0, 11.0),
                                 (3, "1", dt.datetime(2024, 1, 4), "BUY", 0.7, 11.0, 9.0)],
                                "id long, code string, run_ts timestamp, action string, confidence double, target_price double, stop_loss double")
    out = {r.id: r.success for r in resolve_outcomes(sig, bars, 2).collect()}
    assert out == {1: 1, 2: 0, 3: None}
    many = spark.range(200).select(F.col("id"), F.lit("BUY").alias("action"), (F.col("id") % 10 / 10).alias("confidence"),
                                   ((F.col("id") % 10) > 5).cast("int").alias("success"),
                                   (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("run_ts"))
    samples = calibration_samples(many)
    assert samples.where("in_train").count() == 160 and samples.agg(F.max("sample_no")).first()[0] == 200
    model = fit_calibration(samples)
    row = model.first()
    assert row.coef > 0 and row.auc > 0.95
    few = fit_calibration(calibration_samples(many.limit(10))).first()
    assert (few.coef, few.intercept, few.notes) == (1.0, 0.0, "pass-through")
    fitted = apply_calibration(sig, model).select("action", "calibrated_confidence").where("action = 'SELL'").first()
    assert fitted.calibrated_confidence == 0.7


def test_names_in_texts(spark):
    names = spark.createDataFrame([("000001", "平安"), ("000002", "平安银行"), ("000003", "x")], "code string, name string")
    asks = spark.createDataFrame([(1, "平安银行怎么样"), (2, "看 600519 的走势"), (3, "没有")], "question_id int, text string")
    assert {r.question_id: r.code for r in rs.match_names(asks, names).collect()} == {1: "000002", 2: "600519", 3: None}


def test_long_titles_are_classed_whole(spark):
    df = spark.createDataFrame([("x" * 500 + " <em>profit</em>",)], "title string")
    assert df.select(tx.keyword_class(tx.clean_title("title"), {"earnings": ("profit",)})).first()[0] == "earnings"


def test_boosting_goes_past_one_tree(spark):
    assert best_round([3.0, 2.0, 2.5, 1.0], 1) == 2 and best_round([3.0, 2.0, 2.5, 1.0], 2) == 4
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=d), f"{c:02d}", float((7 * c + d) % 20), float((3 * c + 5 * d) % 20), float(((7 * c + d) % 20 + (3 * c + 5 * d) % 20) // 4))
            for d in range(40) for c in range(20)]
    df = spark.createDataFrame(rows, "trade_date date, code string, x double, y double, label double")
    bounds = dict(train_end=dt.date(2024, 1, 20), val_start=dt.date(2024, 1, 21), val_end=dt.date(2024, 1, 30), test_start=dt.date(2024, 1, 31))
    model, scored = train_ranker(df, ["x", "y"], bounds, rounds=5, depth=2, min_rows=5)  # one such tree cannot hold a sum
    assert model.getNumTrees > 1 and scored.where("part = 'test' AND score IS NULL").count() == 0


def test_date_range_of_all_codes(spark):
    rows = [(c, dt.date(y, 5, 1), 1.0) for c in ("000001", "000002", "000005", None) for y in (1995, 1996, 2000, 2001)]
    bars = spark.createDataFrame(rows, "code string, trade_date date, close double")
    assert sc.bars_between(bars, None, "1996-01-01", "2000-12-31").count() == 8
    assert {r.code for r in sc.bars_between(bars, "000002", "1996-01-01", "2000-12-31").collect()} == {"000002"}


def test_range_query_scans_all_codes(spark, tmp_path):
    import catalog.queries as catalog
    rows = [(i, 1, i, s, 2.0, 10.0 + i, dt.date(y, 5, 1)) for i, (s, y) in enumerate((s, y) for s in (1, 2, 7) for y in (1995, 1997))]
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate date"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert {r.code for r in catalog.QUERIES["bars_s05_range"](spark, str(tmp_path)).collect()} == {"000001", "000002", "000007"}


def test_texts_are_not_broadcast(spark):
    asks = spark.createDataFrame([(i, f"what of firm {'abcdefgh'[i % 8]}xyz{i}") for i in range(20)], "question_id long, text string")
    out = rs.match_names(asks, spark.createDataFrame([("000001", "firm axyz"), ("000002", "firm bxyz")], "code string, name string"))
    assert out.where("code IS NOT NULL").count() > 0
    out.collect()
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_newest_indicators_need_no_long_frames(spark):
    rows = [("000001", dt.date(2024, 1, 1) + dt.timedelta(days=i), 9.0 + i % 7, 11.0 + i % 7, 8.0 + i % 5, 10.0 + i % 7, 100.0 + i) for i in range(300)]
    bars = spark.createDataFrame(rows, "code string, trade_date date, open double, high double, low double, close double, volume double")
    out = tc.technical_inputs(bars)
    assert "-249" not in out._jdf.queryExecution().executedPlan().toString()
    got, closes = out.first(), [r[5] for r in rows]
    assert got.n == 300 and got.close == closes[-1] and got.trade_date == rows[-1][1]
    for w in (5, 10, 20, 60, 250):
        assert got[f"ma{w}"] == pytest.approx(sum(closes[-w:]) / w)
    moves = [b - a for a, b in zip(closes[-15:-1], closes[-14:])]
    assert got.gain == pytest.approx(sum(max(m, 0) for m in moves) / 14) and got.loss == pytest.approx(sum(max(-m, 0) for m in moves) / 14)
    assert tc.technical_inputs(bars.limit(3)).first().ma5 is None
