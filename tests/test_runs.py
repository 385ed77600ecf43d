"""Batch scoring, the daily run's parts, logs by run, the news ledger and closing bars."""

import datetime as dt

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from barloom.operators import structured_events as se
from barloom.operators.calendar import build_calendar, map_to_trading_day
from barloom.plans import daily_run as dr
from barloom.plans import scoring as sg
from barloom.sources.merge import append_log, write_panel
from barloom.streaming import watch as wt

DAY = dt.date(2024, 1, 2)
ROWS = "code string, trade_date date, n_bars int, x double, y double"


def ranker(spark, folder, kind, slope, version=1):
    points = spark.createDataFrame([(float(i), slope * i) for i in range(5)], "x double, t double")
    learner = LinearRegression(labelCol="t", featuresCol="features", predictionCol="score", solver="normal")
    model = learner.fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(points))
    sg.save_ranker(spark, model, ["x"], folder, kind, version)


def test_rankers_are_chosen_by_trend_and_history(spark, tmp_path):
    folder = str(tmp_path)
    ranker(spark, folder, "universal", 1.0)
    ranker(spark, folder, "universal", 10.0, version=2)
    rows = spark.createDataFrame([("a", DAY, 300, 1.0, 0.0), ("b", DAY, 300, None, 0.0), ("c", DAY, 300, -1.0, 0.0), ("d", DAY, 10, 99.0, 0.0),
                                  ("a", dt.date(2024, 1, 3), 250, 5.0, 0.0), ("a", dt.date(2024, 1, 4), 250, 5.0, 0.0), ("b", dt.date(2024, 1, 4), None, 6.0, 0.0)], ROWS)
    trend = spark.createDataFrame([(DAY, "bear"), (dt.date(2024, 1, 3), "bull")], "trade_date date, trend string")

    def scores(**kw):
        out = sg.batch_scores(rows, sg.load_rankers(spark, folder), trend, **kw).collect()
        return {(r.code, r.trade_date.day): (r.ranker, r.skipped, None if r.score is None else round(r.score, 6)) for r in out}

    # without a bear model the universal one serves; a missing factor is 0, above -1; the lone rows are neutral
    assert scores() == {("c", 2): ("universal", None, round(10 * (1 / 3 - 0.5), 6)), ("b", 2): ("universal", None, round(10 * (2 / 3 - 0.5), 6)), ("a", 2): ("universal", None, 5.0),
                        ("d", 2): ("universal", "short_history", None), ("a", 3): ("universal", None, 0.0), ("a", 4): ("universal", None, 0.0), ("b", 4): ("universal", "short_history", None)}
    ranker(spark, folder, "bear", -2.0)
    got = scores()
    assert got["a", 2] == ("bear", None, -1.0) and got["a", 3][0] == "universal" and got["d", 2] == ("bear", "short_history", None)
    assert {v[0] for v in scores(regime="bull").values()} == {"universal"} and {v[0] for v in scores(regime="bear").values()} == {"bear"}
    only_bear = {"bear": sg.load_rankers(spark, folder)["bear"]}
    assert {r.skipped for r in sg.batch_scores(rows, only_bear, trend).where("trade_date = '2024-01-03'").collect()} == {"no_model"}
    assert sg.batch_scores(rows.limit(0), sg.load_rankers(spark, folder), trend).count() == 0
    inputs = sg.scoring_inputs(rows, {"universal": ["x", "gone"], "bear": ["y"]}, trend).where(F.col("trade_date") == F.lit(DAY)).collect()
    assert {r.code: (r.x, r.gone, r.y) for r in inputs}["a"] == (None, None, pytest.approx(1 / 6)) and {r.code: r.y for r in inputs}["d"] is None


def test_a_repeated_run_is_logged_once(spark, tmp_path):
    log = str(tmp_path / "log")
    one, two = (spark.createDataFrame([(c, v) for c in "ab"], "code string, v int") for v in (1, 2))
    append_log(one, log, "r1")
    append_log(two, log, "r2")
    append_log(one, log, "r1")
    assert sorted((r.run_id, r.code, r.v) for r in spark.read.parquet(log).collect()) == [("r1", "a", 1), ("r1", "b", 1), ("r2", "a", 2), ("r2", "b", 2)]


def test_pool_takes_candidates_into_free_places(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(100)]
    lead = [0.05 if i % 5 == 0 else -0.01 for i in range(100)]
    moves = {"lead": lead, "near": [0.0, *[0.7 * x for x in lead[:-1]]], "far": [0.0, *[0.2 * x + 0.01 * (i % 3) for i, x in enumerate(lead[:-1])]], "own": [0.001 * (i % 7) for i in range(100)]}
    rows = []
    for code, steps in moves.items():
        price = 10.0
        for day, x in zip(days, steps):
            price *= 1 + x
            rows.append((code, day, price))
    bars = spark.createDataFrame(rows, "code string, trade_date date, close double")
    quotes = spark.createDataFrame([("lead", 6.0), ("near", 0.0), ("far", 0.0), ("own", 1.0)], "code string, pct_change double")
    table = lambda *codes: spark.createDataFrame([(c, "active") for c in codes] + [("gone", "closed")], "code string, status string")
    inputs = dr.DailyInputs(pool=spark.createDataFrame([("lead",), ("own",)], "code string"), positions=table("own"), alerts=table("held"), quotes=quotes, bars=bars,
                            market=bars, news=bars, raw_signals=bars, events=bars, sectors=bars)
    pool = lambda **kw: {r.code: r.origin for r in dr.analysis_pool(inputs, min_corr=0.05, **kw).collect()}
    own = {"lead": "pool", "own": "pool", "held": "alert"}
    assert pool() == own | {"near": "candidate", "far": "candidate"}
    assert pool(max_codes=4) == own | {"near": "candidate"} and pool(max_codes=3) == own and pool(max_codes=1) == own


def test_raw_events_are_cleaned_and_netted(spark):
    raw = spark.createDataFrame([(" 1", "20240110", "100"), ("1", "2024-01-20", "-300"), ("1", "2023-11-01", "999"), ("2", "unknown", "5"), ("2", "2024-01-20", "--"), ("", "2024-01-20", "1"),
                                 (None, "2024-01-20", "1"), ("3", None, "1"), ("4", "2024-01-02", "7")], "code string, adate string, shares string")
    clean = se.cleaned(raw, "adate", "shares", since="2024-01-31")
    assert sorted((r.code, r.adate.day, r.shares) for r in clean.collect()) == [("000001", 10, 100.0), ("000001", 20, -300.0), ("000004", 2, 7.0)]
    assert {(r.code, r.type) for r in se.insider_events(clean, "2024-01-31").collect()} == {("000001", "insider_sell"), ("000004", "insider_buy")}
    events = spark.createDataFrame([("a", "lockup", dt.date(2024, 1, d), "info", "n") for d in range(1, 9)] + [("a", "z", None, "warning", "n")], "code string, type string, date date, level string, note string")
    assert [(e.type, e.date and e.date.day) for e in se.events_by_code(events, 3).first().events] == [("z", None), ("lockup", 1), ("lockup", 2)]
    assert len(se.events_by_code(events).first().events) == 9


def test_raw_events_are_not_shuffled_by_day(spark):
    events = spark.range(1000).select((F.lit("2024-01-02 10:00:00").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("ts"))
    calendar = build_calendar(spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(60)], "trade_date date"))
    plan = map_to_trading_day(events, calendar, "ts")._jdf.queryExecution().executedPlan().toString()
    above = plan[:plan.index("Range (0, 1000")]  # from the result down to the raw rows
    assert "BroadcastHashJoin" in above and "Exchange" not in above


def test_large_years_become_several_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(40_000).select(F.hex(F.sha2(F.col("id").cast("string"), 256).cast("binary")).alias("code"), F.when(F.col("id") < 39_990, F.lit("2001-05-05")).otherwise(F.lit("2000-05-05")).cast("date").alias("trade_date"))
        write_panel(rows, str(tmp_path / "panel"))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = {y: len(list((tmp_path / "panel" / f"year={y}").glob("*.parquet"))) for y in (2000, 2001)}
    assert files[2000] == 1 and files[2001] > 3 and spark.read.parquet(str(tmp_path / "panel")).count() == 40_000


FINAL = ("code string, name string, action string, confidence double, target_price double, stop_loss double, n int, close double, pct_change double, support_price double, "
         "resistance_price double, regime_floor double, held_stop double, held_target double, last_notified_at timestamp, held boolean")


def test_signals_are_finished_by_the_rules(spark):
    base = dict(name="n", action="BUY", confidence=0.7, target_price=0.0, stop_loss=0.0, n=100, close=10.0, pct_change=1.0, support_price=9.0, resistance_price=11.0,
                regime_floor=0.6, held_stop=None, held_target=None, last_notified_at=None, held=None)
    cases = {"plain": {}, "limit": dict(pct_change=9.6), "st": dict(name="*ST x"), "short": dict(n=59), "none": dict(action=None, confidence=None, target_price=None, stop_loss=None),
             "crossed": dict(target_price=8.0, stop_loss=9.0), "sell": dict(action="SELL", confidence=0.8), "floor": dict(regime_floor=0.8),
             "stopped": dict(confidence=0.1, held=True, held_stop=10.5), "told": dict(confidence=0.1, held=True, held_stop=10.5, last_notified_at=dt.datetime(2024, 1, 2, 9)),
             "other": dict(confidence=0.1, held_stop=10.5), "goal": dict(confidence=0.1, held=True, held_target=10.1)}
    rows = [tuple((base | {"code": c} | o)[k.split()[0]] for k in FINAL.split(", ")) for c, o in cases.items()]
    got = {r.code: r for r in dr.finish_signals(spark.createDataFrame(rows, FINAL), levels="critical", today="2024-01-02").collect()}
    assert (got["plain"].target_price, got["plain"].stop_loss, got["plain"].trade_price, got["plain"].level, got["plain"].will_push, got["plain"].pushed) == (11.0, 9.3, 10.0, "warning", True, False)
    assert {c: got[c].hold_reason for c in ("limit", "st", "short", "none")} == {"limit": "limit_up", "st": "special_treatment", "short": "short_history", "none": "no_signal"}
    assert all((got[c].action, got[c].confidence, got[c].trade_price, got[c].will_push) == ("HOLD", 0.5, 0.0, False) for c in ("limit", "st", "short", "none"))
    assert got["crossed"].target_price == 10.5 and (got["sell"].target_price, got["sell"].stop_loss, got["sell"].pushed) == (9.0, 11.0, True)
    assert not got["floor"].will_push and not got["other"].will_push and not got["told"].will_push
    assert (got["stopped"].tracked_reason, got["stopped"].level, got["stopped"].pushed) == ("stop", "critical", True)
    assert (got["goal"].tracked_reason, got["goal"].will_push, got["goal"].pushed) == ("target", True, False)


NEWS = "event_id long, code string, ts timestamp, title string, score double"


def test_news_ledger_survives_repeated_batches_and_late_items(spark, tmp_path):
    ledger, told = str(tmp_path / "ledger"), []
    run = wt.news_batches(ledger, lambda df: told.extend(r.title for r in df.collect()), levels="red")
    t0 = dt.datetime(2024, 1, 5, 10)
    first = spark.createDataFrame([(1, "a", t0, "good", 0.9), (2, "a", t0, "bad", -0.9), (3, "a", t0, "calm", 0.1), (4, "a", t0, "bad", -0.9), (5, "b", t0, None, None)], NEWS)
    run(first, 0)
    run(first, 0)  # the batch comes again after a failure
    second = spark.createDataFrame([(6, "a", t0, "bad", -0.9), (7, "a", t0 - dt.timedelta(days=9), "late", -1.0), (8, "b", t0, "bad", -0.9)], NEWS)
    run(second, 1)
    run(second.limit(0), 2)
    got = sorted((r.code, r.title, r.outcome, r.level) for r in wt.read_ledger(spark, ledger).fillna("", subset=["title"]).collect())
    assert got == sorted([("a", "good", "news_filtered", "info"), ("a", "bad", "major_news", "critical"), ("a", "calm", "news_seen", None), ("b", "", "news_seen", None),
                          ("a", "late", "major_news", "critical"), ("b", "bad", "major_news", "critical")])
    assert sorted(told) == ["bad", "bad", "bad", "late"]  # the repeated batch tells its item again, under the same key


def test_bars_close_once_and_late_ticks_are_defined(spark, tmp_path):
    schema, day = "code string, ts timestamp, price double, size double, event_id long", dt.datetime(2024, 1, 5)
    paths = {n: str(tmp_path / n) for n in ("ticks", "closes", "out", "state")}
    spark.createDataFrame([], schema).write.parquet(paths["ticks"])
    spark.createDataFrame([], "ts timestamp").write.parquet(paths["closes"])

    def land(ticks=(), closes=()):
        spark.createDataFrame([("a", day + dt.timedelta(hours=h), p, 1.0, i) for i, (h, p) in enumerate(ticks)], schema).write.mode("append").parquet(paths["ticks"])
        spark.createDataFrame([(day + dt.timedelta(hours=h),) for h in closes], "ts timestamp").write.mode("append").parquet(paths["closes"])
        bars = wt.tick_bars(spark.readStream.schema(schema).parquet(paths["ticks"]), spark.readStream.schema("ts timestamp").parquet(paths["closes"]))
        (bars.writeStream.format("parquet").option("checkpointLocation", paths["state"]).trigger(availableNow=True).start(paths["out"]).awaitTermination())
        return sorted((r.trade_date.day, r.open, r.close, r.volume) for r in spark.read.schema(bars.schema).parquet(paths["out"]).collect())

    assert land([(10, 1.0), (12, 2.0)]) == []
    assert land([(23.5, 3.0), (9, 0.5)]) == []  # hours late, but its day is open
    assert land([(24.5, 4.0)]) == [] and land([(23.6, 5.0)]) == []  # less than an hour behind
    assert land(closes=[26]) == [(5, 0.5, 5.0, 5.0)]
    assert land([(23.7, 9.0)]) == [(5, 0.5, 5.0, 5.0)]  # after the close: dropped
    assert land(closes=[50]) == [(5, 0.5, 5.0, 5.0), (6, 4.0, 4.0, 1.0)]


def test_wide_rows_of_the_training_panel_do_not_move(spark):
    import datetime

    from barloom.plans.training_panel import training_panel
    rows = [(c, datetime.date(2020, 1, 1) + datetime.timedelta(days=i), *[10.0 + (i * k) % 11 for k in (1, 2, 3, 4)], 100.0 + i, 1000.0)
            for k, c in enumerate(("000001", "000002")) for i in range(60)]
    bars = spark.createDataFrame(rows, "code string, trade_date date, open double, high double, low double, close double, volume double, amount double")
    panel, _ = training_panel(bars, names=["MA5", "RET5"], horizons=(5,), label_horizon=5, warmup=10, min_rows=20, propagation=False)
    plan = panel._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join")
    assert panel.count() == 2 * (60 - 10 - 5) and panel.where("label IS NULL OR MA5 = 0").count() == 0
