"""All 300 factors against a plain numpy statement of each rule."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators.factors import (
    BEAR, BULL, FAMILIES, ROBUST, WINDOWS, factor_frame, factor_names, feature_set, latest_factors, newest_factors, register_factor)
from barloom.operators.rolling import RollingBlocks

EPS = 1e-12
NAN = float("nan")


def make_bars(n=300, seed=42, code="000001", holes=True):
    rng = np.random.default_rng(seed)
    close = 10 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * (1 + rng.normal(0, 0.005, n))
    high, low = np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99
    volume = rng.integers(100, 10_000, n).astype(float)
    if holes:
        volume[40] = 0.0
        close[150:156] = close[150]
        high[60:66] = low[60:66] = close[60:66]
    amount = np.where(rng.random(n) < 0.2, 0.0, volume * close)
    start = datetime.date(2020, 1, 1)
    return [(code, start + datetime.timedelta(days=i), *map(float, (open_[i], high[i], low[i], close[i], volume[i], amount[i])))
            for i in range(n)]


SCHEMA = "code string, trade_date date, open double, high double, low double, close double, volume double, amount double"


def expected(rows, market):
    """Factor values by direct evaluation of every window."""
    o, h, l, c, v, a = (np.array([r[i] for r in rows]) for i in range(2, 8))
    n = len(rows)
    m = np.zeros(n)
    m[1:] = market[1:] / market[:-1] - 1
    vz = np.where(v == 0, NAN, v)
    with np.errstate(all="ignore"):
        ret = np.r_[NAN, c[1:] / c[:-1] - 1]
        lv = np.log(vz)
        dc, dlv, dv = (np.r_[NAN, np.diff(x)] for x in (c, lv, v))
        vp = np.r_[NAN, v[1:] / v[:-1] - 1]
        vp[~np.isfinite(vp)] = NAN
        rng = np.where(h == l, NAN, h - l)
        vwap = np.where(a > 0, a / vz, (h + l + c) / 3)
        out = {"OPEN0": o / c, "HIGH0": h / c, "LOW0": l / c, "VWAP0": vwap / c, "KMID": (c - o) / o, "KLEN": (h - l) / o,
               "KMID2": (c - o) / (rng + EPS), "KUP": (h - np.maximum(o, c)) / o, "KUP2": (h - np.maximum(o, c)) / (rng + EPS),
               "KLOW": (np.minimum(o, c) - l) / o, "KLOW2": (np.minimum(o, c) - l) / (rng + EPS),
               "KSFT": (2 * c - h - l) / o, "KSFT2": (2 * c - h - l) / (rng + EPS)}

    def roll(x, w, f):
        res = np.full(n, NAN)
        for t in range(w - 1, n):
            part = x[t - w + 1:t + 1]
            if np.isfinite(part).all():
                res[t] = f(part)
        return res

    def pair(x, y, w, f):
        res = np.full(n, NAN)
        for t in range(w - 1, n):
            p, q = x[t - w + 1:t + 1], y[t - w + 1:t + 1]
            if np.isfinite(p).all() and np.isfinite(q).all():
                res[t] = f(p, q)
        return res

    def cov(p, q):
        return np.cov(p, q, ddof=1)[0, 1]

    def corr(p, q):
        return NAN if np.ptp(p) == 0 or np.ptp(q) == 0 else np.corrcoef(p, q)[0, 1]

    def sd(p):
        return p.std(ddof=1)

    up, down = (ret > 0).astype(float), (ret < 0).astype(float)
    gain, loss = np.where(np.isnan(ret), NAN, np.maximum(ret, 0)), np.where(np.isnan(ret), NAN, np.maximum(-ret, 0))
    vg, vl = np.where(np.isnan(dv), NAN, np.maximum(dv, 0)), np.where(np.isnan(dv), NAN, np.maximum(-dv, 0))
    cv = c * v
    with np.errstate(all="ignore"):
        for w in WINDOWS:
            beta = pair(ret, m, w, cov) / (roll(m, w, lambda p: p.var(ddof=1)) + EPS)
            mean_v, mean_cv, std_v = roll(v, w, np.mean), roll(cv, w, np.mean), roll(v, w, sd)
            ups, downs = roll(up, w, np.sum), roll(down, w, np.sum)
            g, s = roll(gain, w, np.sum), roll(loss, w, np.sum)
            vgs, vls = roll(vg, w, np.sum), roll(vl, w, np.sum)
            hi, lo = roll(c, w, np.max), roll(c, w, np.min)
            ago = np.r_[np.full(w, NAN), c[:-w]]
            mom = roll(ret, w, np.mean) / (roll(ret, w, sd) + EPS)
            imax, imin = roll(h, w, lambda p: (np.argmax(p) + 1) / w), roll(l, w, lambda p: (np.argmin(p) + 1) / w)
            vals = {
                "ROC": ago / c, "MA": roll(c, w, np.mean) / c, "STD": roll(c, w, sd) / c, "BETA": beta,
                "RSQR": pair(ret, m, w, corr) ** 2, "RESI": roll(ret - beta * m, w, sd), "MAX": roll(h, w, np.max) / c,
                "MIN": roll(l, w, np.min) / c, "QTLU": roll(c, w, lambda p: np.quantile(p, 0.8)) / c,
                "QTLD": roll(c, w, lambda p: np.quantile(p, 0.2)) / c,
                "RANK": roll(c, w, lambda p: ((p < p[-1]).sum() + ((p == p[-1]).sum() + 1) / 2) / w),
                "RSV": (c - lo) / (hi - lo + EPS), "IMAX": imax, "IMIN": imin, "IMXD": imax - imin,
                "CORR": pair(c, lv, w, corr), "CORD": pair(dc, dlv, w, corr), "CNTP": ups / w, "CNTN": downs / w,
                "CNTD": ups / w - downs / w, "SUMP": g / (g + s + EPS), "SUMN": s / (g + s + EPS),
                "SUMD": g / (g + s + EPS) - s / (g + s + EPS), "VMA": mean_v / vz, "VSTD": std_v / vz,
                "WVMA": roll(cv, w, sd) / (mean_cv + EPS), "VSUMP": vgs / (vgs + vls + EPS), "VSUMN": vls / (vgs + vls + EPS),
                "VSUMD": vgs / (vgs + vls + EPS) - vls / (vgs + vls + EPS), "RET": c / ago - 1, "MOM": mom,
                "DD": c / (hi + EPS) - 1, "UPR": ups / (downs + EPS), "DNR": downs / w, "SHARPE": mom * np.sqrt(252),
                "VOLZ": (v - mean_v) / (std_v + EPS), "TURN": v / (mean_v + EPS), "AMTMA": mean_cv / (cv + EPS),
                "ILLIQ": roll(np.abs(ret), w, np.mean) / (mean_cv + EPS), "PVCHG": pair(ret, vp, w, corr),
                "RELV": roll(ret - m, w, np.sum)}
            out |= {f"{k}{w}": x for k, x in vals.items()}
    return {k: np.where(np.isfinite(x), x, 0.0) for k, x in out.items()}


def test_all_factors_match_direct_evaluation(spark):
    rows = make_bars()
    market = 3000 * np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.01, len(rows))))
    index = spark.createDataFrame([(r[1], float(x)) for r, x in zip(rows, market)], "trade_date date, close double")
    got = factor_frame(spark.createDataFrame(rows, SCHEMA), index).orderBy("trade_date").toPandas()
    assert list(got.columns) == ["code", "trade_date", *factor_names()]
    assert len(factor_names()) == 300
    for name, values in expected(rows, market).items():
        np.testing.assert_allclose(got[name].to_numpy(), values, rtol=1e-7, atol=1e-9, err_msg=name)


def test_missing_close_and_short_history(spark):
    rows = [list(r) for r in make_bars(12, holes=False)]
    rows[6][5] = None
    got = factor_frame(spark.createDataFrame([tuple(r) for r in rows], SCHEMA), names=["MA5", "RET5", "CNTP5", "MA250"],
                       zero_fill=False).orderBy("trade_date").toPandas()
    assert got["MA5"].notna().tolist() == [False] * 4 + [True] * 2 + [False] * 5 + [True]
    assert got["CNTP5"].notna().sum() == 8  # a missing return counts as no rise
    assert got["MA250"].isna().all()


def test_future_does_not_change_the_past(spark):
    rows = make_bars(120, holes=False)
    names = ["MA20", "RANK20", "RESI5", "IMAX60", "CORR20"]
    whole = factor_frame(spark.createDataFrame(rows, SCHEMA), names=names).where(F.col("trade_date") <= rows[99][1])
    cut = factor_frame(spark.createDataFrame(rows[:100], SCHEMA), names=names)
    a, b = whole.orderBy("trade_date").toPandas(), cut.orderBy("trade_date").toPandas()
    np.testing.assert_allclose(a[names].to_numpy(), b[names].to_numpy(), rtol=1e-12)


def test_one_exchange_for_the_whole_frame(spark):
    bars = spark.createDataFrame(make_bars(30, holes=False), SCHEMA)
    plan = factor_frame(bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan


def test_latest_row_and_custom_factor(spark):
    register_factor("GAP", lambda c: c["open"] / c["close"] - 1)
    bars = spark.createDataFrame(make_bars(30, holes=False) + make_bars(30, 7, "000002", holes=False), SCHEMA)
    last = latest_factors(factor_frame(bars, names=["RET5", "GAP"]))
    assert last.count() == 2 and {r["trade_date"] for r in last.collect()} == {datetime.date(2020, 1, 30)}


@pytest.mark.parametrize("kind,size", [("robust", 32), ("bear", 40), ("bull", 18), ("all", 300), ("nonsense", 32)])
def test_feature_sets(kind, size):
    assert len(feature_set(kind, factor_names())) == size


def test_robust_leaves_out_unstable_families():
    assert not any(n.startswith(("ILLIQ", "STD", "BETA", "RSQR")) for n in ROBUST)
    assert set(ROBUST) < set(BEAR) and len(set(BULL)) == 18 and len(FAMILIES) == 41


def test_rows_that_are_not_wanted_only_feed_the_windows(spark):
    rows = make_bars(60, holes=False) + make_bars(40, 7, "000002", holes=False)
    bars = spark.createDataFrame(rows, SCHEMA).withColumn("some", F.dayofmonth("trade_date") % 3 == 0)
    names = ["MA5", "RESI5", "RESI20", "RANK20", "ROC10", "IMAX20", "KMID", "CORR20"]
    whole = factor_frame(bars, names=names, keep=["some"]).where("some").drop("some").orderBy("code", "trade_date").collect()
    for few in (False, True):
        got = factor_frame(bars, names=names, only="some", few=few)
        assert got.columns == ["code", "trade_date", *names]
        assert got.orderBy("code", "trade_date").collect() == whole


def test_newest_factors_are_the_latest_of_the_frame(spark):
    rows = make_bars(60, holes=False) + make_bars(30, 7, "000002", holes=False)
    rows += [("000003", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("000002", None, 9.0, 9.0, 9.0, 9.0, 9.0, 9.0)]
    bars = spark.createDataFrame(rows, SCHEMA)
    names = ["MA5", "RESI20", "RANK20", "ROC10", "KMID"]
    slow = latest_factors(factor_frame(bars, names=names)).orderBy("code").collect()
    fast = newest_factors(bars, names=names)
    assert fast.orderBy("code").collect() == slow and len(slow) == 3
    assert "max_by" not in fast._jdf.queryExecution().optimizedPlan().toString()


def test_residuals_keep_no_longer_windows_than_they_need(spark):
    df = spark.createDataFrame([("a", i, i + 1, float(i * i % 7), float(i % 5)) for i in range(30)], "code string, trade_date int, row_no int, x double, y double")
    blocks = RollingBlocks(means=["x", "y"], upto={"x": 5, "y": 10})
    sizes = {}

    def look(level, w):
        sizes[w] = level.select(F.size(f"first{w}").alias("n")).first()["n"]
        return level.withColumn(f"q{w}", F.expr(blocks.ref("q", "y", w)))

    got = blocks.add(df, (5, 10), after_level=look).orderBy("trade_date").collect()
    assert sizes == {5: 2, 10: 1}
    y = np.array([i % 5 for i in range(30)], dtype=float)
    np.testing.assert_allclose([r["q10"] for r in got[9:]], [((y[i - 9:i + 1] - y[i - 9:i + 1].mean()) ** 2).sum() for i in range(9, 30)])
