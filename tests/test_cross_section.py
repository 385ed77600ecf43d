import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import cross_section as xs
from barloom.operators import evaluate as ev


def panel(spark, n=400, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f"d{i % 3}", f"{i:06d}", float(x) if rng.random() > 0.05 else None, float(y))
            for i, (x, y) in enumerate(zip(np.round(rng.normal(0, 1, n), 1), rng.normal(0, 1, n)))]
    # a third of all rows share one value
    rows += [("d0", f"9{i:05d}", 0.5, float(i)) for i in range(n // 2)]
    return spark.createDataFrame(rows, "trade_date string, code string, x double, y double")


def test_centered_rank_values(spark):
    df = spark.createDataFrame([("a", str(i), float(i)) for i in (1, 2, 3, 4)] + [("b", "1", 7.0)], "trade_date string, code string, x double")
    got = {(r.trade_date, r.code): r.x for r in xs.rank_centered(df, ["x"], single_row_zero=True).collect()}
    assert [got["a", str(i)] for i in (1, 2, 3, 4)] == [-0.25, 0, 0.25, 0.5] and got["b", "1"] == 0
    ties = spark.createDataFrame([("a", str(i), x) for i, x in enumerate((1.0, 1.0, 2.0))], "trade_date string, code string, x double")
    assert sorted(r.x for r in xs.pct_rank(ties, ["x"]).collect()) == [0.5, 0.5, 1.0]
    missing = xs.rank_centered(df, ["x", "gone"]).select("gone").distinct().collect()
    assert [r.gone for r in missing] == [0.0]


def test_decile_of_four(spark):
    df = spark.createDataFrame([("a", str(i), float(i)) for i in range(4)], "trade_date string, code string, x double")
    assert [r.decile for r in xs.decile(df, "x").orderBy("code").collect()] == [2, 5, 7, 9]


@pytest.fixture(params=[4096, 7])
def ranges(request, monkeypatch):
    """Groups in one range, and in very many."""
    monkeypatch.setattr(xs, "RANGE_ROWS", request.param)


def plain(df):
    return df.toPandas().sort_values(["trade_date", "code"]).reset_index(drop=True)


def same(got, want, cols, **kw):
    got = got.toPandas().sort_values(["trade_date", "code"]).reset_index(drop=True)
    for c in cols:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, **kw)


def test_ranks_are_those_of_pandas(spark, ranges):
    df = panel(spark).withColumn("z", F.when(F.col("y") > 0, F.col("y") * 1e9).otherwise(F.col("y") * 1e-9))
    want = plain(df)
    for c in "xyz":
        want[c] = want.groupby("trade_date")[c].rank(pct=True)
    same(xs.pct_rank(df, ["x", "y", "z"]), want, "xyz")
    same(xs.pct_rank(df, {"x": "r"}).select("trade_date", "code", F.col("r").alias("x")), want, "x")


@pytest.mark.parametrize("method", ["first", "average"])
def test_deciles_are_those_of_pandas(spark, ranges, method):
    df, want = panel(spark), plain(panel(spark))
    rank = want.groupby("trade_date").x.rank(method=method, pct=False)
    n = want.groupby("trade_date").x.transform("count")
    want["decile"] = np.floor((rank / n if method == "average" else rank * 10 / n) * (10 if method == "average" else 1) + 0).clip(upper=9)
    same(xs.decile(df, "x", method=method), want, ["decile"])


def test_quantiles_and_scores_are_those_of_pandas(spark, ranges):
    df, want = panel(spark), plain(panel(spark))
    got = {r.trade_date: (r.a, r.b, r.c) for r in xs.group_quantiles(df, "x", {"a": 0.01, "b": 0.5, "c": 0.99}).collect()}
    for d, x in want.groupby("trade_date").x:
        assert got[d] == pytest.approx(tuple(x.quantile([0.01, 0.5, 0.99])))
    whole = xs.group_quantiles(df, "y", {"m": 0.3}, by=[]).first()
    assert whole.m == pytest.approx(want.y.quantile(0.3))
    for c in "xy":
        g = want.groupby("trade_date")[c]
        want[c] = want[c].clip(g.transform(lambda v: v.quantile(0.01)), g.transform(lambda v: v.quantile(0.99)))
        g = want.groupby("trade_date")[c]
        want[c] = (want[c] - g.transform("mean")) / g.transform("std")
    same(xs.winsor_z(df, ["x", "y"]), want, "xy")


def test_ranks_of_extreme_values_and_missing_dates(spark, ranges):
    odd = [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5e-324, -5e-324, 1.7e308, -1.7e308, None]
    df = spark.createDataFrame([(d, f"{i:02d}", v) for d in ("a", "b", None) for i, v in enumerate(odd)], "trade_date string, code string, x double")
    rank = {i: r for i, r in zip((2, 8, 6, 3, 4, 5, 7, 1, 0), (1, 2, 3, 4.5, 4.5, 6, 7, 8, 9))}
    for out in (xs.pct_rank(df, ["x"]), xs.pct_rank(df.withColumn("y", F.col("x")), ["x", "y"])):
        for r in out.collect():
            assert r.x == (pytest.approx(rank[int(r.code)] / 9) if r.trade_date and int(r.code) in rank else None)


def test_nothing_runs_while_a_plan_is_built(spark):
    tracker = spark.sparkContext.statusTracker()
    df = panel(spark)
    spark.sparkContext.setJobGroup("plans", "")
    try:
        xs.display_percentile(xs.composite_score(xs.rank_centered(df, ["x", "y"]), {"x": 1, "y": -1}), "score")
        xs.group_quantiles(df, "x", {"m": 0.5})
        assert not tracker.getJobIdsForGroup("plans")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_constant_score_and_flat_spread(spark):
    df = spark.createDataFrame([("a", str(i), 1.0, float(i)) for i in range(5)], "trade_date string, code string, x double, y double")
    assert ev.ic_by_date(df, "x", "y").count() == 0
    assert {r.x for r in xs.winsor_z(df, ["x"]).collect()} == {0.0}


def test_ndcg_with_ties(spark):
    df = spark.createDataFrame([("a", "1", 1.0, 3), ("a", "2", 1.0, 1), ("a", "3", 0.0, 2)], "trade_date string, code string, s double, g int")
    got = ev.ndcg_by_date(df, "s", "g", 3).collect()[0].ndcg
    d = [1 / np.log2(i + 2) for i in range(3)]
    assert got == pytest.approx((2 * d[0] + 2 * d[1] + 2 * d[2]) / (3 * d[0] + 2 * d[1] + 1 * d[2]))


@pytest.fixture(params=[0, 150, 1 << 18])
def sizes(request, monkeypatch):
    """All dates cut into ranges, the largest one alone, and none."""
    monkeypatch.setattr(xs, "GROUP_ROWS", request.param)
    monkeypatch.setattr(xs, "RANGE_ROWS", 7)


def test_dates_of_every_size_agree(spark, sizes):
    df, want = panel(spark).unionByName(spark.createDataFrame([(None, "z", 1.0, 1.0)], panel(spark, 1).schema)), plain(panel(spark))
    ranks, deciles, scores = xs.pct_rank(df, {"x": "rx", "y": "ry"}), xs.decile(df, "y"), xs.winsor_z(df, ["x"])
    for out, cols in ((ranks, ["rx", "ry"]), (deciles, ["decile"])):
        assert {tuple(r) for r in out.where("trade_date IS NULL").select(*cols).collect()} == {(None,) * len(cols)}
    g = want.groupby("trade_date")
    want["rx"], want["ry"] = g.x.rank(pct=True), g.y.rank(pct=True)
    want["decile"] = np.floor(g.y.rank(method="first") * 10 / g.y.transform("count")).clip(upper=9)
    kept = want.x.clip(g.x.transform(lambda v: v.quantile(0.01)), g.x.transform(lambda v: v.quantile(0.99)))
    want["x"] = (kept - kept.groupby(want.trade_date).transform("mean")) / kept.groupby(want.trade_date).transform("std")
    for out, cols in ((ranks, ["rx", "ry"]), (deciles, ["decile"]), (scores, ["x"])):
        same(out.where("trade_date IS NOT NULL"), want, cols)


def test_rows_of_usual_dates_move_once(spark, tmp_path):
    """Composite of many factors: rows are shuffled once and partial counts once, and the plan for larger dates falls away."""
    names = [f"f{i}" for i in range(12)]
    spark.range(600).select((F.col("id") % 3).cast("string").alias("trade_date"), F.col("id").cast("string").alias("code"),
                            *[F.rand(i).alias(n) for i, n in enumerate(names)]).write.parquet(f"{tmp_path}/p")
    df = xs.composite_score(spark.read.parquet(f"{tmp_path}/p"), {n: 1 for n in names})
    assert len(df.collect()) == 600
    ran = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert ran.count("Exchange hashpartitioning") <= 3


def test_composite_with_given_sizes_reads_an_input_that_is_not_stored(spark, monkeypatch):
    monkeypatch.setattr("barloom.operators.cross_section.GROUP_ROWS", 30)
    rows = [(f"{c:03d}", d, float((c * 37 + k * 11) % 101), float((c * c + k) % 53)) for k, d in enumerate(("a", "b", None)) for c in range(20 + 30 * (k == 1))]
    df = spark.createDataFrame(rows, "code string, trade_date string, x double, y double")
    sizes = df.groupBy("trade_date").agg(F.count("*").alias("rows"))
    signs = {"x": 1, "y": -1}
    plain = {(r["code"], r["trade_date"]): r["score"] for r in xs.composite_score(df, signs).collect()}
    given = {(r["code"], r["trade_date"]): r["score"] for r in xs.composite_score(df, signs, sizes=sizes).collect()}
    assert given.keys() == plain.keys() and len(plain) == 90
    for k, v in plain.items():
        assert (v is None and given[k] is None) or abs(v - given[k]) < 1e-9
    assert {v for (_, d), v in given.items() if d is None} == {0.0}
