"""Cross-section, label, as-of, evaluation and backtest queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import backtest as bt
from barloom.operators import cross_section as xs
from barloom.operators import evaluate as ev
from barloom.operators.asof import asof_left, latest_per_key
from barloom.operators.calendar import build_calendar
from barloom.operators.factors import COMPOSITE_SIGNS, factor_frame
from barloom.operators.labels import (
    benchmark_forward, drop_warmup, forward_drawdown, forward_labels, forward_returns, split_history)
from barloom.operators.regime import trend_flags
from barloom.session import cut_lineage
from catalog.factors import factor_ctes
from catalog.registry import query, r, with_ctes

P = "PARTITION BY code ORDER BY trade_date"
SPLIT = "1999-01-01"


def scored(t):
    """Panel with a 20-day return as score and forward returns; rows where both are known. Stored, as it is read more than once."""
    df = factor_frame(forward_labels(t.bars(), (5, 20), 20), names=["RET20"], zero_fill=False,
                      keep=["close", "volume", "forward_5d_return", "forward_20d_return", "label_score"])
    return cut_lineage(df.where(F.col("RET20").isNotNull() & F.col("forward_5d_return").isNotNull()).select(
        "code", "trade_date", "close", "volume", F.col("RET20").alias("score"), F.col("forward_5d_return").alias("fwd5"),
        F.col("forward_20d_return").alias("fwd20"), "label_score"))


# percentile rank with average ties, as SQL over a partition
def pct(x: str, part: str) -> str:
    return (f"((rank() OVER (PARTITION BY {part} ORDER BY {x}) + (count(*) OVER (PARTITION BY {part}, {x}) - 1) / 2) / "
            f"count({x}) OVER (PARTITION BY {part}))")


@query("xs_x01_rank_centered", with_ctes("scored") + f"SELECT code, trade_date, {r(pct('score', 'trade_date') + ' - 0.5', 'score', 6)}, "
       + r(pct("volume", "trade_date") + " - 0.5", "volume", 6) + " FROM scored", 6)
def x01(t):
    return xs.rank_centered(scored(t), ["score", "volume"]).select("code", "trade_date", "score", "volume")


@query("xs_x02_decile", with_ctes("scored") + "SELECT code, trade_date, CAST(least(9, floor(row_number() OVER (PARTITION BY trade_date "
       "ORDER BY score, code) * 10 / count(*) OVER (PARTITION BY trade_date))) AS INTEGER) AS decile FROM scored")
def x02(t):
    return xs.decile(scored(t), "score").select("code", "trade_date", "decile")


@query("xs_r06b_decile_average", with_ctes("scored") + f"SELECT code, trade_date, CAST(least(9, floor({pct('volume', 'trade_date')} * 10)) AS INTEGER) "
       "AS decile FROM scored")
def r06b(t):
    return xs.decile(scored(t), "volume", method="average").select("code", "trade_date", "decile")


_CLIP = ("SELECT code, trade_date, {cols} FROM (SELECT code, trade_date, {clips} FROM scored s JOIN (SELECT trade_date, {qs} "
         "FROM scored GROUP BY 1) USING (trade_date))")


def z_sql(names, src: str) -> dict[str, str]:
    qs = ", ".join(f"quantile_cont({n}, 0.01) AS {n}_lo, quantile_cont({n}, 0.99) AS {n}_hi" for n in names)
    clips = ", ".join(f"greatest(least({n}, {n}_hi), {n}_lo) AS {n}" for n in names)
    zs = ", ".join(f"CASE WHEN coalesce(stddev_samp({n}) OVER d, 0) = 0 THEN 0 ELSE ({n} - avg({n}) OVER d) / stddev_samp({n}) OVER d END AS {n}"
                   for n in names)
    return {
        "clipped": f"SELECT code, trade_date, {clips} FROM {src} JOIN (SELECT trade_date, {qs} FROM {src} GROUP BY 1) USING (trade_date)",
        "zed": f"SELECT code, trade_date, {zs} FROM clipped WINDOW d AS (PARTITION BY trade_date)"}


@query("xs_x03_winsor_z", with_ctes("scored", **z_sql(["score", "volume"], "scored"))
       + f"SELECT code, trade_date, {r('score')}, {r('volume')} FROM zed")
def x03(t):
    return xs.winsor_z(scored(t), ["score", "volume"]).select("code", "trade_date", "score", "volume")


SIGNED = list(COMPOSITE_SIGNS)
_signed = " + ".join(f"({v} * {n})" for n, v in COMPOSITE_SIGNS.items())


@query("xs_x04_composite", with_ctes("fx", **factor_ctes(SIGNED), **z_sql(SIGNED, "fa"))
       + f"SELECT code, trade_date, {r(f'({_signed}) / {len(SIGNED)}', 'score')} FROM zed")
def x04(t):
    """Composite of all 32 signed factors."""
    sizes = t.bars().groupBy("trade_date").agg(F.count("*").alias("rows"))
    df = factor_frame(t.bars(), t.market_bars(), names=SIGNED)  # not stored: as large as the input many times over
    return xs.composite_score(df, COMPOSITE_SIGNS, sizes=sizes).select("code", "trade_date", "score")


BULL = ("bull AS (SELECT trade_date, coalesce(close > CASE WHEN count(close) OVER w = 200 THEN avg(close) OVER w END, false) AS bull "
        "FROM market WINDOW w AS (ORDER BY trade_date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))")


@query("xs_x05_regime_switched", with_ctes("scored", "market") .rstrip() + ", " + BULL
       + f" SELECT code, trade_date, {r('CASE WHEN coalesce(bull, true) THEN score ELSE -score END', 'score')} FROM scored "
         "LEFT JOIN bull USING (trade_date)")
def x05(t):
    flags = trend_flags(t.market_bars()).select("trade_date", "bull")
    return scored(t).join(flags, "trade_date", "left").select(
        "code", "trade_date", xs.regime_switched(F.col("bull"), F.col("score"), -F.col("score")).alias("score"))


@query("xs_x06_display_percentile", with_ctes("scored", p="SELECT code, trade_date, (row_number() OVER (PARTITION BY trade_date "
       "ORDER BY score, code) - 1) / greatest(1, count(*) OVER (PARTITION BY trade_date) - 1) AS p FROM scored")
       + f"SELECT code, trade_date, {r('p * 9', 'display_score')}, CAST(greatest(1, floor((1 - p) * 100)) AS INTEGER) AS top_pct FROM p")
def x06(t):
    return xs.display_percentile(scored(t), "score", "trade_date").select("code", "trade_date", "display_score", "top_pct")


@query("xs_x07_date_excess", with_ctes("scored") + f"SELECT code, trade_date, {r('fwd5 - avg(fwd5) OVER (PARTITION BY trade_date)', 'excess')} FROM scored")
def x07(t):
    df = xs.with_date_mean(scored(t), "fwd5", "date_mean")
    return df.select("code", "trade_date", (F.col("fwd5") - F.col("date_mean")).alias("excess"))


@query("xs_x08_leaders", with_ctes("fx", v=f"SELECT code, trade_date, ret, CASE WHEN count(volume) OVER w >= 10 THEN (volume - avg(volume) OVER w) / "
       f"nullif(stddev_samp(volume) OVER w, 0) END AS volz FROM fx WINDOW w AS ({P} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
       l="SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY ret DESC, code) AS leader_rank FROM v WHERE ret >= 0.04 AND volz >= 1")
       + f"SELECT trade_date, code, {r('ret')}, {r('volz')}, leader_rank FROM l WHERE leader_rank <= 8")
def x08(t):
    from barloom.operators.factors import daily_return
    from barloom.operators.propagation import volume_zscore
    df = volume_zscore(daily_return(t.bars()))
    return xs.leaders(df).select("trade_date", "code", "ret", "volz", "leader_rank")


# ---- labels -----------------------------------------------------------------------------

@query("label_w41_forward_return", with_ctes("bars") + "SELECT code, trade_date, " + ", ".join(
    r(f"lead(close, {h}) OVER ({P}) / close - 1", f"forward_{h}d_return") for h in (5, 20, 60)) + " FROM bars")
def w41(t):
    return forward_returns(t.bars()).select("code", "trade_date", *[f"forward_{h}d_return" for h in (5, 20, 60)])


@query("label_w42_drawdown", with_ctes("bars") + f"SELECT code, trade_date, {r(f'min(close) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / close - 1', 'forward_20d_drawdown')} FROM bars")
def w42(t):
    return forward_drawdown(t.bars(), 20).select("code", "trade_date", "forward_20d_drawdown")


@query("label_w43_score", with_ctes("bars") + f"SELECT code, trade_date, {r(f'lead(close, 20) OVER ({P}) / close - 1 + 0.5 * (min(close) OVER ({P} ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING) / close - 1)', 'label_score')} FROM bars")
def w43(t):
    return forward_labels(t.bars(), (5,), 20).select("code", "trade_date", "label_score")


@query("label_w41_benchmark_forward", with_ctes("market") + f"SELECT trade_date, {r('lead(close, 20) OVER (ORDER BY trade_date) / close - 1', 'bench_return')} FROM market")
def bench(t):
    return benchmark_forward(t.market_bars(), 20)


@query("label_p04_skip_list", with_ctes("bars") + "SELECT code, count(*) AS rows, '<530' AS reason FROM bars GROUP BY 1 HAVING count(*) < 530")
def p04(t):
    return split_history(t.bars(), 530)[1]


@query("label_p04_kept_p05_warmup", with_ctes("bars") + f"SELECT code, trade_date, {r('close', 'close', 8)} FROM (SELECT *, count(*) OVER (PARTITION BY code) AS n, "
       f"row_number() OVER ({P}) AS rn FROM bars) WHERE n >= 530 AND rn > 250", 8)
def p05(t):
    return drop_warmup(split_history(t.bars(), 530)[0], 250).select("code", "trade_date", "close")


# ---- as-of ------------------------------------------------------------------------------

@query("asof_j04_fundamentals", with_ctes("bars", "funds") + "SELECT b.code, b.trade_date, "
       + r("CASE WHEN b.trade_date - f.available_at <= 400 THEN f.ocf_to_eps END", "ocf_to_eps", 6)
       + " FROM bars b ASOF LEFT JOIN funds f ON b.code = f.code AND b.trade_date > f.available_at", 6)
def j04(t):
    return asof_left(t.bars().select("code", "trade_date"), t.fundamentals(), left_ts="trade_date", right_ts="available_at",
                     values=["ocf_to_eps"], max_age_days=400, tie=["report_period"], left_unique=True).select("code", "trade_date", "ocf_to_eps")


@query("asof_j05_market_alignment", with_ctes("fx") + f"SELECT code, trade_date, {r('m', 'market_ret', 6)} FROM fx", 6)
def j05(t):
    from barloom.operators.factors import align_market
    return align_market(t.bars(), t.market_bars()).select("code", "trade_date", "market_ret")


@query("asof_j16_latest_fundamentals", with_ctes("bars", "funds", lf="SELECT code, last(ocf_to_eps ORDER BY report_period) AS o FROM funds GROUP BY 1")
       + f"SELECT b.code, b.trade_date, {r('o', 'ocf_to_eps', 6)} FROM bars b JOIN lf USING (code) QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1", 6)
def j16(t):
    newest = latest_per_key(t.fundamentals(), ["code"], ["report_period"]).select("code", "ocf_to_eps")
    return latest_per_key(t.bars(), ["code"], ["trade_date"]).select("code", "trade_date").join(newest, "code", "left")


# ---- evaluation -------------------------------------------------------------------------

MIN_ROWS = 10


def ic_ctes(target: str, extra: str = "", src: str = "scored", score: str = "score") -> dict[str, str]:
    return {
        "rk": f"SELECT trade_date, {score} AS s, {target} AS t, {pct(score, 'trade_date')} AS rs, {pct(target, 'trade_date')} AS rt "
              f"FROM (SELECT * FROM {src} WHERE {score} IS NOT NULL AND {target} IS NOT NULL)",
        "ics": "SELECT trade_date, covar_pop(rs, rt) / (stddev_pop(rs) * stddev_pop(rt)) AS ic, count(*) AS n FROM rk GROUP BY 1 "
               f"HAVING count(*) >= {MIN_ROWS} AND min(s) < max(s) AND min(t) < max(t)"}


SUMMARY = (f"{r('avg(ic)', 'mean')}, {r('stddev_samp(ic)', 'std')}, {r('avg(ic) / nullif(stddev_samp(ic), 0)', 'icir')}, "
           f"{r('median(ic)', 'median')}, {r('avg(CASE WHEN ic > 1e-12 THEN 1.0 ELSE 0 END)', 'positive_rate')}, count(*) AS days")


def ics(t, target="fwd5"):
    return ev.ic_by_date(scored(t), "score", target, min_rows=MIN_ROWS)


@query("eval_a03_ic_by_date", with_ctes("scored", **ic_ctes("fwd5")) + f"SELECT trade_date, {r('ic', 'ic', 6)}, n FROM ics", 6)
def a03(t):
    return ics(t)


@query("eval_a04_ic_summary", with_ctes("scored", **ic_ctes("fwd5")) + f"SELECT {SUMMARY} FROM ics")
def a04(t):
    return ev.summarize_ic(ics(t))


@query("eval_ic_by_year", with_ctes("scored", **ic_ctes("fwd5")) + f"SELECT CAST(year(trade_date) AS INTEGER) AS year, {SUMMARY} FROM ics GROUP BY 1")
def a05(t):
    """A05 and the flagship: scan, rolling factor, forward label, rank per date, IC by year."""
    return ev.ic_by_year(ics(t))


@query("eval_a06_ic_by_regime", with_ctes("scored", "market", **ic_ctes("fwd5")).rstrip() + ", " + BULL
       + f" SELECT bull, 'score' AS score, {SUMMARY} FROM ics JOIN bull USING (trade_date) GROUP BY 1")
def a06(t):
    return ev.ic_by_regime(scored(t), trend_flags(t.market_bars()), ["score"], "fwd5", min_rows=MIN_ROWS)


@query("eval_t02_ic_extremes", with_ctes("scored", **ic_ctes("fwd5")) + f"SELECT trade_date, {r('ic', 'ic', 6)}, n, 'worst' AS side FROM "
       "(SELECT * FROM ics ORDER BY ic, trade_date LIMIT 5) UNION ALL "
       f"SELECT trade_date, {r('ic', 'ic', 6)}, n, 'best' FROM (SELECT * FROM ics ORDER BY ic DESC, trade_date LIMIT 5)", 6)
def t02(t):
    return ev.ic_extremes(ics(t))


DEC = {"ok": "SELECT trade_date, avg(fwd5) AS dm FROM scored GROUP BY 1 HAVING count(*) >= 10 AND min(score) < max(score)",
       "dc": "SELECT trade_date, fwd5, least(9, floor(row_number() OVER (PARTITION BY trade_date ORDER BY score, code) * 10 / "
             "count(*) OVER (PARTITION BY trade_date))) AS decile FROM scored JOIN ok USING (trade_date)",
       "dm": "SELECT trade_date, decile, avg(fwd5) AS m FROM dc GROUP BY 1, 2",
       "pr": "SELECT CAST(decile AS INTEGER) AS decile, avg(m) AS mean_return, count(*) AS dates, (SELECT avg(dm) FROM ok) AS universe_return FROM dm GROUP BY 1"}


@query("eval_a07_decile_profile", with_ctes("scored", **DEC) + f"SELECT decile, {r('mean_return')}, dates, {r('universe_return')}, "
       + r("mean_return - universe_return", "excess_return") + " FROM pr")
def a07(t):
    return ev.decile_profile(scored(t), "score", "fwd5")


@query("eval_a07_decile_spread", with_ctes("scored", **DEC) + f"SELECT {r('max(CASE WHEN decile = 9 THEN mean_return END) - max(CASE WHEN decile = 0 THEN mean_return END)', 'spread_9_minus_0')}, "
       + r("max(universe_return)", "universe_return") + " FROM pr")
def a07s(t):
    return ev.decile_spread(ev.decile_profile(scored(t), "score", "fwd5"))


TOP = {"tp": "SELECT trade_date, avg(fwd5) AS top_return FROM (SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS k "
             "FROM scored) WHERE k <= 5 GROUP BY 1",
       "un": "SELECT trade_date, avg(fwd5) AS universe_return FROM scored GROUP BY 1 HAVING count(*) >= 5",
       "ex": "SELECT *, top_return - universe_return AS excess FROM tp JOIN un USING (trade_date)"}


@query("eval_a08_topk_excess", with_ctes("scored", **TOP) + f"SELECT {r('avg(top_return)', 'top_return')}, {r('avg(universe_return)', 'universe_return')}, "
       f"{r('avg(excess)', 'excess_return')}, {r('stddev_samp(excess)', 'excess_std')}, "
       f"{r('avg(CASE WHEN excess > 1e-12 THEN 1.0 ELSE 0 END)', 'excess_positive_rate')}, count(*) AS period_count FROM ex")
def a08(t):
    return ev.topk_excess(scored(t), "score", "fwd5", 5)


@query("eval_t01_topk_rows", with_ctes("scored") + f"SELECT trade_date, code, {r('score', 'score', 6)}, place FROM (SELECT *, row_number() OVER "
       "(PARTITION BY trade_date ORDER BY score DESC, code) AS place FROM scored) WHERE place <= 5", 6)
def t01(t):
    from barloom.operators.research import newest_rows
    return newest_rows(scored(t), ["trade_date"], [F.desc("score"), "code"], 5).select(
        "trade_date", "code", "score", F.col("row_no").alias("place"))


@query("eval_a09_ndcg", with_ctes(
    "scored", dl="SELECT trade_date, code, score, least(9, floor(row_number() OVER (PARTITION BY trade_date ORDER BY label_score, code) * 10 / "
    "count(*) OVER (PARTITION BY trade_date))) AS label FROM scored WHERE label_score IS NOT NULL",
    tg="SELECT *, avg(label) OVER (PARTITION BY trade_date, score) AS g, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS a, "
       "row_number() OVER (PARTITION BY trade_date ORDER BY label DESC, code) AS i, count(*) OVER (PARTITION BY trade_date) AS n FROM dl")
    + f"SELECT trade_date, {r('coalesce(sum(CASE WHEN a <= 5 THEN g / log2(a + 1) ELSE 0 END) / nullif(sum(CASE WHEN i <= 5 THEN label / log2(i + 1) ELSE 0 END), 0), 0)', 'ndcg')} "
      "FROM tg WHERE n > 1 GROUP BY 1")
def a09(t):
    labelled = xs.decile(scored(t).where(F.col("label_score").isNotNull()), "label_score", name="label")
    return ev.ndcg_by_date(labelled, "score", "label", 5)


@query("eval_a11_distribution", with_ctes("scored") + f"SELECT count(fwd20) AS count, {r('avg(fwd20)', 'mean')}, {r('stddev_samp(fwd20)', 'std')}, "
       f"{r('avg(CASE WHEN fwd20 > 0 THEN 1.0 WHEN fwd20 IS NOT NULL THEN 0 END)', 'positive_rate')}, " + ", ".join(
           r(f"quantile_cont(fwd20, {q})", n) for n, q in (("q10", 0.1), ("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q90", 0.9))) + " FROM scored")
def a11(t):
    return ev.distribution(scored(t), "fwd20")


@query("eval_a17_panel_report", with_ctes("bars", d="SELECT trade_date, count(DISTINCT code) AS codes, count(*) AS n FROM bars GROUP BY 1")
       + "SELECT CAST(sum(n) AS BIGINT) AS rows, min(trade_date) AS date_start, max(trade_date) AS date_end, min(codes) AS per_date_min_codes, "
       f"{r('median(codes)', 'per_date_median_codes')}, max(codes) AS per_date_max_codes, (SELECT count(DISTINCT code) FROM bars) AS codes FROM d")
def a17(t):
    return ev.panel_report(t.bars())


@query("eval_m04_non_overlapping_ic", with_ctes("scored", "cal", nov="SELECT * FROM scored JOIN cal USING (trade_date) WHERE idx % 5 = 0", **ic_ctes("fwd5", src="nov"))
       + f"SELECT {SUMMARY} FROM ics")
def m04(t):
    return ev.summarize_ic(ev.ic_by_date(ev.non_overlapping(scored(t), t.calendar(), 5), "score", "fwd5", min_rows=MIN_ROWS))


# ---- backtest ---------------------------------------------------------------------------

HOLD, K, COST, RF, EXPO = 20, 5, 0.003, 0.02, 0.5
RFP = RF * HOLD / 252
PERIODS = {
    "days": f"SELECT trade_date, CASE WHEN trade_date < DATE '{SPLIT}' THEN 'train' ELSE 'test' END AS segment FROM (SELECT DISTINCT trade_date FROM sc)",
    "rb": f"SELECT trade_date, segment FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY trade_date) - 1 AS i FROM days) WHERE i % {HOLD} = 0",
    "us": "SELECT *, row_number() OVER (PARTITION BY segment ORDER BY trade_date) AS period FROM (SELECT segment, trade_date, avg(fwd20) AS universe "
          f"FROM sc JOIN rb USING (trade_date) GROUP BY 1, 2 HAVING count(*) >= {2 * K} AND min(score) < max(score))",
    "bk": "SELECT * FROM (SELECT sc.*, us.segment, us.period, us.universe, row_number() OVER (PARTITION BY trade_date ORDER BY score DESC, code) AS place "
          f"FROM sc JOIN us USING (trade_date)) WHERE place <= {K}",
    "tr": f"SELECT a.segment, a.period, CASE WHEN a.period = 1 THEN 1 ELSE 1 - count(b.code) / {K}::DOUBLE END AS turnover FROM bk a LEFT JOIN bk b "
          "ON a.segment = b.segment AND a.code = b.code AND a.period = b.period + 1 GROUP BY 1, 2, a.period",
    "bench": f"SELECT trade_date, lead(close, {HOLD}) OVER (ORDER BY trade_date) / close - 1 AS bench_return FROM market",
    "pd": "SELECT segment, period, trade_date, turnover, top_return, "
          f"(CASE WHEN bull THEN 1 ELSE {EXPO} END) * (top_return - turnover * {COST}) + (1 - CASE WHEN bull THEN 1 ELSE {EXPO} END) * {RFP} AS port, "
          "universe, coalesce(bench_return, universe) AS bench FROM (SELECT segment, period, trade_date, avg(fwd20) AS top_return, any_value(universe) AS universe "
          "FROM bk GROUP BY 1, 2, 3) JOIN tr USING (segment, period) JOIN bull USING (trade_date) LEFT JOIN bench USING (trade_date)"}


def bt_sql() -> str:
    head = with_ctes("scored", "market").rstrip() + ", " + BULL + ", sc AS (SELECT * FROM scored WHERE fwd20 IS NOT NULL)"
    return head + "".join(f", {k} AS ({v})" for k, v in PERIODS.items())


def bt_input(t):
    flags = trend_flags(t.market_bars()).select("trade_date", "bull")
    return scored(t).where(F.col("fwd20").isNotNull()).join(flags, "trade_date", "left")


def bt_periods(t):
    return bt.backtest_periods(bt_input(t), "fwd20", bench=benchmark_forward(t.market_bars(), HOLD), hold=HOLD, k=K, cost=COST, rf=RF,
                               bear_exposure=EXPO, split_date=SPLIT)


@query("backtest_b01_periods", bt_sql() + f" SELECT segment, period, trade_date, {r('turnover')}, {r('top_return')}, {r('port')}, {r('universe')}, {r('bench')} FROM pd")
def b01p(t):
    return bt_periods(t)


def _cagr(x: str) -> str:
    return f"pow(exp(sum(ln(1 + {x}))), {252 / HOLD} / count(*)) - 1"


@query("backtest_b01_metrics", bt_sql() + ", w AS (SELECT *, exp(sum(ln(1 + port)) OVER (PARTITION BY segment ORDER BY period)) AS wealth FROM pd), "
       "dd AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY segment ORDER BY period) - 1 AS drawdown FROM w) SELECT segment, count(*) AS periods, "
       f"{r(_cagr('port'), 'cagr')}, {r(_cagr('bench'), 'bench_cagr')}, {r(_cagr('universe'), 'universe_cagr')}, "
       f"{r(f'stddev_pop(port) * sqrt({252 / HOLD})', 'ann_vol')}, {r(f'coalesce(avg(port - {RFP}) / nullif(stddev_pop(port), 0) * sqrt({252 / HOLD}), 0)', 'sharpe')}, "
       f"{r('min(drawdown)', 'max_drawdown')}, {r('avg(turnover)', 'avg_turnover')}, {r(f'avg(CASE WHEN port > {RFP} THEN 1.0 ELSE 0 END)', 'beat_rf')}, "
       f"{r('avg(CASE WHEN port > bench THEN 1.0 ELSE 0 END)', 'beat_bench')}, {r('avg(CASE WHEN port > universe THEN 1.0 ELSE 0 END)', 'beat_universe')} FROM dd GROUP BY 1")
def b01m(t):
    return bt.backtest_metrics(bt_periods(t), hold=HOLD, rf=RF)


@query("backtest_b01_deciles", bt_sql() + f", dq AS (SELECT segment, trade_date, least(9, floor({pct('score', 'trade_date')} * 10)) AS decile, fwd20 FROM sc "
       f"JOIN us USING (trade_date)) SELECT segment, CAST(decile AS INTEGER) AS decile, {r('avg(m)', 'mean_return')}, count(*) AS dates FROM (SELECT segment, trade_date, decile, "
       "avg(fwd20) AS m FROM dq GROUP BY 1, 2, 3) GROUP BY 1, 2")
def b01d(t):
    return bt.backtest_deciles(bt_input(t), "fwd20", hold=HOLD, k=K, split_date=SPLIT)


@query("backtest_u05_basket_overlap", bt_sql() + f" SELECT segment, period, {r('turnover')} FROM tr")
def u05(t):
    df = bt_input(t)
    usable = bt._usable(df, bt.rebalance_dates(df, HOLD, SPLIT), K, "fwd20")
    return bt.turnover(bt.baskets(df, usable, K, "fwd20"), K)


@query("calendar_w48_index", with_ctes("cal") + "SELECT trade_date, idx FROM cal")
def w48(t):
    return build_calendar(t.bars())
