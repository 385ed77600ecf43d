"""Rolling factor queries (W01-W33), one per family over all seven windows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.operators.cross_section import extreme_factors
from barloom.operators.factors import CANDLE_SHAPES, WINDOWS, factor_frame, factor_names, newest_factors
from barloom.operators.technical import factor_summary
from barloom.session import cut_lineage
from catalog.registry import query, r, with_ctes

EPS = "1e-12"


def win(w: int) -> str:
    return f"OVER (PARTITION BY code ORDER BY trade_date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def full(expr: str, x: str, w: int) -> str:
    """Value only when all w rows of x are present."""
    return f"CASE WHEN count({x}) {win(w)} = {w} THEN {expr} END"


def corr(x: str, y: str, w: int) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    mx, my = f"CASE WHEN {both} THEN {x} END", f"CASE WHEN {both} THEN {y} END"
    spread = f"nullif(stddev_samp({mx}) {win(w)} * stddev_samp({my}) {win(w)}, 0)"
    return f"CASE WHEN count({mx}) {win(w)} = {w} THEN covar_samp({mx}, {my}) {win(w)} / {spread} END"


def beta(w: int) -> str:
    return full(f"covar_samp(ret, CASE WHEN ret IS NOT NULL THEN m END) {win(w)} / (var_samp(m) {win(w)} + {EPS})", "ret", w)


def _sum(x: str, w: int) -> str:
    return full(f"sum({x}) {win(w)}", x, w)


def _flag(op: str, w: int, how: str = "sum") -> str:
    f = f"CASE WHEN ret {op} 0 THEN 1::DOUBLE ELSE 0 END"
    return full(f"{how}({f}) {win(w)}", f, w)


def _share(up: str, down: str, w: int) -> str:
    return f"({_sum(up, w)}) / (({_sum(up, w)}) + ({_sum(down, w)}) + {EPS})"


GAIN, LOSS = "greatest(ret, 0)", "greatest(-ret, 0)"
VGAIN, VLOSS = "greatest(dv, 0)", "greatest(-dv, 0)"
# greatest/least skip nulls, so the argument must be null when the series is
GAIN, LOSS, VGAIN, VLOSS = (f"CASE WHEN {x} IS NOT NULL THEN {e} END" for x, e in
                            (("ret", GAIN), ("ret", LOSS), ("dv", VGAIN), ("dv", VLOSS)))


def _rank(w: int) -> str:
    items = f"list(c) {win(w)}"
    return full(f"(len(list_filter({items}, lambda x: x < c)) + (len(list_filter({items}, lambda x: x = c)) + 1) / 2) / {w}",
                "c", w)


def _arg(x: str, pick: str, w: int) -> str:
    return full(f"list_position(list({x}) {win(w)}, {pick}({x}) {win(w)}) / {w}", x, w)


def _mom(w: int) -> str:
    return full(f"avg(ret) {win(w)} / (stddev_samp(ret) {win(w)} + {EPS})", "ret", w)


FORMULAS = {
    "ROC": lambda w: f"lag(c, {w}) OVER (PARTITION BY code ORDER BY trade_date) / c",
    "MA": lambda w: full(f"avg(c) {win(w)} / c", "c", w),
    "STD": lambda w: full(f"stddev_samp(c) {win(w)} / c", "c", w),
    "BETA": beta,
    "RSQR": lambda w: f"pow({corr('ret', 'm', w)}, 2)",
    "MAX": lambda w: full(f"max(high) {win(w)} / c", "high", w),
    "MIN": lambda w: full(f"min(low) {win(w)} / c", "low", w),
    "QTLU": lambda w: full(f"quantile_cont(c, 0.8) {win(w)} / c", "c", w),
    "QTLD": lambda w: full(f"quantile_cont(c, 0.2) {win(w)} / c", "c", w),
    "RANK": _rank,
    "RSV": lambda w: full(f"(c - min(c) {win(w)}) / (max(c) {win(w)} - min(c) {win(w)} + {EPS})", "c", w),
    "IMAX": lambda w: _arg("high", "max", w),
    "IMIN": lambda w: _arg("low", "min", w),
    "IMXD": lambda w: f"({_arg('high', 'max', w)}) - ({_arg('low', 'min', w)})",
    "CORR": lambda w: corr("c", "lv", w),
    "CORD": lambda w: corr("dc", "dlv", w),
    "CNTP": lambda w: _flag(">", w, "avg"),
    "CNTN": lambda w: _flag("<", w, "avg"),
    "CNTD": lambda w: f"({_flag('>', w, 'avg')}) - ({_flag('<', w, 'avg')})",
    "SUMP": lambda w: _share(GAIN, LOSS, w),
    "SUMN": lambda w: _share(LOSS, GAIN, w),
    "SUMD": lambda w: f"{_share(GAIN, LOSS, w)} - {_share(LOSS, GAIN, w)}",
    "VMA": lambda w: full(f"avg(volume) {win(w)} / nullif(volume, 0)", "volume", w),
    "VSTD": lambda w: full(f"stddev_samp(volume) {win(w)} / nullif(volume, 0)", "volume", w),
    "WVMA": lambda w: full(f"stddev_samp(cv) {win(w)} / (avg(cv) {win(w)} + {EPS})", "cv", w),
    "VSUMP": lambda w: _share(VGAIN, VLOSS, w),
    "VSUMN": lambda w: _share(VLOSS, VGAIN, w),
    "VSUMD": lambda w: f"{_share(VGAIN, VLOSS, w)} - {_share(VLOSS, VGAIN, w)}",
    "RET": lambda w: f"c / lag(c, {w}) OVER (PARTITION BY code ORDER BY trade_date) - 1",
    "MOM": _mom,
    "SHARPE": lambda w: f"({_mom(w)}) * sqrt(252)",
    "DD": lambda w: full(f"c / (max(c) {win(w)} + {EPS}) - 1", "c", w),
    # without a down day the ratio is of the size 1e12: compared in units of 1e12
    "UPR": lambda w: f"({_flag('>', w)}) / (({_flag('<', w)}) + {EPS})",
    "DNR": lambda w: _flag("<", w, "avg"),
    "VOLZ": lambda w: full(f"(volume - avg(volume) {win(w)}) / (stddev_samp(volume) {win(w)} + {EPS})", "volume", w),
    "TURN": lambda w: full(f"volume / (avg(volume) {win(w)} + {EPS})", "volume", w),
    "AMTMA": lambda w: full(f"avg(cv) {win(w)} / (cv + {EPS})", "cv", w),
    "ILLIQ": lambda w: full(f"avg(abs(ret)) {win(w)} / (avg(cv) {win(w)} + {EPS})", "ret", w),
    "PVCHG": lambda w: corr("ret", "vp", w),
    "RELV": lambda w: _sum("rel", w),
}
SCALE = {"ILLIQ": 1e6}
NEEDS_MARKET = {"BETA", "RSQR", "RESI", "RELV"}


def _digits(families) -> int:
    """Ratios of whole quantities often end in a 5 at the fifth place: round them further out."""
    return 8 if {"VMA", "TURN", "WVMA", "AMTMA"} & set(families) else 4


def _sql(families: list[str]) -> str:
    cols = [r(f"coalesce({FORMULAS[f](w)}, 0) * {SCALE.get(f, 1)}", f"{f}{w}", _digits(families))
            for f in families for w in WINDOWS]
    return with_ctes("fx") + "SELECT code, trade_date, " + ", ".join(cols) + " FROM fx"


def _frame(t, families: list[str]):
    names = [f"{f}{w}" for f in families for w in WINDOWS]
    market = t.market_bars() if NEEDS_MARKET & set(families) else None
    df = factor_frame(t.bars(), market, names=names)
    return df.select("code", "trade_date", *[(F.col(n) * SCALE.get(n.rstrip("0123456789"), 1.0)).alias(n) for n in names])


GROUPS = {
    "w06_roc": ["ROC"], "w07_ma": ["MA"], "w08_std": ["STD"], "w09_beta": ["BETA"], "w10_rsqr": ["RSQR"],
    "w12_max_min": ["MAX", "MIN"], "w13_quantile": ["QTLU", "QTLD"], "w14_rank": ["RANK"], "w15_rsv": ["RSV"],
    "w16_first_extreme": ["IMAX", "IMIN", "IMXD"], "w17_corr": ["CORR"], "w18_cord": ["CORD"],
    "w19_day_counts": ["CNTP", "CNTN", "CNTD"], "w20_gain_sums": ["SUMP", "SUMN", "SUMD"],
    "w21_volume": ["VMA", "VSTD"], "w22_wvma": ["WVMA"], "w23_volume_sums": ["VSUMP", "VSUMN", "VSUMD"],
    "w24_ret": ["RET"], "w25_mom_sharpe": ["MOM", "SHARPE"], "w26_drawdown": ["DD"], "w27_up_down": ["UPR", "DNR"],
    "w28_volz_turn": ["VOLZ", "TURN"], "w29_amtma": ["AMTMA"], "w30_illiq": ["ILLIQ"], "w31_pvchg": ["PVCHG"],
    "w32_relv": ["RELV"],
}
for _name, _families in GROUPS.items():
    query(f"factor_{_name}", _sql(_families), _digits(_families))(lambda t, fs=_families: _frame(t, fs))

_resid = ", ".join(f"ret - ({beta(w)}) * m AS e{w}" for w in WINDOWS)
_resi = ", ".join(r(f"coalesce({full(f'stddev_samp(e{w}) {win(w)}', f'e{w}', w)}, 0)", f"RESI{w}") for w in WINDOWS)


@query("factor_w11_resi", with_ctes("fx", res=f"SELECT code, trade_date, {_resid} FROM fx")
       + f"SELECT code, trade_date, {_resi} FROM res")
def resi(t):
    return _frame(t, ["RESI"])


@query("factor_w01_w02_price_ratios", with_ctes("bars") + "SELECT code, trade_date, "
       + ", ".join([r("open / close", "OPEN0"), r("high / close", "HIGH0"), r("low / close", "LOW0"),
                    r("CASE WHEN amount > 0 THEN amount / volume ELSE (high + low + close) / 3 END / close", "VWAP0")])
       + " FROM bars")
def price_ratios(t):
    return factor_frame(t.bars(), names=["OPEN0", "HIGH0", "LOW0", "VWAP0"])


_rng = f"(nullif(high - low, 0) + {EPS})"
_shape = {"KMID": "(c - open) / open", "KLEN": "(high - low) / open", "KMID2": f"(c - open) / {_rng}",
          "KUP": "(high - greatest(open, c)) / open", "KUP2": f"(high - greatest(open, c)) / {_rng}",
          "KLOW": "(least(open, c) - low) / open", "KLOW2": f"(least(open, c) - low) / {_rng}",
          "KSFT": "(2 * c - high - low) / open", "KSFT2": f"(2 * c - high - low) / {_rng}"}


@query("factor_w03_w05_candles", with_ctes("fx") + "SELECT code, trade_date, "
       + ", ".join(r(f"coalesce({e}, 0)", n) for n, e in _shape.items()) + " FROM fx")
def candles(t):
    return factor_frame(t.bars(), names=list(CANDLE_SHAPES))


LATEST = ("RET20", "MA20", "STD20", "VOLZ20", "RSV20", "MOM60")
_latest = ", ".join(r(f"coalesce({FORMULAS[n.rstrip('0123456789')](int(n.lstrip('ABCDEFGHIJKLMNOPQRSTUVWXYZ')))}, 0)", n)
                    for n in LATEST)

_EXPR = {"OPEN0": "open / close", "HIGH0": "high / close", "LOW0": "low / close",
         "VWAP0": "CASE WHEN amount > 0 THEN amount / volume ELSE (high + low + close) / 3 END / close", **_shape}


def factor_expr(name: str) -> str:
    """SQL of any of the 300 factors over the rows of ``fe``, missing as 0."""
    family, window = name.rstrip("0123456789"), "".join(c for c in name if c.isdigit())
    if name in _EXPR:
        return f"coalesce({_EXPR[name]}, 0)"
    if family == "RESI":
        return f"coalesce({full(f'stddev_samp(e{window}) {win(int(window))}', f'e{window}', int(window))}, 0)"
    return f"coalesce({FORMULAS[family](int(window))}, 0)"


def factor_ctes(names, keep: str = "code, trade_date") -> dict[str, str]:
    """Blocks after ``fx``: fe adds the residuals of the windows that are needed, fa has the factors."""
    windows = sorted({int(n[4:]) for n in names if n.startswith("RESI")})
    resid = "".join(f", ret - ({beta(w)}) * m AS e{w}" for w in windows)
    return {"fe": f"SELECT *{resid} FROM fx", "fa": f"SELECT {keep}, " + ", ".join(f"{factor_expr(n)} AS {n}" for n in names) + " FROM fe"}


# ratios without a down day are of the size 1e12: compared in units of it
UNITS = {f"UPR{w}": 1e12 for w in WINDOWS}


@query("factor_w33_latest", with_ctes("fx", f=f"SELECT code, trade_date, {_latest} FROM fx")
       + "SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1")
def latest(t):
    return newest_factors(t.bars(), names=list(LATEST))


def _listed(items) -> str:
    return "unnest([" + ", ".join(items) + "])"


ALL = factor_names()


def in_units() -> Column:
    """All factors of a row as one vector, each in its unit; none is missing. Spark ML keeps the sums of a vector in
    plain arrays, so a row is not exploded into 300 and no aggregation buffer has a field per factor."""
    return array_to_vector(F.array(*[F.col(n) / UNITS.get(n, 1.0) for n in ALL]))


_unit = {n: f"{n} / {UNITS.get(n, 1.0)!r}" for n in ALL}


@query("factor_full_frame", with_ctes("fx", **factor_ctes(ALL), st="SELECT " + ", ".join(
       [_listed(f"'{n}'" for n in ALL) + " AS factor", _listed(f"count({n})" for n in ALL) + " AS rows",
        _listed(f"avg({_unit[n]})" for n in ALL) + " AS mean", _listed(f"stddev_samp({_unit[n]})" for n in ALL) + " AS std"]) + " FROM fa")
       + f"SELECT factor, rows, {r('mean')}, {r('std')} FROM st")
def full_frame(t):
    """All 300 factors on every bar (J1), reported as mean and spread of each factor."""
    df = factor_frame(t.bars(), t.market_bars())
    stats = df.select(F.lit(0).alias("all"), in_units().alias("values")).groupBy("all").agg(
        F.count("*").alias("rows"), Summarizer.metrics("mean", "std").summary(F.col("values")).alias("s"))  # no rows: no groups
    per_factor = F.arrays_zip(F.array(*[F.lit(n) for n in ALL]).alias("factor"), vector_to_array("s.mean").alias("mean"), vector_to_array("s.std").alias("std"))
    return stats.select("rows", F.inline(per_factor)).select("factor", "rows", "mean", F.when(F.col("rows") > 1, F.col("std")).alias("std"))


@query("factor_a22_extreme_zscores", with_ctes(
    "fx", **factor_ctes(ALL), lf="SELECT * FROM fa QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1",
    lo=f"SELECT code, {_listed(repr(n) for n in ALL)} AS factor, {_listed(ALL)} AS v FROM lf",
    z="SELECT code, factor, round(coalesce((v - avg(v) OVER (PARTITION BY factor)) / nullif(stddev_samp(v) OVER (PARTITION BY factor), 0), 0), 9) AS z FROM lo",
    rk="SELECT *, row_number() OVER (PARTITION BY code ORDER BY z DESC, factor) AS hi, row_number() OVER (PARTITION BY code ORDER BY z, factor) AS lw FROM z")
    + f"SELECT code, 'top' AS side, hi AS place, factor, {r('z', 'z')} FROM rk WHERE hi <= 5 "
      f"UNION ALL SELECT code, 'bottom', lw, factor, {r('z', 'z')} FROM rk WHERE lw <= 5")
def extremes(t):
    """The five highest and lowest of all 300 factors of each code's newest row."""
    picked = extreme_factors(cut_lineage(newest_factors(t.bars(), t.market_bars())), ALL)
    sides = [picked.select("code", F.lit(s).alias("side"), F.posexplode(s).alias("p", "e")) for s in ("top", "bottom")]
    return sides[0].unionByName(sides[1]).select("code", "side", (F.col("p") + 1).cast("bigint").alias("place"),
                                                 "e.factor", "e.z")


SUMMARY = ("ROC5", "ROC20", "ROC120", "ROC250", "MA20", "MA120", "MA250", "RSV20", "CNTD20", "SUMD20", "SUMD120",
           "DD120", "RELV60", "SHARPE120", "VSUMD20", "TURN20")


def _cols(names) -> str:
    return ", ".join(f"coalesce({FORMULAS[n.rstrip('0123456789')](int(n.lstrip('ABCDEFGHIJKLMNOPQRSTUVWXYZ')))}, 0) AS {n}"
                     for n in names)


def _rules_sql() -> str:
    from barloom.operators.technical import FACTOR_RULES
    test = {"low": "{x} > 0 AND {x} <= {b}", "high": "{x} >= {b}", "under": "{x} <= {b}", "near": "{x} >= {b} AND {x} < 0"}
    items = ", ".join(f"CASE WHEN {test[s].format(x=f, b=b)} THEN '{m}' END" for f, s, b, m in FACTOR_RULES)
    return f"list_filter([{items}], lambda m: m IS NOT NULL)"


@query("factor_f18_summary", with_ctes(
    "fx", f=f"SELECT code, trade_date, {_cols(SUMMARY)} FROM fx",
    l="SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY code ORDER BY trade_date DESC) = 1",
    n=f"SELECT code, trade_date, {_rules_sql()} AS notes FROM l")
    + "SELECT code, trade_date, CASE WHEN len(notes) > 0 THEN array_to_string(notes[1:5], '; ') ELSE 'neutral' END "
      "AS factor_summary FROM n")
def summary(t):
    df = newest_factors(t.bars(), t.market_bars(), names=list(SUMMARY))
    return factor_summary(df).select("code", "trade_date", "factor_summary")
