"""The rolling factor frame: 4 price ratios, 9 candle shapes and 41 families over 7 windows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import EPS, finite_or
from barloom.operators.rolling import RollingBlocks, rows_window

# Window lengths, family names and the named factor subsets.
WINDOWS = (5, 10, 20, 30, 60, 120, 250)
PRICE_RATIOS = ("OPEN0", "HIGH0", "LOW0", "VWAP0")
CANDLE_SHAPES = ("KMID", "KLEN", "KMID2", "KUP", "KUP2", "KLOW", "KLOW2", "KSFT", "KSFT2")
FAMILIES = (
    "ROC", "MA", "STD", "BETA", "RSQR", "RESI", "MAX", "MIN", "QTLU", "QTLD",
    "RANK", "RSV", "IMAX", "IMIN", "IMXD", "CORR", "CORD", "CNTP", "CNTN", "CNTD",
    "SUMP", "SUMN", "SUMD", "VMA", "VSTD", "WVMA", "VSUMP", "VSUMN", "VSUMD", "RET",
    "MOM", "DD", "UPR", "DNR", "SHARPE", "VOLZ", "TURN", "AMTMA", "ILLIQ", "PVCHG", "RELV",
)
ROBUST = (
    "RET20", "RET30", "RET60", "RELV20", "RELV30", "RELV60", "ROC20", "ROC30", "ROC60",
    "QTLD20", "QTLD30", "QTLD60", "QTLU60", "QTLU120", "MA20", "MA30", "MA60", "IMIN30",
    "TURN120", "TURN250", "VOLZ120", "VOLZ250", "AMTMA60", "AMTMA120", "AMTMA250",
    "VMA120", "VMA250", "VSUMN60", "VSUMN120", "CORD60", "RESI10", "WVMA20",
)
BEAR_EXTRA = ("ILLIQ20", "ILLIQ60", "ILLIQ120", "DD60", "DD120", "MAX60", "IMIN60", "QTLD120")
BULL = (
    "MA20", "MA30", "MA60", "QTLD20", "QTLD30", "QTLD60", "QTLU60", "QTLU120", "IMIN30",
    "ILLIQ20", "ILLIQ60", "TURN120", "TURN250", "AMTMA120", "AMTMA250", "VMA120",
    "VMA250", "VSUMN60",
)
STABLE_PREFIXES = ("STD", "BETA", "RSQR", "CORR", "VMA", "WVMA", "TURN", "VOLZ", "MOM", "SHARPE")
# Sign of each robust factor in the composite score, -1 where a high value speaks for a low forward return.
COMPOSITE_SIGNS = {
    "RET20": -1, "RET30": -1, "RET60": -1, "RELV20": -1, "RELV30": -1, "RELV60": -1,
    "ROC20": 1, "ROC30": 1, "ROC60": 1, "QTLD20": 1, "QTLD30": 1, "QTLD60": 1,
    "QTLU60": 1, "QTLU120": 1, "MA20": 1, "MA30": 1, "MA60": 1, "IMIN30": 1,
    "TURN120": -1, "TURN250": -1, "VOLZ120": -1, "VOLZ250": -1, "AMTMA60": 1, "AMTMA120": 1, "AMTMA250": 1,
    "VMA120": 1, "VMA250": 1, "VSUMN60": 1, "VSUMN120": 1, "CORD60": -1, "RESI10": -1, "WVMA20": -1,
}

BEAR = ROBUST + BEAR_EXTRA

_CUSTOM: dict[str, Callable[[dict[str, Column]], Column]] = {}


def factor_names(windows: Iterable[int] = WINDOWS) -> list[str]:
    return [*PRICE_RATIOS, *CANDLE_SHAPES, *(f"{f}{w}" for w in windows for f in FAMILIES)]


def feature_set(kind: str, available: Iterable[str], extra: Sequence[str] = ()) -> list[str]:
    """Named subset, restricted to the columns at hand. Unknown names mean ``robust``."""
    have = set(available)
    names: Iterable[str]
    if kind == "all":
        names = [*factor_names(), *extra]
    elif kind == "stable":
        names = [n for n in factor_names() if n.startswith(STABLE_PREFIXES)] + list(extra)
    else:
        names = {"bear": BEAR, "bull": BULL}.get(kind, ROBUST)
    return [n for n in names if n in have]


def register_factor(name: str, make: Callable[[dict[str, Column]], Column]) -> None:
    """Add a factor of one's own: a function from the bar columns to a Column."""
    _CUSTOM[name] = make


def clean_bars(bars: DataFrame) -> DataFrame:
    """Numeric bars: unreadable values become null, a column that is not there becomes 0."""
    have = set(bars.columns)
    return bars.withColumns({
        c: F.col(c).try_cast("double") if c in have else F.lit(0.0)
        for c in ("open", "high", "low", "close", "volume", "amount")
    })


def market_returns(market: DataFrame, fill: str = "pad") -> DataFrame:
    """Index returns on the index's own calendar (one row per date, so a small input)."""
    return daily_return(market.withColumn("index_id", F.lit(0)), by="index_id", fill=fill).select(
        "trade_date", F.col("ret").alias("market_ret"))


def daily_return(bars: DataFrame, by: str = "code", fill: str = "pad", price: str = "close") -> DataFrame:
    """Adds ``ret``. ``pad`` measures against the last known price, ``none`` against the
    previous row."""
    frame = rows_window(by)
    if fill == "pad":
        past = F.last(price, ignorenulls=True).over(frame.rowsBetween(Window.unboundedPreceding, -1))
        now = F.coalesce(F.col(price), F.col("__past"))
    else:
        past, now = F.lag(price).over(frame), F.col(price)
    return (bars.withColumn("__past", past)
            .withColumn("ret", F.try_divide(now, F.col("__past")) - 1)
            .drop("__past"))


def align_market(bars: DataFrame, market: DataFrame | None, fill: str = "pad") -> DataFrame:
    """Market return on each bar's date, carried forward over dates the index lacks, else 0."""
    if market is None:
        return bars.withColumn("market_ret", F.lit(0.0))
    frame = rows_window().rowsBetween(Window.unboundedPreceding, 0)
    joined = bars.join(F.broadcast(market_returns(market, fill)), "trade_date", "left")  # one row per date
    return joined.withColumn(
        "market_ret", F.coalesce(F.last("market_ret", ignorenulls=True).over(frame), F.lit(0.0)))


def _base_series(bars: DataFrame, fill: str) -> DataFrame:
    frame = rows_window()
    before = frame.rowsBetween(Window.unboundedPreceding, -1)
    padded = fill == "pad"
    df = bars.withColumns({
        "c": F.nullif("close", F.lit(0.0)),
        "lv": F.ln(F.nullif("volume", F.lit(0.0))),
    }).withColumns({
        "row_no": F.row_number().over(frame),
        "c1": F.lag("c").over(frame),
        "lv1": F.lag("lv").over(frame),
        "v1": F.lag("volume").over(frame),
        "c_past": F.last("c", ignorenulls=True).over(before) if padded else F.lag("c").over(frame),
        "v_past": F.last("volume", ignorenulls=True).over(before) if padded else F.lag("volume").over(frame),
    })
    now_c, now_v = ("coalesce(c, c_past)", "coalesce(volume, v_past)") if padded else ("c", "volume")
    df = df.withColumns({
        "ret": F.expr(f"try_divide({now_c}, c_past) - 1"),
        "vp": F.expr(f"try_divide({now_v}, v_past) - 1"),
        "dc": F.expr("c - c1"),
        "dlv": F.expr("lv - lv1"),
        "dv": F.expr("volume - v1"),
        "cv": F.expr("c * volume"),
    })
    return df.withColumns({
        "up": F.expr("CASE WHEN ret > 0 THEN 1D ELSE 0D END"),
        "down": F.expr("CASE WHEN ret < 0 THEN 1D ELSE 0D END"),
        "gain": F.expr("CASE WHEN ret IS NOT NULL THEN greatest(ret, 0D) END"),
        "loss": F.expr("CASE WHEN ret IS NOT NULL THEN greatest(-ret, 0D) END"),
        "aret": F.expr("abs(ret)"),
        "vgain": F.expr("CASE WHEN dv IS NOT NULL THEN greatest(dv, 0D) END"),
        "vloss": F.expr("CASE WHEN dv IS NOT NULL THEN greatest(-dv, 0D) END"),
        "rel": F.expr("ret - market_ret"),
    })


def _candle_formulas() -> dict[str, str]:
    rng = "(nullif(high - low, 0D) + " + EPS + ")"
    o = "nullif(open, 0D)"
    top = f"CASE WHEN {o} IS NOT NULL AND c IS NOT NULL THEN greatest({o}, c) END"
    bottom = f"CASE WHEN {o} IS NOT NULL AND c IS NOT NULL THEN least({o}, c) END"
    vwap = "CASE WHEN amount > 0 THEN try_divide(amount, volume) ELSE (high + low + c) / 3D END"
    body, upper, lower, shift = f"(c - {o})", f"(high - {top})", f"({bottom} - low)", "(2D * c - high - low)"
    per_open = {"KMID": body, "KLEN": "(high - low)", "KUP": upper, "KLOW": lower, "KSFT": shift}
    per_range = {"KMID2": body, "KUP2": upper, "KLOW2": lower, "KSFT2": shift}
    return {
        "OPEN0": "try_divide(open, c)", "HIGH0": "try_divide(high, c)", "LOW0": "try_divide(low, c)",
        "VWAP0": f"try_divide({vwap}, c)",
        **{k: f"try_divide({v}, {o})" for k, v in per_open.items()},
        **{k: f"try_divide({v}, {rng})" for k, v in per_range.items()},
    }


def _quantile(w: int, p: float) -> str:
    pos = p * (w - 1)
    low = int(pos + 1e-9)
    part = pos - low
    if part < 1e-9:
        return f"sorted{w}[{low}]"
    return f"(sorted{w}[{low}] + {part!r}D * (sorted{w}[{low + 1}] - sorted{w}[{low}]))"


def _ranked_formula(family: str, w: int) -> str:
    if family in ("QTLU", "QTLD"):
        return f"try_divide({_quantile(w, 0.8 if family == 'QTLU' else 0.2)}, c)"
    below = f"(array_position(sorted{w}, c) - 1)"
    above = f"(array_position(reverse(sorted{w}), c) - 1)"
    return f"({below} + ({w} - {below} - {above} + 1) / 2D) / {w}D"


def _beta(blocks: RollingBlocks, w: int) -> str:
    return (f"try_divide({blocks.ref('p', 'ret~market_ret', w)} / {w - 1}D, "
            f"{blocks.ref('q', 'market_ret', w)} / {w - 1}D + {EPS})")


def _family_formula(blocks: RollingBlocks, family: str, w: int) -> str:
    def mean(x: str) -> str:
        return blocks.ref("a", x, w)

    def std(x: str) -> str:
        return f"sqrt({blocks.ref('q', x, w)} / {w - 1}D)"

    def total(x: str) -> str:
        return blocks.ref("s", x, w)

    def corr(x: str, y: str) -> str:
        return (f"try_divide({blocks.ref('p', f'{x}~{y}', w)}, "
                f"sqrt({blocks.ref('q', x, w)}) * sqrt({blocks.ref('q', y, w)}))")

    def share(x: str, y: str) -> str:
        return f"try_divide({total(x)}, {total(x)} + {total(y)} + {EPS})"

    def first_hit(kind: str, x: str) -> str:
        return f"({blocks.ref(kind, x, w)} - row_no + {w}) / {w}D"

    def mom() -> str:
        return f"try_divide({mean('ret')}, {std('ret')} + {EPS})"

    makers = {
        "MA": lambda: f"try_divide({mean('c')}, c)",
        "STD": lambda: f"try_divide({std('c')}, c)",
        "BETA": lambda: _beta(blocks, w),
        "RSQR": lambda: f"pow({corr('ret', 'market_ret')}, 2)",
        "MAX": lambda: f"try_divide({blocks.ref('x', 'high', w)}, c)",
        "MIN": lambda: f"try_divide({blocks.ref('n', 'low', w)}, c)",
        "RSV": lambda: (f"try_divide(c - {blocks.ref('n', 'c', w)}, "
                        f"{blocks.ref('x', 'c', w)} - {blocks.ref('n', 'c', w)} + {EPS})"),
        "IMAX": lambda: first_hit("xi", "high"),
        "IMIN": lambda: first_hit("ni", "low"),
        "IMXD": lambda: f"{first_hit('xi', 'high')} - {first_hit('ni', 'low')}",
        "CORR": lambda: corr("c", "lv"),
        "CORD": lambda: corr("dc", "dlv"),
        "CNTP": lambda: f"{total('up')} / {w}D",
        "CNTN": lambda: f"{total('down')} / {w}D",
        "CNTD": lambda: f"{total('up')} / {w}D - {total('down')} / {w}D",
        "SUMP": lambda: share("gain", "loss"),
        "SUMN": lambda: share("loss", "gain"),
        "SUMD": lambda: f"{share('gain', 'loss')} - {share('loss', 'gain')}",
        "VMA": lambda: f"try_divide({mean('volume')}, volume)",
        "VSTD": lambda: f"try_divide({std('volume')}, volume)",
        "WVMA": lambda: f"try_divide({std('cv')}, {mean('cv')} + {EPS})",
        "VSUMP": lambda: share("vgain", "vloss"),
        "VSUMN": lambda: share("vloss", "vgain"),
        "VSUMD": lambda: f"{share('vgain', 'vloss')} - {share('vloss', 'vgain')}",
        "MOM": mom,
        "SHARPE": lambda: f"{mom()} * sqrt(252D)",
        "DD": lambda: f"try_divide(c, {blocks.ref('x', 'c', w)} + {EPS}) - 1",
        "UPR": lambda: f"try_divide({total('up')}, {total('down')} + {EPS})",
        "DNR": lambda: f"{total('down')} / {w}D",
        "VOLZ": lambda: f"try_divide(volume - {mean('volume')}, {std('volume')} + {EPS})",
        "TURN": lambda: f"try_divide(volume, {mean('volume')} + {EPS})",
        "AMTMA": lambda: f"try_divide({mean('cv')}, cv + {EPS})",
        "ILLIQ": lambda: f"try_divide({total('aret')} / {w}D, {mean('cv')} + {EPS})",
        "PVCHG": lambda: corr("ret", "vp"),
        "RELV": lambda: total("rel"),
    }
    return makers[family]()


# Which rolling states each family reads.
_NEEDS: dict[str, dict[str, list]] = {
    "MA": {"means": ["c"]}, "STD": {"means": ["c"]},
    "BETA": {"means": ["ret", "market_ret"], "pairs": [("ret", "market_ret")]},
    "RSQR": {"means": ["ret", "market_ret"], "pairs": [("ret", "market_ret")]},
    "RESI": {"means": ["ret", "market_ret"], "pairs": [("ret", "market_ret")]},
    "MAX": {"highs": ["high"]}, "MIN": {"lows": ["low"]},
    "QTLU": {}, "QTLD": {}, "RANK": {},
    "RSV": {"highs": ["c"], "lows": ["c"]},
    "IMAX": {"highs": ["high"]}, "IMIN": {"lows": ["low"]}, "IMXD": {"highs": ["high"], "lows": ["low"]},
    "CORR": {"means": ["c", "lv"], "pairs": [("c", "lv")]},
    "CORD": {"means": ["dc", "dlv"], "pairs": [("dc", "dlv")]},
    "CNTP": {"sums": ["up"]}, "CNTN": {"sums": ["down"]}, "CNTD": {"sums": ["up", "down"]},
    "SUMP": {"sums": ["gain", "loss"]}, "SUMN": {"sums": ["gain", "loss"]}, "SUMD": {"sums": ["gain", "loss"]},
    "VMA": {"means": ["volume"]}, "VSTD": {"means": ["volume"]}, "WVMA": {"means": ["cv"]},
    "VSUMP": {"sums": ["vgain", "vloss"]}, "VSUMN": {"sums": ["vgain", "vloss"]},
    "VSUMD": {"sums": ["vgain", "vloss"]},
    "MOM": {"means": ["ret"]}, "SHARPE": {"means": ["ret"]}, "DD": {"highs": ["c"]},
    "UPR": {"sums": ["up", "down"]}, "DNR": {"sums": ["down"]},
    "VOLZ": {"means": ["volume"]}, "TURN": {"means": ["volume"]}, "AMTMA": {"means": ["cv"]},
    "ILLIQ": {"means": ["cv"], "sums": ["aret"]},
    "PVCHG": {"means": ["ret", "vp"], "pairs": [("ret", "vp")]},
    "RELV": {"sums": ["rel"]}, "ROC": {}, "RET": {},
}
_RANKED = ("QTLU", "QTLD", "RANK")
_LATE = ("RESI", *_RANKED)
# Families that read the means alone, not the squared deviations.
_MEANS_ONLY = ("MA", "VMA", "TURN", "AMTMA", "ILLIQ")


def _ladder(windows: Iterable[int]) -> list[int]:
    """The standard ladder up to the longest window asked for, plus the windows themselves."""
    longest = max(windows)
    return sorted({w for w in WINDOWS if w <= longest} | set(windows))


def factor_frame(bars: DataFrame, market: DataFrame | None = None, *, names: Sequence[str] | None = None,
                 windows: Sequence[int] = WINDOWS, fill: str = "pad", zero_fill: bool = True,
                 keep: Sequence[str] = (), only: str | None = None, few: bool = False) -> DataFrame:
    """Factors per (code, trade_date). ``names`` limits the output (and the work);
    ``zero_fill=False`` keeps null for windows that are not full. One exchange on ``code``.
    ``only`` names a boolean column of the bars: other rows feed the windows and are not returned. ``few``:
    they are few, so formulas are kept from the others, at the price that formulas do not share their parts.
    """
    names = list(names) if names is not None else [*factor_names(windows), *_CUSTOM]
    rolled = {n: (f, w) for w in windows for f in FAMILIES if (n := f"{f}{w}") in set(names)}
    frame = rows_window()
    df = _base_series(align_market(clean_bars(bars), market, fill), fill)

    def wanted(value: str) -> str:
        return f"CASE WHEN `{only}` THEN {value} END" if only and few else value

    out: dict[str, Column] = {n: F.expr(f) for n, f in _candle_formulas().items() if n in names}
    columns = {c: F.col(c) for c in ("open", "high", "low", "close", "volume", "amount", "ret", "market_ret")}
    out |= {n: make(columns) for n, make in _CUSTOM.items() if n in names}

    need: dict[str, list] = {"means": [], "pairs": [], "sums": [], "highs": [], "lows": []}
    for family, _ in rolled.values():
        for kind, series in _NEEDS[family].items():
            need[kind] += [s for s in series if s not in need[kind]]
    if any(need.values()):
        spread = {s for f, _ in rolled.values() if f not in _MEANS_ONLY for s in _NEEDS[f].get("means", ())}
        blocks = RollingBlocks(**need, spreads=[s for s in need["means"] if s in spread])
        in_level = {n: (f, w) for n, (f, w) in rolled.items() if f in _NEEDS and _NEEDS[f] and f not in _LATE}

        def finish_level(level: DataFrame, w: int) -> DataFrame:
            """Pack the level's factors into one array column before the next window node."""
            here = [n for n, (_, v) in in_level.items() if v == w]
            added = {}
            if here:
                added[f"made{w}"] = F.expr(wanted(
                    "array(" + ", ".join(_family_formula(blocks, rolled[n][0], w) for n in here) + ")"))
                for place, n in enumerate(here):
                    out[n] = F.expr(f"made{w}[{place}]")
            if (("RESI", w)) in rolled.values():
                added[f"resid{w}"] = F.expr(f"ret - {_beta(blocks, w)} * market_ret")
            return level.withColumns(added) if added else level

        df = blocks.add(df, _ladder(w for _, w in rolled.values()), after_level=finish_level)

    resid = sorted({w for f, w in rolled.values() if f == "RESI"})
    if resid:
        second_pass = RollingBlocks(means=[f"resid{w}" for w in resid], upto={f"resid{w}": w for w in resid})

        def finish_resid(level: DataFrame, w: int) -> DataFrame:
            if w not in resid:
                return level
            spread = second_pass.ref("q", f"resid{w}", w)
            return level.withColumn(f"resi{w}", F.expr(f"sqrt({spread} / {w - 1}D)"))

        df = second_pass.add(df, _ladder(resid), after_level=finish_resid)
        out |= {f"RESI{w}": F.col(f"resi{w}") for w in resid}

    late: dict[str, Column] = {}
    for n, (family, w) in rolled.items():
        if family in ("ROC", "RET"):
            late[f"ago{w}"] = F.lag("c", w).over(frame)
            out[n] = F.expr(f"try_divide(ago{w}, c)" if family == "ROC" else f"try_divide(c, ago{w}) - 1")
    ranked = sorted({w for f, w in rolled.values() if f in _RANKED})
    if ranked:
        late["recent"] = F.collect_list("c").over(frame.rowsBetween(-(max(ranked) - 1), 0))
        gap = F.last(F.when(F.col("c").isNull(), F.col("row_no")), ignorenulls=True).over(frame.rowsBetween(Window.unboundedPreceding, 0))
        late["run"] = F.col("row_no") - F.coalesce(gap, F.lit(0))  # rows with a price up to here, without a gap
    if late:
        df = df.withColumns(late)
    if only:
        df = df.where(F.col(only))
    if ranked:
        df = df.withColumns({
            f"sorted{w}": F.expr(f"CASE WHEN run >= {w} THEN sort_array(slice(recent, -{w}, {w})) END")
            for w in ranked}).drop("recent", "run")
        out |= {n: F.expr(_ranked_formula(f, w)) for n, (f, w) in rolled.items() if f in _RANKED}

    carried = ["code", "trade_date", *[k for k in keep if k not in ("code", "trade_date")]]
    df = df.select(*carried, *[out[n].alias(n) for n in names if n in out])
    if not zero_fill:
        return df
    return df.select(*carried, *[finite_or(n).alias(n) for n in names if n in out])


def newest_factors(bars: DataFrame, market: DataFrame | None = None, *, keep: Sequence[str] = (), **options) -> DataFrame:
    """``latest_factors`` of ``factor_frame``: older rows feed the windows only. The newest row of a code without any
    date holds nothing."""
    place = rows_window()
    every = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = bars.withColumn("__newest", F.row_number().over(place) == F.count("*").over(every))
    df = factor_frame(marked, market, keep=keep, only="__newest", few=True, **options)
    dated = F.col("trade_date").isNotNull()
    return df.select("code", "trade_date", *[F.when(dated, F.col(c)).alias(c) for c in df.columns if c not in ("code", "trade_date")])


def latest_factors(factors: DataFrame) -> DataFrame:
    """Newest factor row per instrument (map-side combined, no sort)."""
    rest = [c for c in factors.columns if c != "code"]
    return (factors.groupBy("code")
            .agg(F.max_by(F.struct(*rest), "trade_date").alias("row"))
            .select("code", "row.*"))
