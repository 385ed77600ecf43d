"""Cross-sections: ranks, deciles, quantiles and z-scores among the rows of one date.

One plan serves dates of every size. Rows of dates up to ``GROUP_ROWS`` rows move once, to the task of their date, and
are ordered there. Larger dates are cut: equal values of a date are counted first (combined on the map side, so a value
that a third of the rows share is one row), the counts are cut into value ranges, the more the larger the date; each
range is ordered on its own, and the rows in the ranges below are added. Range bounds follow from the date's extremes
alone, so every evaluation of the plan sees the same ones, and nothing runs while a plan is built. The input is read
more than once: store a panel that is costly to compute. Rows without a date are in no cross-section: their results are
null. Tables of one row per date (or feature and date) are broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.numeric import finite

#: Distinct values of a group that make one range, on average.
RANGE_ROWS = 4096
#: Rows of a group that are ordered in one task; a larger group is cut into ranges.
GROUP_ROWS = 1 << 18
_LAST = 1 << 40


def _joined(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join with the row right has for the keys; a missing key has none."""
    return left.join(right, list(keys), "left").select(*left.columns, *[c for c in right.columns if c not in keys])


def _by_size(df: DataFrame, by: str, whole: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame],
             sizes: DataFrame | None = None) -> DataFrame:
    """``whole`` of the groups of up to GROUP_ROWS rows and ``cut`` of the larger ones and of rows without a group, as
    one table. The list of larger groups is short: each has more than GROUP_ROWS rows.

    With ``sizes`` (``by``, rows), counted on something narrower, df need not be stored: rows without a group stay with
    ``whole``, which knows them, and ``cut`` meets the list of larger groups in an inner join, so
    adaptive execution drops its branch before it reads df if the list is empty."""
    if sizes is not None:
        large = F.broadcast(sizes.where(F.col("rows") > GROUP_ROWS).select(by, F.lit(True).alias("__large")))
        rest = _joined(df, large, [by]).where(F.col("__large").isNull()).drop("__large")
        return whole(rest).unionByName(cut(df.join(large.drop("__large"), by).select(*df.columns)))
    large = df.groupBy(by).agg(F.count("*").alias("__m")).where(F.col("__m") > GROUP_ROWS).select(by, F.lit(True).alias("__large"))
    marked = _joined(df, F.broadcast(large), [by])
    small = F.col(by).isNotNull() & F.col("__large").isNull()
    return whole(marked.where(small).drop("__large")).unionByName(cut(marked.where(~small).drop("__large")))


def _spread(value: Column) -> Column:
    """Grows with the value (each step of it does, rounding included) and evens out magnitudes."""
    v = value.cast("double")
    return F.least(F.signum(v) * F.least(F.log1p(F.abs(v) * 1e6), F.lit(750.0)), F.lit(750.0))


def _range_no(place: Column, low: Column, high: Column, rows: Column) -> Column:
    """Number of the value range; missing places (not a number) come last."""
    share = F.coalesce(F.try_divide(place - low, high - low), F.lit(0.0))
    parts = F.ceil(rows / RANGE_ROWS)
    return F.when(F.isnan(place), F.lit(_LAST)).otherwise(F.least(F.floor(share * parts), parts - 1))


def _counted(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Distinct (keys, value, ties) with the count of smaller values (``below``) and of the group (``total``)."""
    for k in keys:  # the joins below would add this on one side only, and the sides could not share an exchange
        values = values.where(F.col(k).isNotNull())
    place = _spread(F.col(value))
    known = F.when(~F.isnan(F.col(value).cast("double")), place)
    extremes = values.groupBy(*keys).agg(F.min(known).alias("__lo"), F.max(known).alias("__hi"), F.count("*").alias("__m"), F.sum("ties").alias("total"))
    ranged = _joined(values, extremes, keys).withColumn("__range", _range_no(
        F.when(F.isnan(F.col(value).cast("double")), F.lit(float("nan"))).otherwise(place), F.col("__lo"), F.col("__hi"), F.col("__m"))).drop("__lo", "__hi", "__m")
    sizes = ranged.groupBy(*keys, "__range").agg(F.sum("ties").alias("__size"))
    before = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    sizes = sizes.select(*keys, "__range", before.alias("__before"))
    inside = F.sum("ties").over(Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) - F.col("ties")
    ranged = ranged.withColumn("__inside", inside)
    return _joined(ranged, sizes, [*keys, "__range"]).select(
        *keys, value, "ties", (F.col("__before") + F.col("__inside")).alias("below"), "total")


def _long(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """(keys, place of the column, known value), one row per cell."""
    cells = F.array(*[F.col(c).cast("double") for c in cols])
    return df.select(*keys, F.posexplode(cells).alias("feature", "value")).where(F.col("value").isNotNull())


def pct_rank(df: DataFrame, cols: Mapping[str, str] | Sequence[str], by: str = "trade_date") -> DataFrame:
    """Average rank over count, in (0, 1]. Missing values keep no rank. ``cols`` maps the
    source column to the new name (a plain list replaces the columns)."""
    names = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    return _by_size(df, by, lambda d: _rank_whole(d, names, by), lambda d: _rank_cut(d, names, by)) if names else df


def _rank_whole(df: DataFrame, names: Mapping[str, str], by: str) -> DataFrame:
    """One exchange by group; each column is ordered where its rows are, missing values last."""
    out = {}
    for i, (c, new) in enumerate(names.items()):
        order = Window.partitionBy(by).orderBy(F.col(c).asc_nulls_last())
        up_to = F.count("*").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # equal values included
        total = F.count(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        df = df.withColumn(f"__r{i}", F.when(F.col(c).isNotNull(), (F.rank().over(order) + up_to) / 2 / total))
        out[new] = F.col(f"__r{i}")
    return df.withColumns(out).drop(*[f"__r{i}" for i in range(len(names))])


def _rank_cut(df: DataFrame, names: Mapping[str, str], by: str) -> DataFrame:
    rank = (F.col("below") + (F.col("ties") + 1) / 2) / F.col("total")
    if len(names) == 1:
        (c, new), = names.items()
        values = df.where(F.col(c).isNotNull()).groupBy(by, F.col(c).alias("value")).agg(F.count("*").alias("ties"))
        ranks = _counted(values, [by]).select(by, F.col("value").alias(c), rank.alias("__rank"))
        return _joined(df, ranks, [by, c]).withColumn(new, F.col("__rank")).drop("__rank")
    # rows of equal values have equal ranks: 128 bits of hash stand for the values of a row
    keyed = df.withColumns({f"__h{i}": F.xxhash64(F.lit(i), *names) for i in (0, 1)})
    cells = _long(keyed, [by, "__h0", "__h1"], list(names))
    counted = _counted(cells.groupBy(by, "feature", "value").agg(F.count("*").alias("ties")), [by, "feature"])
    placed = _joined(cells, counted.select(by, "feature", "value", rank.alias("__rank")), [by, "feature", "value"])
    wide = placed.groupBy(by, "__h0", "__h1").agg(
        *[F.max(F.when(F.col("feature") == i, F.col("__rank"))).alias(f"__r{i}") for i in range(len(names))])
    out = _joined(keyed, wide, [by, "__h0", "__h1"])
    return out.withColumns({new: F.col(f"__r{i}") for i, new in enumerate(names.values())}).drop("__h0", "__h1", *[f"__r{i}" for i in range(len(names))])


def rank_centered(df: DataFrame, cols: Sequence[str], by: str = "trade_date", *, single_row_zero: bool = False) -> DataFrame:
    """Percentile rank minus one half, per date. A column that is not there becomes 0.
    ``single_row_zero`` is the scoring rule: a lone row cannot be ranked and gets 0."""
    have = [c for c in cols if c in df.columns]
    if single_row_zero:
        lone = df.groupBy(by).agg(F.count("*").alias("__n")).where(F.col("__n") <= 1).select(by, F.lit(True).alias("__lone"))
        df = _joined(df, F.broadcast(lone), [by])
    df = pct_rank(df, have, by)
    if single_row_zero:
        df = df.withColumns({c: F.when(F.col("__lone"), 0.0).otherwise(F.col(c) - 0.5) for c in have}).drop("__lone")
    else:
        df = df.withColumns({c: F.col(c) - 0.5 for c in have})
    return df.withColumns({c: F.lit(0.0) for c in cols if c not in have})


def _text_place(c: Column) -> Column:
    """Number that grows with the byte order of a text's first six characters."""
    return F.conv(F.rpad(F.hex(F.substring(c.cast("string"), 1, 6)), 12, "0"), 16, 10).cast("double")


def positions(df: DataFrame, col: str, by: str = "trade_date", tie: str = "code", *, name: str = "position",
              total: str = "group_rows") -> DataFrame:
    """1-based position of each row by (col, tie) and the number of ranked rows. Rows with a
    missing value get null.

    In a large group rows of one value are ordered by ``tie``, in ranges of the group's tie texts, so a value that many
    rows share is not ordered in one task."""
    def whole(d: DataFrame) -> DataFrame:
        known, order = F.col(col).isNotNull(), Window.partitionBy(by).orderBy(F.col(col).asc_nulls_last(), tie)
        count = F.count(col).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return d.withColumns({name: F.when(known, F.row_number().over(order).cast("long")), total: F.when(known, count)})

    return _by_size(df, by, whole, lambda d: _positions_cut(d, col, by, tie, name, total))


def _positions_cut(df: DataFrame, col: str, by: str, tie: str, name: str, total: str) -> DataFrame:
    placed = df.withColumn("__place", _text_place(F.col(tie)))
    known = placed.where(F.col(col).isNotNull())
    extremes = known.groupBy(by).agg(F.min("__place").alias("__lo"), F.max("__place").alias("__hi"), F.count("*").alias("__m"))
    share = F.coalesce(F.try_divide(F.col("__place") - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    parts = F.ceil(F.col("__m") / RANGE_ROWS)
    placed = _joined(placed, extremes, [by]).withColumn("__sub", F.least(F.floor(share * parts), parts - 1)).drop("__lo", "__hi", "__m")
    subs = placed.where(F.col(col).isNotNull()).groupBy(by, col, "__sub").agg(F.count("*").alias("__n"))
    counted = _counted(subs.groupBy(by, F.col(col).alias("value")).agg(F.sum("__n").alias("ties")), [by])
    counted = counted.select(by, F.col("value").alias(col), "below", F.col("total").alias("__total"))
    order = Window.partitionBy(by, col).orderBy("__sub").rowsBetween(Window.unboundedPreceding, 0)
    subs = subs.withColumn("__before", F.sum("__n").over(order) - F.col("__n")).drop("__n")
    lookup = _joined(subs, counted, [by, col]).select(by, col, "__sub", (F.col("below") + F.col("__before")).alias("__base"), "__total")
    inside = F.row_number().over(Window.partitionBy(by, col, "__sub").orderBy("__place", tie))
    return _joined(placed, lookup, [by, col, "__sub"]).withColumns({
        name: F.when(F.col(col).isNotNull(), F.col("__base") + inside), total: F.col("__total")}).drop("__base", "__total", "__sub", "__place")


def decile(df: DataFrame, col: str, by: str = "trade_date", name: str = "decile", *, tie: str = "code",
           method: str = "first") -> DataFrame:
    """Ten classes per date, floor(position / n * 10) capped at 9. ``first`` breaks ties by
    ``tie``; ``average`` gives tied rows the same class."""
    if method == "average":
        df = pct_rank(df, {col: "__pct"}, by)
        return df.withColumn(name, F.when(F.col("__pct").isNotNull(), F.least(F.lit(9), F.floor(F.col("__pct") * 10)).cast("int"))).drop("__pct")
    df = positions(df, col, by, tie, name="__pos", total="__n")
    return df.withColumn(
        name, F.when(F.col("__pos").isNotNull(),
                     F.least(F.lit(9), F.floor(F.col("__pos") * 10 / F.col("__n"))).cast("int"))
    ).drop("__pos", "__n")


def _quantiles(counted: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Linear interpolation between the values at the two places around p * (n - 1)."""
    aggs, out = [], []
    for n, p in probs.items():
        at = F.lit(float(p)) * (F.col("total") - 1)
        for side, idx in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            covers = (F.col("below") <= idx) & (idx < F.col("below") + F.col("ties"))
            aggs.append(F.max(F.when(covers, F.col("value"))).alias(f"{n}__{side}"))
        out.append((F.col(f"{n}__lo") + (at - F.floor(at)) * (F.col(f"{n}__hi") - F.col(f"{n}__lo"))).alias(n))
    return counted.groupBy(*keys).agg(F.max("total").alias("total"), *aggs).select(*keys, "total", *out)


def group_quantiles(df: DataFrame, col: str, probs: Mapping[str, float], by: str | Sequence[str] = "trade_date") -> DataFrame:
    """Exact quantiles per group with linear interpolation; ``by`` may be empty for the whole table. Rows are counted by
    value range, and only the ranges that hold a quantile are ordered."""
    keys = [by] if isinstance(by, str) else list(by)
    if not keys:
        return group_quantiles(df.withColumn("__all", F.lit(0)), col, probs, ["__all"]).drop("__all")
    rows = df.select(*keys, F.col(col).cast("double").alias("value")).where(F.col("value").isNotNull())
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    strange, place = F.isnan("value"), _spread(F.col("value"))
    extremes = rows.groupBy(*keys).agg(F.min(F.when(~strange, place)).alias("__lo"), F.max(F.when(~strange, place)).alias("__hi"), F.count("*").alias("total"))
    ranged = _joined(rows, F.broadcast(extremes), keys).withColumn("__range", _range_no(
        F.when(strange, F.lit(float("nan"))).otherwise(place), F.col("__lo"), F.col("__hi"), F.col("total")))
    sizes = ranged.groupBy(*keys, "__range").agg(F.count("*").alias("__size"), F.max("total").alias("__rows"))
    before = F.sum("__size").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size")
    places = [f(F.lit(float(p)) * (F.col("__rows") - 1)) for p in probs.values() for f in (F.floor, F.ceil)]
    held = [(F.col("__before") <= at) & (at < F.col("__before") + F.col("__size")) for at in places]
    wanted = sizes.withColumn("__before", before).where(reduce(or_, held)).select(*keys, "__range", "__before")
    # only the rows of ranges that hold a wanted place move: two per quantile at most
    values = ranged.join(F.broadcast(wanted), [*keys, "__range"]).groupBy(*keys, "__range", "value").agg(
        F.count("*").alias("ties"), F.max("__before").alias("__before"), F.max("total").alias("total"))
    inside = F.sum("ties").over(Window.partitionBy(*keys, "__range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ties")
    return _quantiles(values.withColumn("below", F.col("__before") + inside), keys, probs).drop("total")


def _z(c: str, low: Column, high: Column, mean: Column, std: Column) -> Column:
    flat = std.isNull() | (std <= F.abs(mean) * 1e-14)
    return F.when(F.col(c).isNull(), None).when(flat, 0.0).otherwise(F.try_divide(_clipped(c, low, high) - mean, std))


def _clipped(c: str, low: Column, high: Column) -> Column:
    return F.greatest(F.least(F.col(c), high), low)


def winsor_z(df: DataFrame, cols: Sequence[str], by: str = "trade_date", low: float = 0.01, high: float = 0.99,
             sizes: DataFrame | None = None) -> DataFrame:
    """Clip to the group's 1 % and 99 % quantiles, then z-score; no spread gives 0. All columns share one pass.
    ``sizes`` (``by``, rows): df need not be stored."""
    return _by_size(df, by, lambda d: _winsor_whole(d, cols, by, low, high), lambda d: _winsor_cut(d, cols, by, low, high), sizes)


def _winsor_whole(df: DataFrame, cols: Sequence[str], by: str, low: float, high: float) -> DataFrame:
    """Edges, then moments of the clipped values, of one group after the other: the rows move once."""
    group, n = Window.partitionBy(by), range(len(cols))
    df = df.withColumns({f"__q{i}": F.percentile(F.col(c).cast("double"), F.array(F.lit(low), F.lit(high))).over(group) for i, c in enumerate(cols)})
    kept = {f"__c{i}": F.when(F.col(c).isNotNull(), _clipped(c, F.col(f"__q{i}")[0], F.col(f"__q{i}")[1])) for i, c in enumerate(cols)}
    df = df.withColumns(kept)
    df = df.withColumns({f"__{k}{i}": f(f"__c{i}").over(group) for i in n for k, f in (("m", F.avg), ("s", F.stddev_samp))})
    known = F.col(by).isNotNull()
    stats = {c: (F.col(f"__q{i}")[0], F.col(f"__q{i}")[1], F.col(f"__m{i}"), F.col(f"__s{i}")) for i, c in enumerate(cols)}
    out = {c: _z(c, *[F.when(known, x) for x in at]) for c, at in stats.items()}  # rows without a group have no spread
    return df.withColumns(out).drop(*[f"__{k}{i}" for i in n for k in "qcms"])


def _winsor_cut(df: DataFrame, cols: Sequence[str], by: str, low: float, high: float) -> DataFrame:
    """The moments come from the counted values, as distances to the lower edge."""
    values = _long(df, [by], list(cols)).groupBy(by, "feature", "value").agg(F.count("*").alias("ties"))
    counted = _counted(values, [by, "feature"])
    edges = _quantiles(counted, [by, "feature"], {"lo": low, "hi": high}).drop("total")
    apart = F.greatest(F.least(F.col("value"), F.col("hi")), F.col("lo")) - F.col("lo")
    moments = _joined(counted, edges, [by, "feature"]).groupBy(by, "feature").agg(
        F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("ties").alias("n"), F.sum(F.col("ties") * apart).alias("s1"), F.sum(F.col("ties") * apart * apart).alias("s2"))
    var = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0))
    moments = moments.select(by, "feature", F.struct("lo", "hi", (F.col("lo") + F.col("s1") / F.col("n")).alias("mean"),
                                                     F.sqrt(F.try_divide(var, F.col("n") - 1)).alias("std")).alias("m"))
    wide = moments.groupBy(by).agg(*[F.max(F.when(F.col("feature") == i, F.col("m"))).alias(f"__m{i}") for i in range(len(cols))])

    edges = {c: [F.col(f"__m{i}.{k}") for k in ("lo", "hi", "mean", "std")] for i, c in enumerate(cols)}
    return _joined(df, wide, [by]).withColumns({c: _z(c, *e) for c, e in edges.items()}).drop(*[f"__m{i}" for i in range(len(cols))])


def composite_score(df: DataFrame, signs: Mapping[str, int], name: str = "score", by: str = "trade_date",
                    sizes: DataFrame | None = None) -> DataFrame:
    """Mean over factors of sign times winsorised z; missing factors are left out of the mean. ``sizes`` (``by``, rows):
    df need not be stored."""
    raw = {f"__raw_{c}": F.col(c) for c in signs}
    z = winsor_z(df.withColumns(raw), list(signs), by, sizes=sizes)
    parts = [F.col(c) * F.lit(float(s)) for c, s in signs.items()]
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    present = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return z.withColumn(name, F.try_divide(total, present)).withColumns(
        {c: F.col(f"__raw_{c}") for c in signs}).drop(*raw)


def regime_switched(bull: Column, universal: Column, bear: Column) -> Column:
    """Bear score on bear dates, universal score otherwise (also where the flag is missing)."""
    return F.when(F.coalesce(bull, F.lit(True)), universal).otherwise(bear)


def display_percentile(df: DataFrame, score: str, by: str | None = None, tie: str = "code") -> DataFrame:
    """Score place on a 0-9 scale and as a top percentage, among all rows or per group."""
    key = by or "__all"
    base = df if by else df.withColumn(key, F.lit(0))
    ranked = positions(base, score, key, tie)
    place = F.try_divide(F.col("position") - 1, F.greatest(F.lit(1), F.col("group_rows") - 1).cast("double"))
    ranked = ranked.withColumns({
        "display_score": place * 9,
        "top_pct": F.greatest(F.lit(1), F.floor((1 - place) * 100).cast("int")),
    }).drop("position", "group_rows")
    return ranked if by else ranked.drop(key)


def with_date_mean(df: DataFrame, col: str, name: str, by: str = "trade_date") -> DataFrame:
    """Group mean on every row: aggregated first (map-side), then joined back."""
    return df.join(df.groupBy(by).agg(F.avg(col).alias(name)), by, "left")


def leaders(df: DataFrame, *, ret: str = "ret", volz: str | None = "volz", min_ret: float = 0.04, min_volz: float = 1.0,
            top: int = 8, by: str = "trade_date", tie: str = "code") -> DataFrame:
    """Strongest movers per date, best first (``leader_rank``). ``volz=None`` drops the volume test."""
    picked = df.where(F.col(ret) >= min_ret)
    if volz:
        picked = picked.where(F.col(volz) >= min_volz)
    order = Window.partitionBy(by).orderBy(F.desc(ret), tie)
    return picked.withColumn("leader_rank", F.row_number().over(order)).where(F.col("leader_rank") <= top)


def extreme_factors(df: DataFrame, names: Sequence[str], top: int = 5, key: str = "code") -> DataFrame:
    """Largest and smallest ``top`` z-scores per instrument: z over all rows of each factor, to nine decimals, so that
    factors that measure the same tie and are ordered by name."""
    moments = df.agg(F.array(*[F.struct(F.avg(n).alias("m"), F.nullif(F.stddev_samp(n), F.lit(0.0)).alias("s")) for n in names]).alias("__moments"))
    df = df.select(key, F.array(*names).alias("__values")).join(F.broadcast(moments))  # one row
    z = F.zip_with("__values", "__moments", lambda v, m: F.round(F.coalesce(finite(F.try_divide(v - m["m"], m["s"])), F.lit(0.0)), 9))
    df = df.withColumn("__z", z).withColumn("__names", F.array(*[F.lit(n) for n in names]))

    def side(sign: float) -> Column:
        items = F.zip_with("__z", "__names", lambda z, n: F.struct((z * sign).alias("order"), n.alias("factor"), z.alias("z")))
        return F.transform(F.slice(F.sort_array(items), 1, top), lambda e: F.struct(e["factor"].alias("factor"), e["z"].alias("z")))

    return df.select(key, side(-1.0).alias("top"), side(1.0).alias("bottom"))
