"""Cross-sectional evaluation of a score against a forward return.

Every measure is two-level: per date, then over dates. Dates are few (a calendar), so the second
level is small; the first level is a grouped aggregation with map-side combine or a per-date
rank (see ``cross_section`` for very large dates).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.cross_section import decile, group_quantiles, pct_rank


def safe_corr(x: str, y: str) -> Column:
    """Grouped correlation that is null for a constant side."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def ic_by_date(df: DataFrame, score: str, target: str, *, min_rows: int = 3, by: str | Sequence[str] = "trade_date") -> DataFrame:
    """Spearman correlation per date over rows where both sides are known. Dates with fewer rows
    than ``min_rows`` or a constant side are left out."""
    pairs = df.where(F.col(score).isNotNull() & F.col(target).isNotNull())
    keys = [by] if isinstance(by, str) else list(by)
    pairs = pairs.select(*keys, F.col(score).alias("__s"), F.col(target).alias("__t"))
    if len(keys) == 1:
        ranked = pct_rank(pairs, {"__s": "__rs", "__t": "__rt"}, keys[0])
    else:
        pairs = pairs.select(F.struct(*keys).alias("__key"), "__s", "__t")
        ranked = pct_rank(pairs, {"__s": "__rs", "__t": "__rt"}, "__key").select("__key.*", "__s", "__t", "__rs", "__rt")
    per = ranked.groupBy(*keys).agg(
        safe_corr("__rs", "__rt").alias("ic"), F.count("*").alias("n"),
        (F.min("__s") < F.max("__s")).alias("__vs"), (F.min("__t") < F.max("__t")).alias("__vt"))
    return per.where((F.col("n") >= min_rows) & F.col("__vs") & F.col("__vt") & F.col("ic").isNotNull()).select(
        *keys, "ic", "n")


def summarize_ic(ics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ics.groupBy(*by).agg(
        F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"),
        F.try_divide(F.avg("ic"), F.stddev_samp("ic")).alias("icir"),
        F.percentile("ic", F.lit(0.5)).alias("median"),
        # correlations of short cross-sections can be 0 up to summation order
        F.avg((F.col("ic") > 1e-12).cast("double")).alias("positive_rate"),
        F.count("*").alias("days"))


def ic_by_year(ics: DataFrame, date: str = "trade_date") -> DataFrame:
    return summarize_ic(ics.withColumn("year", F.year(date)), ["year"])


def ic_by_regime(df: DataFrame, flags: DataFrame, scores: Sequence[str], target: str, *, min_rows: int = 3) -> DataFrame:
    """IC of several scores on bull and bear dates; dates the index lacks are left out."""
    parts = []
    for s in scores:
        ics = ic_by_date(df, s, target, min_rows=min_rows)
        parts.append(summarize_ic(ics.join(flags.select("trade_date", "bull"), "trade_date"), ["bull"])
                     .withColumn("score", F.lit(s)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ic_extremes(ics: DataFrame, n: int = 5) -> DataFrame:
    """The n worst and n best dates."""
    worst = ics.orderBy("ic", "trade_date").limit(n).withColumn("side", F.lit("worst"))
    best = ics.orderBy(F.desc("ic"), "trade_date").limit(n).withColumn("side", F.lit("best"))
    return worst.unionByName(best)


def decile_profile(df: DataFrame, score: str, target: str, *, min_rows: int = 10, by: str = "trade_date") -> DataFrame:
    """Mean target per score decile: mean per (date, decile), then over dates; plus the excess
    over the mean of date means. Decile 0 holds the lowest scores."""
    known = df.where(F.col(score).isNotNull() & F.col(target).isNotNull()).select(by, "code", score, target)
    ok = known.groupBy(by).agg(F.count("*").alias("n"), (F.min(score) < F.max(score)).alias("varies"),
                               F.avg(target).alias("date_mean")).where((F.col("n") >= min_rows) & F.col("varies"))
    ranked = decile(known.join(F.broadcast(ok.select(by)), by, "left_semi"), score, by)  # one row per date
    # the date means travel as class -1, so one aggregation yields all levels
    means = ranked.groupBy(by, "decile").agg(F.avg(target).alias("m")).unionByName(
        ok.select(by, F.lit(-1).alias("decile"), F.col("date_mean").alias("m")))
    profile = means.groupBy("decile").agg(F.avg("m").alias("mean_return"), F.count("*").alias("dates"))
    universe = F.max(F.when(F.col("decile") == -1, F.col("mean_return"))).over(Window.partitionBy(F.lit(0)))
    return (profile.withColumn("universe_return", universe).where(F.col("decile") >= 0)
            .withColumn("excess_return", F.col("mean_return") - F.col("universe_return")))


def decile_spread(profile: DataFrame) -> DataFrame:
    def at(d: int) -> Column:
        return F.max(F.when(F.col("decile") == d, F.col("mean_return")))
    return profile.agg((at(9) - at(0)).alias("spread_9_minus_0"), F.max("universe_return").alias("universe_return"))


def topk_by_date(df: DataFrame, score: str, target: str, k: int, by: str = "trade_date") -> DataFrame:
    """Per date: mean target of the k best scores and of all rows; dates with fewer than k rows
    are left out. The top-k is cut before the shuffle (window group limit)."""
    order = Window.partitionBy(by).orderBy(F.desc(score), "code")
    top = (df.select(by, "code", score, target).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
           .groupBy(by).agg(F.avg(target).alias("top_return")))
    every = df.groupBy(by).agg(F.avg(target).alias("universe_return"), F.count("*").alias("n")).where(F.col("n") >= k)
    return every.join(top, by).withColumn("excess", F.col("top_return") - F.col("universe_return"))


def topk_excess(df: DataFrame, score: str, target: str, k: int, by: str = "trade_date") -> DataFrame:
    return topk_by_date(df, score, target, k, by).agg(
        F.avg("top_return").alias("top_return"), F.avg("universe_return").alias("universe_return"),
        F.avg("excess").alias("excess_return"), F.stddev_samp("excess").alias("excess_std"),
        # a date whose rows are all in the top has excess 0 up to summation order
        F.avg((F.col("excess") > 1e-12).cast("double")).alias("excess_positive_rate"),
        F.count("*").alias("period_count"))


def ndcg_by_date(df: DataFrame, score: str, gain: str, k: int, by: str = "trade_date") -> DataFrame:
    """NDCG@k with linear gain and log2 discount; rows of equal score share their mean gain.

    Tied rows are collapsed first: a tie group at places a+1..a+m contributes its mean gain
    times the discounts of those places, so no row order inside a tie is needed."""
    groups = df.groupBy(by, score).agg(F.count("*").alias("m"), F.sum(gain).alias("g"))
    ideal = df.groupBy(by, gain).agg(F.count("*").alias("m"))
    totals = df.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(by)

    def dcg(d: DataFrame, order: str, mean_gain: Column, name: str) -> DataFrame:
        upto = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
        placed = d.withColumn("end", F.sum("m").over(upto)).withColumn("begin", F.col("end") - F.col("m"))
        placed = placed.where(F.col("begin") < k).withColumn("mean_gain", mean_gain)
        weight = F.aggregate(F.sequence(F.col("begin") + 1, F.least(F.col("end"), F.lit(k).cast("bigint"))), F.lit(0.0),
                             lambda s, p: s + 1 / F.log2(p.cast("double") + 1))
        return placed.groupBy(by).agg(F.sum(F.col("mean_gain") * weight).alias(name))

    actual = dcg(groups, score, F.col("g") / F.col("m"), "dcg")
    best = dcg(ideal, gain, F.col(gain).cast("double"), "idcg")
    return (totals.join(actual, by).join(best, by)
            .select(by, F.coalesce(F.try_divide("dcg", "idcg"), F.lit(0.0)).alias("ndcg")))


QUANTILES = {"q10": 0.1, "q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
DISTRIBUTION = ("count", "mean", "std", "positive_rate", *QUANTILES)


def distribution(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Count, moments, share of positive values and exact quantiles of a column, per group or of the whole table.

    Quantiles come from counted value ranges (``group_quantiles``): no state grows with a group."""
    keys = list(by) or ["__all"]
    df = df if by else df.withColumn("__all", F.lit(0))
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.avg(F.when(F.col(value).isNotNull(), (F.col(value) > 0).cast("double"))).alias("positive_rate"))
    return moments.join(group_quantiles(df, value, QUANTILES, keys), keys, "left").select(*by, *DISTRIBUTION)


def event_study(df: DataFrame, event_cols: Sequence[str], target: str, by: str = "trade_date") -> DataFrame:
    """Per event class: rows, dates, codes and the distribution of the target and of its excess
    over the date mean, for rows where the class count is positive. ``df`` is read several times: store it."""
    means = df.groupBy(by).agg(F.avg(target).alias("__date_mean"))
    data = df.join(F.broadcast(means), by).withColumn("__excess", F.col(target) - F.col("__date_mean"))
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in event_cols)
    longs = data.select(by, "code", F.col(target).alias("ret"), F.col("__excess").alias("excess"),
                        F.expr(f"stack({len(event_cols)}, {pairs}) AS (event_class, hits)")).where(F.col("hits") > 0)
    base = longs.groupBy("event_class").agg(
        F.count("*").alias("rows"), F.count_distinct(by).alias("dates"), F.count_distinct("code").alias("codes"))
    dists = [distribution(longs, v, ["event_class"]).select("event_class", *[F.col(n).alias(f"{v}_{n}") for n in DISTRIBUTION])
             for v in ("ret", "excess")]
    return base.join(dists[0], "event_class").join(dists[1], "event_class")


def coverage(df: DataFrame, cols: Sequence[str], target: str, condition: str | None = None) -> DataFrame:
    """Share of rows where column and target are both known; with a condition, the share of all
    rows that also meet it."""
    pairs = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    cond = F.col(condition) > 0 if condition else F.lit(True)
    longs = df.select(F.col(target).alias("t"), cond.alias("meets"),
                      F.expr(f"stack({len(cols)}, {pairs}) AS (feature, value)"))
    known = F.col("value").isNotNull() & F.col("t").isNotNull()
    return longs.groupBy("feature").agg(
        F.count_if(known).alias("non_null_rows"),
        (F.count_if(known) / F.count("*")).alias("coverage"),
        (F.count_if(known & F.coalesce(F.col("meets"), F.lit(False))) / F.count("*")).alias("conditional_coverage"))


def unpivot_features(df: DataFrame, features: Sequence[str], target: str,
                     conditions: dict[str, str] | None = None) -> DataFrame:
    """Long form (feature, value, target, meets): one pass evaluates all features."""
    conditions = conditions or {}
    rows = ", ".join(
        f"'{c}', CAST(`{c}` AS DOUBLE), "
        + (f"coalesce(`{conditions[c]}` > 0, false)" if c in conditions else "true") for c in features)
    return df.select("trade_date", "code", F.col(target).alias("target"),
                     F.expr(f"stack({len(features)}, {rows}) AS (feature, value, meets)"))


def _scoped(df: DataFrame, features: Sequence[str], target: str, conditions: dict[str, str] | None) -> DataFrame:
    """Long form with ``scope``: every row counts for all, and again for conditional where its feature's condition holds."""
    longs = unpivot_features(df, features, target, conditions)
    return longs.withColumn("scope", F.explode(F.when(
        F.col("meets") & F.col("feature").isin(*(conditions or {"": ""})), F.array(F.lit("all"), F.lit("conditional")))
        .otherwise(F.array(F.lit("all")))))


def evaluate_features(df: DataFrame, features: Sequence[str], target: str, *, min_per_date: int = 30,
                      conditions: dict[str, str] | None = None) -> DataFrame:
    """IC summary per feature over all rows and, where a condition is named, over the rows that
    meet it (``scope``), with the share of the scope's rows where feature and target are known."""
    scopes = _scoped(df, features, target, conditions)
    ics = ic_by_date(scopes, "value", "target", min_rows=min_per_date, by=["feature", "scope", "trade_date"])
    known = F.col("value").isNotNull() & F.col("target").isNotNull()
    covered = scopes.groupBy("feature", "scope").agg(F.count_if(known).alias("known_rows"), (F.count_if(known) / F.count("*")).alias("coverage"))
    return covered.join(summarize_ic(ics, ["feature", "scope"]), ["feature", "scope"], "left")


def feature_deciles(df: DataFrame, features: Sequence[str], target: str, *, min_per_date: int = 30,
                    conditions: dict[str, str] | None = None) -> DataFrame:
    """Mean target per decile of each feature and scope: per date first, then over the dates with enough rows."""
    rows = _scoped(df, features, target, conditions).where(F.col("value").isNotNull() & F.col("target").isNotNull())
    rows = rows.select(F.struct("feature", "scope", "trade_date").alias("__key"), "code", "value", "target")
    ok = rows.groupBy("__key").agg(F.count("*").alias("n"), (F.min("value") < F.max("value")).alias("varies"))
    ok = F.broadcast(ok.where((F.col("n") >= min_per_date) & F.col("varies")).select("__key"))  # one row per feature, scope and date
    rows = rows.join(ok, "__key", "left_semi")
    per = decile(rows, "value", "__key").groupBy("__key", "decile").agg(F.avg("target").alias("m")).select("__key.*", "decile", "m")
    return per.groupBy("feature", "scope", "decile").agg(F.avg("m").alias("mean_return"), F.count("*").alias("dates"))


def panel_report(panel: DataFrame) -> DataFrame:
    """Rows, instruments, date span and instruments per date."""
    per_date = panel.groupBy("trade_date").agg(F.count_distinct("code").alias("codes"), F.count("*").alias("rows"))
    spread = per_date.agg(F.sum("rows").alias("rows"), F.min("trade_date").alias("date_start"),
                          F.max("trade_date").alias("date_end"), F.min("codes").alias("per_date_min_codes"),
                          F.percentile("codes", F.lit(0.5)).alias("per_date_median_codes"),
                          F.max("codes").alias("per_date_max_codes"))
    codes = panel.agg(F.count_distinct("code").alias("codes"))
    return spread.withColumn("k", F.lit(1)).join(codes.withColumn("k", F.lit(1)), "k").drop("k")


def non_overlapping(df: DataFrame, calendar: DataFrame, step: int) -> DataFrame:
    """Rows on every ``step``-th date."""
    return df.join(calendar.where(F.col("idx") % max(1, step) == 0).select("trade_date"), "trade_date", "left_semi")
