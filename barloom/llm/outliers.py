"""Quality rules and robust multivariate outliers, in DataFrame functions only.

Each text becomes a few counts and these a vector of logarithms. Per language and source, concentration steps estimate
the minimum covariance determinant: of the rows the nearer part H by Mahalanobis distance gives the next centre and
covariance. A row far from the final estimate is rejected. Small groups use the estimate of their language, or of all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT = 10, 20
#: Share of rows in the estimate, concentration steps, and rows that a group needs.
H, STEPS, MIN_GROUP = 0.75, 6, 200
#: Quantiles of chi-square with five degrees of freedom: the median, and 99.9 %, the squared distance of rejection.
MEDIAN_CHI2_5, CUTOFF = 4.351, 20.515
#: Smallest standard deviation per statistic, near what one count makes of it: a symbol in 1,000 characters, a line in 200
#: words, a passage of five words twice in 1,000 words. Keeps estimates regular where nearly all rows hold the same value.
FLOORS = {"x0": 0.05, "x1": 0.5, "x2": 0.1, "x3": 0.4, "x4": 0.7}
NONE = "(none)"


def repeat_words(words: Column) -> dict[str, Column]:
    """Columns to add in turn to a frame with ``words``; the last, n_repeat_words, counts the words in windows of five
    that occur twice or more in the text."""
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW),
                          lambda i: F.xxhash64(*[F.get("hashed", i + k) for k in range(WINDOW)]))
    sorted_ = F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def twice(x: Column, j: Column) -> Column:
        same = lambda k: F.coalesce(F.when(k >= 0, F.get("by_window", k))["w"] == x["w"], F.lit(False))
        return F.when(same(j - 1) | same(j + 1), x["i"])

    gaps = F.transform("places", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("places", j + 1) - p, F.lit(WINDOW))))
    return {
        "hashed": F.transform(words, lambda w: F.xxhash64(w)),
        "windows": F.when(F.size("words") >= WINDOW, windows),
        "by_window": F.when(F.size(F.array_distinct("windows")) < F.size("windows"), sorted_),
        "places": F.sort_array(F.filter(F.transform("by_window", twice), lambda p: p.isNotNull())),
        "n_repeat_words": F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long"),
    }


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of whole texts.

    Words are runs outside 0x20 and 0x09-0x0D. Null and empty texts have zeros and fail. Null languages and sources are
    ``(none)``. One row per row of docs; other columns are ignored."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)).alias("lang"),
                     F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)).alias("source"), text.alias("t"))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = df.select("*", F.filter(F.split("t", r"[\x20\x09-\x0D]+", -1), lambda w: w != "").alias("words"), lines.alias("lines"))
    df = df.select("doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
                   F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
                   (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                   (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), "words")
    for name, col in repeat_words(F.col("words")).items():
        df = df.withColumn(name, col)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return df.drop("words", "hashed", "windows", "by_window", "places").withColumn("base_failed", failed)


def vector() -> dict[str, Column]:
    """The transformed statistics; of texts that do not fail, so n_words > 0."""
    rate = lambda c, of: F.log1p(100 * F.col(c) / F.col(of))
    return {"x0": F.log(F.col("word_chars") / F.col("n_words")), "x1": F.log("n_words"), "x2": rate("n_symbols", "word_chars"),
            "x3": rate("n_dup_lines", "n_words"), "x4": rate("n_repeat_words", "n_words")}


NAMES = tuple(FLOORS)
P = len(NAMES)


def factored(est: DataFrame) -> DataFrame:
    """Rows with means m* and covariances c*_* -> means and the inverse Cholesky factor v*_* (the floors on the diagonal)."""
    for i in range(P):
        for j in range(i + 1):
            inner = F.col(f"c{i}_{j}") + (F.lit(FLOORS[NAMES[i]] ** 2) if i == j else 0.0)
            for k in range(j):
                inner = inner - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}")
            est = est.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(inner, F.lit(1e-12))) if i == j else inner / F.col(f"l{j}_{j}"))
    for i in range(P):
        for j in range(i + 1):
            if i == j:
                est = est.withColumn(f"v{i}_{i}", 1 / F.col(f"l{i}_{i}"))
            else:
                terms = sum((F.col(f"l{i}_{k}") * F.col(f"v{k}_{j}") for k in range(j, i)), F.lit(0.0))
                est = est.withColumn(f"v{i}_{j}", -terms / F.col(f"l{i}_{i}"))
    return est.select("g", *[f"m{i}" for i in range(P)], *[f"v{i}_{j}" for i in range(P) for j in range(i + 1)])


def distance() -> Column:
    rows = [sum((F.col(f"v{i}_{j}") * (F.col(NAMES[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0)) for i in range(P)]
    return sum((r * r for r in rows), F.lit(0.0))


def beside(rows: DataFrame, groups: DataFrame, bound: int = 50_000) -> DataFrame:
    """rows joined with one row per group; up to ``bound`` groups (a few hundred bytes each, counted) are broadcast, so
    a hot group's rows stay where they are."""
    return rows.join(F.broadcast(groups) if groups.count() <= bound else groups, "g")


def estimates(points: DataFrame, scratch: Scratch, steps: int = STEPS) -> DataFrame:
    """(g, m*, v*_*, scale) of points (g, x*): all groups at once, one aggregation with partial sums per step."""
    mid = lambda c, p=0.5: F.percentile_approx(c, F.lit(p), F.lit(2000))
    centre = scratch.keep(points.groupBy("g").agg(*[mid(x).alias(f"m{i}") for i, x in enumerate(NAMES)]), "centre")
    spread = beside(points, centre).groupBy("g").agg(
        *[F.first(f"m{i}").alias(f"m{i}") for i in range(P)], *[(1.4826 * mid(F.abs(F.col(x) - F.col(f"m{i}")))).alias(f"s{i}") for i, x in enumerate(NAMES)])
    for i in range(P):
        for j in range(i + 1):
            spread = spread.withColumn(f"c{i}_{j}", F.col(f"s{i}") * F.col(f"s{i}") if i == j else F.lit(0.0))
    est = scratch.keep(factored(spread), "est_start")
    for s in range(steps):
        near = beside(points, est).withColumn("d", distance())
        cut = scratch.keep(near.groupBy("g").agg(mid("d", H).alias("cut")), f"cut_{s}")
        inner = beside(near, cut).where("d <= cut")
        # centred on the last means, so the squares do not cancel
        off = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(NAMES)]
        sums = inner.groupBy("g").agg(*[F.first(f"m{i}").alias(f"o{i}") for i in range(P)], *[F.avg(off[i]).alias(f"a{i}") for i in range(P)],
                                      *[F.avg(off[i] * off[j]).alias(f"q{i}_{j}") for i in range(P) for j in range(i + 1)])
        for i in range(P):
            sums = sums.withColumn(f"m{i}", F.col(f"o{i}") + F.col(f"a{i}"))
            for j in range(i + 1):
                sums = sums.withColumn(f"c{i}_{j}", F.col(f"q{i}_{j}") - F.col(f"a{i}") * F.col(f"a{j}"))
        est = scratch.keep(factored(sums), f"est_{s}")
    scale = beside(points, est).withColumn("d", distance()).groupBy("g").agg((mid("d") / MEDIAN_CHI2_5).alias("scale"))
    return scratch.keep(est.join(scale, "g").withColumn("scale", F.greatest("scale", F.lit(1.0))), "estimates")


def judged(docs: DataFrame, cutoff: float = CUTOFF, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
           source_col: str = "source") -> DataFrame:
    """``statistics`` of docs with distance (squared, null where the base rules fail) and kept. A group with fewer than
    MIN_GROUP rows takes its language's estimate, a language with fewer that of all rows. Empty input gives an empty
    result."""
    scratch = Scratch(docs.sparkSession)
    stats = scratch.keep(statistics(docs, id_col, text_col, lang_col, source_col).withColumn("rid", F.monotonically_increasing_id()), "stats")
    good = stats.where("NOT base_failed").select("rid", *[c.alias(n) for n, c in vector().items()], "lang", "source")
    levels = F.array(F.to_json(F.array("lang", "source")), F.to_json(F.array("lang")), F.lit("[]"))
    points = scratch.keep(good.select("rid", *NAMES, levels.alias("levels")), "points")
    spread = points.select(F.explode("levels").alias("g"), *NAMES)
    est = estimates(spread, scratch)
    n = est.join(spread.groupBy("g").agg(F.count("*").alias("n")), "g").where(f"n >= {MIN_GROUP} OR g = '[]'").select("g")
    tables = [n.select(F.col("g").alias(f"g{i}"), F.lit(True).alias(f"has{i}")) for i in range(2)]
    own = points.select("rid", *NAMES, *[F.col("levels")[i].alias(f"g{i}") for i in range(3)])
    for i, t in enumerate(tables):
        own = own.join(t, f"g{i}", "left")
    own = own.withColumn("g", F.when(F.col("has0"), F.col("g0")).when(F.col("has1"), F.col("g1")).otherwise(F.col("g2")))
    far = beside(own, est).select("rid", (distance() / F.col("scale")).alias("distance"))
    out = stats.join(far, "rid", "left")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.col("distance") <= cutoff)).alias("kept"), F.round("distance", 4).alias("distance"))
