"""Lookups and small reports over landed tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.dates import age_days
from barloom.functions.text import comparable_name, plain_text, six_digits
from barloom.operators.asof import latest_per_key

# Words that ask for restructuring filings.
RESTRUCTURING_WORDS = ("重组", "吸收合并", "资产出售")


def newest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First n rows per key in the given order, cut before the shuffle (window group limit)."""
    spec = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("row_no", F.row_number().over(spec)).where(F.col("row_no") <= n)


def decayed_sentiment(news: DataFrame, now: Column, *, newest: int = 15, rate: float = 0.15) -> DataFrame:
    """Exponentially aged mean score of each code's newest items; an unknown time weighs 1."""
    top = newest_rows(news, ["code"], [F.col("ts").desc_nulls_last(), "event_id"], newest)
    weight = F.coalesce(F.exp(-rate * age_days(now, "ts")), F.lit(1.0))
    score = F.coalesce("score", F.lit(0.0))
    return top.groupBy("code").agg(
        F.round(F.coalesce(F.try_divide(F.sum(score * weight), F.sum(weight)), F.lit(0.0)), 4).alias("sentiment"),
        F.count("*").alias("scored_count"))


def strongest_news(news: DataFrame, n: int = 3) -> DataFrame:
    return newest_rows(news.where(F.col("score").isNotNull()), ["code"], [F.desc(F.abs("score")), F.desc("ts"), "event_id"], n)


def unique_items(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int | None = None,
                 per: Sequence[str] = ()) -> DataFrame:
    """First row of every key (an aggregation, so a heavily repeated item combines map-side);
    optionally the first ``limit`` of each group."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
    return newest_rows(first, per, order, limit).drop("row_no") if limit and per else first


def filings_for_question(filings: DataFrame, as_of, *, restructuring: bool = False, days: int = 45, recent: int = 6,
                         per_word: int = 5, limit: int = 10) -> DataFrame:
    """Per code: newest filings of the last days and, on request, the newest ones per
    restructuring word since 2020 (those come first); distinct by (date, title)."""
    today = F.lit(as_of).cast("date")
    base = filings.withColumn("date", F.to_date("published_at"))
    order = [F.desc("published_at"), "title"]
    new = newest_rows(base.where(F.col("date").between(F.date_sub(today, days), today)), ["code"], order, recent)
    picked = new.withColumn("source_order", F.lit(1))
    if restructuring:
        words = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(w).alias("word"))
                                    for i, w in enumerate(RESTRUCTURING_WORDS)]))
        since = base.where((F.col("date") >= F.lit("2020-01-01").cast("date")) & (F.col("date") <= today))
        hits = since.withColumn("w", words).where(F.col("title").contains(F.col("w.word")))
        hits = newest_rows(hits.withColumn("word", F.col("w.word")), ["code", "word"], order, per_word)
        picked = hits.drop("w", "word").withColumn("source_order", F.lit(0)).unionByName(picked)
    first = picked.groupBy("code", "date", "title").agg(F.min(F.struct("source_order", "row_no")).alias("o"))
    return newest_rows(first, ["code"], ["o.source_order", F.desc("date"), "o.row_no", "title"], limit).select(
        "code", "date", plain_text("title", 160).alias("title"), F.col("row_no").alias("place"))


def latest_report(rows: DataFrame, metrics: dict[str, str], date: str) -> DataFrame:
    """Newest row per code with metrics renamed and rounded to two decimals."""
    last = latest_per_key(rows.select("code", date, *metrics), ["code"], [date])
    return last.select("code", date, *[F.round(F.col(c), 2).alias(n) for c, n in metrics.items()])


def fund_flow(flows: DataFrame) -> DataFrame:
    """Newest net inflow and ratio, and sums over the last 5 and 20 rows per code."""
    back = Window.partitionBy("code").orderBy(F.desc("trade_date"))
    df = flows.withColumns({"i": F.row_number().over(back), "net": F.coalesce("net", F.lit(0.0))}).where(F.col("i") <= 20)
    return df.groupBy("code").agg(
        F.max("trade_date").alias("date"), F.round(F.max(F.when(F.col("i") == 1, F.col("net"))), 2).alias("latest_net"),
        F.round(F.max(F.when(F.col("i") == 1, F.col("ratio"))), 2).alias("latest_ratio"),
        F.round(F.sum(F.when(F.col("i") <= 5, F.col("net"))), 2).alias("net_5d"),
        F.round(F.sum("net"), 2).alias("net_20d"))


def top_net_buys(flows: DataFrame, n: int = 10) -> DataFrame:
    return flows.orderBy(F.desc("net_buy"), "code").limit(n)


def hot_pool(listed: DataFrame, leaders: DataFrame, net_buys: DataFrame, *, pool: int = 30) -> DataFrame:
    """Ordered distinct union: up to 15 listed codes, sector leaders, net buys; first ``pool``.
    Each input has code and place."""
    parts = [listed.where(F.col("place") <= 15), leaders, net_buys]
    union = None
    for i, p in enumerate(parts):
        p = p.select(six_digits("code").alias("code"), F.lit(i).alias("source"), "place")
        union = p if union is None else union.unionByName(p)
    first = union.where(F.col("code").isNotNull()).groupBy("code").agg(F.min(F.struct("source", "place")).alias("o"))
    return first.select("code", "o.source", "o.place").orderBy("source", "place", "code").limit(pool)


def run_universe(watch: DataFrame, pool: DataFrame, limit: int = 50) -> DataFrame:
    """Watch list first, then the pool, distinct, up to the limit (the watch list is kept whole)."""
    own = watch.select("code", F.lit(0).alias("rank0"), "place")
    rest = pool.select("code", F.lit(1).alias("rank0"), "place").join(own.select("code"), "code", "left_anti")
    both = own.unionByName(rest)
    order = Window.orderBy("rank0", "place", "code")
    return both.withColumn("run_place", F.row_number().over(order)).where(
        (F.col("rank0") == 0) | (F.col("run_place") <= limit)).select("code", "run_place")


def _grams(df: DataFrame, col: str, sizes: Sequence[int], *keep: str) -> DataFrame:
    """(keep, q, at, gram): every piece of q letters of a text with its place, for each q of ``sizes``; rows grow with the text."""
    cells = df.select(*keep, F.col(col).alias("__t"), F.explode(F.array(*[F.lit(q) for q in sizes])).alias("q"))
    cells = cells.where(F.length("__t") >= F.col("q"))
    places = F.sequence(F.lit(1), F.length("__t") - F.col("q") + 1)
    grams = F.transform(places, lambda i: F.struct(i.alias("at"), F.substring(F.col("__t"), i, F.col("q")).alias("gram")))
    return cells.select(*keep, "q", F.explode(grams).alias("g")).select(*keep, "q", "g.at", "g.gram")


def match_names(questions: DataFrame, names: DataFrame) -> DataFrame:
    """Code named in a text: a six-digit code wins, else the longest known name contained in it (ties: the greatest code).

    Each name is represented by one anchor, its piece of four letters (two for names of two or three) that the fewest
    names hold. The pieces of the texts meet the anchors in an equi join, and what meets is verified against the whole
    name. A text makes two rows a letter, whatever the names are, and the texts themselves move once."""
    asked = questions.withColumns({"direct": six_digits("text", standalone=True), "clean": comparable_name("text")})
    known = names.select(F.col("code").alias("hit"), comparable_name("name").alias("piece")).where(F.length("piece") >= 2)
    own = _grams(known.select("piece").distinct(), "piece", (2, 4), "piece").where(F.col("q") == F.when(F.length("piece") < 4, 2).otherwise(4))
    held = own.groupBy("q", "gram").agg(F.count("*").alias("names"))
    rarest = own.join(held.hint("merge"), ["q", "gram"]).groupBy("piece").agg(F.min(F.struct("names", "at", "q", "gram")).alias("a"))
    anchors = rarest.select("piece", F.col("a.q").alias("q"), F.col("a.gram").alias("gram"), F.col("a.at").alias("inside"))
    open_texts = asked.where(F.col("direct").isNull()).select("question_id", "clean")
    met = _grams(open_texts, "clean", (2, 4), "question_id").join(anchors.hint("merge"), ["q", "gram"]).select(
        "question_id", (F.col("at") - F.col("inside") + 1).alias("start"), "piece").where(F.col("start") >= 1)
    # all sides are sorted and merged: pieces and texts compress so well that they look small, but a broadcast would
    # hold them whole in the driver
    sure = met.join(open_texts.hint("merge"), "question_id").where(F.substring(F.col("clean"), F.col("start"), F.length("piece")) == F.col("piece"))
    best = sure.select("question_id", "piece").distinct().join(known.hint("merge"), "piece").groupBy("question_id").agg(
        F.max_by("hit", F.struct(F.length("piece"), "hit")).alias("named"))
    return asked.join(best.hint("merge"), "question_id", "left").select(
        "question_id", F.coalesce("direct", "named").alias("code"))


def clock_profile(stamps: DataFrame, ts: str = "published_at") -> DataFrame:
    """Rows, codes, span and shares of midnight and before-cutoff stamps."""
    second = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    midnight = F.col(ts) == F.date_trunc("day", F.col(ts))
    early = second <= 15 * 3600
    return stamps.where(F.col(ts).isNotNull()).agg(
        F.count("*").alias("rows"), F.count_distinct("code").alias("codes"), F.min(ts).alias("first"), F.max(ts).alias("last"),
        F.avg(midnight.cast("double")).alias("midnight_rate"), F.avg(early.cast("double")).alias("before_or_at_15_rate"),
        F.avg((~early | midnight).cast("double")).alias("after_15_or_date_only_rate"))


def top_clocks(stamps: DataFrame, ts: str = "published_at", n: int = 10) -> DataFrame:
    return (stamps.groupBy(F.date_format(ts, "HH:mm:ss").alias("clock")).agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "clock").limit(n))


def index_membership(rows: DataFrame) -> DataFrame:
    """Rows and distinct valid codes per index."""
    return rows.withColumn("code", six_digits("code")).where(F.col("code").isNotNull()).groupBy("index_id").agg(
        F.count("*").alias("rows"), F.count_distinct("code").alias("unique_codes"))


def sector_map(membership: DataFrame, order: str) -> DataFrame:
    """One sector per valid code; the later listing wins."""
    clean = membership.withColumn("code", six_digits("code")).where(F.col("code").isNotNull())
    return clean.groupBy("code").agg(F.max_by("sector", order).alias("sector"))


def run_counters(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count("*").alias("analysed"), F.count_if(F.col("pushed") == 1).alias("pushed"),
                         F.count_if(F.col("push_ok") == 1).alias("ok"))
