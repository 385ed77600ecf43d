"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed per cell (source, language, topic). Raking scales the cells to each target marginal in turn
until all three hold; the ratio of raked to present tokens is a cell's weight. A document is kept with its cell's
weight over the largest weight, so the kept tokens have the target proportions, by a number in [0, 1) that its id alone
decides.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

NONE = "(none)"
#: Topics by what a text holds; the first that fits counts.
TOPICS = (("licence", "License"), ("contact", "@"), ("credentials", "AKIA|password=|token = "), ("markup", "[#$%&*][#$%&*]"))
OTHER_TOPIC = "general"
#: Powers of the present shares that make the default targets: below 1 small categories gain.
FLATTEN = {"source": 0.7, "language": 0.8, "topic": 1.0}
ITERATIONS, PER_STORE, DIGITS = 12, 3, 6


def topic_of(text: Column, topics: Sequence[tuple[str, str]] = TOPICS) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(topics):
        out = F.when(text.rlike(pattern), name).otherwise(F.coalesce(out, F.lit(OTHER_TOPIC)))
    return F.coalesce(out, F.lit(OTHER_TOPIC))


def token_count(text: Column) -> Column:
    """Spaces and line breaks plus one; 0 without text."""
    gaps = F.length(text) - F.length(F.translate(text, " \n", ""))
    return F.when(F.length(text) > 0, gaps + 1).otherwise(0).cast("long")


def uniform(id_col: Column, seed: str) -> Column:
    """Number in [0, 1) of an id (52 bits of a digest); a null id counts as an empty string."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def raked(cells: DataFrame, scratch: Scratch, targets: Mapping[str, Mapping[str, float]] | None = None,
          iterations: int = ITERATIONS) -> DataFrame:
    """(source, language, topic, tokens, weight) of cells with a tokens column. targets gives wanted shares per
    dimension; a dimension without any flattens its present shares by FLATTEN. Categories without a share get none.
    One row per cell, so hot sources are one row for each language and topic."""
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for dim, power in FLATTEN.items():
        own = Window.partitionBy(dim)
        if targets and dim in targets:
            pairs = F.create_map(*[F.lit(x) for kv in targets[dim].items() for x in kv])
            share = F.coalesce(pairs[F.col(dim)].cast("double"), F.lit(0.0))
        else:
            share = F.pow(F.sum("w").over(own), power)
        now = now.withColumn(f"share_{dim}", share)
        sums = now.groupBy(dim).agg(F.max(f"share_{dim}").alias("s")).agg(F.sum("s").alias(f"all_{dim}"))
        now = now.join(F.broadcast(sums)).withColumn(f"share_{dim}", F.col(f"share_{dim}") / F.col(f"all_{dim}")).drop(f"all_{dim}")
    now = scratch.keep(now.join(F.broadcast(now.agg(F.sum("w").alias("total")))), "shares")
    for i in range(iterations):
        for dim in FLATTEN:
            held = F.sum("w").over(Window.partitionBy(dim))
            now = now.withColumn("w", F.when(held > 0, F.col("w") * F.col(f"share_{dim}") * F.col("total") / held).otherwise(0.0))
        if (i + 1) % PER_STORE == 0 or i == iterations - 1:
            now = scratch.keep(now, f"raked_{i}")
    return now.select(*FLATTEN, "tokens", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).alias("weight"))


def mixture(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, seed: str = "mixture",
            topics: Sequence[tuple[str, str]] = TOPICS, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, source, language, topic, tokens, probability, kept), one row per row of docs.

    Null sources and languages are the category ``(none)``. Texts without tokens weigh nothing: in a cell without any
    token the probability is 1. Rows that repeat an id share their number and, in one cell, their fate. Empty input
    gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col)
    facts = scratch.keep(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)).alias("source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)).alias("language"), topic_of(text, topics).alias("topic"),
        token_count(text).alias("tokens")), "facts")
    cells = raked(facts.groupBy(*FLATTEN).agg(F.sum("tokens").alias("tokens")), scratch, targets)
    cells = scratch.keep(cells, "cells")
    most = cells.agg(F.max("weight").alias("most"))  # one row
    chance = F.when(F.col("weight").isNull(), 1.0).otherwise(F.round(F.col("weight") / F.col("most"), DIGITS))
    calibrated = cells.join(F.broadcast(most)).select(*FLATTEN, chance.alias("probability"))
    out = facts.join(calibrated, list(FLATTEN))
    return out.select("doc_id", *FLATTEN, "tokens", "probability", (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("kept"))


def mixture_sql(seed: str = "mixture", iterations: int = ITERATIONS, table: str = "documents") -> str:
    """The same in DuckDB's SQL, with the default targets."""
    topic = " ".join(f"WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}'" for n, p in TOPICS)
    parts = [f"""facts AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS language,
        CASE {topic} ELSE '{OTHER_TOPIC}' END AS topic,
        CASE WHEN length(text) > 0 THEN length(text) - length(translate(text, ' ' || chr(10), '')) + 1 ELSE 0 END AS tokens FROM {table})""",
             "c AS MATERIALIZED (SELECT source, language, topic, sum(tokens) AS tokens, sum(tokens)::DOUBLE AS w FROM facts GROUP BY ALL)"]
    for dim, power in FLATTEN.items():
        parts.append(f"t_{dim} AS MATERIALIZED (SELECT {dim}, p / sum(p) OVER () * (SELECT sum(w) FROM c) AS goal FROM (SELECT {dim}, pow(sum(w), {power}) AS p FROM c GROUP BY 1))")
    last, step = "c", 0
    for _ in range(iterations):
        for dim in FLATTEN:
            step += 1
            parts.append(f"""r{step} AS MATERIALIZED (SELECT source, language, topic, tokens,
                CASE WHEN h > 0 THEN w * goal / h ELSE 0 END AS w
                FROM (SELECT *, sum(w) OVER (PARTITION BY {dim}) AS h FROM {last}) JOIN t_{dim} USING ({dim}))""")
            last = f"r{step}"
    parts.append(f"cells AS MATERIALIZED (SELECT source, language, topic, CASE WHEN tokens > 0 THEN w / tokens END AS weight FROM {last})")
    parts.append(f"""p AS MATERIALIZED (SELECT source, language, topic, CASE WHEN weight IS NULL THEN 1.0::DOUBLE
        ELSE round(weight / max(weight) OVER (), {DIGITS}) END AS probability FROM cells)""")
    number = f"CAST('0x' || substr(md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / {float(1 << 52)}"
    return "WITH " + ", ".join(parts) + f""" SELECT doc_id, source, language, topic, CAST(tokens AS BIGINT) AS tokens, probability,
        {number} < probability AS kept FROM facts JOIN p USING (source, language, topic)"""
