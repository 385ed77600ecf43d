"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import language as lg
from barloom.llm import mixing as mx
from barloom.llm import ngram_join as nj
from barloom.llm import packing as pk
from barloom.llm import pseudonyms as ps
from barloom.llm.common import Scratch, by_ids, crc_remainder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PSEUDONYM_KEY, WORD_BPE = "barloom", "word_bpe_49k.json"
ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language (operator 3); filters are learned from the documents themselves."""
    filters = lg.train(docs, crc_remainder(4) != 2)
    gone = Scratch(spark).keep(lg.rejected(lg.predict(docs, filters)), "rejected")
    return by_ids(docs, gone, "doc_id", "left_anti").select(*COLUMNS)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 10): shingles of five words, Jaccard 0.8."""
    return nj.keep_one_of_each(docs, threshold=0.8, words=5).select(*COLUMNS)


def pseudonym_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses replaced by pseudonyms (operator 5); n_chars follows the new text."""
    made = ps.pseudonymised(docs, PSEUDONYM_KEY, count_col=None)
    return made.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled to target weights (operator 4)."""
    out = mx.mixture(docs).where("NOT kept").select("doc_id").distinct()
    return by_ids(docs, Scratch(spark).keep(out, "unsampled"), "doc_id", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents packed into training sequences (operator 1): one row per piece."""
    return pk.packed(docs, public_tokenizers.path(WORD_BPE))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("ngram_jaccard", near_copies_stage),
    ("pseudonyms", pseudonym_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
