"""Registered queries of the training-data operators: one per operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import chat as ct
from barloom.llm import language as lg
from barloom.llm import media as md
from barloom.llm import merkle as mk
from barloom.llm import mixing as mx
from barloom.llm import ngram_join as nj
from barloom.llm import outliers as ol
from barloom.llm import packing as pk
from barloom.llm import pseudonyms as ps
from barloom.llm import sharding as sh
from barloom.llm import spelling as sp
from barloom.llm import toxicity as tx
from barloom.llm import warc as wc
from barloom.llm.common import Scratch, by_ids, crc_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


WORD_BPE = "word_bpe_49k.json"


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    rows = pk.packed(table(spark, folder, "documents"), public_tokenizers.path(WORD_BPE))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op2_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = tx.train(docs, labels, crc_remainder(3) != 1)
    return tx.scored(docs, model).select("doc_id", (crc_remainder(3) == 1).alias("held_out"), "score",
                                         F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


@query("op3_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    filters = lg.train(docs, crc_remainder(4) != 2)
    made = lg.predict(docs, filters)
    return made.select("doc_id", (crc_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


@query("op4_mixing", mx.mixture_sql())
def mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mx.mixture(table(spark, folder, "documents"))


PSEUDONYM_KEY = "barloom"


@query("op5_pseudonyms")
def pseudonyms(spark: SparkSession, folder: str) -> DataFrame:
    return ps.pseudonymised(table(spark, folder, "documents"), PSEUDONYM_KEY).select("doc_id", "text", "n_replaced")


BYTE_BPE = "byte_bpe_50k.tiktoken"


@query("op6_chat_prefix_tree")
def chat_prefix_tree(spark: SparkSession, folder: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    path, scratch = public_tokenizers.path(BYTE_BPE), Scratch(spark)
    nodes, members = ct.prefix_trees(turns, path, public_tokenizers.PATTERN, scratch)
    return ct.read_back(nodes, members, path, public_tokenizers.PATTERN)


@query("op7_balanced_shards")
def balanced_shards(spark: SparkSession, folder: str) -> DataFrame:
    rows = sh.sharded(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "linked")


@query("op8_robust_outliers")
def robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return ol.judged(table(spark, folder, "documents"))


@query("op9_image_copies")
def image_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Images drawn from all embeddings; the edited crop of every twentieth is searched among all."""
    scratch = Scratch(spark)
    images = md.rendered(table(spark, folder, "embeddings"), "vec_id", "embedding")  # drawn again where used: cheaper than kept
    of = scratch.keep(md.classes(images), "classes")
    one = by_ids(images, of.where("id = class_id").select("id").distinct(), "id")
    found = md.copies(md.edited(images.where("id % 20 = 0")), one, scratch)
    best = found.groupBy(F.col("query_id").alias("id")).agg(
        F.count("*").alias("n_links"), F.max(F.struct("inliers", F.negative("image_id").alias("m"))).alias("b"))
    return of.join(best, "id", "left").select(
        F.col("id").alias("vec_id"), "class_id", (F.col("id") % 20 == 0).alias("searched"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.negative("b.m").alias("best_class"), F.col("b.inliers").alias("inliers"))


@query("op10_ngram_jaccard_join")
def ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return nj.linked_components(table(spark, folder, "documents"), threshold=0.9, words=3).select("doc_id", "n_shingles", "component_id")


@query("op11_merkle_manifest", mk.manifest_sql())
def merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return mk.manifest(table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)


@query("op12_spelling_variants", sp.variants_sql())
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return sp.variants(table(spark, folder, "documents"))


WARC_DATE = "2024-01-01T00:00:00Z"


@query("op13_warc_archive", wc.pages_sql())
def warc_archive(spark: SparkSession, folder: str) -> DataFrame:
    archive = f"{Scratch(spark).folder}/archive"
    wc.archive(table(spark, folder, "pages"), archive, WARC_DATE)
    return wc.read(spark, archive, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
