"""N-gram Jaccard join by parity sketches.

A document is the set of hashes of its distinct word shingles. A sketch deals the shingles to K words and XORs them
there, so the number of words in which two sketches differ never exceeds the size of the sets' symmetric difference.
Sets that link at Jaccard t have a symmetric difference of at most (1 - t) / t times the smaller size; within a band of
sizes whose smaller member has at most m shingles that is at most d = floor(m (1 - t) / t). Of K = d + 1 + e words,
e + 1 at least are equal in both (pigeonhole), so a set with at most e light words (too few shingles to tell sets apart)
shares a word that is not light with every partner: those words are the join keys. A set with more light words is dealt
again with the next seed; the last seed uses the light words too. Candidates are verified on the exact sets.

Large groups: equal sets are one class first, and keys held by the same classes are one key. Of the classes that share a
key, the one with most shared keys is the pivot; the others are verified against it alone. After that only classes of one
key that are still in different components are compared with each other. So no link between components is lost and the
pairs of a group are never listed. In both rounds pairs pass the Hamming distance of folded bit sketches first, then that
of sketches as wide as the sets are large; whole sets are fetched only for pairs that both leave.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, arrow_batches, by_ids, mix, slices, texts
from barloom.llm.graph import components

BAND_RATIO, SEEDS = 1.5, 4
FOLD_WORDS = 16
WORD_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
SHINGLE_MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, WORD_MULTIPLIER, np.uint64), np.full(n, pow(WORD_MULTIPLIER, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts laid end to end, and each text's bounds in them.

    data: UTF-8 bytes; bounds: byte offsets of the texts (n + 1). A word is hashed as a polynomial in its bytes, taken
    as a difference of running sums, so the work is a few passes over the bytes.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = bounds[:-1][bounds[:-1] < n]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends_at = bounds[1:][bounds[1:] > 0] - 1
    last[ends_at] = inside[ends_at]
    ends = np.flatnonzero(last) + 1
    up, down = _powers(1 << max(16, (n - 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((LOWER[data] + np.uint64(1)) * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, bounds)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; with fewer words the whole sequence is one."""
    k = min(n, len(words))
    if k == 0:
        return np.zeros(0, np.uint64)
    mixed = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        mixed += words[i:len(words) - k + 1 + i] * np.uint64(SHINGLE_MULTIPLIERS[i % 5] + 2 * (i // 5))
    return np.unique(mix(mixed))


def parity(hashes: np.ndarray, words: int) -> np.ndarray:
    """Parity sketch of ``words`` 64-bit words."""
    bits = np.bincount((hashes % np.uint64(words * 64)).astype(np.int64), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


@lru_cache(maxsize=4096)
def band_plan(band: int, threshold: float) -> tuple[int, int, int]:
    """Largest size whose home the band is, most differing shingles of a linked pair, and spare words."""
    most = math.ceil(BAND_RATIO ** (band + 1) - 1e-9) - 1
    d = math.floor(most * (1 - threshold) / threshold + 1e-9)
    return most, d, 1 + math.ceil((0.1 if threshold >= 0.85 else 0.2) * d)


def band_keys(hashes: np.ndarray, threshold: float) -> np.ndarray:
    """Join keys: sketch words for the set's own size band, and for every band below that may hold a partner."""
    n, out = len(hashes), []
    if n == 0:
        return np.zeros(0, np.uint64)
    least = 2 if threshold / (1 - threshold) >= 6 else 1
    band = math.floor(math.log(n) / math.log(BAND_RATIO) + 1e-9)
    while n > band_plan(band, threshold)[0]:
        band += 1
    while band >= 0 and n * threshold <= band_plan(band, threshold)[0] + 1e-9:
        _, d, spare = band_plan(band, threshold)
        if d == 0:  # only equal sets link, and those are one class
            break
        k = d + 1 + spare
        for seed in range(SEEDS):
            place = np.uint64((band * SEEDS + seed + 1) << 40)
            dealt = mix(hashes + place)
            at = (dealt % np.uint64(k)).astype(np.int64)
            words = np.zeros(k, np.uint64)
            np.bitwise_xor.at(words, at, mix(dealt))
            light = np.bincount(at, minlength=k) < least
            enough = np.count_nonzero(light) <= spare
            used = np.flatnonzero(~light) if enough or seed < SEEDS - 1 else np.arange(k)
            out.append(mix(words[used] ^ mix(used.astype(np.uint64) + place)))
            if enough:
                break
        band -= 1
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in slices(batch, "text", 1 << 19):
        blobs = [b"" if t is None else t.encode() for t in part.column("text").to_pylist()]
        bounds = np.zeros(len(blobs) + 1, np.int64)
        np.cumsum([len(b) for b in blobs], out=bounds[1:])
        hashes, at = word_hashes(np.frombuffer(b"".join(blobs), np.uint8), bounds)
        yield part, [shingle_set(hashes[at[i]:at[i + 1]], n) for i in range(len(blobs))]


def _class(s: np.ndarray) -> tuple[int, int]:
    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(digest[0]), int(digest[1])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _keys_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()


def wide_parity(hashes: np.ndarray) -> np.ndarray:
    """Parity sketch of one bit or more a shingle, a power of two of words; empty where the folded sketch is as wide."""
    words = 1 << max(0, (len(hashes) - 1) // 64).bit_length()
    return parity(hashes, words) if words > FOLD_WORDS else np.zeros(0, np.uint64)


def _apart(x: str, y: str) -> Column:
    """Hamming distance of two folded sketches; at most the symmetric difference."""
    return sum((F.bit_count(F.col(f"{x}f{i}").bitwiseXOR(F.col(f"{y}f{i}"))) for i in range(FOLD_WORDS)), F.lit(0))


def _wide_apart(x: str, y: str) -> Column:
    """Hamming distance of two wide sketches, the wider one folded in two; 0 where one is missing or over twice as wide."""
    w = F.least(F.size(x), F.size(y))
    xor = lambda p, q: p.bitwiseXOR(q)
    narrow = lambda c: F.when(F.size(c) > w, F.zip_with(F.slice(c, F.lit(1), w), F.slice(c, w + 1, w), xor)).otherwise(F.col(c))
    bits = F.aggregate(F.zip_with(narrow(x), narrow(y), xor), F.lit(0), lambda n, z: n + F.bit_count(z))
    return F.when((w > 0) & (F.greatest(F.size(x), F.size(y)) <= 2 * w), bits).otherwise(0)


def linked_components(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies): components of documents linked at Jaccard >= threshold.

    A-Z are lower-cased; words are runs of bytes outside 0x20 and 0x09-0x0D. component_id is the smallest doc_id
    reachable, n_copies the number of documents with the same set. Null, empty and word-free texts have no shingles
    and are linked with nothing. Rows without an id are returned with a null component and link nothing; rows that
    repeat an id are one document with the links of all of them, and each a row of the result. Empty input gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch, low = Scratch(spark), texts(docs, id_col, text_col)
    per, of = round(threshold * 1000), 1000  # integers, so that a pair exactly at the threshold is decided right

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, words):
                made = [_class(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([c[0] for c in made], pa.int64()), pa.array([c[1] for c in made], pa.int64())],
                    ["doc_id", "n_shingles", "h1", "h2"])

    def key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, words):
                keys = [band_keys(s, threshold) for s in sets]
                rows = np.repeat(part.column("doc_id").to_numpy(zero_copy_only=False), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(rows.astype(np.int64))], ["key", "node"])

    def sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, words):
                folds = np.stack([parity(s, FOLD_WORDS) for s in sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _lists([wide_parity(s) for s in sets]),
                     *[pa.array(folds[:, i].copy()) for i in range(FOLD_WORDS)]],
                    ["node", "n", "wide", *[f"f{i}" for i in range(FOLD_WORDS)]])

    def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, words):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(sets)], ["doc_id", "members"])

    signed = scratch.keep(low.mapInArrow(sizes, "doc_id long, n_shingles long, h1 long, h2 long"), "signed")
    linkable = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch.keep(linkable.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_copies")), "classes")
    # one document of each class gives keys; classes that share none are done
    copies = scratch.keep(linkable.join(classes, ["h1", "h2"]).where("doc_id <> node").select("doc_id").distinct()
                          .join(classes.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_anti"), "copies")
    keyed = by_ids(low.where("doc_id IS NOT NULL"), copies, "doc_id", "left_anti").mapInArrow(key_rows, "key long, node long")
    # keys held by the same classes become one; should different groups get the same number, they are one larger group
    of_key = Window.partitionBy("key")
    half = lambda salt: F.sum(F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(1 << 32))).over(of_key)
    counted = keyed.select("node", F.count("*").over(of_key).alias("c"), half(0).alias("s"), half(1).alias("t")).where("c > 1")
    shared = scratch.keep(counted.select(F.xxhash64("c", "s", "t").alias("key"), "node", "c").distinct(), "shared")
    central = scratch.keep(shared.groupBy("node").agg(F.sum("c").alias("score")), "central")
    folds = [f"f{i}" for i in range(FOLD_WORDS)]
    sketches = scratch.keep(by_ids(low, central.select(F.col("node").alias("doc_id")), "doc_id")
                            .mapInArrow(sketch_rows, f"node long, n long, wide array<long>, {', '.join(f + ' long' for f in folds)}"), "sketches")
    folded = sketches.select("node", "n", *folds)
    side = lambda df, x: df.select(F.col("node").alias(x), *[F.col(c).alias(x + c) for c in df.columns if c != "node"])
    least, most = F.least("an", "bn"), F.greatest("an", "bn")
    alike = least * of >= most * per  # by size
    close = lambda apart: apart * per <= least * (of - per)  # noqa: E731  linked sets differ by no more

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.keep(pairs, f"{name}_pairs")
        wide = by_ids(sketches.select(F.col("node").alias("doc_id"), "n", "wide"), _keys_of(pairs), "doc_id").withColumnRenamed("doc_id", "node")
        pairs = scratch.keep(pairs.join(side(wide, "a"), "a").join(side(wide, "b"), "b")
                             .where(close(_wide_apart("awide", "bwide"))).select("a", "b").distinct(), f"{name}_close")
        members = scratch.keep(by_ids(low, _keys_of(pairs), "doc_id").mapInArrow(set_rows, "doc_id long, members array<long>"), f"{name}_sets")
        both = (pairs.join(members.toDF("a", "sa"), "a").join(members.toDF("b", "sb"), "b"))
        same, total = F.size(F.array_intersect("sa", "sb")), F.size("sa") + F.size("sb")
        return scratch.keep(both.where(same * of >= per * (total - same)).select("a", "b"), name)

    pivots = shared.join(central, "node").groupBy("key").agg(F.max(F.struct("score", F.negative("node").alias("m"))).alias("p"))
    star = shared.join(pivots.select("key", F.negative("p.m").alias("a")), "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
    # a repeated id has several sketches; any two of them may link
    sized = folded.select("node", "n")
    star = star.join(side(sized, "a"), "a").join(side(sized, "b"), "b").where(alike).select("a", "b").distinct()
    star = star.join(side(folded, "a"), "a").join(side(folded, "b"), "b").where(alike & close(_apart("a", "b"))).select("a", "b").distinct()
    # an id on several texts ties their classes together
    owned = linkable.join(classes, ["h1", "h2"]).select("doc_id", "node").distinct()
    several = owned.groupBy("doc_id").agg(F.min("node").alias("a"), F.count("*").alias("c")).where("c > 1").select("doc_id", "a")
    tied = owned.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
    first = components(verified(star, "star").union(tied), scratch, "first")
    # what is left: classes of one key in different components
    placed = shared.select("key", "node").join(first, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    spread = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    rest = scratch.keep(placed.join(spread, "key").distinct().join(folded, "node"), "rest")
    held = lambda x: rest.select("key", F.col("node").alias(x), *[F.col(c).alias(x + c) for c in ("component", "n", *folds)])
    left = held("a").join(held("b"), "key").where((F.col("a") < F.col("b")) & (F.col("acomponent") != F.col("bcomponent"))
                                                  & alike & close(_apart("a", "b")))
    more = verified(left.select("a", "b").distinct(), "more")
    # links between components; nodes the first round did not link stand for themselves
    at = lambda x: first.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    joined = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    second = components(joined.distinct(), scratch, "second").toDF("component", "whole")
    placed = (classes.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
              .join(second, "component", "left").select("h1", "h2", "n_copies", F.coalesce("whole", "component").alias("component_id")))
    linked = linkable.join(placed, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id", "n_copies")
    alone = signed.where("doc_id IS NULL OR n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"))
    out = scratch.keep(linked.unionByName(alone), "out")
    scratch.drop("out")
    return out


def keep_one_of_each(docs: DataFrame, threshold: float = 0.8, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without near copies: of each component the row with the smallest id stays (all columns kept).

    Documents without shingles and rows without an id stay; rows that repeat an id are one document and stay together.
    """
    parts = linked_components(docs, threshold, words, id_col, text_col)
    stays = parts.where("doc_id = component_id").select("doc_id").distinct()
    gone = parts.where("doc_id <> component_id").select("doc_id").distinct().join(stays, "doc_id", "left_anti")
    return by_ids(docs, gone.withColumnRenamed("doc_id", id_col), id_col, "left_anti")
