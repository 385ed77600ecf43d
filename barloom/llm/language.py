"""Language identification by bit-sliced Bloom filters of character n-grams.

One filter holds all languages: every slot is a bitmask over languages, and an n-gram sets its language's bit in
``HASHES`` slots. ANDing the slots of an n-gram returns all languages that hold it at once. A text's language is the one
with the highest share of n-grams holding its bit, corrected for the false positives that the fill of its slice implies.

N-grams are runs of 3 and 4 characters of the lower-cased text in which everything but letters is one space. An n-gram
belongs to a language if its rate there is at least ``SHARE`` of its summed rates over all languages, so passages in a
foreign language inside training texts do not enter the filter.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, arrow_batches, slices, unit_hash

#: Documents per language that the filters are learned from, on average (a bounded sample by hash of the id).
TRAIN_DOCUMENTS = 4000
#: Characters of the training table's n-grams kept per language: the most frequent ones.
TRAIN_GRAMS = 50_000
SHARE, MIN_COUNT, HASHES, SLOTS_PER_GRAM = 0.4, 3, 2, 12
LENGTHS = (3, 4)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or 32 for all that is no letter; marks count as letters."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(ch := chr(c))[0] in "LM":
            table[c] = ord(ch.lower()[0])
    return table


def grams(values: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, the text each belongs to, and the number of letters of each text."""
    letters = _letters()
    flat, sizes, count = [], np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    for i, v in enumerate(values):
        c = letters[np.frombuffer((" " + (v or "") + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
        gap = c == 32
        gap[1:] &= gap[:-1].copy()
        gap[0] = False
        c = c[~gap]
        count[i] = np.count_nonzero(c != 32)
        if count[i]:
            c = np.append(c, np.uint32(0))  # ends the text: no n-gram holds it
            flat.append(c)
            sizes[i] = len(c)
    if not flat:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), count
    c = np.concatenate(flat)
    who = np.repeat(np.arange(len(values), dtype=np.int32), sizes)
    stop, wide = c == 0, c.astype(np.uint64)
    out, own = [], []
    for n in LENGTHS:
        if len(c) <= n:
            continue
        size = len(c) - n + 1
        h, across = wide[:size] * np.uint64(MULTIPLIERS[0]), stop[:size].copy()
        for k in range(1, n):
            h += wide[k:k + size] * np.uint64(MULTIPLIERS[k])
            across |= stop[k:k + size]
        h ^= h >> np.uint64(29)
        h *= np.uint64(MULTIPLIERS[n])
        out.append(h[~across])
        own.append(who[:size][~across])
    return np.concatenate(out), np.concatenate(own), count


@dataclass
class Filters:
    """languages: names in bit order; table: slots x languages bits packed into bytes; wrong: false-positive rates."""

    languages: list[str]
    table: np.ndarray
    wrong: np.ndarray

    def slots(self, h: np.ndarray) -> Iterator[np.ndarray]:
        width = len(self.table).bit_length() - 1
        for k in range(HASHES):
            yield (h >> np.uint64(64 - width * (k + 1))) & np.uint64(len(self.table) - 1)

    def masks(self, h: np.ndarray) -> np.ndarray:
        found = None
        for s in self.slots(h):
            found = self.table[s] if found is None else found & self.table[s]
        return found

    def shares(self, values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected share of n-grams held, per text and language, and the number of letters of each text."""
        h, who, letters = grams(values)
        hits = np.zeros((len(values), self.table.shape[1] * 8))
        if len(h):
            found = self.masks(h)
            bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
            for b in range(found.shape[1]):  # texts x mask bytes, then the popcount of every bit slice
                table = np.bincount(who.astype(np.int64) * 256 + found[:, b], minlength=len(values) * 256)
                hits[:, b * 8:b * 8 + 8] = table.reshape(len(values), 256) @ bits
        total = np.maximum(np.bincount(who, minlength=len(values)), 1)
        share = hits[:, :len(self.languages)] / total[:, None]
        return np.clip((share - self.wrong) / (1 - self.wrong), 0, 1), letters


def build(languages: list[str], held: list[tuple[int, int]]) -> Filters:
    """Filters of (n-gram hash, language number) rows; sized by their number, which training bounds."""
    most = max([sum(x[1] == i for x in held) for i in range(len(languages))], default=0)
    slots = 1 << min(32, max(10, (SLOTS_PER_GRAM * most).bit_length()))
    f = Filters(languages, np.zeros((slots, (len(languages) + 7) // 8), np.uint8), np.zeros(len(languages)))
    h = np.array([x[0] for x in held], np.int64).view(np.uint64) if held else np.zeros(0, np.uint64)
    lang = np.array([x[1] for x in held], np.int64)
    for i in range(len(languages)):
        own = h[lang == i]
        for s in f.slots(own):
            f.table[s, i // 8] |= np.uint8(1 << (i % 8))
        fill = np.count_nonzero(f.table[:, i // 8] & np.uint8(1 << (i % 8))) / slots
        f.wrong[i] = min(0.5, fill ** HASHES)
    return f


def train(docs: DataFrame, train_where, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Filters learned from the rows of ``train_where`` with a language. Rows without text or language teach nothing;
    without any such row there are no languages and every text is ``und``."""
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark)
    rows = docs.where(train_where).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy("lang").limit(1000).collect()}
    languages = sorted(sizes)
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint8), np.zeros(0))
    part = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, TRAIN_DOCUMENTS / v)))])
    sample = rows.where(unit_hash("doc_id", "language-sample") < part[F.col("lang")]).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                langs = np.array([languages.index(x) for x in piece.column("lang").to_pylist()])
                h, who, _ = grams(piece.column("text").to_pylist())
                for i in np.unique(langs):
                    g, n = np.unique(h[langs[who] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), i)), pa.array(n)], ["gram", "lang", "n"])

    counts = scratch.keep(sample.mapInArrow(count, "gram long, lang long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n")), "counts")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(total), "lang").withColumn("rate", F.col("n") / F.col("total"))
    home = rate.groupBy("gram").agg(F.sum("rate").alias("all"), F.collect_list(F.struct("lang", "n", "rate")).alias("by"))
    held = home.select("gram", "all", F.explode("by").alias("x")).where(f"x.n >= {MIN_COUNT} AND x.rate >= {SHARE} * all").select("gram", F.col("x.lang").alias("lang"), F.col("x.n").alias("n"))
    rows_held: list[tuple[int, int]] = []
    for i in range(len(languages)):  # at most TRAIN_GRAMS rows of each language
        best = held.where(F.col("lang") == i).orderBy(F.desc("n"), "gram").limit(TRAIN_GRAMS).select("gram")
        rows_held += [(r["gram"], i) for r in best.collect()]
    scratch.drop()
    return build(languages, rows_held)


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, support) per row. A text that is null or has no letters is ``und`` with score 0.
    score is the winner's part of all corrected shares; support the winner's corrected share. Of equal shares the first
    language by name wins; a text none of whose n-grams is held gets the first language by name with score 0."""
    arrow_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(filters)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = known.value
        for batch in batches:
            for piece in slices(batch, "text"):
                values = piece.column("text").to_pylist()
                if f.languages:
                    shares, letters = f.shares(values)
                    best = shares.argmax(axis=1)
                    top = shares[np.arange(len(values)), best]
                    part = np.where(letters > 0, top / np.maximum(shares.sum(axis=1), 1e-12), 0.0)
                    names = [f.languages[b] if n else UNKNOWN for b, n in zip(best, letters)]
                    top = np.where(letters > 0, top, 0.0)
                else:
                    names, part, top = [UNKNOWN] * len(values), np.zeros(len(values)), np.zeros(len(values))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(names, pa.string()), pa.array(part, pa.float64()),
                                                  pa.array(top, pa.float64())], ["doc_id", "lang_pred", "score", "support"])

    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return only.mapInArrow(score, "doc_id long, lang_pred string, score double, support double")


def rejected(predictions: DataFrame, support: float = 0.2) -> DataFrame:
    """Ids of documents in no known language: no letters, or hardly an n-gram that the winner holds."""
    return predictions.where((F.col("lang_pred") == UNKNOWN) | (F.col("support") < support)).select("doc_id").where("doc_id IS NOT NULL").distinct()
