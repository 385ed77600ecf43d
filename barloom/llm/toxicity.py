"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on words that labelled toxic texts hold significantly more often, one on
words of ordinary texts. Every window of a text - a framed word - is compressed with both; its margin is the part of
what a whole match would save that the toxic dictionary does save, cubed, so that a word which only shares its ending with
a toxic one counts little. A logistic curve calibrated on labelled texts turns a text's largest margins into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, arrow_batches, by_ids, slices, unit_hash

#: Labelled documents per class that are learned from, on average; words per dictionary.
TRAIN_DOCUMENTS, TRAIN_WORDS = 4000, 2000
#: A word is toxic if its share among toxic texts exceeds that among ordinary ones by so many standard errors in both
#: halves of the sample. Copies fall into one half, so what only a group of copies holds does not count.
ERRORS, LEAST = 3.5, 3
LEVEL, FRAME, TOP = 12, "\n\n\n", 3
#: Margins kept by a worker; more are computed again.
CACHED = 400_000
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray | None = None  # bias, largest margin, sum of the TOP largest
    constant: float = 0.0

    def margins(self) -> Margins:
        return Margins(self.toxic, self.ordinary)


class Margins(dict):
    """word -> margin from 0 to 1: length compressed with the ordinary dictionary minus that with the toxic one, as a part
    of the same difference for the shortest length of a word in the toxic dictionary, cubed."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        super().__init__()
        self.by = [self.compressor(x) for x in (ordinary, toxic)]
        self.whole = min((len(self.by[1].compress(self.window(w))) for w in toxic.decode().split(FRAME) if w), default=0)

    @staticmethod
    def window(word: str) -> bytes:
        return (FRAME + word + FRAME).encode()

    @staticmethod
    def compressor(content: bytes) -> zstandard.ZstdCompressor:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def __missing__(self, word: str) -> float:
        ordinary, toxic = (len(c.compress(self.window(word))) for c in self.by)
        margin = min(1.0, max(0.0, (ordinary - toxic) / max(1, ordinary - self.whole))) ** 3
        if len(self) < CACHED:
            self[word] = margin
        return margin

    def features(self, text: str | None) -> tuple[float, float]:
        """Largest margin and the sum of the TOP largest, of all words of the text; zeros without words."""
        best = sorted((self[w] for w in WORD.findall((text or "").lower())), reverse=True)[:TOP]
        return (float(best[0]), float(sum(best))) if best else (0.0, 0.0)


def _half(text: str) -> int:
    """Half of a text by its smallest word hash: near copies mostly share it."""
    return min((xxhash.xxh3_64_intdigest(w) for w in set(text.lower().split())), default=0) & 1


def train(docs: DataFrame, labels: DataFrame, train_where: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    """Model of the labelled documents with ``train_where`` true. Null labels, ids and texts teach nothing; an id with
    several labels has its largest. Without examples of both classes, or without any text among them, every score is the
    share of toxic examples."""
    spark = docs.sparkSession
    arrow_batches(spark)
    scratch = Scratch(spark)
    marked = (labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
              .where("doc_id IS NOT NULL AND y IS NOT NULL").groupBy("doc_id").agg(F.max("y").alias("y")).where(train_where))
    sizes = {r["y"]: r["count"] for r in marked.where("y IN (0, 1)").groupBy("y").count().collect()}
    if len(sizes) < 2:
        return Model(b"", b"", None, 1.0 if sizes.get(1) else 0.0)
    share = F.when(F.col("y") == 1, min(1.0, TRAIN_DOCUMENTS / sizes[1])).otherwise(min(1.0, TRAIN_DOCUMENTS / sizes[0]))
    chosen = scratch.keep(marked.where(unit_hash("doc_id", "toxicity-sample") < share), "chosen")
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample = by_ids(only, chosen.select("doc_id"), "doc_id").join(chosen, "doc_id").where("text IS NOT NULL")
    sample = scratch.keep(sample.groupBy(F.md5(F.col("text").cast("binary")).alias("same")).agg(F.first("text").alias("text"), F.max("y").alias("y")), "sample")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(w, y, h) for t, y in zip(part.column("text").to_pylist(), part.column("y").to_pylist())
                        for h in (_half(t),) for w in {"", *WORD.findall(t.lower())}]
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["word", "y", "half"])

    number = lambda y, h: F.count(F.when((F.col("y") == y) & (F.col("half") == h), 1))
    words = scratch.keep(sample.mapInArrow(held, "word string, y int, half int").groupBy("word").agg(
        *[number(y, h).alias(f"n{y}{h}") for y in (0, 1) for h in (0, 1)]), "words")
    all_ = words.where("word = ''").first()
    if all_ is None:  # labelled documents without a text: nothing but the labels to learn from
        scratch.drop()
        return Model(b"", b"", None, sizes[1] / (sizes[0] + sizes[1]))
    n = {(y, h): max(1, all_[f"n{y}{h}"]) for y in (0, 1) for h in (0, 1)}

    def errors(h: int) -> Column:
        a, b = F.col(f"n1{h}") / n[1, h], F.col(f"n0{h}") / n[0, h]
        p = (F.col(f"n1{h}") + F.col(f"n0{h}")) / (n[1, h] + n[0, h])
        return F.when(p < 1, (a - b) / F.sqrt(F.greatest(p * (1 - p), F.lit(1e-12)) * (1 / n[1, h] + 1 / n[0, h]))).otherwise(0.0)

    ranked = words.where("word <> ''").withColumn("e", F.least(errors(0), errors(1)))
    over = ranked.where((F.col("e") >= ERRORS) & (F.col("n10") + F.col("n11") >= LEAST)).orderBy(F.desc("e"), "word").limit(TRAIN_WORDS)
    under = ranked.where("e < 0").orderBy(F.desc(F.col("n00") + F.col("n01")), "word").limit(TRAIN_WORDS)
    toxic, ordinary = [r["word"] for r in over.collect()], [r["word"] for r in under.collect() if len(r["word"]) > 3]
    content = lambda ws: (FRAME + FRAME.join(reversed(ws)) + FRAME).encode()  # noqa: E731  (the strongest last)
    size = max(2000, len(content(toxic)))
    model = Model(content(toxic), content(ordinary)[-size:])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins = model.margins()
        for batch in batches:
            f = [margins.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64())], ["y", "a", "b"])

    rows = sample.mapInArrow(measured, "y int, a double, b double").groupBy("y", "a", "b").count().collect()  # distinct margins: few
    model.weights = calibrated(np.array([[r["y"], r["a"], r["b"], r["count"]] for r in rows], float))
    scratch.drop()
    return model


def calibrated(rows: np.ndarray, steps: int = 200) -> np.ndarray:
    """Logistic weights (bias, a, b) of rows (label, a, b, count): classes count alike, a small penalty keeps them finite."""
    y, x, c = rows[:, 0], np.column_stack([np.ones(len(rows)), rows[:, 1:3]]), rows[:, 3].copy()
    for k in (0, 1):
        c[y == k] /= max(1.0, c[y == k].sum())
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (c * (p - y)) + 1e-4 * w
        bend = (x * (c * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        w = w - np.linalg.solve(bend, slope)
    return np.array([w[0], max(w[1], 0.0), max(w[2], 0.0)])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row over its whole text; null and empty texts have margins of zero."""
    arrow_batches(docs.sparkSession)
    known = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        margins = m.margins() if m.weights is not None else None
        for batch in batches:
            if margins is None:
                out = np.full(batch.num_rows, m.constant)
            else:
                f = np.array([(1.0, *margins.features(t)) for t in batch.column("text").to_pylist()]).reshape(-1, 3)
                out = 1 / (1 + np.exp(-np.clip(f @ m.weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64())], ["doc_id", "score"])

    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return only.mapInArrow(score, "doc_id long, score double")
