"""Spelling variants: words one edit apart, found in tries over the words' letter-group counts.

A word's vector counts its letters by group, in fixed order. An inserted letter adds one to one count, a deleted one
takes one away, a replaced one may do both: so a word one edit away lies in the trie of vectors where a depth-first
search with a surplus and a deficit of one each ends. Leaf words are verified letter by letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from barloom.llm.common import Scratch, arrow_batches
from barloom.llm.merkle import CRC_TABLE, crc_sql

RUN = re.compile("[A-Za-zÀ-ÿ]{5,}")  # shorter runs make no word of five letters
BREAK = re.compile("[^A-Za-zÀ-ÿ]")
PIECE, TASK_WORDS = 1 << 22, 200_000
MIN_LETTERS, MIN_COUNT, TYPO = 5, 3, 97
#: Letter groups of near equal frequency in European texts; all other letters make the last group.
GROUPS = ("e", "a", "i", "nm", "r", "s", "t", "ou", "ld", "cpb")
DEPTHS = len(GROUPS) + 1
#: Words in the trie of one task, and rows of a lookup table that are broadcast after counting them.
TRIE_WORDS, LOOKUP_ROWS = 20_000, 200_000
PAIRS, CELLS = 1 << 18, 1 << 23


def _pieces(text: str) -> Iterator[str]:
    """Parts of a text of some four million characters, cut where no run of letters is cut."""
    start = 0
    while len(text) - start > PIECE:
        cut = BREAK.search(text, start + PIECE)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])
        words.clear()
        return out

    for batch in batches:
        for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = raw.as_py()
            if not text:
                continue
            seed = zlib.crc32(b"%d:" % doc_id if doc_id is not None else b":")
            for piece in _pieces(text):
                found = Counter(RUN.findall(piece.encode().lower().decode()))  # bytes know A-Z alone
                for run, k in found.items():
                    h = zlib.crc32(run.encode(), seed)
                    if h % TYPO == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < MIN_LETTERS:
                            continue
                    words[run] += k
                if len(words) > TASK_WORDS:
                    yield flush()
    if words:
        yield flush()


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least five letters found at least three times in all texts."""
    arrow_batches(docs.sparkSession)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(_count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _group_of() -> np.ndarray:
    table = np.full(256, len(GROUPS), np.int64)
    for i, letters in enumerate(GROUPS):
        table[[ord(c) for c in letters]] = i
    return table


def _vectors(words: list[bytes]) -> np.ndarray:
    """Counts by letter group, one row a word (Latin-1 bytes)."""
    sizes = np.array([len(w) for w in words], np.int64)
    at = np.repeat(np.arange(len(words)), sizes) * DEPTHS + _group_of()[np.frombuffer(b"".join(words), np.uint8)]
    return np.bincount(at, minlength=len(words) * DEPTHS).reshape(-1, DEPTHS).astype(np.int32)


def _with_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            v = _vectors([w.encode("latin-1") for w in batch.column("word").to_pylist()])
            lists = pa.ListArray.from_arrays(np.arange(0, v.size + 1, DEPTHS, dtype=np.int32), v.ravel())
            yield pa.record_batch([batch.column("word"), batch.column("n"), lists], ["word", "n", "vector"])


@F.udf(ArrayType(ArrayType(IntegerType())))
def _within_budget(prefix):
    """The prefix itself and all that differ by a surplus of one, a deficit of one, or one of each."""
    out = {tuple(prefix)}
    for i in [None, *range(len(prefix))]:
        for j in [None, *range(len(prefix))]:
            if i != j or i is None:
                near = list(prefix)
                if i is not None:
                    near[i] += 1
                if j is not None:
                    near[j] -= 1
                if min(near) >= 0:
                    out.add(tuple(near))
    return [list(p) for p in out]


class _Verify:
    """Pairs of words kept until there are many, then compared letter by letter in one go."""

    def __init__(self, words: list[bytes], queries: list[bytes]):
        self.words, self.queries = self._packed(words), self._packed(queries)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.found = 0, [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    @staticmethod
    def _packed(words: list[bytes]):
        sizes = np.array([len(w) for w in words], np.int64)
        return np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes

    def add(self, w: np.ndarray, q: np.ndarray) -> None:
        self.pairs.append((w, q))
        self.held += len(w)
        if self.held >= PAIRS:
            self.flush()

    def flush(self) -> None:
        if not self.pairs:
            return
        w, q = (np.concatenate([p[i] for p in self.pairs]) for i in (0, 1))
        self.pairs, self.held = [], 0
        shape = self.words[2][w] * 4 + self.queries[2][q] - self.words[2][w] + 1
        order = np.argsort(shape, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shape[order])) + 1):
            step = max(1, CELLS // int(self.words[2][w[part[0]]] + 1))
            for i in range(0, len(part), step):
                a, b = w[part[i:i + step]], q[part[i:i + step]]
                keep = self._near(a, b)
                self.found.append((a[keep], b[keep]))

    def _near(self, w: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exactly one edit apart; all words of w have one length, and all of q."""
        a, b = ((letters[starts[i][:, None] + np.arange(sizes[i[0]])]) for (letters, starts, sizes), i in ((self.words, w), (self.queries, q)))
        if a.shape[1] == b.shape[1]:
            return (a != b).sum(1) == 1
        if a.shape[1] < b.shape[1]:
            a, b = b, a
        short = b.shape[1]
        head = np.logical_and.accumulate(a[:, :short] == b, axis=1).sum(1)
        tail = np.logical_and.accumulate((a[:, 1:] == b)[:, ::-1], axis=1).sum(1)
        return head + tail >= short


def _half_matches(words: list[bytes], queries: list[bytes], w: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a large leaf that agree in their first or in their second half: one edit leaves one half untouched."""
    size = len(words[w[0]])
    for length in (size - 1, size, size + 1):
        own = [i for i in q.tolist() if len(queries[i]) == length]
        if not own:
            continue
        h, rest = min(size, length) // 2, min(size, length) - min(size, length) // 2
        for part in (lambda x: x[:h], lambda x: x[len(x) - rest:]):
            index: dict[bytes, list[int]] = {}
            for i in w.tolist():
                index.setdefault(part(words[i]), []).append(i)
            pairs = []
            for j in own:
                for i in index.get(part(queries[j]), ()):
                    pairs.append((i, j))
                if len(pairs) > PAIRS:
                    yield tuple(np.array(pairs, np.int64).T)
                    pairs = []
            if pairs:
                yield tuple(np.array(pairs, np.int64).T)


def near_pairs(words: list[bytes], queries: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (word, query) exactly one edit apart, by depth-first search of the words' trie with all queries at once."""
    vec, qvec = _vectors(words), _vectors(queries)
    order = np.lexsort(vec.T[::-1])
    vec = vec[order]
    check = _Verify(words, queries)
    all_q = np.arange(len(queries))
    full = np.ones(len(queries), bool)
    stack = [(0, len(words), 0, all_q, full, full)]
    while stack:
        lo, hi, level, q, surplus, deficit = stack.pop()
        if hi - lo == 1 or level == DEPTHS:  # one path left: its remaining counts at once
            d = vec[lo, level:] - qvec[q, level:]
            up, down = (d > 0).sum(1), (d < 0).sum(1)
            q = q[(np.abs(d) <= 1).all(1) & (up <= surplus) & (down <= deficit)]
            if len(q) and (hi - lo) * len(q) > 1 << 14:
                for w, own in _half_matches(words, queries, order[lo:hi], q):
                    check.add(w, own)
            elif len(q):
                check.add(np.repeat(order[lo:hi], len(q)), np.tile(q, hi - lo))
            continue
        counts = vec[lo:hi, level]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(counts)) + 1, [hi - lo]])
        for a, b in zip(starts[:-1], starts[1:]):
            d = counts[a] - qvec[q, level]
            ok = (d == 0) | ((d == 1) & surplus) | ((d == -1) & deficit)
            if ok.any():
                d = d[ok]
                stack.append((lo + a, lo + b, level + 1, q[ok], surplus[ok] & (d != 1), deficit[ok] & (d != -1)))
    check.flush()
    found = np.unique(np.stack([np.concatenate([f[i] for f in check.found]) for i in (0, 1)]), axis=1)
    return found[0], found[1]


def _cell(table: pa.Table) -> pa.Table:
    """Near words of the queries of one cell: their number, and the one with the largest n (ties: the first)."""
    asked = np.array(table.column("asked").to_pylist(), bool)
    text = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    n = np.array(table.column("n").to_pylist(), np.int64)
    own, q = np.flatnonzero(~asked), np.flatnonzero(asked)
    words, queries = [text[i] for i in own], [text[i] for i in q]
    w, j = near_pairs(words, queries) if len(own) and len(q) else (np.zeros(0, np.int64),) * 2
    rank = np.empty(len(words), np.int64)  # place by falling n, then by code points
    rank[sorted(range(len(words)), key=lambda i: (-n[own[i]], words[i]))] = np.arange(len(words))
    order = np.lexsort((rank[w], j))
    w, j = w[order], j[order]
    first = np.flatnonzero(np.r_[True, np.diff(j) > 0]) if len(j) else np.zeros(0, np.int64)
    return pa.table({"word": pa.array([queries[i].decode("latin-1") for i in j[first]], pa.string()),
                     "n_near": pa.array(np.diff(np.r_[first, len(j)]), pa.int64()),
                     "best_n": pa.array(n[own[w[first]]], pa.int64()),
                     "best": pa.array([words[i].decode("latin-1") for i in w[first]], pa.string())})


def _lookup(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= LOOKUP_ROWS else df


def nearest(words: DataFrame, scratch: Scratch, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of every word with a near one, from distinct (word, n).

    The trie is cut at the depth from which no branch holds more than ``trie_words`` words; each branch is one task's
    trie, and a word is asked in all branches within its budget. Words of one vector beyond that bound are split by
    hash, as are the words asked in a branch, so no task holds more than the bound and eight times it.
    """
    words = scratch.keep(words.select("word", "n").mapInArrow(_with_vectors, "word string, n long, vector array<int>"), "vectors")
    deep = words.select(F.explode(F.sequence(F.lit(1), F.lit(DEPTHS))).alias("d"), "vector")
    sizes = deep.groupBy("d", F.slice("vector", F.lit(1), F.col("d")).alias("p")).agg(F.count("*").alias("k"))
    largest = {r["d"]: r["k"] for r in sizes.groupBy("d").agg(F.max("k").alias("k")).collect()}
    depth = next((d for d in range(1, DEPTHS) if largest.get(d, 0) <= trie_words), DEPTHS)
    words = words.select("word", "n", F.slice("vector", 1, depth).alias("prefix"))
    branches = scratch.keep(words.groupBy("prefix").agg(F.count("*").alias("k")), "branches")
    routes = branches.select(F.col("prefix").alias("at"), F.col("k").alias("asked"), F.explode(_within_budget("prefix")).alias("prefix"))
    routes = routes.join(branches, "prefix")
    arrivals = routes.groupBy("prefix").agg(F.sum("asked").alias("asked"))
    parts = branches.join(arrivals, "prefix").select("prefix", F.ceil(F.col("k") / trie_words).alias("wk"), F.ceil(F.col("asked") / (8 * trie_words)).alias("qk"))
    parts = scratch.keep(parts, "parts")
    routes = scratch.keep(routes.select("at", "prefix").join(parts, "prefix"), "routes")
    bucket = F.xxhash64("word")
    held = words.join(_lookup(parts), "prefix").select(
        "prefix", F.pmod(bucket, F.col("wk")).alias("wb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("qk") - 1)).alias("qb"), "word", "n", F.lit(False).alias("asked"))
    asked = words.join(_lookup(routes).withColumnRenamed("prefix", "to"), F.col("prefix") == F.col("at")).select(
        F.col("to").alias("prefix"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("wk") - 1)).alias("wb"), F.pmod(bucket, F.col("qk")).alias("qb"), "word", "n", F.lit(True).alias("asked"))
    found = held.unionByName(asked).groupBy("prefix", "wb", "qb").applyInArrow(lambda t: _cell(t), "word string, n_near long, best_n long, best string")
    best = F.min(F.struct(F.negative("best_n").alias("m"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.negative("b.m").alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of every word that is some word's form, from (word, form) with form null at the end of a chain.

    A form is found at least twice as often as its word, so chains end; each round replaces a target by its target's
    target, which halves what is left.
    """
    named = forms.where("form IS NOT NULL").select(F.col("form").alias("word")).distinct()
    at = scratch.keep(named.join(forms, "word").select("word", F.coalesce("form", "word").alias("root")), "roots")
    step = 0
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = scratch.keep(at.join(_lookup(further), "root").select("word", "root", "next"), f"roots_{step}")
        at = new.select("word", F.col("next").alias("root"))
        step += 1
        if new.where("root <> next").isEmpty():
            return at


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_words: int = TRIE_WORDS,
             scratch: Scratch | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the texts; see ``vocabulary`` for what a word is.

    form is the near word of largest n (ties: first in code-point order) if that n is at least twice the word's; root
    follows forms to the last. Null and empty texts hold no words; a null id counts as empty in the typo rule; rows that
    repeat count again. Texts of any length are read in pieces cut between words. No words give an empty result. Other
    columns are ignored.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    words = scratch.keep(vocabulary(docs, id_col, text_col), "words")
    found = scratch.keep(nearest(words, scratch, trie_words), "near")
    enough = F.col("best_n") >= 2 * F.col("n")
    formed = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))
    formed = scratch.keep(formed, "forms")
    ends = roots(formed.select("word", "form"), scratch).select(F.col("word").alias("form"), "root")
    return formed.join(_lookup(ends), "form", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql() -> str:
    return f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, run, count(*) AS k FROM (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (SELECT run, k, {crc_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM runs, tab),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (
  SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
ends AS (SELECT DISTINCT c.word AS longer, w.word AS shorter, c.n AS ln, w.n AS sn FROM cut c JOIN words w ON w.word = c.a || c.b),
pairs AS (SELECT longer AS word, shorter AS other, sn AS other_n FROM ends UNION ALL SELECT shorter, longer, ln FROM ends
  UNION ALL SELECT x.word, y.word, y.n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS top FROM pairs GROUP BY word),
named AS (SELECT b.word, n_near, top, min(p.other) AS other FROM best b JOIN pairs p ON p.word = b.word AND p.other_n = b.top GROUP BY b.word, n_near, top),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN other END AS form, CASE WHEN top >= 2 * n THEN top END AS form_n
  FROM words w LEFT JOIN named USING (word)),
walk AS (SELECT word, word AS at FROM forms UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at AND f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk r ON r.word = f.word
JOIN forms e ON e.word = r.at AND e.form IS NULL"""
