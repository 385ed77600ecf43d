"""Best-fit packing with certified repacking.

Documents are cut into pieces of at most one sequence. Pieces are dealt to partitions of bounded size; each is packed
best-fit decreasing, and dual feasible functions give a lower bound on its number of sequences. Where the bound is met
the partition's count is proven. Sequences with gaps give their pieces back: these are dealt anew over fewer
partitions and packed again, as long as that saves sequences and the bound of what is open leaves room.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, arrow_batches, slices, texts
from barloom.llm.tokens import tokenizer

CAPACITY, END_ID = 4096, 1
#: Pieces of one partition: bounds the memory and time of a task.
PIECES_PER_PART = 20_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): ids of each document with the end id, cut only if longer than a
    sequence. Null and empty texts hold the end id alone; every row of docs has its pieces, also without or with a
    repeated id. Empty input gives an empty result; other columns are ignored."""
    arrow_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).ids
        for batch in batches:
            for part in slices(batch, "text"):
                rows: list[tuple] = []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        own = ids[at:at + capacity]
                        rows.append((doc, k, at, len(own), zlib.crc32(own.tobytes()), *([own.tolist()] if with_ids else [])))
                columns = list(zip(*rows))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names[:len(columns)])

    return texts(docs, id_col, text_col).mapInArrow(cut, PIECE_SCHEMA + (", ids array<long>" if with_ids else ""))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences for counts[x] pieces of length x: the best of two families of dual feasible functions.

    The first drops pieces below a and counts those above capacity - a as whole; the second rounds lengths down to
    multiples of 1/(k + 1) scaled by 1/k unless they are such a multiple.
    """
    x = np.arange(capacity + 1, dtype=np.int64)
    if not counts.any():
        return 0
    tokens, number = np.cumsum(counts * x), np.cumsum(counts)
    a = np.arange(0, capacity // 2 + 1)
    below = np.where(a > 0, tokens[np.maximum(a - 1, 0)], 0)
    best = int(np.max(-(-((tokens[capacity - a] - below) + (number[capacity] - number[capacity - a]) * capacity) // capacity)))
    for k in range(1, 101):
        scaled = (k + 1) * x
        exact = scaled % capacity == 0
        value = np.where(exact, x * k, scaled // capacity * capacity)  # times k
        best = max(best, -(-int((counts * value).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of every piece, and the free room of every bin. Ties keep the given order."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r: a bin with r free
    for i in order.tolist():
        size = int(lengths[i])
        fitting = there >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            b = by_room[free].pop()
            if not by_room[free]:
                there &= ~(1 << free)
        else:
            b, free = len(room), capacity
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - free
        room[b] = free - size
        by_room[room[b]].append(b)
        there |= 1 << room[b]
    return bins, offsets, np.array(room, np.int64)


def _packer(capacity: int, tolerated: int) -> Callable[[pa.Table], pa.Table]:
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows.column("length").to_numpy()
        bins, offsets, room = best_fit(lengths, capacity)
        proven = len(room) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        gap = room > (tolerated if proven else 0)
        return (rows.append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets))
                .append_column("gap", pa.array(gap[bins])))
    return pack


def pack(found: DataFrame, scratch: Scratch, capacity: int = CAPACITY, per_part: int = PIECES_PER_PART, rounds: int = 4) -> DataFrame:
    """Pieces with sequence_id and offset. Pieces of a whole sequence's length stand alone. A sequence's pieces lie
    gapless from 0 in order of falling length, then doc_id and piece. An empty table gives an empty result.

    Only a histogram of lengths (at most ``capacity`` numbers) comes to the driver.
    """
    found = scratch.keep(found, "pieces")
    columns = found.columns
    whole = found.where(F.col("length") >= capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = ", ".join(f"{n} {t}" for n, t in found.dtypes) + ", part long, bin long, offset long, gap boolean"

    def once(df: DataFrame, step: int) -> DataFrame:
        parts = max(1, math.ceil(df.count() / per_part))
        key = F.pmod(F.xxhash64(F.lit(step), "doc_id", "piece", "ids_crc32"), F.lit(parts))
        dealt = df.select(*columns, key.alias("part"))
        return scratch.keep(dealt.groupBy("part").applyInArrow(_packer(capacity, capacity // 64), schema), f"packed_{step}")

    def number_of_bins(df: DataFrame) -> int:
        return df.select("part", "bin").distinct().count()

    def bound(df: DataFrame) -> int:
        counts = np.zeros(capacity + 1, np.int64)
        for r in df.groupBy("length").count().collect():
            counts[r["length"]] = r["count"]
        return lower_bound(counts, capacity)

    def numbered(df: DataFrame, step: int) -> DataFrame:
        return df.select(*columns, (F.shiftleft(F.lit(step).cast("long"), 58) + F.shiftleft("part", 30) + F.col("bin")).alias("sequence_id"), "offset")

    out, now = whole, once(found.where(F.col("length") < capacity), 0)
    step = 0
    while step < rounds and (bins := number_of_bins(now.where("gap"))) > bound(now.where("gap")):
        tried = once(now.where("gap").select(*columns), step + 1)
        if number_of_bins(tried) >= bins:
            break
        out = out.unionByName(numbered(now.where("NOT gap"), step))
        step, now = step + 1, tried
    return out.unionByName(numbered(now, step))


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Documents packed into sequences of at most ``capacity`` ids: the rows of ``pieces`` with sequence_id and offset."""
    scratch = Scratch(docs.sparkSession)
    return pack(pieces(docs, tokenizer_path, capacity, end_id, with_ids), scratch, capacity)


def sequences(rows: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths) of packed pieces that carry their ids: at most one sequence's ids a group."""
    piece = F.struct("offset", "doc_id", "length", "ids")
    return (rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
            .select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths")))
