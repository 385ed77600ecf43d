"""Chat formatting as prefix trees.

A turn's node is the digest of all turns up to it, so conversations that share their first turns share nodes. Distinct
conversations are range-sorted by their node paths, which is depth-first order; a node belongs to the first path that
holds it and is emitted there once. A node carries its token ids, the place where it is emitted in its tree, the
position of its first token (tokens of its ancestors) and the intervals of emitted tokens of its ancestors, to which
alone it may attend.

Template: ``<|im_start|>role``, a line break, the text, ``<|im_end|>``, a line break. Control strings in texts get a
backslash after their first character (one more if they have some), which is undone by taking one away.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, arrow_batches

START, END = "<|im_start|>", "<|im_end|>\n"
# Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>",
           "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
MARKED = re.compile("|".join(rf"{re.escape(c[0])}(\\*){re.escape(c[1:])}" for c in CONTROL))
TURN = re.compile(r"<\|im_start\|>((?:[^\n\\]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)
LOSS_ROLE = "assistant"


def escape(text: str) -> str:
    return MARKED.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return MARKED.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == "\\" else m[0], text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


@lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chained(turns: list[dict]) -> list[bytes]:
    """Node of every turn: digest of the node before and the turn."""
    out, at = [], b""
    for t in turns:
        role, text = (t["role"] or "").encode(), (t["text"] or "").encode()
        at = hashlib.blake2b(at + len(role).to_bytes(8, "little") + role + text, digest_size=16).digest()
        out.append(at)
    return out


def paths(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns, nodes): one row per conversation, its turns in order of turn, then role and text."""
    arrow_batches(turns.sparkSession)
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                   F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = [chained(t) for t in b.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nodes, pa.list_(pa.binary()))], [*b.schema.names, "nodes"])

    return whole.mapInArrow(add, "conv_id long, turns array<struct<turn:long,role:string,text:string>>, nodes array<binary>")


def _tokens(ranks_path: str, pattern: str):
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks_path, pattern).encode_ordinary
        for b in batches:
            ids, first, last = [], [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
                head, body, tail = encode(f"{START}{escape_role(role)}\n"), encode(escape(text)), encode(END)
                loss = role == LOSS_ROLE
                ids.append(head + body + tail)
                first.append(len(head) if loss else 0)
                last.append(len(head) + len(body) if loss else 0)
            b = b.drop_columns(["role", "text"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(first, pa.int64()), pa.array(last, pa.int64()),
                                              pa.array([len(x) for x in ids], pa.int64())],
                                             [*b.schema.names, "token_ids", "loss_from", "loss_to", "length"])
    return add


def _ancestors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each path the nodes it owns, with the position and the merged ancestor intervals."""
    for b in batches:
        rows: list[tuple] = []
        for rank, path in zip(b.column("rank").to_pylist(), b.column("path").to_pylist()):
            seen: list[list[int]] = []
            position = 0
            for n in path:
                if n["owner"] == rank:
                    rows.append((n["node"], position, [{"from": x, "to": y} for x, y in seen]))
                if seen and seen[-1][1] == n["start"]:
                    seen[-1][1] += n["length"]
                else:
                    seen.append([n["start"], n["start"] + n["length"]])
                position += n["length"]
        cols = list(zip(*rows)) or [(), (), ()]
        spans = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], spans)], ["node", "position", "ancestors"])


def prefix_trees(turns: DataFrame, ranks_path: str, pattern: str, scratch: Scratch, conv_col: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of conversations given as rows (conv_id, turn, role, text).

    nodes: tree, node, parent, depth, start, position, ancestors, token_ids, loss_from, loss_to, length; start counts
    from 0 in each tree, depth-first without gaps. members: conv_id and its nodes in order. Null roles and texts are
    empty; turns that repeat a number follow in order of role and text; rows without a conversation id are one
    conversation; identical conversations share all nodes. Empty input gives empty tables; other columns are ignored.
    """
    whole = scratch.keep(paths(turns, conv_col), "whole")
    leaf = F.element_at("nodes", -1)
    first = whole.groupBy(leaf.alias("leaf")).agg(F.min(F.coalesce("conv_id", F.lit(-1 << 63))).alias("key"))
    distinct = whole.withColumn("key", F.coalesce("conv_id", F.lit(-1 << 63))).withColumn("leaf", leaf).join(first, ["leaf", "key"])
    sorted_ = distinct.repartitionByRange("nodes").sortWithinPartitions("nodes").withColumn("rank", F.monotonically_increasing_id())
    sorted_ = scratch.keep(sorted_.select("rank", "nodes", "turns"), "sorted")
    steps = sorted_.select("rank", F.col("nodes")[0].alias("tree"), F.posexplode(F.arrays_zip("nodes", "turns")).alias("depth", "x"))
    steps = steps.select("rank", "tree", "depth", F.col("x.nodes").alias("node"), F.col("x.turns.role").alias("role"), F.col("x.turns.text").alias("text"))
    owner = steps.groupBy("node").agg(F.min("rank").alias("owner"))
    mine = steps.join(owner, "node").where("rank = owner").select("tree", "node", "depth", "owner", "role", "text")
    made = scratch.keep(mine.mapInArrow(_tokens(ranks_path, pattern), "tree binary, node binary, depth int, owner long, token_ids array<int>, loss_from long, loss_to long, length long"), "made")
    # depth-first places: within a sorted partition, then over partitions, then from the tree's first
    sized = made.select("tree", "node", "depth", "owner", "length", F.shiftright("owner", 33).alias("part"))
    inside = F.sum("length").over(Window.partitionBy("part").orderBy("owner", "depth")) - F.col("length")
    parts = sized.groupBy("part").agg(F.sum("length").alias("all"))  # one row per partition
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    placed = scratch.keep(sized.withColumn("inside", inside).join(F.broadcast(before), "part").select("tree", "node", "owner", "length", (F.col("inside") + F.col("before")).alias("at")), "placed")
    placed = placed.join(placed.groupBy("tree").agg(F.min("at").alias("first")), "tree").select("node", "owner", "length", (F.col("at") - F.col("first")).alias("start"))
    placed = scratch.keep(placed, "starts")
    chain = steps.select("rank", "depth", "node").join(placed, "node")
    path = chain.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "owner", "start", "length"))).alias("path"))
    spans = path.mapInArrow(_ancestors, "node binary, position long, ancestors array<struct<from:long,to:long>>")
    parent = steps.select("node", "rank", "depth", F.lag("node").over(Window.partitionBy("rank").orderBy("depth")).alias("parent"))
    parent = parent.join(owner, "node").where("rank = owner").select("node", "parent")
    nodes = (made.drop("owner").join(placed.select("node", "start"), "node").join(spans, "node").join(parent, "node"))
    return scratch.keep(nodes, "nodes"), whole.select("conv_id", "nodes")


def read_back(nodes: DataFrame, members: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) decoded from the emitted token ids."""
    steps = members.select("conv_id", F.explode("nodes").alias("node"))
    piece = F.struct("position", "token_ids", "loss_from", "loss_to")
    whole = steps.join(nodes.select("node", "position", "token_ids", "loss_from", "loss_to"), "node").groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoding(ranks_path, pattern).decode_bytes
        for b in batches:
            rows = []
            for pieces in b.column("p").to_pylist():
                text = b"".join(decode(p["token_ids"]) for p in pieces).decode()
                turns = [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(text)]
                loss = "".join(unescape(decode(p["token_ids"][p["loss_from"]:p["loss_to"]]).decode()) for p in pieces if p["loss_to"])
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                             len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                                             ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return whole.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
