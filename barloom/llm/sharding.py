"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal text are linked. Each starts in a shard by hash; in every round the linked documents propose to
move to the shard that holds most of their group, and a shard takes as many bytes as its quota and what leaves it allow;
rounds go on until no move is admitted. A group larger than an eighth of a shard is admitted row by row, so it fills as
few shards as it can. What lies over a shard's even part is given
back, and the documents without links fill the shards up to equal bytes, large ones first.

All sums over shards are taken per (shard, bucket) first; bounded tables of SHARDS * BUCKETS rows are all that is
ordered as one, and the bytes per pair of shards all that comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

SHARDS, BUCKETS, ROW_BYTES = 40, 1024, 16
#: Tasks that handle the bounded tables of (shard, bucket) sums, whatever the session's shuffle partitions are.
SLICES = 8
#: Part of an even shard that linked documents may fill while they move, and the room of a shard open to larger groups.
QUOTA, LEAST_ROOM = 0.95, 0.05


def bucket(*cols: Column | str) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(BUCKETS)).cast("int")


def loads(df: DataFrame, shards: int) -> list[int]:
    """Bytes per shard."""
    held = {r["shard"]: r["b"] for r in df.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    return [int(held.get(i) or 0) for i in range(shards)]


def _admitted(held: DataFrame, target: str, room: list[int]) -> DataFrame:
    """(target, bucket) of held (target, bucket, b) that fit into the room of their target, small buckets first."""
    free = F.array(*[F.lit(int(x)).cast("long") for x in room])
    up_to = F.sum("b").over(Window.partitionBy(target).orderBy("b", "bucket"))
    return held.withColumn("up_to", up_to).where(F.col("up_to") <= F.element_at(free, F.col(target) + 1)).select(target, "bucket")


def _swaps(flows: dict[tuple[int, int], int], load: list[int], cap: list[float]) -> list[int]:
    """Bytes each shard may take when what leaves it makes room: the largest parts of the wishes that keep every cap."""
    shards = range(len(load))
    into = [sum(b for (_, t), b in flows.items() if t == k) for k in shards]
    part = [1.0] * len(load)
    for _ in range(200):
        left = [sum(b * part[t] for (s, t), b in flows.items() if s == k) for k in shards]
        new = [min(part[k], max(0.0, cap[k] - load[k] + left[k]) / into[k]) if into[k] else 1.0 for k in shards]
        if max(x - y for x, y in zip(part, new)) < 1e-6:
            break
        part = new
    return [int(x * b) for x, b in zip(part, into)]


def _flows(held: DataFrame) -> dict[tuple[int, int], int]:
    return {(r["shard"], r["target"]): r["b"] for r in held.repartition(SLICES, "target").groupBy("shard", "target").agg(F.sum("b").alias("b")).collect()}


def propagate(linked: DataFrame, scratch: Scratch, even: float, shards: int) -> DataFrame:
    """linked (rid, g, size, shard, whole, ...) with moved shards, in rounds until no move is admitted. Ties go to the
    shard with the smallest hash for the group.

    Moves are admitted against the room of a shard and what leaves it in the round, so full shards swap. When no swap is
    left, groups turn to the shards that hold room for them. Every move brings rows to where at least as many of their
    group are, so the rounds end."""
    columns, load, swapping, i = linked.columns, loads(linked, shards), True, 0
    while True:
        cap = [max(even * QUOTA, x) for x in load]
        room = [max(0, int(c) - x) for c, x in zip(cap, load)]
        free = F.element_at(F.array(*[F.lit(x).cast("long") for x in room]), F.col("shard") + 1)
        open_ = F.lit(True) if swapping else free >= F.least(F.col("whole"), F.lit(int(even * LEAST_ROOM)))
        votes = linked.groupBy("g", "shard").agg(F.count("*").alias("n"), F.first("whole").alias("whole"))
        best = votes.groupBy("g").agg(F.max(F.when(open_, F.struct("n", F.xxhash64("g", "shard").alias("t"), "shard"))).alias("top"))
        there = votes.select("g", "shard", F.col("n").alias("own_n")).join(best, "g")
        wish = (linked.join(there, ["g", "shard"]).withColumn("target", F.col("top.shard"))
                .withColumn("moves", (F.col("target") != F.col("shard")) & (F.struct("top.n", "top.t") > F.struct("own_n", F.xxhash64("g", "shard"))))
                .withColumn("bucket", F.when(F.col("whole") > even / 8, bucket("g", "rid")).otherwise(bucket("g"))))
        wish = scratch.keep(wish.select(*columns, "target", "moves", "bucket"), f"wish_{i}")
        by_source = wish.where("moves").groupBy("shard", "target", "bucket").agg(F.sum("size").alias("b"))
        by_source = scratch.keep(by_source.repartition(SLICES, "target"), f"moves_{i}")
        held = by_source.repartition(SLICES, "target").groupBy("target", "bucket").agg(F.sum("b").alias("b"))
        wanted, aim, bound = _flows(by_source), cap, [max(even, x) for x in load]
        for attempt in range(8):
            may = _swaps(wanted, load, aim) if swapping and attempt < 7 else room
            yes = scratch.keep(_admitted(held, "target", may), f"yes_{i}_{attempt}")
            flows = _flows(by_source.join(F.broadcast(yes), ["target", "bucket"]))  # at most shards * BUCKETS rows
            after = [x - sum(b for (s, _), b in flows.items() if s == k) + sum(b for (_, t), b in flows.items() if t == k) for k, x in enumerate(load)]
            if all(x <= y for x, y in zip(after, bound)):
                break
            # whole buckets leave less than foreseen: less comes in, at last no more than fits without any swap
            aim = [c - 1.5 * max(0.0, x - y) for c, x, y in zip(aim, after, bound)]
        if not flows:
            if not swapping:
                return linked
            swapping = False
        else:
            moved = wish.join(F.broadcast(yes.withColumn("yes", F.lit(True))), ["target", "bucket"], "left")
            moved = moved.withColumn("shard", F.when(F.col("moves") & F.col("yes"), F.col("target")).otherwise(F.col("shard")))
            linked, load, swapping = scratch.keep(moved.select(*columns), f"linked_{i}"), after, True
            now = f"linked_{i}"
            scratch.drop("start", now)
        i += 1


def fill(pool: DataFrame, scratch: Scratch, held: list[int], even: float, shards: int) -> list[DataFrame]:
    """Documents of the pool dealt to shards in proportion to what these lack, class by class of falling size."""
    pool = scratch.keep(pool.drop("shard").withColumn("class", F.floor(F.log2("size") / 2).cast("int")).withColumn("bucket", bucket("rid")), "pool")
    per = {r["class"]: r["b"] for r in pool.groupBy("class").agg(F.sum("size").alias("b")).collect()}
    out = []
    for c in sorted(per, reverse=True):
        own = pool.where(F.col("class") == c)
        lack = [max(0.0, even - x) for x in held]
        lack = lack if sum(lack) > 0 else [1.0] * shards
        ends, at = [], 0.0
        for x in lack[:-1]:
            at += x / sum(lack) * per[c]
            ends.append(at)
        sums = own.groupBy("bucket").agg(F.sum("size").alias("b"))  # BUCKETS rows
        sums = sums.select("bucket", (F.sum("b").over(Window.orderBy("bucket")) - F.col("b")).alias("before"))
        inside = F.sum("size").over(Window.partitionBy("bucket").orderBy("rid"))
        middle = F.col("before") + inside - F.col("size") / 2
        shard = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("middle"))) if ends else F.lit(0)
        dealt = own.join(F.broadcast(sums), "bucket").withColumn("middle", middle).withColumn("shard", shard)
        dealt = scratch.keep(dealt.drop("class", "bucket", "before", "middle"), f"class_{c}")
        held = [x + y for x, y in zip(held, loads(dealt, shards))]
        out.append(dealt)
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, linked): every row of docs in one of ``shards`` shards of near equal bytes.

    size is the text's UTF-8 bytes plus 16. Null texts are linked with nothing, weigh 16 and have crc 0; empty texts are
    equal texts. slot counts from 0 in each shard without gaps. Rows without or with a repeated id are rows like others.
    Empty input gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col).cast("string")
    facts = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
                        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"), F.md5(text.cast("binary")).alias("g"))
    facts = scratch.keep(facts.withColumn("rid", F.monotonically_increasing_id()), "facts")
    total = facts.agg(F.sum("size").alias("b")).first()["b"] or 0
    even = total / shards
    groups = facts.where("g IS NOT NULL").groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("whole")).where("n > 1").select("g", "whole", F.lit(True).alias("linked"))
    facts = scratch.keep(facts.join(groups, "g", "left").withColumn("linked", F.coalesce("linked", F.lit(False)))
                         .withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int")), "start")
    linked = propagate(facts.where("linked"), scratch, even, shards)
    # whatever lies over an even part is dealt again, whole groups where they are small
    linked = linked.withColumn("bucket", F.when(F.col("whole") > even / 8, bucket("g", "rid")).otherwise(bucket("g")))
    stays = scratch.keep(_admitted(linked.groupBy("shard", "bucket").agg(F.sum("size").alias("b")).repartition(SLICES, "shard"), "shard", [int(even)] * shards).withColumn("stays", F.lit(True)), "stays")
    judged = scratch.keep(linked.join(F.broadcast(stays), ["shard", "bucket"], "left").drop("bucket"), "judged")
    settled = judged.where("stays").drop("stays")
    pool = facts.where("NOT linked").unionByName(judged.where("stays IS NULL").drop("stays"))
    parts = fill(pool, scratch, loads(settled, shards), even, shards)
    for p in parts:
        settled = settled.unionByName(p)
    settled = scratch.keep(settled.withColumn("bucket", bucket("rid")), "settled")
    # slots: rows before the bucket, plus the place in it
    counts = settled.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("shard", "bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("rid")) - 1
    return (settled.join(F.broadcast(before), ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("before") + place).alias("slot"), "linked"))
