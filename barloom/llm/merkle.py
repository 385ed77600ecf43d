"""Merkle manifest of a dataset: levels built page by page into parent-linked rows, proofs by a recursive query.

A page spans ``page`` levels: a node and the up to ``2 ** page`` nodes below it. Every lower node is one row that holds
its siblings on the way up and links to the upper node. The climb is one Spark recursive query: it starts at every
leaf, and each step joins the linked row, appends that row's siblings and folds the hash through them.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

PAGE = 10
#: Rows of a lookup table (some 60 bytes each) that are broadcast after counting them.
LOOKUP_ROWS = 200_000
ROOT_TREE, ROOT = -1, "root"
NODES = ("tree long, level int, pos long, height int, doc_id long, hash string, start string, siblings array<binary>, "
         "node string, parent string")
ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


def field(col: Column) -> Column:
    """`-` for null, else byte count, colon, value."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]), 256)


def positions(df: DataFrame, order: list[str], within: str, scratch: Scratch, tag: str) -> DataFrame:
    """df with ``pos`` (place in its group ``within`` by ``order``, from 0) and ``height`` (levels above the group's leaves).

    Rows are range-sorted, so a group of any size lies over many partitions; places count from the group's first row in
    the partition, plus its rows in partitions before. Rows equal in all of ``order`` are spread by a salt: their order
    among each other changes nothing.
    """
    salted = df.withColumn("salt", F.monotonically_increasing_id() % 64)
    ranged = salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").drop("salt")
    rows = scratch.keep(ranged.withColumn("rid", F.monotonically_increasing_id()), tag)
    rows = rows.withColumn("part", F.shiftright("rid", 33))
    counts = rows.groupBy(F.col(within).alias("g"), F.col("part").alias("p")).agg(F.min("rid").alias("first"), F.count("*").alias("k"))
    whole = F.sum("k").over(Window.partitionBy("g"))
    before = F.sum("k").over(Window.partitionBy("g").orderBy("p")) - F.col("k")
    height = F.when(whole > 1, F.length(F.bin(whole - 1))).otherwise(0).cast("int")
    spans = scratch.keep(counts.select("g", "p", (before - F.col("first")).alias("shift"), height.alias("height")), f"{tag}_spans")
    side = F.broadcast(spans) if spans.count() <= LOOKUP_ROWS else spans
    return (rows.join(side, F.col(within).eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
            .withColumn("pos", F.col("rid") + F.col("shift")).drop("g", "p", "part", "rid", "shift"))


def _page(table: pa.Table, page: int) -> pa.Table:
    """Rows of one page's lower nodes with siblings and link, and one row for the node they come to (no siblings)."""
    rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
    first = rows[0]
    tree, level, height = first["tree"], first["level"], first["height"]
    steps = min(page, height - level)
    run, start = [r["hash"] for r in rows], rows[0]["pos"]
    siblings: list[list[bytes | None]] = [[] for _ in rows]
    for step in range(steps):
        for i, r in enumerate(rows):
            at = ((r["pos"] >> step) ^ 1) - (start >> step)
            siblings[i].append(bytes.fromhex(run[at]) if at < len(run) else None)
        run = [hashlib.sha256("".join(run[i:i + 2]).encode()).hexdigest() for i in range(0, len(run), 2)]
    top = {"tree": tree, "level": level + steps, "pos": start >> steps, "height": height, "doc_id": None, "hash": run[0],
           "start": None, "siblings": None, "node": None, "parent": None}
    if top["level"] < height:
        parent = f"{tree}:{top['level']}:{top['pos']}"
    else:
        parent = ROOT if tree == ROOT_TREE else f"{ROOT_TREE}:0:{tree}"
    out = [r | {"siblings": s, "node": f"{tree}:{level}:{r['pos']}", "parent": parent} for r, s in zip(rows, siblings)]
    return pa.Table.from_pylist([*out, top], schema=_arrow_schema())


def _arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in NODES.split(", "))])


def levels(leaves: DataFrame, scratch: Scratch, tag: str, page: int = PAGE) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """Rows of the leaves, rows of the upper levels, and (tree, subroot), from leaves (tree, pos, height, doc_id, hash, start).

    Each round folds one page of levels in groups of at most ``2 ** page`` rows, so rounds grow with the logarithm of
    the largest tree, and no group with a tree.
    """
    frontier = leaves.withColumn("level", F.lit(0))
    tables, tops = [], []
    while True:
        plain = frontier.select("tree", F.col("level").cast("int").alias("level"), "pos", "height", "doc_id", "hash", "start")
        made = plain.groupBy("tree", F.expr(f"shiftright(pos, {page})")).applyInArrow(lambda t: _page(t, page), NODES)
        made = scratch.keep(made, f"{tag}_{len(tables)}")
        tables.append(made.where("siblings IS NOT NULL"))
        ends = made.where("siblings IS NULL")
        tops.append(ends.where("level = height").select("tree", F.col("hash").alias("subroot")))
        frontier = ends.where("level < height")
        if frontier.isEmpty():
            break
    subroots = tops[0]
    for t in tops[1:]:
        subroots = subroots.unionByName(t)
    return tables[0], tables[1:], subroots


CLIMB = """
WITH RECURSIVE climb(doc_id, tree, leaf, node, folded, proof) AS (
  SELECT doc_id, tree, leaf, parent, {fold_start}, {append_start} FROM {leaves}
  UNION ALL
  SELECT c.doc_id, c.tree, c.leaf, n.parent, {fold_next}, {append_next}
  FROM climb c JOIN {nodes} n ON c.node = n.node)
SELECT doc_id, tree, leaf, folded, proof FROM climb WHERE node = 'root'
"""


def _fold(hash_: str, siblings: str, pos: str) -> str:
    """The hash folded through the siblings: one stands to the left where the bit of the position is set."""
    step = ("CASE WHEN s IS NULL THEN sha2(a.h, 256) WHEN a.p % 2 = 1 THEN sha2(concat(lower(hex(s)), a.h), 256) "
            "ELSE sha2(concat(a.h, lower(hex(s))), 256) END")
    return f"aggregate({siblings}, named_struct('h', {hash_}, 'p', {pos}), (a, s) -> named_struct('h', {step}, 'p', shiftright(a.p, 1)), a -> a.h)"


def _append(proof: str, siblings: str) -> str:
    return f"aggregate({siblings}, {proof}, (a, s) -> concat(a, coalesce(s, X'')))"


def manifest(docs: DataFrame, tamper: Column, page: int = PAGE, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of documents.

    ``tamper`` marks the rows of docs whose leaf enters the climb with n_chars one higher (null n_chars stays).
    Null fields are `-` in the leaf, rows without a language make a tree of their own, which comes first, and rows
    without doc_id come first in their tree; rows that repeat a doc_id are ordered by leaf, and equal rows are equal
    leaves. A language with one row has that leaf as subroot. No documents give an empty result. Other columns are
    ignored. Levels, siblings and proofs are rows of tables; nothing but counts passes the driver.
    """
    spark, scratch = docs.sparkSession, scratch or Scratch(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text",
                      F.coalesce(tamper, F.lit(False)).alias("tampered"))
    c = [F.col(n) for n in ("doc_id", "source", "lang")]
    true = leaf(*c, F.col("n_chars"), F.col("text"))
    changed = leaf(*c, F.col("n_chars").cast("decimal(20,0)") + 1, F.col("text"))
    rows = own.select("doc_id", "lang", true.alias("hash"), F.when(F.col("tampered") & F.col("n_chars").isNotNull(), changed).alias("start"))
    rows = positions(rows, ["lang", "doc_id", "hash"], "lang", scratch, "leaves")
    rows = scratch.keep(rows, "placed")
    langs = positions(rows.select("lang").distinct().withColumn("all", F.lit(0)), ["lang"], "all", scratch, "langs")
    langs = scratch.keep(langs.select(F.col("lang").alias("l"), F.col("pos").alias("tree"), F.col("height").alias("root_height")), "trees")
    few = langs.count()
    if not few:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    side = F.broadcast(langs) if few <= LOOKUP_ROWS else langs
    placed = rows.join(side, F.col("lang").eqNullSafe(F.col("l"))).drop("l", "lang")
    first, upper, subroots = levels(placed, scratch, "level", page)
    heads = langs.join(subroots, "tree").select(F.lit(ROOT_TREE).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("root_height").alias("height"),
                                                F.lit(None).cast("long").alias("doc_id"), F.col("subroot").alias("hash"), F.lit(None).cast("string").alias("start"))
    low, high, root = levels(heads, scratch, "root", page)
    for more in [low, *high]:
        upper = [*upper, more]
    nodes = upper[0]
    for more in upper[1:]:
        nodes = nodes.unionByName(more)
    nodes = scratch.keep(nodes.select("node", "parent", "pos", "siblings"), "nodes")
    leaves = first.select("doc_id", "tree", F.unhex("hash").alias("leaf"), F.coalesce("start", "hash").alias("start"), "pos", "siblings", "parent")
    text = CLIMB
    for name, value in {"fold_start": _fold("start", "siblings", "pos"), "append_start": _append("X''", "siblings"),
                        "fold_next": _fold("c.folded", "n.siblings", "n.pos"), "append_next": _append("c.proof", "n.siblings")}.items():
        text = text.replace("{" + name + "}", value)
    limit = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, -1)  # rows of all steps together; the default stops at a million
    try:
        climbed = scratch.keep(spark.sql(text, leaves=leaves, nodes=nodes), "climbed")
    finally:
        spark.conf.set(ROW_LIMIT, limit)
    top = root.first()["subroot"]
    subs = scratch.keep(subroots, "subroots")
    subs = F.broadcast(subs) if few <= LOOKUP_ROWS else subs
    return climbed.join(subs, "tree").select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), "subroot", F.lit(top).alias("root"), F.sha2(F.lower(F.hex("proof")), 256).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.lit(top)).alias("verified"))


# DuckDB has no crc32: the table of the 256 bytes' remainders, and its walk over the bytes of a string.
CRC_TABLE = """tab AS (SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t
  FROM range(256) r(i))"""


def crc_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of a string of code points below 2048; needs `tab` in scope."""
    points = f"list_transform(string_split({text}, ''), lambda c: unicode(c)::BIGINT)"
    units = f"flatten(list_transform({points}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
    return f"xor(list_reduce({units}, lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


def _field_sql(col: str) -> str:
    return f"coalesce(strlen(({col})::VARCHAR)::VARCHAR || ':' || ({col})::VARCHAR, '-')"


def manifest_sql() -> str:
    def leaf_sql(n: str) -> str:
        return "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", n, "text")) + ")"
    return f"""
WITH RECURSIVE {CRC_TABLE},
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM (
  SELECT doc_id, lang, {leaf_sql('n_chars')} AS leaf,
    CASE WHEN {crc_sql('doc_id::VARCHAR')} % 7 = 0 THEN {leaf_sql('n_chars + 1')} END AS start FROM documents, tab)),
own AS (SELECT lang, 0 AS level, pos, leaf AS hash FROM leaves
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(hash || coalesce(after, '')) FROM (
    SELECT *, lead(hash) OVER (PARTITION BY lang ORDER BY pos) AS after, count(*) OVER (PARTITION BY lang) AS n FROM own) WHERE n > 1 AND pos % 2 = 0),
subs AS (SELECT lang, max(level) AS height, max_by(hash, level) AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM own GROUP BY lang),
high AS (SELECT 0 AS level, tree AS pos, subroot AS hash FROM subs
  UNION ALL
  SELECT level + 1, pos // 2, sha256(hash || coalesce(after, '')) FROM (
    SELECT *, lead(hash) OVER (ORDER BY pos) AS after, count(*) OVER () AS n FROM high) WHERE n > 1 AND pos % 2 = 0),
low AS (SELECT doc_id, lang, pos AS place, 0 AS level, pos, coalesce(start, leaf) AS folded, '' AS proof FROM leaves
  UNION ALL
  SELECT c.doc_id, c.lang, c.place, c.level + 1, c.pos // 2,
    sha256(CASE WHEN c.pos % 2 = 1 THEN s.hash || c.folded ELSE c.folded || coalesce(s.hash, '') END), c.proof || coalesce(s.hash, '')
  FROM low c JOIN subs t ON t.lang IS NOT DISTINCT FROM c.lang AND c.level < t.height
  LEFT JOIN own s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.pos = xor(c.pos, 1)),
up AS (SELECT c.doc_id, c.lang, c.place, t.subroot, 0 AS level, t.tree AS pos, c.folded, c.proof
  FROM low c JOIN subs t ON t.lang IS NOT DISTINCT FROM c.lang AND c.level = t.height
  UNION ALL
  SELECT c.doc_id, c.lang, c.place, c.subroot, c.level + 1, c.pos // 2,
    sha256(CASE WHEN c.pos % 2 = 1 THEN s.hash || c.folded ELSE c.folded || coalesce(s.hash, '') END), c.proof || coalesce(s.hash, '')
  FROM up c LEFT JOIN high s ON s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.level < (SELECT max(level) FROM high)),
root AS (SELECT max_by(hash, level) AS root FROM high)
SELECT u.doc_id, l.leaf, u.subroot, root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = root AS verified
FROM up u JOIN leaves l ON l.lang IS NOT DISTINCT FROM u.lang AND l.pos = u.place, root WHERE u.level = (SELECT max(level) FROM high)"""
