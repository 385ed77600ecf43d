"""Local image descriptors: cropped or edited copies of images.

Corners of the structure tensor are taken at several scales; the intensity centroid of a corner's patch gives its
orientation, and 256 intensity comparisons turned by it its descriptor. Descriptors that agree in one of four 64-bit
words meet in a join (all pairs within Hamming distance 3 do); matches of two images are counted per shift and scale,
and enough of them on one shift are a copy. Images with equal pixels are one class, described once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch, arrow_batches

RADIUS, TURNS, TESTS = 12, 32, 256
#: Corners described per scale, the strongest ones; scales; largest Hamming distance; matches on one shift; its cell.
CORNERS, SCALES, DISTANCE, CONSENSUS, CELL = 32, (1, 2), 32, 5, 4
POINT = "id long, scale int, x double, y double, k0 long, k1 long, k2 long, k3 long"


def _pattern() -> np.ndarray:
    """Offsets (TURNS, TESTS, 2 points, y and x): random pairs in a disc, turned."""
    rng = np.random.default_rng(20)
    r, a = (RADIUS - 2) * np.sqrt(rng.random((TESTS, 2))), 2 * np.pi * rng.random((TESTS, 2))
    turn = 2 * np.pi * np.arange(TURNS)[:, None, None] / TURNS
    return np.rint(np.stack([r * np.sin(a + turn), r * np.cos(a + turn)], axis=-1)).astype(np.int64)


PATTERN = _pattern()
GRID = np.mgrid[-RADIUS + 1:RADIUS, -RADIUS + 1:RADIUS]
DISC = (GRID ** 2).sum(axis=0) < RADIUS ** 2


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over (2 r + 1) squares; edges repeat."""
    p = np.pad(a, r, mode="edge")
    rows = sum(p[i:i + a.shape[0]] for i in range(2 * r + 1))
    return sum(rows[:, i:i + a.shape[1]] for i in range(2 * r + 1)) / (2 * r + 1) ** 2


def describe(image: np.ndarray, corners: int = CORNERS) -> list[tuple]:
    """(scale, x, y, k0..k3) of a grey image; x and y in pixels of the whole image. Images too small have none."""
    out: list[tuple] = []
    for scale in SCALES:
        h, w = (s // scale for s in image.shape)
        if min(h, w) < 2 * RADIUS + 3:
            continue
        a = image[:h * scale, :w * scale].reshape(h, scale, w, scale).mean(axis=(1, 3))
        dy, dx = np.gradient(a)
        xx, yy, xy = _box(dx * dx, 2), _box(dy * dy, 2), _box(dx * dy, 2)
        strength = xx * yy - xy * xy - 0.04 * (xx + yy) ** 2
        inner = strength[RADIUS:h - RADIUS, RADIUS:w - RADIUS]
        around = np.stack([strength[RADIUS + i:h - RADIUS + i, RADIUS + j:w - RADIUS + j] for i in (-1, 0, 1) for j in (-1, 0, 1)]).max(axis=0)
        ys, xs = np.nonzero((inner == around) & (inner > 1e-3))
        best = np.argsort(-inner[ys, xs], kind="stable")[:corners]
        if not len(best):
            continue
        ys, xs = ys[best] + RADIUS, xs[best] + RADIUS
        patch = a[ys[:, None, None] + GRID[0], xs[:, None, None] + GRID[1]] * DISC
        angle = np.arctan2((patch * GRID[0]).sum(axis=(1, 2)), (patch * GRID[1]).sum(axis=(1, 2)))
        at = PATTERN[np.rint(angle / (2 * np.pi) * TURNS).astype(np.int64) % TURNS]
        smooth = _box(a, 1)
        value = smooth[ys[:, None, None] + at[..., 0], xs[:, None, None] + at[..., 1]]
        keys = np.packbits(value[..., 0] < value[..., 1], axis=1).view(np.int64)
        out += [(scale, float(x * scale), float(y * scale), *map(int, k)) for x, y, k in zip(xs, ys, keys)]
    return out


def points(images: DataFrame) -> DataFrame:
    """Descriptors of images (id, width, height, pixels); pixels are grey bytes row by row. Null or wrongly sized pixels
    have none. Other columns are ignored."""
    arrow_batches(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, w, h, p in zip(*(b.column(c).to_pylist() for c in ("id", "width", "height", "pixels"))):
                if p is not None and w and h and len(p) == w * h:
                    rows += [(i, *k) for k in describe(np.frombuffer(p, np.uint8).reshape(h, w).astype(np.float64))]
            cols = list(zip(*rows)) or [()] * 8
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["id", "scale", "x", "y", "k0", "k1", "k2", "k3"])

    return images.select("id", "width", "height", "pixels").mapInArrow(run, POINT)


def classes(images: DataFrame) -> DataFrame:
    """(id, class_id): the smallest id of the images with equal size and pixels. Null pixels are a class of their own
    per row, rows without an id have no class."""
    same = F.when(F.col("pixels").isNotNull(), F.md5(F.col("pixels")))
    marked = images.select("id", "width", "height", same.alias("same"))
    low = marked.where("same IS NOT NULL AND id IS NOT NULL").groupBy("width", "height", "same").agg(F.min("id").alias("class_id"))
    return marked.join(low, ["width", "height", "same"], "left").select("id", F.coalesce("class_id", "id").alias("class_id"))


def copies(queries: DataFrame, images: DataFrame, scratch: Scratch, consensus: int = CONSENSUS) -> DataFrame:
    """(query_id, image_id, inliers): images of which a query image may be a crop or an edit. Both are (id, width,
    height, pixels). Give one image of each class as ``images``, or the pairs repeat for its copies."""
    q, d = scratch.keep(points(queries), "query_points"), scratch.keep(points(images), "image_points")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col(f"k{i}").alias("key")) for i in range(4)]))
    a = q.select("*", keys.alias("e")).select(F.col("e.t").alias("t"), F.col("e.key").alias("key"), *[F.col(c).alias(f"q_{c}") for c in q.columns])
    b = d.select("*", keys.alias("e")).select(F.col("e.t").alias("t"), F.col("e.key").alias("key"), *d.columns)
    apart = sum((F.bit_count(F.col(f"q_k{i}").bitwiseXOR(F.col(f"k{i}"))) for i in range(4)), F.lit(0))
    first = F.coalesce(*[F.when(F.col(f"q_k{i}") == F.col(f"k{i}"), i) for i in range(4)])  # a match comes out of one table only
    met = a.join(b, ["t", "key"]).where((apart <= DISTANCE) & (F.col("t") == first))
    ratio = F.col("scale") / F.col("q_scale")
    shift = [F.floor((F.col(c) - F.col(f"q_{c}") * ratio) / CELL * 2).alias(f"s{c}") for c in ("x", "y")]
    # images with fewer matches than the consensus cannot reach it on one shift
    of_pair = F.count("*").over(Window.partitionBy("query_id", "image_id", "ratio"))
    matches = met.select(F.col("q_id").alias("query_id"), F.col("id").alias("image_id"), ratio.alias("ratio"), "q_scale", "q_x", "q_y", *shift)
    matches = matches.withColumn("matches", of_pair).where(F.col("matches") >= consensus).drop("matches")
    votes = matches.select("query_id", "image_id", "ratio", "q_scale", "q_x", "q_y",
                           F.explode(F.array(*[F.struct((F.col("sx") + i).alias("sx"), (F.col("sy") + j).alias("sy")) for i in (0, 1) for j in (0, 1)])).alias("s"))
    # overlapping cells: matches one cell apart meet in one of the four
    counted = votes.distinct().groupBy("query_id", "image_id", "ratio", "s").agg(F.count("*").alias("n")).where(F.col("n") >= consensus)
    return counted.groupBy("query_id", "image_id").agg(F.max("n").alias("inliers"))


def rendered(vectors: DataFrame, id_col: str, vector_col: str, size: int = 96, waves: int = 14) -> DataFrame:
    """(id, width, height, pixels): grey images drawn from numeric vectors, as sums of waves with mixed weights.
    Null or empty vectors give null pixels."""
    arrow_batches(vectors.sparkSession)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        basis = np.cos(np.pi * np.outer(np.arange(waves), (np.arange(size) + 0.5) / size))
        mixing: dict[int, np.ndarray] = {}
        for b in batches:
            pixels = []
            for v in b.column("vector").to_pylist():
                if not v:
                    pixels.append(None)
                    continue
                m = mixing.setdefault(len(v), np.random.default_rng(len(v)).standard_normal((len(v), waves * waves)))
                field = basis.T @ (np.nan_to_num(np.array([x or 0.0 for x in v])) @ m).reshape(waves, waves) @ basis
                pixels.append(np.clip(128 + 55 * field / max(1e-9, field.std()), 0, 255).astype(np.uint8).tobytes())
            n = pa.array([size] * b.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), n, n, pa.array(pixels, pa.binary())], ["id", "width", "height", "pixels"])

    only = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    return only.mapInArrow(draw, "id long, width int, height int, pixels binary")


def edited(images: DataFrame, part: float = 0.75) -> DataFrame:
    """Crops of images, darker, with less contrast and a patch pasted over; the place depends on the id."""
    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws, hs, ps = [], [], []
            for i, w, h, p in zip(*(b.column(c).to_pylist() for c in ("id", "width", "height", "pixels"))):
                if p is not None:
                    rng = np.random.default_rng(abs(i or 0))
                    a = np.frombuffer(p, np.uint8).reshape(h, w)
                    h, w = int(h * part), int(w * part)
                    y, x = (2 * int(rng.integers(0, (s - t) // 2 + 1)) for s, t in zip(a.shape, (h, w)))
                    a = np.rint(a[y:y + h, x:x + w] * 0.8 + 5).astype(np.uint8)
                    a[2:h // 6, 2:w // 6] = 0
                    p = a.tobytes()
                ws.append(w)
                hs.append(h)
                ps.append(p)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(ws, pa.int32()), pa.array(hs, pa.int32()), pa.array(ps, pa.binary())], ["id", "width", "height", "pixels"])

    return images.mapInArrow(edit, "id long, width int, height int, pixels binary")
