"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors with cosine >= t are within squared distance 2 - 2t. Vectors are rotated
(a fixed random rotation) and cut into blocks; of two such vectors some block lies within
its proportional share of that budget. Vectors of a label are dealt to tiles by the signs
of rotated coordinates, so that near vectors mostly share one; a tile knows the least and
largest of each coordinate. Two tiles are joined only if in some block these ranges come
within the block's share. In a joined pair each block is range-joined on its few
coordinates alone, the union of what the blocks find are the candidates, and their cosine
is taken in double precision on the vectors as given. A pair of tiles gives numbers of
links and a spanning forest, never its pairs of vectors.

How much that saves depends on the vectors. The ranges part tiles of clustered vectors;
those of vectors spread evenly in 64 dimensions overlap in some block nearly always (a
block's share is about the deviation of one coordinate), so there only the exact cosines
are saved (of random pairs about 1 in 600 is a candidate at 0.93), and a label's tiles all
meet: bytes sent grow as n * n / TILE for a label of n vectors.

Equal vectors of one label are one class beforehand, whose size counts in n_links; classes
are numbered, and a vector finds its class by 128 bits of hash.
Defined cases: vectors that are null, empty, zero or hold null or non-finite components,
and null labels, link with nothing; vectors of different lengths don't link; repeated
vec_ids stay repeated rows; a null vec_id is in no minimum and not kept;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import components, drop, keep, roots, runs, sole, tune

BLOCK, TILE, STRIPE, SLACK = 8, 2048, 512, 1e-5
CODE_BITS = 20
_rotations: dict[int, np.ndarray] = {}


def rotation(d: int) -> np.ndarray:
    if d not in _rotations:
        _rotations[d] = np.linalg.qr(np.random.Generator(np.random.PCG64(d)).normal(size=(d, d)))[0]
    return _rotations[d]


def cuts(d: int) -> list[tuple[int, int]]:
    """Blocks of about BLOCK dimensions."""
    n = max(1, round(d / BLOCK))
    edges = [d * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:]))


def budgets(d: int, cosine: float) -> list[float]:
    return [(2 - 2 * cosine) * (b - a) / d + SLACK for a, b in cuts(d)]


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times powers of two that keep squares finite (which changes no cosine), and their lengths."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x, np.sqrt((x * x).sum(1))


def rotated(x: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return x / norm[:, None] @ rotation(x.shape[1])


def _spot(r: np.ndarray) -> np.ndarray:
    """In [0, 1): signs as binary digits, a coordinate of each block in turn."""
    order = sorted((c - a, a, c) for a, b in cuts(r.shape[1]) for c in range(a, b))
    out = np.zeros(len(r))
    for k, (_, _, c) in enumerate(order[:CODE_BITS]):
        out += (r[:, c] > 0) * 0.5 ** (k + 1)
    return out


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _spots(batches):
    sole("embedding", lambda: None)
    for batch in batches:
        size = batch["d"].to_numpy()
        spot = np.zeros(len(size))
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            spot[at] = _spot(rotated(*scaled(_vectors(batch["v"].take(pa.array(at)), d))))
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("cls", "d", "label", "n", "v")), pa.array(spot)], names=["cls", "d", "label", "n", "v", "spot"])


_TILE = ["d", "label", "part", "chunk"]
_TILED = "d int, label string, rows int, cls binary, n binary, v binary, low binary, high binary"


def _tiles(batches):
    """One row a tile: its classes, their sizes and vectors, and the range of each rotated coordinate."""
    for table in runs(batches, _TILE):
        table = table.combine_chunks()
        edge = np.zeros(table.num_rows, bool)
        edge[0] = True
        for k in _TILE:
            col = table[k].to_numpy(zero_copy_only=False)
            edge[1:] |= col[1:] != col[:-1]
        heads = np.append(np.flatnonzero(edge), table.num_rows)
        for s, e in zip(heads.tolist(), heads[1:].tolist()):
            t = table.slice(s, e - s)
            d = t["d"][0].as_py()
            x = _vectors(t["v"], d)
            r = rotated(*scaled(x)).astype(np.float32)
            parts = [t["cls"].to_numpy(), t["n"].to_numpy(), x, r.min(0), r.max(0)]
            row = [pa.array([d], pa.int32()), t["label"].combine_chunks().slice(0, 1), pa.array([e - s], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
            yield pa.RecordBatch.from_arrays(row, names=[c.split()[0] for c in _TILED.split(", ")])


def _near_tiles(cosine: float):
    """Those pairs of tiles whose ranges come within the share of some block."""

    def each(batches):
        for b in batches:
            good = []
            for d, *ranges in zip(b["d"].to_pylist(), *(b[c].to_pylist() for c in ("low", "high", "low2", "high2"))):
                low, high, low2, high2 = (np.frombuffer(x, np.float32).astype(float) for x in ranges)
                gap = np.maximum(0, np.maximum(low - high2, low2 - high))
                gap *= gap
                good.append(any(gap[s:e].sum() <= share for (s, e), share in zip(cuts(d), budgets(d, cosine))))
            yield pa.RecordBatch.from_arrays([b["a"], b["b"]], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return each


def links_between(x: np.ndarray, y: np.ndarray | None, cosine: float):
    """Row pairs (i, j) with cosine >= ``cosine`` of x and y, or within x (i < j), stripe by stripe as bool matrices with their first row."""
    d = x.shape[1]
    x, nx = scaled(x)
    rx = rotated(x, nx).astype(np.float32)
    own = y is None
    y, ny = (x, nx) if own else scaled(y)
    ry = rx if own else rotated(y, ny).astype(np.float32)
    blocks = list(zip(cuts(d), budgets(d, cosine)))
    square = lambda r: np.stack([(r[:, s:e] * r[:, s:e]).sum(1) for (s, e), _ in blocks])
    sx, sy = square(rx), square(ry)
    for at in range(0, len(x), STRIPE):
        rows = slice(at, at + STRIPE)
        near = np.zeros((len(x[rows]), len(y)), bool)
        for k, ((s, e), share) in enumerate(blocks):
            near |= rx[rows, s:e] @ ry[:, s:e].T * -2 + sx[k, rows, None] <= np.float32(share) - sy[k][None, :]
        if own:
            near &= np.arange(len(y))[None, :] > np.arange(at, at + len(near))[:, None]
        found = np.count_nonzero(near)
        if not found:
            continue
        unsure = near
        if found > near.size // 16:  # many: all cosines at once, and again as given where that is too close to tell
            c = (x[rows] / nx[rows, None]) @ (y / ny[:, None]).T
            unsure = near & (np.abs(c - cosine) <= 1e-9)
            near &= c >= cosine
            near &= ~unsure
        else:
            near = np.zeros_like(unsure)
        i, j = np.nonzero(unsure)
        for a in range(0, len(i), 1 << 15):
            p, q = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
            fits = (x[p + at] * y[q]).sum(1) / (nx[p + at] * ny[q]) >= cosine
            near[p[fits], q[fits]] = True
        yield at, near


def _links(cosine: float):
    """By pair of tiles: (cls, root, links): links of each class, and a forest."""

    def each(batches):
        sole("embedding", lambda: None)
        for batch in batches:
            for row in batch.to_pylist():
                own, d = row["a"] == row["b"], row["d"]
                part = lambda c, kind: np.frombuffer(row[c], kind)
                x, cls, n = part("v", float).reshape(-1, d), part("cls", np.int64), part("n", np.int64)
                y = None if own else part("v2", float).reshape(-1, d)
                both = cls if own else np.concatenate([cls, part("cls2", np.int64)])
                sizes = n if own else np.concatenate([n, part("n2", np.int64)])
                first = 0 if own else len(x)
                count, top = np.zeros(len(both), np.int64), np.arange(len(both))
                for at, near in links_between(x, y, cosine):
                    i, j = np.nonzero(near)
                    i, j = i + at, j + first
                    count += np.bincount(i, sizes[j], len(both)).astype(np.int64) + np.bincount(j, sizes[i], len(both)).astype(np.int64)
                    top = roots(len(both), np.concatenate([i, np.arange(len(both))]), np.concatenate([j, top]))
                use = np.flatnonzero(count)
                if len(use):
                    yield pa.RecordBatch.from_arrays([pa.array(both[use]), pa.array(both[top[use]]), pa.array(count[use])], names=["cls", "root", "links"])

    return each


def _name(label: Column | str = "label", v: Column | str = "v") -> list[Column]:
    """128 bits of a label and vector."""
    return [F.xxhash64(F.lit(salt), label, v).alias(f"h{salt}") for salt in (1, 2)]


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector of (vec_id, embedding, label)."""
    tune(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("v"), F.col("label").cast("string").alias("label"))
    sound = F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("sound", sound)
    classes = rows.where("sound").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = keep(classes.withColumn("cls", F.monotonically_increasing_id()).withColumn("d", F.size("v")))
    spots = keep(classes.mapInArrow(_spots, "cls long, d int, label string, n long, v array<double>, spot double"))
    many = spots.groupBy("d", "label").agg(F.ceil(F.count("*") / F.lit(tile)).alias("parts"))
    spots_ = spots.join(many, ["d", "label"]).withColumn("part", F.floor(F.col("spot") * F.col("parts")).cast("long")).drop("spot", "parts")
    full = spots_.groupBy("d", "label", "part").agg(F.ceil(F.count("*") / F.lit(tile)).cast("long").alias("chunks"))
    dealt = spots_.join(full, ["d", "label", "part"]).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks"))).drop("chunks")
    tiles = dealt.repartition(*_TILE).sortWithinPartitions(*_TILE).mapInArrow(_tiles, _TILED)
    tiles = keep(tiles.withColumn("tile", F.monotonically_increasing_id()))
    one = tiles.select("d", "label", F.col("tile").alias("a"), "low", "high")
    two = tiles.select("d", "label", F.col("tile").alias("b"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    pairs = keep(one.join(two, ["d", "label"]).where("a <= b").mapInArrow(_near_tiles(cosine), "a long, b long"))
    left = tiles.select(F.col("tile").alias("a"), "d", "cls", "n", "v")
    right = tiles.select(F.col("tile").alias("b"), F.col("cls").alias("cls2"), F.col("n").alias("n2"), F.col("v").alias("v2"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", "d", "cls", "n", "v", "cls2", "n2", "v2")
    found = keep(met.mapInArrow(_links(cosine), "cls long, root long, links long"))
    drop(spots, tiles, pairs)
    counts = keep(found.groupBy("cls").agg(F.sum("links").alias("links")))
    joined = keep(components(found.select(F.col("cls").alias("a"), F.col("root").alias("b"))))
    of = classes.select(*_name(), "cls", "rep", "n").join(counts, "cls", "left").join(joined, F.col("cls") == F.col("node"), "left")
    of = keep(of.select("h1", "h2", "rep", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "cls").alias("comp")))
    least = keep(of.groupBy("comp").agg(F.min("rep").alias("component_id")))
    of = keep(of.join(least, "comp").select("h1", "h2", "n_links", "component_id"))
    names = [F.when(F.col("sound"), h).alias(f"h{k}") for k, h in enumerate(_name(), 1)]
    out = rows.select("vec_id", *names).join(of, ["h1", "h2"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
