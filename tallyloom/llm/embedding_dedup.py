"""Near-duplicate embeddings: PCA-ordered tiled comparison.

Unit vectors are rotated onto the principal axes of a bounded sample, so that leading dimensions hold most of the
variance.  A tile pair accumulates inner products over the leading dimensions first; the residual of a pair is at most
the product of the two suffix norms, and pairs whose bound cannot reach the threshold stop there.  Survivors go on
through the next dimensions, and the last ones are decided by the cosine of the original vectors in double precision.
The rotation only decides how early pairs stop, never which pairs are found.

Distribution: equal vectors form a class with a count.  Classes are put into cells of the two leading coordinates, as
wide as two linked vectors can be apart, so that links lie within a cell or between neighbours; cells are split into
tiles of about `tile_bytes` by hash, however many a cell holds.  A tile travels once for each of its tile pairs, in the
element type of the input; a task holds two tiles at a time and returns one row for each linked vector of the pair
(number of links, smallest linked-to member of its local component), never the links.

Cost: the number of tile pairs follows the cells.  Where the spectrum falls off quickly few cells are neighbours; where
vectors point everywhere alike most cells are, and all tiles are compared: no partition of such vectors keeps links of
cosine 0.9 together, since two unrelated vectors are hardly further apart in any few coordinates than linked ones may be.

Nulls and odd cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
neither do vectors of different lengths, nor rows with a null vec_id (component_id null, kept true); rows that share a
vec_id are one node and each of them counts as a vector; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch
from tallyloom.llm.components import components


def principal_axes(sample: list[np.ndarray]) -> dict[int, np.ndarray]:
    """For each length of vectors in the sample: the eigenvectors of its second moments, largest first."""
    axes = {}
    for d in {len(v) for v in sample}:
        x = np.stack([v for v in sample if len(v) == d])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        axes[d] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return axes


def unit(x: np.ndarray) -> np.ndarray:
    x = x / abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cell_rows(axes: dict[int, np.ndarray], width: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, kind) for v in batch.column("vector").to_pylist()]
            cells = np.zeros((len(raw), 2), np.int64)
            for i, v in enumerate(raw):
                u = unit(v[None])[0]
                lead = (u @ axes[len(v)][:, :2]) if len(v) in axes else u[:2]
                cells[i, : len(lead)] = np.floor(lead / width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), batch.column("n"), pa.array([len(v) for v in raw], pa.int32()), pa.array(cells[:, 0], pa.int32()), pa.array(cells[:, 1], pa.int32()), pa.array([v.tobytes() for v in raw], pa.binary())],
                names=["rep", "n", "dim", "x", "y", "vector"],
            )

    return run


TILE = "dim int, x int, y int, part long, reps binary, counts binary, vectors binary"


def _tile_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile -> a row a tile."""

    def put(tile: tuple, rows: list[list]) -> pa.RecordBatch:
        packed = [np.array(rows[0], np.int64).tobytes(), np.array(rows[1], np.int64).tobytes(), b"".join(rows[2])]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*tile, *packed], [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 3)], names=[c.split()[0] for c in TILE.split(", ")])

    now, held = None, [[], [], []]
    for batch in batches:
        for *tile, rep, n, vector in zip(*(batch.column(c).to_pylist() for c in ("dim", "x", "y", "part", "rep", "n", "vector"))):
            if tile != now:
                if now is not None:
                    yield put(now, held)
                now, held = tile, [[], [], []]
            for h, v in zip(held, (rep, n, vector)):
                h.append(v)
    if now is not None:
        yield put(now, held)


def linked_pairs(a: np.ndarray, b: np.ndarray, ra: np.ndarray, rb: np.ndarray, threshold: float, same: bool, step: int = 16, chunk: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices (i, j) with cosine >= threshold, `chunk` rows of a at a time; a, b: vectors, ra, rb: unit vectors of
    the same directions on the principal axes; same: a is b, and only i < j."""
    d = ra.shape[1]
    qa, qb = (np.einsum("ij,ij->i", x, x) for x in (a, b))
    slack = 1e-4  # of single precision
    lb = rb[:, :step].astype(np.float32).T.copy()
    tails = {lo: tuple(np.sqrt((r[:, lo:] ** 2).sum(1)) for r in (ra, rb)) for lo in range(step, d + step, step)}
    sb = tails[step][1].astype(np.float32)
    for low in range(0, len(a), chunk):
        bound = ra[low : low + chunk, :step].astype(np.float32) @ lb
        bound += tails[step][0][low : low + chunk, None].astype(np.float32) * sb[None]
        i, j = np.nonzero(bound >= threshold - slack)
        i += low
        if same:
            i, j = i[i < j], j[i < j]
        for lo in range(step, d, step):
            if not len(i):
                break
            ta, tb = tails[lo + step]
            keep = []
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                part = np.einsum("ij,ij->i", ra[p, : lo + step], rb[q, : lo + step])
                keep.append(part + ta[p] * tb[q] >= threshold - slack)
            k = np.concatenate(keep)
            i, j = i[k], j[k]
        if len(i):
            keep = []
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                keep.append(np.einsum("ij,ij->i", a[p], b[q]) / np.sqrt(qa[p] * qb[q]) >= threshold)
            k = np.concatenate(keep)
            yield i[k], j[k]


def joined(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """label, in which nodes of a component have its smallest node, after links (i, j)."""
    i, j = label[i], label[j]
    root = np.arange(len(label))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == root).all():
            return root[label]
        root = new


def _pair_rows(axes: dict[int, np.ndarray], threshold: float, kind: str):
    """Rows (pair, side, dim, reps, counts, vectors) sorted by pair and side; a tile paired with itself has one row."""

    def load(dim: int, reps: bytes, counts: bytes, vectors: bytes):
        x = np.frombuffer(vectors, kind).reshape(-1, dim).astype(np.float64)
        x = np.ldexp(x, -np.frexp(abs(x).max(1, keepdims=True))[1])  # by powers of two, which leaves cosines as they are
        u = unit(x)
        return np.frombuffer(reps, np.int64), np.frombuffer(counts, np.int64), x, u @ axes[dim] if dim in axes else u

    def put(left: tuple, right: tuple | None) -> pa.RecordBatch | None:
        ia, na, a, ra = left
        ib, nb, b, rb = right or left
        ids = ia if right is None else np.concatenate([ia, ib])
        links, label, base = np.zeros(len(ids), np.int64), np.arange(len(ids)), 0 if right is None else len(ia)
        for i, j in linked_pairs(a, b, ra, rb, threshold, right is None):
            links += np.bincount(i, nb[j], len(ids)).astype(np.int64) + np.bincount(j + base, na[i], len(ids)).astype(np.int64)
            label = joined(label, i, j + base)
        at = np.nonzero(links)[0]
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, label, ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(links[at]), pa.array(least[label[at]])], names=["rep", "links", "root"]) if len(at) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for r in range(batch.num_rows):
                pair = batch.column("pair")[r].as_py()
                if pair != now and held and (out := put(held[0], held[1] if len(held) > 1 else None)):
                    yield out
                if pair != now:
                    now, held = pair, []
                held.append(load(*(batch.column(c)[r].as_py() for c in ("dim", "reps", "counts", "vectors"))))
        if held and (out := put(held[0], held[1] if len(held) > 1 else None)):
            yield out

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tile_bytes: int = 2 << 20, fit_rows: int = 20_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding).

    fit_rows: at most about so many vectors, chosen by hash, are read to find the principal axes.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    fine = "vec_id is not null and vector is not null and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(vector, x -> x <> 0)"
    usable = rows.where(fine)
    classes = scratch.keep(usable.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")), "classes")
    every = max(1, -(-classes.count() // fit_rows))
    sample = classes.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("vector").toPandas()
    axes = principal_axes([np.array(v, np.float64) for v in sample["vector"]])
    width = (2 - 2 * threshold) ** 0.5 + 1e-6
    kind = "float32" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "float64"
    placed = classes.mapInArrow(_cell_rows(axes, width, kind), "rep long, n long, dim int, x int, y int, vector binary")
    placed = scratch.keep(placed, "placed")
    cells = placed.groupBy("dim", "x", "y").agg(F.ceil(F.count(F.lit(1)) * F.col("dim") * int(kind[5:]) / 8 / tile_bytes).alias("tiles"))
    keyed = placed.join(cells, ["dim", "x", "y"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("tiles"))).drop("tiles")
    tiles = keyed.repartition("dim", "x", "y", "part").sortWithinPartitions("dim", "x", "y", "part").mapInArrow(_tile_rows, TILE)
    tiles = scratch.keep(tiles, "tiles")
    scratch.drop("placed")

    # pairs of tiles: within a cell, and with half of the neighbouring cells
    here = tiles.select("dim", "x", "y", "part")
    near = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    there = here.select("dim", F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("part").alias("part2"))
    pairs = here.withColumn("o", F.explode(near)).select("dim", "x", "y", "part", (F.col("x") + F.col("o.dx")).alias("x2"), (F.col("y") + F.col("o.dy")).alias("y2"))
    pairs = pairs.join(there, ["dim", "x2", "y2"]).where("x <> x2 or y <> y2 or part <= part2")
    left = pairs.select("dim", "x", "y", "part", F.struct("dim", "x", "y", "part", "x2", "y2", "part2").alias("pair"), F.lit(0).alias("side"))
    right = pairs.where("x <> x2 or y <> y2 or part <> part2").select("dim", F.col("x2").alias("x"), F.col("y2").alias("y"), F.col("part2").alias("part"), F.struct("dim", "x", "y", "part", "x2", "y2", "part2").alias("pair"), F.lit(1).alias("side"))
    sent = left.unionByName(right).withColumn("pair", F.concat_ws(",", "pair.dim", "pair.x", "pair.y", "pair.part", "pair.x2", "pair.y2", "pair.part2"))
    sent = scratch.keep(sent, "sent")
    loaded = tiles.join(sent, ["dim", "x", "y", "part"]).select("pair", "side", "dim", "reps", "counts", "vectors").repartition("pair").sortWithinPartitions("pair", "side")
    found = scratch.keep(loaded.mapInArrow(_pair_rows(axes, threshold, kind), "rep long, links long, root long"), "found")
    scratch.drop("tiles")

    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), scratch, "groups").select(F.col("node").alias("rep"), "component")
    known = classes.select("vector", "rep", "n").join(links, "rep", "left").join(groups, "rep", "left")
    known = known.select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    keyed = rows.withColumn("vector", F.expr(f"if({fine}, vector, null)"))
    out = keyed.join(scratch.keep(known, "known"), "vector", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
