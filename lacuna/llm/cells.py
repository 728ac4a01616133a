"""Near duplicates of embeddings: spherical k-means cells, blocked cosines, one kept a group.

Equal vectors count as one with a multiplicity. Centroids are fitted on the FITTED vectors
with the least hashes; every vector is then assigned. Cells that lie near each other share
a tile of bounded size; a cell that is too large for one has several. A vector is at home
in one tile and visits each tile of a lower number that may hold a vector it links with:
one with a cell across whose border (the great circle between the two centroids) the
vector reaches, and whose farthest member is not too far from its centroid. Both bounds
are exact, so no link is lost. A tile compares its own vectors with each other and with
its visitors, who come in chunks of bounded size; it sends counts of links and a spanning
forest of them, never all pairs.

Where vectors have structure (clusters, few directions), most tiles are ruled out. Vectors
that are spread evenly over many dimensions reach across nearly all borders; then the
work grows with the square of the vectors, in products of blocks, as no exact bound is left.

Cases: null, zero, odd (null or non-finite components) vectors link with nothing and are
kept; vectors link with those of their length only; a null id gives a null component and
is not kept; rows that share an id or a vector are rows of their own; an empty table gives
an empty result; columns beside the two named are not read, labels among them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lacuna.llm.common import mix64, staged
from lacuna.llm.graph import components

#: Least cosine; vectors that centroids are fitted on, rows aimed at in a cell, most cells of a length, rounds, seed.
THRESHOLD, FITTED, CELL_ROWS, MOST_CELLS, ROUNDS, SEED = 0.95, 8192, 250, 1024, 8, 7
#: Tiles aimed at for each length; rows of a tile at least and at most, and numbers in it; visitors of a chunk; rows multiplied at once.
TILES, LEAST_ROWS, TILE_ROWS, TILE_NUMBERS, VISITORS, SLICE = 12, 1024, 8192, 1 << 22, 16_384, 256


def normed(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(x: np.ndarray, k: int) -> np.ndarray:
    """Centroids of spherical k-means, of length 1."""
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        home = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, x)
        size = np.linalg.norm(total, axis=1)
        c = np.where(size[:, None] > 1e-9, total / np.maximum(size, 1e-9)[:, None], c)
    return c


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


class Tiles:
    """Which tile each vector of one length is at home in, and which ones it visits."""

    def __init__(self, centroids: np.ndarray, rows: np.ndarray, least_cosine: np.ndarray, threshold: float):
        """rows and least_cosine: of each cell, its vectors and the least cosine of one with its centroid."""
        n, k, dim = int(rows.sum()), *centroids.shape
        size = min(max(LEAST_ROWS, -(-n // TILES)), TILE_ROWS, max(1, TILE_NUMBERS // dim))
        self.centroids, self.threshold = centroids, threshold
        self.between = np.sqrt(np.maximum(2 - 2 * centroids @ centroids.T, 0))
        self.far = angles(least_cosine) + math.acos(threshold)
        order = np.argsort(np.argmax(centroids @ fit(centroids, max(1, n // size)).T, axis=1), kind="stable")  # near cells together
        self.parts = np.maximum(1, -(-rows // size))
        self.first = np.zeros(k, np.int64)
        tile, held = -1, size
        for c in order.tolist():
            if self.parts[c] > 1:
                self.first[c], tile, held = tile + 1, tile + self.parts[c], size
            else:
                if held + rows[c] > size:
                    tile, held = tile + 1, 0
                self.first[c], held = tile, held + rows[c]
        cell = np.repeat(np.arange(k), self.parts)
        tile_of = self.first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(self.parts) - self.parts, self.parts)
        by_tile = np.argsort(tile_of, kind="stable")
        self.cell, self.starts = cell[by_tile], np.searchsorted(tile_of[by_tile], np.arange(tile + 1))

    def of(self, x: np.ndarray, reps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, the tiles they are at home in or visit, and whether they are at home there; a few rows at a time."""
        step = max(1, 4_000_000 // (len(self.starts) + len(self.centroids)))
        for lo in range(0, len(x), step):
            some = x[lo : lo + step]
            near = some @ self.centroids.T
            cell = np.argmax(near, axis=1)
            own = np.arange(len(some))
            home = self.first[cell] + (mix64(reps[lo : lo + step].astype(np.uint64)) % self.parts[cell].astype(np.uint64)).astype(np.int64)
            reach = math.sqrt(1 - self.threshold**2) * self.between[cell] + 1e-9
            may = (near[own, cell][:, None] - near <= reach) & (angles(near) <= self.far + 1e-9)
            may[own, cell] = True
            visits = np.logical_or.reduceat(may[:, self.cell], self.starts, axis=1) & (np.arange(len(self.starts)) < home[:, None])
            visits[own, home] = True
            row, tile = np.nonzero(visits)
            yield row + lo, tile, tile == home[row]


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what the rows and columns of a boolean matrix link: rows are 0.., columns follow."""
    n, m = linked.shape
    row, column = np.full(n, -1), np.full(m, -1)
    a, b = [], []
    for i in np.flatnonzero(linked.any(1)):
        if row[i] >= 0:
            continue
        row[i], front = i, [i]
        while front:
            hit = np.flatnonzero(linked[front].any(0) & (column < 0))
            if not len(hit):
                break
            a += [i] * len(hit)
            b += (n + hit).tolist()
            column[hit] = i
            more = np.flatnonzero(linked[:, hit].any(1) & (row < 0))
            row[more] = i
            a += [i] * len(more)
            b += more.tolist()
            front = more.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def grouped(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors."""
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("x"))
    good = F.coalesce(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine, F.lit(False))
    reps = staged(rows.filter(good).groupBy("x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).withColumn("dim", F.size("x")), "vectors")
    centroids: dict[int, np.ndarray] = {}
    sizes = {r.dim: r["count"] for r in reps.groupBy("dim").count().collect()}
    rank = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("rep"), "x"))
    sample = reps.withColumn("r", rank).filter(F.col("r") <= FITTED).select("dim", "x").collect()
    for dim, n in sizes.items():
        x = normed(np.array([r.x for r in sample if r.dim == dim], np.float64))
        centroids[dim] = fit(x, min(MOST_CELLS, max(1, math.ceil(n / CELL_ROWS))))
    kind = np.float32 if reps.schema["x"].dataType.elementType.simpleString() == "float" else np.float64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Length, ids, multiplicities and vectors, one length at a time."""
        for batch in batches:
            reps_, m, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            dims = np.diff(lists.offsets.to_numpy())
            ends, flat = np.cumsum(dims), lists.flatten().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                yield dim, reps_[at], m[at], flat[(ends[at] - dim)[:, None] + np.arange(dim)]

    def columns(**found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in found.values()], list(found))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {dim: (np.zeros(len(c), np.int64), np.ones(len(c))) for dim, c in centroids.items()}
        for dim, _, _, x in read(batches):
            near = normed(x.astype(np.float64)) @ centroids[dim].T
            cell = np.argmax(near, axis=1)
            np.add.at(held[dim][0], cell, 1)
            np.minimum.at(held[dim][1], cell, near[np.arange(len(x)), cell])
        for dim, (n, least) in held.items():
            at = np.flatnonzero(n)
            yield columns(dim=np.full(len(at), dim, np.int32), cell=at, n=n[at], least=least[at])

    source = reps.select("rep", "m", "x")
    cells = source.mapInArrow(measure, "dim int, cell long, n long, least double").groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    held = {dim: (np.zeros(len(c), np.int64), np.ones(len(c))) for dim, c in centroids.items()}
    for r in cells.collect():  # MOST_CELLS rows a length at most
        held[r.dim][0][r.cell], held[r.dim][1][r.cell] = r.n, r.least
    tiles = {dim: Tiles(c, *held[dim], threshold) for dim, c in centroids.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = {dim: np.zeros(len(t.starts), np.int64) for dim, t in tiles.items()}
        for dim, ids, _, x in read(batches):
            for _, tile, home in tiles[dim].of(normed(x.astype(np.float64)), ids):
                np.add.at(n[dim], tile[~home], 1)
        for dim, found in n.items():
            at = np.flatnonzero(found)
            yield columns(dim=np.full(len(at), dim, np.int32), tile=at, n=found[at])

    chunks = {dim: np.ones(len(t.starts), np.int64) for dim, t in tiles.items()}
    for r in source.mapInArrow(count, "dim int, tile long, n long").groupBy("dim", "tile").agg(F.sum("n").alias("n")).filter(F.col("n") > VISITORS).collect():
        chunks[r.dim][r.tile] = -(-r.n // VISITORS)  # a number for every TILE_ROWS vectors at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, m, x in read(batches):
            packed = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
            for row, tile, home in tiles[dim].of(normed(x.astype(np.float64)), ids):
                of = chunks[dim][tile]
                chunk = (mix64(ids[row].astype(np.uint64) + np.uint64(1)) % of.astype(np.uint64)).astype(np.int64)
                times = np.where(home, of, 1)  # a tile's own vectors go to all its chunks
                at = np.repeat(np.arange(len(row)), times)
                nth = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                row, tile, home, chunk = row[at], tile[at], home[at], np.where(home[at], nth, chunk[at])
                yield columns(dim=np.full(len(row), dim, np.int32), tile=tile, chunk=chunk, home=home, rep=ids[row], m=m[row], x=packed.take(pa.array(row)))

    def compare(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        own = found[found["home"]]
        y = normed(np.frombuffer(b"".join(own["x"]), kind).reshape(len(own), -1).astype(np.float64))
        y_rep, y_m, y_links = own["rep"].to_numpy(), own["m"].to_numpy(), np.zeros(len(own), np.int64)
        edges, ids, counts = [np.zeros((0, 2), np.int64)], [], []

        def meet(rep: np.ndarray, m: np.ndarray, linked: np.ndarray) -> None:
            nonlocal y_links
            y_links += m @ linked
            ids.append(rep)
            counts.append(linked @ y_m)
            a, b = forest(linked)
            both = np.concatenate([rep, y_rep])
            edges.append(np.stack([both[a], both[b]], 1))

        if key[2] == 0:
            for lo in range(0, len(y), SLICE):  # each pair once: with those that follow
                linked = y[lo : lo + SLICE] @ y.T >= threshold
                linked &= np.arange(len(y)) > lo + np.arange(len(linked))[:, None]
                meet(y_rep[lo : lo + SLICE], y_m[lo : lo + SLICE], linked)
        others = found[~found["home"]]
        for lo in range(0, len(others), SLICE):
            some = others.iloc[lo : lo + SLICE]
            x = normed(np.frombuffer(b"".join(some["x"]), kind).reshape(len(some), -1).astype(np.float64))
            meet(some["rep"].to_numpy(), some["m"].to_numpy(), x @ y.T >= threshold)
        edges, ids, counts = np.concatenate(edges), np.concatenate([*ids, y_rep]), np.concatenate([*counts, y_links])
        has = np.flatnonzero(counts)
        return pd.DataFrame({"a": np.concatenate([edges[:, 0], ids[has]]), "b": np.concatenate([edges[:, 1], np.full(len(has), -1)]), "n": np.concatenate([np.full(len(edges), -1), counts[has]])})

    placed = source.mapInArrow(place, "dim int, tile long, chunk long, home boolean, rep long, m long, x binary")
    found = staged(placed.groupBy("dim", "tile", "chunk").applyInPandas(compare, "a long, b long, n long"), "links")
    links = found.filter("n >= 0").groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    parts = components(found.filter("n = -1").select("a", "b")).withColumnRenamed("id", "rep")
    known = reps.select("x", "rep", "m").join(links, "rep", "left").join(parts, "rep", "left")
    component = F.coalesce("component", "rep")
    told = rows.filter(good).join(known, "x").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    return told.unionByName(alone)


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x != 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r(id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
"""
