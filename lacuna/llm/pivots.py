"""Exact top-k search by inner product with a table of distances to pivots.

Vectors x become floor(64 * x). For pivots p the distance of a query q and a candidate x
is at least max |d(q, p) - d(x, p)|, so their inner product (|q|^2 + |x|^2 - d^2) / 2 has
an upper bound that costs no look at x. Queries near the same pivots are taken together,
TILE of them; they evaluate candidates from the most promising bound down, in steps that
are one matrix product each, and stop where no bound reaches a k-th score any more. The
maximum is taken over the nearest pivots first; candidates that no query needs any more
are spared the others.

Queries and candidates are packed into blocks of bounded size and dealt on a grid: a task
holds some blocks of each side, and each of them once. A first round with one block of
candidates gives every query a k-th score to start from, so that the second round, over
all candidates, stops early in every part.

Cases: null vectors, vectors with null or non-finite components and null ids take no
part; vectors meet those of their own length only; a query with fewer than k candidates
gets them all; ties go to the smaller id; rows that share an id are each other's own, and
no candidates of it; scores are exact integers, those beyond 64 bits become the largest or
least long; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lacuna.llm.common import partitions, staged

#: Scale of the components; pivots, those looked at together, share of candidates that these rule out to be worth it, vectors pivots are chosen from.
SCALE, PIVOTS, CHEAP, GAIN, FROM = 64, 64, 8, 8, 4096
#: Numbers in a block of vectors, rows of a candidate and of a query block at most; blocks of each that a task holds.
NUMBERS, CANDIDATES, QUERIES, CANDIDATE_BLOCKS, QUERY_BLOCKS = 1 << 18, 4096, 1024, 8, 4
#: Queries handled at once; candidates they evaluate before they look at the bounds again, at first; candidates whose bounds are made at once.
TILE, STEP, AHEAD = 64, 256, 1024
BLOCK = "dim int, block long, n int, ids binary, vectors binary, far binary"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & fine).select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("x"))


def scaled(flat: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * flat.astype(np.float64))


def choose(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Pivots of each length: farthest-first among FROM vectors with the least hashes."""
    rank = F.row_number().over(W.partitionBy("dim").orderBy(F.xxhash64("id"), "id"))
    sample = vectors.withColumn("dim", F.size("x")).withColumn("r", rank).filter(F.col("r") <= FROM).select("dim", "x").collect()
    out = {}
    for dim in sorted({r.dim for r in sample}):
        some = [r.x for r in sample if r.dim == dim]
        rows = scaled(np.array(some, np.float64).reshape(len(some), dim))
        picked = [0]
        near = np.linalg.norm(rows - rows[0], axis=1)
        while len(picked) < min(PIVOTS, len(rows)) and near.max() > 0:
            picked.append(int(np.argmax(near)))
            near = np.minimum(near, np.linalg.norm(rows - rows[picked[-1]], axis=1))
        out[dim] = rows[picked]
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(d2, 0))


def packed(vectors: DataFrame, pivots: dict[int, np.ndarray], most: int) -> DataFrame:
    """Blocks of at most `most` vectors of one length with their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        made = 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            rows = held.pop(dim)
            x, ids = np.concatenate([r for _, r in rows]), np.concatenate([i for i, _ in rows])
            order = np.argsort(np.argmin(distances(x, pivots[dim]), axis=1), kind="stable")  # near ones together
            x, ids = x[order], ids[order]
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([ids.tobytes()]), pa.array([x.tobytes()]), pa.array([distances(x, pivots[dim]).astype(np.float32).tobytes()])],
                ["dim", "block", "n", "ids", "vectors", "far"],
            )

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                size = max(1, min(most, NUMBERS // max(1, dim)))
                for lo in range(0, int((sizes == dim).sum()), size):
                    at = np.flatnonzero(sizes == dim)[lo : lo + size]
                    x = scaled(flat[(ends[at] - dim)[:, None] + np.arange(dim)])
                    if dim in held and sum(len(i) for i, _ in held[dim]) + len(at) > size:
                        yield block(dim)
                    held.setdefault(dim, []).append((ids[at], x))
        for dim in list(held):
            yield block(dim)

    return vectors.select("id", "x").mapInArrow(run, BLOCK)


class Best:
    """The k best candidates so far of each query of a block; floor: k-th scores known before."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray, k: int, floor: np.ndarray | None = None):
        self.ids, self.x, self.far, self.k = ids, x, far, k
        self.norm = (x**2).sum(1)
        self.floor = np.full(len(ids), -np.inf, np.longdouble) if floor is None else floor
        self.score = np.full((len(ids), k), -np.inf, np.longdouble)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.looked = 0

    def least(self) -> np.ndarray:
        """What a score has to reach."""
        return np.maximum(self.floor, self.score[:, -1])

    def bounds(self, some: slice, ids: np.ndarray, norm: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that some of the queries may need, and upper bounds of their inner products.

        The pivots nearest to the queries tell most and come first; the others follow while
        pivots still rule out a GAIN-th of the candidates that are left.
        """
        mine, least, found = self.far[some], self.least()[some, None].astype(np.float64), []
        pivots = np.argsort(mine.min(0), kind="stable")
        far = np.ascontiguousarray(far[:, pivots].T)
        mine = mine[:, pivots]
        for lo in range(0, len(ids), AHEAD):
            at = np.arange(lo, min(lo + AHEAD, len(ids)))
            gap = np.zeros((len(mine), len(at)), np.float32)
            for first in range(0, len(far), CHEAP):
                one = np.empty_like(gap)
                for p in range(first, min(first + CHEAP, len(far))):
                    np.subtract(far[p, at], mine[:, p, None], out=one)
                    np.abs(one, out=one)
                    np.maximum(gap, one, out=gap)
                both = self.norm[some, None] + norm[at]
                bound = (both - gap.astype(np.float64) ** 2) / 2 + 2e-6 * both + 1e-3  # and what rounding of the distances may hide
                bound[np.isnan(bound)] = np.inf
                bound[ids[at] == self.ids[some, None]] = -np.inf
                needed = ((bound >= least) & (bound > -np.inf)).any(0)
                before, at, gap, bound = len(at), at[needed], gap[:, needed], bound[:, needed]
                if first and GAIN * (before - len(at)) < before:
                    break
            found.append((at, bound))
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found], axis=1)

    def take(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Adds candidates, given as equally long arrays."""
        mine = np.unique(q)
        q = np.concatenate([q, np.repeat(mine, self.k)])
        ids, score = np.concatenate([ids, self.found[mine].ravel()]), np.concatenate([score, self.score[mine].ravel()])
        order = np.lexsort((ids, -score, q))
        first = np.searchsorted(q[order], mine)
        best = order[first[:, None] + np.arange(self.k)]
        self.found[mine], self.score[mine] = ids[best], score[best]

    def meet(self, ids: np.ndarray, x: np.ndarray, far: np.ndarray) -> None:
        """Looks at candidates in the order of their bounds."""
        norm = (x**2).sum(1)
        for lo in range(0, len(self.ids), TILE):
            some = slice(lo, min(lo + TILE, len(self.ids)))
            at, bound = self.bounds(some, ids, norm, far) if len(ids) else (np.zeros(0, np.int64), np.zeros((some.stop - lo, 0)))
            least = self.least()[some, None].astype(np.float64)
            promise = np.where(np.isinf(bound) | np.isinf(least), bound, bound - np.where(np.isinf(least), 0, least)).max(0, initial=-np.inf)
            order = np.argsort(-promise, kind="stable")
            at, bound = at[order], bound[:, order]
            place, step = 0, STEP
            while place < len(at):
                least = self.least()[some, None].astype(np.float64)
                if not ((bound[:, place:] >= least) & (bound[:, place:] > -np.inf)).any():
                    break  # no candidate left can be among the k best of any query
                there = slice(place, place + step)
                worth = (bound[:, there] >= least) & (bound[:, there] > -np.inf)
                some_of = worth.any(0)
                self.look(lo, at[there][some_of], worth[:, some_of], ids, x, norm)
                place, step = place + step, 2 * step

    def look(self, lo: int, at: np.ndarray, worth: np.ndarray, ids: np.ndarray, x: np.ndarray, norm: np.ndarray) -> None:
        """Scores of the candidates for the queries from lo on; in doubles where they hold all sums exactly."""
        some = slice(lo, lo + len(worth))
        self.looked += int(worth.sum())
        mine, there = self.x[some], x[at]
        if self.norm[some].max(initial=0) * norm[at].max(initial=0) >= 2.0**104:
            mine, there = mine.astype(np.longdouble), there.astype(np.longdouble)
        score = mine @ there.T
        q, c = np.nonzero(worth & (score >= self.least()[some, None].astype(score.dtype)))
        if len(q):
            self.take(q + lo, ids[at[c]], score[q, c].astype(np.longdouble))


def top_k(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row with is_query its k best others."""
    spark = vectors.sparkSession
    rows = usable(vectors, vec_id, embedding)
    pivots = choose(rows)
    candidates = staged(packed(rows, pivots, CANDIDATES), "candidates")
    asked = staged(packed(usable(vectors.filter(is_query), vec_id, embedding), pivots, QUERIES), "queries")
    n_candidates, n_asked = candidates.count(), asked.count()
    across = max(1, -(-n_asked // QUERY_BLOCKS))
    down = max(1, -(-n_candidates // CANDIDATE_BLOCKS), min(n_candidates, partitions(spark) // across))
    part = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = candidates.withColumn("i", part(down)).withColumn("j", each(across))
    right = asked.withColumn("j", part(across)).withColumn("i", each(down))

    def read(t: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
        for r in range(t.num_rows):
            row = {name: t.column(name)[r].as_py() for name in t.column_names}
            ids = np.frombuffer(row["ids"], np.int64)
            floor = np.frombuffer(row["floor"], np.longdouble) if row.get("floor") else None
            yield row["block"], ids, np.frombuffer(row["vectors"]).reshape(len(ids), row["dim"]), np.frombuffer(row["far"], np.float32).reshape(len(ids), -1), floor

    def met(some: pa.Table, questions: pa.Table) -> Iterator[tuple[int, Best]]:
        blocks = [x for _, *x, _ in read(some)]
        if blocks:
            ids, x, far = (np.concatenate(z) for z in zip(*blocks, strict=True))
            for block, *q, floor in read(questions):
                best = Best(*q, k, floor)
                best.meet(ids, x, far)
                yield block, best

    def start(some: pa.Table, questions: pa.Table) -> pa.Table:
        found = [(block, best.score[:, -1].tobytes()) for block, best in met(some.slice(0, 1), questions)]
        return pa.table([pa.array([b for b, _ in found], pa.int64()), pa.array([x for _, x in found], pa.binary())], ["block", "floor"])

    def search(some: pa.Table, questions: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for _, best in met(some, questions):
            q, r = np.nonzero(best.score > -np.inf)
            most = np.iinfo(np.int64).max
            out.append((best.ids[q], best.found[q, r], np.clip(best.score[q, r], -most - 1, most).astype(np.int64)))
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    grid = ["dim", "i", "j"]
    one = F.col("i") == 0
    begun = left.filter(one).groupBy(*grid).cogroup(right.filter(one).groupBy(*grid)).applyInArrow(start, "block long, floor binary")
    floors = staged(begun, "floors")
    right = right.join(floors, "block", "left")
    found = left.groupBy(*grid).cogroup(right.groupBy(*grid)).applyInArrow(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20
"""
