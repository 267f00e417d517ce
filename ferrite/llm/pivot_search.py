"""Exact top-k inner products by pivot-table elimination.

``index`` writes the pivot table: each vector's integer form, its squared norm and its Euclidean distances to fixed
pivots. Distances to many pivots place a vector in the space that the pivots span, but for the side on which its
remainder lies. So for a query q and a vector x they bound d(q, x) from below as tightly as these distances allow: the
distance of the two places, the remainders taken to point the same way. With 2 q.x = |q|^2 + |x|^2 - d(q, x)^2 this
maximum lower bound of the distance bounds the score from above. Each block of vectors is evaluated in the order of that
bound until the k-th best exact score exceeds the next bound, so nothing that could enter the top k, ties included, is
left out. A task carries its best scores from block to block; one ranking over the tasks' rows ends the search.

Queries are dealt by hash into waves of about QUERY_WAVE vectors, a fixed size; each wave passes once over the table in
blocks. ``evaluated_share`` says how much of a table the bounds leave to be evaluated.

Defined results: vectors that are null or hold a null or non-finite component, 256 times it included, take no part.
Shorter vectors count as padded with zeros. Components are whole numbers of any size and scores are computed exactly; a
score beyond a bigint is the nearest bigint. A query's own row is every row with its vec_id; of repeated query ids the
smallest vector is taken. Repeated rows of other ids are candidates each. Ties go to the smaller vec_id. No vectors give
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
QUERY_WAVE = 8_192
PIVOT_SAMPLE = 512
BLOCK = 4096
STEP = 32
#: Sums of products below this are exact in a double, in any order.
EXACT = 2.0**53
LONG = (-(2**63), 2**63 - 1)
TABLE = "vec_id bigint, v array<double>, norm2 double, pivot_distances array<float>"
FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantise(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(256 x) of each component as a whole double; only vectors that take part."""
    x = F.col(vector)
    fine = x.isNotNull() & F.col(key).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double") * SCALE) < float("inf")))
    # Rounding down by the remainder stays a double, where floor() would end at a bigint's range.
    whole = lambda c: F.when(F.abs(c) < EXACT, F.floor(c).cast("double")).otherwise(c)
    return vectors.where(fine).select(F.col(key).cast("bigint").alias("vec_id"), F.transform(x, lambda c: whole(c.cast("double") * SCALE)).alias("v"))


def _matrix(rows, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


@dataclass(frozen=True)
class Pivots:
    """Points whose distances are stored, and what turns distances into places: an orthonormal basis of their span."""

    points: np.ndarray
    to_place: np.ndarray  # products with the points -> coordinates
    norm2: np.ndarray
    spread: float  # a coordinate error for a unit error of all products

    @property
    def reach(self) -> float:
        return float(self.norm2.max(initial=0.0))

    def distances(self, m: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(norm2[:, None] + self.norm2 - 2 * m @ self.points.T, 0))

    def places(self, norm2: np.ndarray, distances: np.ndarray) -> tuple[np.ndarray, ...]:
        """(coordinates, how far they may be off, the remainder's length at most, trusted) from the table's columns alone.

        Distances have 24 bits, so a product is off by 2**-22 of the squared norms at most, the slack for all that follows
        included. Vectors far beyond the pivots are not trusted: their bound is infinite.
        """
        trusted = norm2 <= 1e8 * self.reach
        known = np.where(trusted, norm2, 0)
        at = np.where(trusted[:, None], (known[:, None] + self.norm2 - distances.astype(np.float64) ** 2) / 2, 0) @ self.to_place
        off = 2.0**-22 * (known + self.reach) * self.spread
        return at, off, np.sqrt(np.maximum(known - (at**2).sum(1), 0) + 2 * np.sqrt(known) * off + off**2), trusted


def choose_pivots(vectors: DataFrame, n: int, dim: int) -> Pivots:
    """Pivots from a sample of at most PIVOT_SAMPLE vectors, fixed by a hash of their ids."""
    rows = common.bounded_sample(vectors.select("vec_id", "v", F.lit(0).alias("all")), "vec_id", "all", PIVOT_SAMPLE, {"v": F.col("v")})
    return pivots_of(_matrix([r["v"] for r in rows], dim), n, dim)


def pivots_of(pool: np.ndarray, n: int, dim: int) -> Pivots:
    """At most ``n`` rows of ``pool``, each the farthest from the span of those before it."""
    pool = pool[np.abs(pool).max(1, initial=0) < 1e100]
    rest, picked, basis = pool.copy(), [], []
    size = (pool**2).sum(1)
    while len(picked) < min(n, dim) and len(pool):
        left = (rest**2).sum(1)
        i = int(np.argmax(left))
        if left[i] <= 1e-4 * max(size[i], 1e-300):
            break
        b = rest[i] / np.sqrt(left[i])
        for c in basis:  # once more, so that rounding leaves no part of the others
            b -= (b @ c) * c
        b /= np.linalg.norm(b)
        picked.append(i)
        basis.append(b)
        rest -= np.outer(rest @ b, b)
    points = pool[picked] if picked else np.zeros((0, dim))
    # points = triangle @ basis, so products with the points give coordinates by the triangle's inverse.
    to_place = np.linalg.inv(points @ np.array(basis).T).T if picked else np.zeros((0, 0))
    spread = float(np.linalg.norm(to_place, 2) * np.sqrt(len(points))) if picked else 0.0
    return Pivots(points, to_place, (points**2).sum(1), spread)


def _list_array(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel()))


def index(vectors: DataFrame, pivots: Pivots, dim: int) -> DataFrame:
    """The written table (vec_id, v, norm2, pivot_distances) of quantised vectors."""
    common.python_ready(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column(1).to_pylist(), dim)
            with np.errstate(over="ignore", invalid="ignore"):  # what overflows is never trusted
                norm2 = (m**2).sum(1)
                far = np.nan_to_num(pivots.distances(m, norm2).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), _list_array(m), pa.array(norm2), _list_array(far)], ["vec_id", "v", "norm2", "pivot_distances"])

    return common.materialise(vectors.mapInArrow(run, TABLE), "pivot-table")


def exact_scores(m: np.ndarray, q: np.ndarray, largest: float) -> np.ndarray:
    """Whole inner products; ``largest`` is a bound of all norms' products."""
    if largest < EXACT:
        return (m @ q).astype(np.int64)
    whole = [int(x) for x in q]
    return np.array([min(max(sum(int(a) * b for a, b in zip(row, whole, strict=True)), LONG[0]), LONG[1]) for row in m], np.int64)


class Wave:
    """One wave of queries on its way over the blocks of a task."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, pivots: Pivots, k: int):
        self.ids, self.q, self.pivots, self.k = ids, q, pivots, k
        with np.errstate(over="ignore", invalid="ignore"):
            self.norm2 = (q**2).sum(1)
            self.at, self.off, self.rest, self.trusted = pivots.places(self.norm2, pivots.distances(q, self.norm2))
        self.best_ids = [np.zeros(0, np.int64)] * len(ids)
        self.best = [np.zeros(0, np.int64)] * len(ids)
        self.evaluated = self.candidates = 0

    def block(self, ids: np.ndarray, m: np.ndarray, norm2: np.ndarray, distances: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            at, off, rest, trusted = self.pivots.places(norm2, distances)
            norm = np.sqrt(norm2)
            for begin in range(0, len(self.ids), 256):
                part = slice(begin, begin + 256)
                own = np.sqrt(self.norm2[part])
                bounds = self.at[part] @ at.T + np.outer(self.rest[part], rest)
                bounds += np.outer(own, off) + np.outer(self.off[part], norm + off) + 1
                bounds[~self.trusted[part]] = np.inf
                bounds[:, ~trusted] = np.inf
                for i, bound in enumerate(bounds, begin):
                    self._one(i, bound, ids, m, norm)

    def _one(self, i: int, bound: np.ndarray, ids: np.ndarray, m: np.ndarray, norm: np.ndarray) -> None:
        best_ids, best, k = self.best_ids[i], self.best[i], self.k
        left = np.flatnonzero((ids != self.ids[i]) & ((bound >= best[k - 1]) if len(best) >= k else True))
        self.candidates += len(ids)
        own = float(np.sqrt(self.norm2[i]))
        seen, step = 0, max(STEP, k)
        # The first few by partition, so that most blocks need no sort.
        if len(left) > step:
            cut = np.argpartition(-bound[left], step)
            head = left[cut[:step]]
            left = np.concatenate([head[np.argsort(-bound[head], kind="stable")], left[cut[step:]]])
        ordered = len(left) <= step
        if ordered:
            left = left[np.argsort(-bound[left], kind="stable")]
        while seen < len(left):
            if seen and not ordered:
                rest = left[seen:]
                rest = rest[bound[rest] >= best[k - 1]] if len(best) >= k else rest
                left, seen, ordered = rest[np.argsort(-bound[rest], kind="stable")], 0, True
                continue
            if len(best) >= k and bound[left[seen]] < best[k - 1]:
                break
            part = left[seen : seen + step]
            best_ids = np.concatenate([best_ids, ids[part]])
            best = np.concatenate([best, exact_scores(m[part], self.q[i], own * float(norm[part].max()))])
            top = np.lexsort((best_ids, ~best))[:k]  # ~ turns the order, also of the least bigint
            best_ids, best = best_ids[top], best[top]
            seen += len(part)
            self.evaluated += len(part)
        self.best_ids[i], self.best[i] = best_ids, best


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, ...]]:
    held, rows = [], 0

    def whole() -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(held).combine_chunks()
        lists = [t.column(c).combine_chunks() for c in ("v", "pivot_distances")]
        return t.column("vec_id").to_numpy(), lists[0].flatten().to_numpy().reshape(len(t), dim), t.column("norm2").to_numpy(), lists[1].flatten().to_numpy().reshape(len(t), -1)

    for b in batches:
        if b.num_rows:
            held.append(b)
            rows += b.num_rows
        if rows >= BLOCK:
            yield whole()
            held, rows = [], 0
    if held:
        yield whole()


def search(table: DataFrame, queries: list[tuple[int, list[float]]], pivots: Pivots, dim: int, k: int) -> DataFrame:
    """FOUND: the k best of each task's part of the pivot table for each of one wave of queries."""
    shared = table.sparkSession.sparkContext.broadcast((np.array([x[0] for x in queries], np.int64), _matrix([x[1] for x in queries], dim), pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, pivots = shared.value
        wave = Wave(ids, q, pivots, k)
        for block in _blocks(batches, dim):
            wave.block(*block)
        for at in range(0, len(ids), 2048):
            some = range(at, min(at + 2048, len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + 2048], [len(wave.best[i]) for i in some])), pa.array(np.concatenate([wave.best_ids[i] for i in some])), pa.array(np.concatenate([wave.best[i] for i in some]))], ["query_id", "vec_id", "score"])

    return table.mapInArrow(run, FOUND)


def _prepare(vectors: DataFrame, pivots: int, key: str, vector: str) -> tuple[DataFrame, Pivots, int]:
    v = quantise(vectors, key, vector)
    dim = v.agg(F.max(F.size("v"))).first()[0] or 0
    chosen = choose_pivots(v, pivots, dim)
    return index(v, chosen, dim), chosen, dim


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = 56, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products over all other rows."""
    spark = vectors.sparkSession
    table, chosen, dim = _prepare(vectors, pivots, key, vector)
    asked = table.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    waves = -(-asked.count() * 5 // (4 * QUERY_WAVE))
    asked = common.materialise(asked.withColumn("wave", F.pmod(F.xxhash64("vec_id", F.lit("wave")), F.lit(max(1, waves))).cast("int")), "queries", by="wave")
    found = None
    for w in range(waves):  # a wave at a time reaches the driver
        rows = asked.where(F.col("wave") == w).select("vec_id", "v").collect()
        part = search(table, [(r["vec_id"], r["v"]) for r in rows], chosen, dim, k) if rows else None
        if part is not None and waves > 1:
            part = common.materialise(part, "topk-wave")
        found = part if found is None else found if part is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluated_share(vectors: np.ndarray, queries: int, pivots: int, k: int = 5) -> float:
    """The share of (query, vector) pairs that the bounds leave to be evaluated, for the first rows as queries; a report, no filter."""
    rows = np.floor(np.asarray(vectors, np.float64) * SCALE)
    chosen = pivots_of(rows[:PIVOT_SAMPLE], pivots, rows.shape[1])
    norm2, ids = (rows**2).sum(1), np.arange(len(rows))
    wave = Wave(ids[:queries], rows[:queries], chosen, k)
    for at in range(0, len(rows), BLOCK):
        wave.block(ids[at : at + BLOCK], rows[at : at + BLOCK], norm2[at : at + BLOCK], chosen.distances(rows[at : at + BLOCK], norm2[at : at + BLOCK]))
    return wave.evaluated / max(1, wave.candidates)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: the 5 best of every vector whose id is divisible by 50."""
    return top_k(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
