"""Centroid clustering: k-means rounds in whole numbers, nearest centroids found by annulus search.

Centroids lie sorted by norm. A vector's distance to the centroid of the nearest norm bounds its least distance from
above; by the triangle inequality nothing nearer lies outside the norms within that bound of the vector's own. Two binary
searches give that annulus, and only its centroids are compared, exactly, ties on its boundary included. A task adds up
its vectors by cluster; a round brings back one sum for each cluster and component, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SIZE = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
#: Vectors that are compared with one run of centroids at a time.
BLOCK = 1024
#: Components beyond this size would overflow distances and sums in longs.
MOST = 1 << 26
#: Up to this size products and sums of a vector's components are exact in doubles.
_EXACT = 1 << 20
FORM = "vec_id {kind}, cluster int, distance long"


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components floor(scale * x), of the vectors of ``size`` components, none null, NaN or infinite."""
    x = F.col(embedding).cast("array<double>")
    # Spark takes NaN for greater than infinity.
    fine = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    whole = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    few = F.forall(x, lambda v: F.abs(v * F.lit(float(scale))) <= MOST)
    checked = F.when(few, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {MOST} after scaling")).cast("array<bigint>"))
    return vectors.filter(fine).select(F.col(vec_id).alias("vec_id"), checked.alias("v"))


def starts(whole: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The vectors of the k least digests of ``2:<vec_id>``; a null id counts as the empty string, equal digests go by their components."""
    key = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), -1 if rows else 0)


class Annuli:
    """Centroids sorted by norm, and the search for the nearest one."""

    def __init__(self, centroids: np.ndarray):
        squares = (centroids * centroids).sum(1)
        self.number = np.argsort(squares, kind="stable")
        self.centroids, self.squares = centroids[self.number], squares[self.number]
        self.norms = np.sqrt(self.squares.astype(np.float64))
        self.doubles = self.centroids.astype(np.float64) if np.abs(centroids).max(initial=0) <= _EXACT else None

    def ranges(self, x: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last (exclusive) place, by norm, of the centroids within each vector's annulus."""
        norms = np.sqrt(squares.astype(np.float64))
        right = np.clip(np.searchsorted(self.norms, norms), 0, len(self.norms) - 1)
        left = np.maximum(right - 1, 0)
        guess = np.where(np.abs(self.norms[left] - norms) <= np.abs(self.norms[right] - norms), left, right)
        gap = x - self.centroids[guess]
        bound = np.sqrt((gap * gap).sum(1).astype(np.float64))
        bound += 1e-9 * (bound + norms + self.norms[guess]) + 1e-9  # roundings make the annulus wider, never narrower
        return np.searchsorted(self.norms, norms - bound, "left"), np.searchsorted(self.norms, norms + bound, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid, the lesser number on ties; comparisons made."""
        squares = (x * x).sum(1)
        first, last = self.ranges(x, squares)
        number, distance, compared = np.empty(len(x), np.int64), np.empty(len(x), np.int64), 0
        order = np.lexsort((last, first))
        doubles = self.doubles is not None and np.abs(x).max(initial=0) <= _EXACT
        for at in range(0, len(x), BLOCK):
            rows = order[at : at + BLOCK]
            a, b = int(first[rows].min()), int(last[rows].max())
            if doubles:
                dots = (x[rows].astype(np.float64) @ self.doubles[a:b].T).astype(np.int64)
            else:
                dots = x[rows] @ self.centroids[a:b].T
            gaps = squares[rows, None] + self.squares[None, a:b] - 2 * dots
            place = np.arange(a, b)
            inside = (place >= first[rows, None]) & (place < last[rows, None])
            gaps = np.where(inside, gaps, np.iinfo(np.int64).max)
            least = gaps.min(1)
            number[rows] = np.where(gaps == least[:, None], self.number[None, a:b], len(self.number)).min(1)
            distance[rows] = least
            compared += int(inside.sum())
        return number, distance, compared


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1)


def _sums(whole: DataFrame, centroids: np.ndarray) -> list:
    """cluster, at, total, n: the sum of each component over each cluster's vectors, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, k = Annuli(centroids), len(centroids)
        totals, n = np.zeros(centroids.shape, np.int64), np.zeros(k, np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                number = annuli.nearest(x)[0]
                order = np.argsort(number, kind="stable")
                sizes = np.bincount(number, minlength=k)
                full = np.flatnonzero(sizes)
                totals[full] += np.add.reduceat(x[order], (np.cumsum(sizes) - sizes)[full])
                n += sizes
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(n[full]), pa.array(list(totals[full]), pa.list_(pa.int64()))], names=["cluster", "n", "totals"])

    own = whole.select("v").mapInArrow(run, "cluster int, n long, totals array<bigint>")
    return own.select("cluster", "n", F.posexplode("totals").alias("at", "total")).groupBy("cluster", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()


def fit(whole: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds; one that no vector is nearest to stays where it is."""
    centroids = starts(whole, k)
    for _ in range(rounds if len(centroids) else 0):
        moved = centroids.copy()
        for r in _sums(whole, centroids):
            moved[r["cluster"], r["at"]] = r["total"] // r["n"]
        centroids = moved
    return centroids


def assign(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for batch in batches:
            if batch.num_rows:
                number, distance, _ = annuli.nearest(_matrix(batch))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return whole.mapInArrow(run, FORM.format(kind=dict(whole.dtypes)["vec_id"]))


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector.

    Vectors of another number of components, or with a null, NaN or infinite one, are left out, as are null vectors. A
    null id keeps its vector. Repeated rows each count and get their row. Fewer vectors than ``k`` are a centroid each,
    equal ones of greater number then stay empty; an empty table gives no row. A component beyond 2**26 after scaling is
    an error, as distances would not fit their column. Other columns are left out, whatever their names.
    """
    scratch = Scratch(vectors.sparkSession)
    whole = scratch.stored(whole_vectors(vectors, vec_id, embedding, size, scale), "whole")
    centroids = fit(whole, k, rounds)
    near = scratch.stored(assign(whole, centroids), "assigned")
    sums = near.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # k rows at most
    inertia = sum(r["cluster_inertia"] for r in sums)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = [(r["cluster"], r["cluster_inertia"], inertia, digests[r["cluster"]]) for r in sums]
    # One row for each cluster, so it may be broadcast.
    known = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return near.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
