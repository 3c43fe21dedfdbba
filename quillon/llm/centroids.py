"""Centroid clustering with exponion search, in exact integers.

A vector carries its centroid, an upper bound of the distance to it and a lower bound of the distance to any other.
Where the bounds can't tell, only the centroids in a ball around the vector's own centroid are looked at: those within
twice the distance plus the way to the nearest other centroid, from lists of the distances between centroids in order.
The radius is inclusive and bounds are rounded outwards, so ties are always looked at and go to the smaller number.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import written

#: Quantised components beyond it would not leave a squared distance in 64 bits.
LARGEST = 1 << 27
#: Sums of squares below it are exact in doubles.
EXACT = 1 << 53
#: Bounds are widened by this part, more than the rounding of a square root and of the sums of movements.
SLACK = 1e-9


def squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to one centre."""
    d = points - centre
    if d.size and float(np.abs(d).max()) ** 2 * d.shape[1] < EXACT:
        d = d.astype(float)
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


class Balls:
    """Centroids with, for each of them, the others in the order of their distance from it."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        between = np.sqrt(np.array([squares(centroids, c) for c in centroids], dtype=float).reshape(n, n))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.distance = np.take_along_axis(between, self.order, 1)
        off = between + np.where(np.eye(n, dtype=bool), np.inf, 0)
        self.nearest_other = off.min(1) if n > 1 else np.full(n, np.inf)

    def assign(self, points: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(centroid, upper bound, lower bound, distances computed) of all points, from those of the round before."""
        own, upper, lower = own.copy(), upper.copy(), lower.copy()
        safe = np.maximum(lower, self.nearest_other[own] / 2 * (1 - SLACK))
        looked = 0
        unsure = np.flatnonzero(upper >= safe)  # an equal bound may hide a tie
        for c in np.unique(own[unsure]).tolist():
            rows = unsure[own[unsure] == c]
            exact = squares(points[rows], self.centroids[c])
            looked += len(rows)
            upper[rows] = np.sqrt(exact) * (1 + SLACK)
            still = upper[rows] >= safe[rows]
            rows, exact = rows[still], exact[still]
            if not len(rows) or len(self.centroids) == 1:
                continue
            radius = (2 * upper[rows] + self.nearest_other[c]) * (1 + SLACK)
            reach = np.searchsorted(self.distance[c], radius, side="right")
            best, second, number = exact, np.full(len(rows), np.inf), np.full(len(rows), c)
            for place in range(len(self.centroids)):
                within = np.flatnonzero(reach > place)
                if not len(within):
                    break
                other = int(self.order[c, place])
                if other == c:
                    continue
                found = squares(points[rows[within]], self.centroids[other])
                looked += len(within)
                old = best[within]
                wins = (found < old) | ((found == old) & (other < number[within]))
                second[within] = np.minimum(second[within], np.where(wins, old, found))
                best[within], number[within] = np.where(wins, found, old), np.where(wins, other, number[within])
            own[rows], upper[rows] = number, np.sqrt(best) * (1 + SLACK)
            # what lies outside the ball is farther away than the second best in it
            lower[rows] = np.sqrt(second) * (1 - SLACK)
        return own, upper, lower, looked

    def moved(self, centroids: np.ndarray) -> np.ndarray:
        """How far each centroid goes to the new ones."""
        return np.sqrt(np.array([squares(a[None], b)[0] for a, b in zip(self.centroids, centroids, strict=True)], dtype=float)) * (1 + SLACK)


def loosened(own: np.ndarray, upper: np.ndarray, lower: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bounds after the centroids have moved: the own one's way, and the longest way of the others."""
    order = np.argsort(-moved, kind="stable")
    longest = moved[order[0]] if len(order) else 0.0
    others = np.where(own == order[0], moved[order[1]] if len(order) > 1 else 0.0, longest) if len(order) else 0.0
    return (upper + moved[own]) * (1 + SLACK), np.maximum(lower - others, 0) * (1 - SLACK)


def _points(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(-1, dim)


def _seeds(kept_rows: DataFrame, clusters: int, seed: int, id_col: str) -> np.ndarray:
    """The vectors with the smallest sha256 of ``seed:id``; equal hashes by the vector, null ids last."""
    first = kept_rows.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256).asc_nulls_last(), "v").limit(clusters).select("v").collect()
    return np.array([r.v for r in first], dtype=np.int64)


def exponion_clusters(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dim: int = 64, factor: float = 64.0, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row for each vector of exactly ``dim`` finite components: id_col, cluster, distance (squared), cluster_inertia,
    inertia and centroid_sha256, with components floor(factor * x).

    Each of ``rounds`` rounds assigns all vectors and moves each non-empty centroid to the floored mean of its vectors;
    then all are assigned once more. Vectors that are null, of another length, or hold null or non-finite components
    take no part. Ties go to the smaller number; repeated rows count as often as they occur; a null id seeds no cluster
    before others. Fewer vectors than clusters give as many clusters as vectors; an empty table gives no rows. Components beyond
    2^27 after the factor are an error, as squared distances would not fit. Other columns are left behind.
    """
    spark = vectors.sparkSession
    x = F.col(vector_col)
    whole = F.coalesce((F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    checked = F.transform(x, lambda c: F.floor(c.cast("double") * factor))
    fits = F.forall(x, lambda c: F.abs(c.cast("double") * factor) < LARGEST)
    start = vectors.filter(whole).select(F.col(id_col), F.when(fits, checked.cast("array<long>")).otherwise(F.raise_error(F.lit("vector component too large for exact distances"))).alias("v"))
    state = written(start, "vectors")
    kind = f"`{id_col}` {state.schema[id_col].dataType.simpleString()}"
    centroids = _seeds(state, clusters, seed, id_col)
    balls = moved = None
    for step in range(rounds + 1 if len(centroids) else 0):
        balls = Balls(centroids)

        def assign(batches, balls=balls, moved=moved, last=step == rounds):
            for batch in batches:
                points = _points(batch["v"], dim)
                if moved is None:  # unbounded as yet: all start at centroid 0
                    own, upper, lower = np.zeros(len(points), np.int64), np.full(len(points), np.inf), np.zeros(len(points))
                else:
                    own = np.asarray(batch["cluster"], dtype=np.int64)
                    upper, lower = loosened(own, np.asarray(batch["upper"]), np.asarray(batch["lower"]), moved)
                own, upper, lower, _ = balls.assign(points, own, upper, lower)
                if last:
                    exact = np.zeros(len(points), np.int64)
                    for c in np.unique(own).tolist():
                        exact[own == c] = squares(points[own == c], balls.centroids[c])
                    yield pa.RecordBatch.from_arrays([batch[id_col], pa.array(own, pa.int32()), pa.array(exact)], names=[id_col, "cluster", "distance"])
                else:
                    yield pa.RecordBatch.from_arrays([batch[id_col], batch["v"], pa.array(own, pa.int32()), pa.array(upper), pa.array(lower)], names=[id_col, "v", "cluster", "upper", "lower"])

        if step == rounds:
            state = written(state.mapInArrow(assign, f"{kind}, cluster int, distance long"), "assigned")
            break
        state = written(state.mapInArrow(assign, f"{kind}, v array<long>, cluster int, upper double, lower double"), "bounds")
        centroids = centroids.copy()
        sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(dim)]
        for c, n, *total in state.groupBy("cluster").agg(F.count(F.lit(1)), *sums).collect():  # a row for each cluster
            centroids[c] = [t // n for t in total]
        moved = balls.moved(centroids)
    if not len(centroids):
        return spark.createDataFrame([], f"{kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    spread = dict(state.groupBy("cluster").agg(F.sum("distance")).collect())  # a row for each cluster
    of = lambda values, c: F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster")).alias(c)
    digests = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()]
    inertia = of([spread.get(c, 0) for c in range(len(centroids))], "cluster_inertia").cast("long").alias("cluster_inertia")
    return state.select(id_col, "cluster", "distance", inertia, F.lit(sum(spread.values())).cast("long").alias("inertia"), of(digests, "centroid_sha256"))
