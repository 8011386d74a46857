"""Centroid clustering with Elkan's bounds on integer vectors.  [operator 13]

Every vector carries its centroid, an upper bound of the distance to it and a lower
bound of the distance to each of the k centroids.  A round moves the bounds by how far
centroids have moved, and computes a distance only where neither a lower bound nor half
the distance between two centroids is greater than the upper bound.  Bounds are doubles
that are always rounded away from the true value and the comparisons are strict, so a
centroid at the same distance is never passed over; what is computed are exact integers.

A round is one pass over a table of vectors and bounds, written in the shared folder,
and one aggregation into k sums; only k centroids, counts and sums come to the driver.

Cases with a defined result
  null or short vector     left out, as is one with a null, NaN or infinite component
  null id                  kept; it is hashed as an empty text and returned as null
  ties                     the centroid with the smaller number
  repeated rows            each is a vector; first centroids of equal hash stand in order
                           of their components
  fewer vectors than k     as many centroids as there are vectors
  empty table              an empty result
  large components         beyond 2**27 after scaling, where a squared distance may not
                           fit a long, the run ends with an error that says so
  extra columns            left out
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import begin_task, discard, materialize

#: Largest scaled component: 64 squares of differences fit a long.
MOST = 1 << 27
_SLACK = 2.0**-50


def _up(v: np.ndarray) -> np.ndarray:
    return v * (1 + _SLACK)


def _down(v: np.ndarray) -> np.ndarray:
    return np.maximum(v * (1 - _SLACK), 0)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers."""
    d = x - c
    return (d * d).sum(axis=-1)


def half_distances(centroids: np.ndarray) -> np.ndarray:
    """Half the distance of each two centroids, or a little less."""
    return _down(np.sqrt(squared(centroids[:, None], centroids[None]).astype(float)) / 2)


def assign(x: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, half: np.ndarray) -> int:
    """Set each row's centroid and bounds in place; returns how many distances were computed."""
    may = ~(lower > upper[:, None]) & ~(half[a] > upper[:, None])
    may[np.arange(len(a)), a] = False
    rows = np.flatnonzero(may.any(axis=1))
    if not len(rows):
        return 0
    x, mine, top, low = x[rows], a[rows], upper[rows], lower[rows]
    best = squared(x, centroids[mine])
    top = _up(np.sqrt(best.astype(float)))
    low[np.arange(len(rows)), mine] = _down(np.sqrt(best.astype(float)))
    computed = len(rows)
    for c in range(len(centroids)):
        at = np.flatnonzero((mine != c) & ~(low[:, c] > top) & ~(half[mine, c] > top))
        if not len(at):
            continue
        computed += len(at)
        d = squared(x[at], centroids[c])
        root = np.sqrt(d.astype(float))
        low[at, c] = _down(root)
        better = (d < best[at]) | ((d == best[at]) & (c < mine[at]))
        won = at[better]
        best[won], mine[won], top[won] = d[better], c, _up(root[better])
    a[rows], upper[rows], lower[rows] = mine, top, low
    return computed


def integer_vectors(vectors: DataFrame, id_column: str, vector_column: str, dimensions: int, scale: int) -> DataFrame:
    """(id, x array<int>) of the vectors that are whole: floor(scale * component)."""
    v = F.col(vector_column).cast("array<double>")
    good = F.coalesce((F.size(v) == dimensions) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))

    def whole(e: Column) -> Column:
        scaled = F.floor(e * F.lit(float(scale)))
        return F.when(F.abs(e * F.lit(float(scale))) <= MOST, scaled).otherwise(F.raise_error("a component is too large for exact squared distances").cast("bigint")).cast("int")

    return vectors.filter(good).select(F.col(id_column).alias("id"), F.transform(v, whole).alias("x"))


def first_centroids(points: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    chosen = points.select(h.alias("h"), "x").orderBy("h", "x").limit(k).collect()  # k rows
    return np.array([r["x"] for r in chosen], np.int64)


def _round(centroids: np.ndarray, moved: np.ndarray):
    half = half_distances(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("elkan")
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(n, -1)
            a = batch.column("cluster").to_numpy().copy()
            upper = _up(batch.column("upper").to_numpy() + moved[a])
            lower = _down(batch.column("lower").flatten().to_numpy().reshape(n, -1) - moved)
            assign(x, a, upper, lower, centroids, half)
            at = pa.array(np.arange(0, n * len(centroids) + 1, len(centroids), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), pa.array(a, pa.int32()), pa.array(upper), pa.ListArray.from_arrays(at, pa.array(lower.ravel()))], ["id", "x", "cluster", "upper", "lower"])

    return work


def _sums(state: DataFrame, dimensions: int) -> dict[int, tuple[int, list[int]]]:
    """Count and componentwise sums of each cluster, k rows."""
    total = [F.sum(F.get("x", F.lit(d)).cast("bigint")).alias(f"s{d}") for d in range(dimensions)]
    rows = state.groupBy("cluster").agg(F.count("*").alias("n"), *total).collect()
    return {r["cluster"]: (r["n"], [r[f"s{d}"] for d in range(dimensions)]) for r in rows}


def cluster(vectors: DataFrame, *, k: int = 8, rounds: int = 10, seed: int = 3, dimensions: int = 64, scale: int = 1024, id_column: str = "vec_id", vector_column: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(assignment, centroids): (id, x, cluster int, distance long) after ``rounds`` rounds and a last assignment.

    Rounds end early once no centroid moves: further ones would change nothing.
    """
    points = integer_vectors(vectors, id_column, vector_column, dimensions, scale)
    kind = points.schema["id"].dataType.simpleString()
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        return points.select("id", "x", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    schema = f"id {kind}, x array<int>, cluster int, upper double, lower array<double>"
    state = points.select("id", "x", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.array_repeat(F.lit(0.0), len(centroids)).alias("lower"))
    moved = np.zeros(len(centroids))
    for n in range(rounds + 1):
        before, state = state, materialize(state.mapInArrow(_round(centroids, moved), schema), f"round-{n}")
        if n:
            discard(before)
        if n == rounds:
            break
        sums = _sums(state, dimensions)
        means = np.array([[s // sums[c][0] for s in sums[c][1]] if c in sums else list(map(int, centroids[c])) for c in range(len(centroids))], np.int64)
        if (means == centroids).all():
            break
        moved = _up(np.sqrt(squared(means, centroids).astype(float)))
        centroids = means

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().astype(np.int64).reshape(batch.num_rows, -1)
            d = squared(x, centroids[batch.column("cluster").to_numpy()]) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d)], [*batch.schema.names, "distance"])

    done = state.select("id", "x", "cluster").mapInArrow(distances, f"id {kind}, x array<int>, cluster int, distance long")
    return done, centroids.tolist()


def centroid_sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def report(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of an assignment."""
    columns = [F.col("id").alias("vec_id"), "cluster", "distance"]
    if not centroids:
        return assigned.select(*columns, *[F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    sums = {r["cluster"]: r["d"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # k rows
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    inertia = [sums.get(c, 0) for c in range(len(centroids))]
    return assigned.select(*columns, of(inertia).cast("long").alias("cluster_inertia"), F.lit(sum(inertia)).cast("long").alias("inertia"), of([centroid_sha256(c) for c in centroids]).alias("centroid_sha256"))
