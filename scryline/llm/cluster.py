"""Centroid clustering of vectors in whole numbers, exact whatever the order of the sums.

A vector's components become floor(scale * x). They are written once in blocks of up to BLOCK vectors, each block a matrix of float64 (or
of float32 where that holds the same numbers). In every round each block's squared distances are |x|^2 - 2 x.c + |c|^2, one matrix
product in float64. Where every component of a vector and of a centroid is below a bound, no term or partial sum reaches 2^53, so
the result is exact; the others are computed in 64-bit integers, or in Python's where even those could overflow. Of these, only centroids whose
largest component alone doesn't already put them too far away are looked at. The vectors' sums and counts of each cluster are added up
by RDD treeAggregate: k * width whole numbers a task, so nothing that reaches the driver grows with the rows.

Defined results: vectors that aren't of the given width, or with a component that is null or whose scaled value isn't finite, are left out; rows that
repeat are vectors of their own; a vector without an id is clustered, but is a first centroid only if those with an id don't suffice;
first centroids with equal ids stand in the order of their components; with fewer vectors than k there are as many centroids as vectors;
empty clusters keep their centroid; ties go to the smaller number; distances and sums beyond 64 bits are null; further columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scryline.llm.common import release, staged

BLOCK = 4096
WIDTH, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
LONG = 1 << 63


def kept(vectors: DataFrame, id_: str, vector: str, width: int, scale: int) -> DataFrame:
    """id_, vector of the rows that take part."""
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity
    return vectors.where((F.size(vector) == width) & fits).select(id_, vector)


def first_centroids(rows: DataFrame, id_: str, vector: str, k: int, scale: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the least sha256 after `seed:`."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_).cast("string")), 256).alias("h")
    first = rows.select(hashed, F.col(vector).cast("array<double>").alias("x")).orderBy(F.asc_nulls_last("h"), "x").limit(k)
    return [[math.floor(scale * x) for x in r["x"]] for r in first.collect()]


def blocks(rows: DataFrame, id_: str, vector: str, width: int, scale: int) -> DataFrame:
    """ids array, x: the components of as many vectors, row by row, as little-endian float32 or float64."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8") * scale)
                with np.errstate(over="ignore"):
                    short = x.astype("<f4")
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([(short if np.array_equal(short, x) else x).tobytes()])], names=["ids", "x"])

    return rows.select(id_, vector).mapInArrow(pack, f"ids array<{rows.schema[id_].dataType.simpleString()}>, x binary")


def matrix(x: bytes, count: int, width: int) -> np.ndarray:
    return np.frombuffer(x, f"<f{len(x) // (count * width)}").astype(np.float64).reshape(count, width)


def bound(width: int) -> int:
    """If all components are below it, width * (|x| + |c|)^2 is below 2^53."""
    return math.isqrt((1 << 53) // width) // 2


def squared(x: np.ndarray, c: list[int]) -> np.ndarray:
    """Squared distances of rows to a centroid, in integers."""
    most = int(np.abs(x).max(initial=0)) + max(map(abs, c))
    if x.shape[1] * most * most < LONG:
        d = x.astype(np.int64) - np.array(c, np.int64)
        return (d * d).sum(axis=1).astype(object)
    return np.array([sum((int(a) - b) ** 2 for a, b in zip(row, c, strict=True)) for row in x.tolist()], object)


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the nearest centroid and its squared distance (int64, or Python's integers)."""
    size, tops = np.abs(x).max(axis=1, initial=0), [max(map(abs, c)) for c in centroids]
    low = size < bound(x.shape[1])
    small = [k for k, t in enumerate(tops) if t < bound(x.shape[1])]
    best, found = np.full(len(x), -1, np.int32), np.zeros(len(x), np.int64)
    if small and low.any():
        y, c = x if low.all() else x[low], np.array([centroids[k] for k in small], np.float64)
        d = (y * y).sum(axis=1)[:, None] - 2 * (y @ c.T) + (c * c).sum(axis=1)
        k = d.argmin(axis=1)
        best[low], found[low] = np.array(small, np.int32)[k], d[np.arange(len(y)), k].astype(np.int64)
    if low.all() and len(small) == len(centroids):
        return best, found
    found = found.astype(object)
    for k, c in enumerate(centroids):
        # not compared yet, and not sure to be further away by the largest component alone
        far = (np.maximum(float(tops[k]) - size, 0) ** 2 * (1 - 1e-9) > found.astype(np.float64)) & (best >= 0)
        todo = np.flatnonzero(~(low & far) if k not in small else ~low)
        d = squared(x[todo], c)
        closer = (best[todo] < 0) | (d < found[todo]) | ((d == found[todo]) & (best[todo] > k))
        best[todo[closer]], found[todo[closer]] = k, d[closer]
    return best, found


Totals = tuple[np.ndarray, np.ndarray, np.ndarray]


def nothing(k: int, width: int) -> Totals:
    """Of each cluster: its vectors' sum, how many there are, their distances' sum; Python's integers."""
    return tuple(np.full(shape, 0, object) for shape in ((k, width), k, k))  # type: ignore[return-value]


def totals(x: np.ndarray, centroids: list[list[int]]) -> Totals:
    """Those of a block."""
    best, found = nearest(x, centroids)
    sums, counts, distances = nothing(len(centroids), x.shape[1])
    low = np.abs(x).max(axis=1, initial=0) < min(bound(x.shape[1]), (1 << 53) // max(1, len(x)))
    chosen = (best[low, None] == np.arange(len(centroids))).astype(np.float64)
    sums += np.array((chosen.T @ x[low]).astype(np.int64).tolist(), object)  # below 2^53
    for i in np.flatnonzero(~low).tolist():
        sums[best[i]] += np.array([int(v) for v in x[i].tolist()], object)
    counts += np.array(np.bincount(best, minlength=len(centroids)).tolist(), object)
    for k in range(len(centroids)):
        distances[k] = sum(found[best == k].tolist())
    return sums, counts, distances


def gathered(packed: DataFrame, centroids: list[list[int]]) -> Totals:
    """The totals of all blocks."""
    width = len(centroids[0])

    def add(a: Totals, b: Totals) -> Totals:
        return tuple(x + y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]

    return packed.rdd.treeAggregate(nothing(len(centroids), width), lambda held, r: add(held, totals(matrix(r["x"], len(r["ids"]), width), centroids)), add)


def moved(centroids: list[list[int]], sums: np.ndarray, counts: np.ndarray) -> list[list[int]]:
    return [[s // n for s in row] if n else old for old, row, n in zip(centroids, sums.tolist(), counts.tolist(), strict=True)]


def clustered(vectors: DataFrame, id_: str, vector: str, k: int = K, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vectors (id_, vector, ...) -> id_, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows = kept(vectors, id_, vector, width, scale)
    schema = f"`{id_}` {vectors.schema[id_].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    centroids = first_centroids(rows, id_, vector, k, scale, seed)
    if not centroids:
        return vectors.sparkSession.createDataFrame([], schema)
    packed = staged(blocks(rows, id_, vector, width, scale), "vector-blocks")
    for _ in range(rounds):
        centroids = moved(centroids, *gathered(packed, centroids)[:2])
    fits = lambda x: x if x < LONG else None
    inertia = gathered(packed, centroids)[2].tolist()
    own, whole = pa.array([fits(x) for x in inertia], pa.int64()), fits(sum(inertia))
    digests = pa.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in zip(batch.column("ids"), batch.column("x"), strict=True):
                best, found = nearest(matrix(x.as_py(), len(ids), width), centroids)
                at = pa.array(best)
                yield pa.RecordBatch.from_arrays([ids.values, at, pa.array([fits(d) for d in found.tolist()], pa.int64()), own.take(at), pa.array([whole] * len(best), pa.int64()), digests.take(at)], names=[id_, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
            release()

    return packed.mapInArrow(assign, schema)


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole embedding's cluster."""
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


def _round(before: str, after: str) -> str:
    return f"""
a{after} AS MATERIALIZED (SELECT v.rid, any_value(v.x) AS x, min({{d: list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x), k: c.k}}) AS b FROM v CROSS JOIN {before} c GROUP BY v.rid),
m{after} AS (SELECT k, j, CAST(sum(y) AS HUGEINT) AS s, count(*) AS n FROM (SELECT b.k AS k, unnest(x) AS y, generate_subscripts(x, 1) AS j FROM a{after}) GROUP BY k, j),
n{after} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS x FROM m{after} GROUP BY k),
{after} AS MATERIALIZED (SELECT c.k, coalesce(n{after}.x, c.x) AS x FROM {before} c LEFT JOIN n{after} USING (k))"""


#: Each round in turn; whole numbers in double are exact at these sizes.
OP11_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS k, x FROM (FROM v ORDER BY sha256('{SEED}:' || vec_id) LIMIT {K})),
{",".join(_round(f"c{i}", f"c{i + 1}") for i in range(ROUNDS))},
e AS (SELECT v.rid, any_value(v.vec_id) AS vec_id, min({{d: list_inner_product(v.x, v.x) - 2 * list_inner_product(v.x, c.x) + list_inner_product(c.x, c.x), k: c.k}}) AS b FROM v CROSS JOIN c{ROUNDS} c GROUP BY v.rid)
SELECT vec_id, CAST(b.k AS INT) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM e JOIN c{ROUNDS} c ON c.k = b.k
"""
