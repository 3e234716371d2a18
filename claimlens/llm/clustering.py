"""K-means over integer vectors; every vector finds its centroid by a tournament of bisectors.

Two centroids are parted by the plane halfway between them. With the integer normal 2 (b - a) and the threshold
|b|**2 - |a|**2, a vector x lies nearer to b exactly if normal . x > threshold. The champion so far meets each further
centroid in such a test of one sign; zero means a tie and leaves the smaller number. After k - 1 tests the champion is
the nearest centroid, and only its distance is computed, exactly.

A round is one pass over the vectors: each task adds up its vectors by cluster, and what leaves it is one row per
cluster and component. The driver holds k centroids. All numbers are integers: as doubles while every product and sum is
below 2**53 and thus exact, as Python integers otherwise.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import stored

LIMB = 10**18
LONG = 2**63
PIECE_ROWS = 4_096
RESULTS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def whole_vectors(df: DataFrame, key: str, column: str, width: int) -> DataFrame:
    """``_key`` and ``_x`` of the rows whose vector has exactly ``width`` components, all of them finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = df.where((F.size(column) == width) & finite)
    return kept.select(F.col(key).alias("_key"), F.col(column).cast("array<double>").alias("_x"))


def integer(x: float, scale: int) -> int:
    return math.floor(Fraction(x) * scale)


def matrices(batch: pa.RecordBatch, width: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch with their vectors as doubles, scaled and floored; a scale by a power of two is exact."""
    for at in range(0, batch.num_rows, PIECE_ROWS):
        part = batch.slice(at, PIECE_ROWS)
        values = part.column(part.schema.get_field_index("_x")).flatten()
        yield part, np.floor(np.asarray(values, dtype=np.float64).reshape(-1, width) * scale)


class Bisectors:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: list[list[int]], scale: int):
        self.centroids, self.scale = centroids, scale
        width = len(centroids[0])
        # Below this, 64 products of a normal and a vector add up to less than 2**53.
        self.limit = math.isqrt(2**51 // width)
        k = len(centroids)
        self.normals = [[[2 * (b - a) for a, b in zip(centroids[i], centroids[j])] for j in range(k)] for i in range(k)]
        square = [sum(c * c for c in row) for row in centroids]
        self.thresholds = [[square[j] - square[i] for j in range(k)] for i in range(k)]
        self.small = all(abs(c) < self.limit for row in centroids for c in row)
        if self.small:
            self.points = np.array(centroids, dtype=np.float64)
            self.planes = np.array(self.normals, dtype=np.float64)
            self.levels = np.array(self.thresholds, dtype=np.float64)

    def fits(self, vectors: np.ndarray) -> np.ndarray:
        """Which rows may be computed in doubles."""
        return (np.abs(vectors) < self.limit).all(axis=1) if self.small else np.zeros(len(vectors), dtype=bool)

    def champions(self, vectors: np.ndarray) -> np.ndarray:
        """The nearest centroid of each row that fits, the smaller number of equal ones."""
        champion = np.zeros(len(vectors), dtype=np.int64)
        for j in range(1, len(self.centroids)):
            side = np.einsum("nd,nd->n", vectors, self.planes[champion, j])
            champion[side > self.levels[champion, j]] = j
        return champion

    def champion(self, vector: list[int]) -> int:
        best = 0
        for j in range(1, len(self.centroids)):
            if sum(n * x for n, x in zip(self.normals[best][j], vector)) > self.thresholds[best][j]:
                best = j
        return best

    def distances(self, vectors: np.ndarray, champion: np.ndarray) -> np.ndarray:
        return ((vectors - self.points[champion]) ** 2).sum(axis=1).astype(np.int64)

    def distance(self, vector: list[int], champion: int) -> int:
        return sum((x - c) ** 2 for x, c in zip(vector, self.centroids[champion]))

    def large(self, part: pa.RecordBatch, fits: np.ndarray) -> list[tuple[int, list[int]]]:
        """Place and exact integers of the rows that do not fit."""
        column = part.column(part.schema.get_field_index("_x"))
        return [(k, [integer(x, self.scale) for x in column[k].as_py()]) for k in np.flatnonzero(~fits).tolist()]


def cluster_sums(vectors: DataFrame, bisectors: Bisectors) -> list[tuple[int, int, list[int]]]:
    """Number, members and component sums of every cluster that has members."""
    width, scale, k = len(bisectors.centroids[0]), bisectors.scale, len(bisectors.centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = [0] * k
        sums = [[0] * width for _ in range(k)]

        def more(cluster: int, n: int, row: list[int]) -> None:
            members[cluster] += n
            sums[cluster] = [a + b for a, b in zip(sums[cluster], row)]

        for batch in batches:
            for part, matrix in matrices(batch, width, scale):
                fits = bisectors.fits(matrix)
                if fits.any():
                    inside = matrix[fits]
                    champion = bisectors.champions(inside)
                    for cluster in np.unique(champion).tolist():
                        own = inside[champion == cluster]
                        more(cluster, len(own), [int(x) for x in own.sum(axis=0)])
                for _, row in bisectors.large(part, fits):
                    more(bisectors.champion(row), 1, row)
        found = [(c, p, members[c], *divmod(sums[c][p], LIMB)) for c in range(k) if members[c] for p in range(width)]
        columns = list(zip(*found)) or [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38), pa.decimal128(38)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["cluster", "place", "members", "high", "low"])

    partial = vectors.select("_x").mapInArrow(add, "cluster int, place int, members long, high decimal(38,0), low decimal(38,0)")
    total = partial.groupBy("cluster", "place").agg(*[F.sum(c).alias(c) for c in ("members", "high", "low")])
    # k * width rows.
    rows = sorted(total.collect())
    made = []
    for c in range(k):
        own = [r for r in rows if r.cluster == c]
        if own:
            made.append((c, own[0].members, [int(r.high) * LIMB + int(r.low) for r in own]))
    return made


def assigned(vectors: DataFrame, bisectors: Bisectors) -> DataFrame:
    """``_key``, ``cluster`` and ``distance`` of every vector; a distance beyond a long is null."""
    width, scale = len(bisectors.centroids[0]), bisectors.scale

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, matrix in matrices(batch, width, scale):
                fits = bisectors.fits(matrix)
                cluster = np.zeros(len(matrix), dtype=np.int64)
                distance = np.zeros(len(matrix), dtype=np.int64)
                beyond = np.zeros(len(matrix), dtype=bool)
                if fits.any():
                    cluster[fits] = bisectors.champions(matrix[fits])
                    distance[fits] = bisectors.distances(matrix[fits], cluster[fits])
                for k, row in bisectors.large(part, fits):
                    cluster[k] = bisectors.champion(row)
                    exact = bisectors.distance(row, int(cluster[k]))
                    beyond[k] = exact >= LONG
                    distance[k] = 0 if beyond[k] else exact
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index("_key")), pa.array(cluster, pa.int32()), pa.array(distance, mask=beyond)],
                    ["_key", "cluster", "distance"],
                )

    kind = vectors.schema["_key"].dataType.simpleString()
    return vectors.mapInArrow(assign, f"_key {kind}, cluster int, distance long")


def first_centroids(vectors: DataFrame, k: int, scale: int, salt: str) -> list[list[int]]:
    """The k vectors with the least sha256 of ``salt`` and key, in that order; equal keys go by their components."""
    hashed = vectors.select(F.sha2(F.concat(F.lit(salt), F.col("_key").cast("string")), 256).alias("_hash"), "_x")
    rows = hashed.orderBy(F.col("_hash").asc_nulls_last(), "_x").limit(k).collect()
    return [[integer(x, scale) for x in r["_x"]] for r in rows]


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def centroid_clusters(
    df: DataFrame,
    key: str = "vec_id",
    column: str = "embedding",
    width: int = 64,
    scale: int = 1024,
    k: int = 8,
    rounds: int = 10,
    salt: str = "3:",
) -> DataFrame:
    """One row per vector: ``key``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    A vector with another number of components than ``width``, or with a null, undefined or infinite one, or null
    itself, has no row. Components x become floor(scale * x), ``scale`` being a power of two. ``rounds`` times every
    vector goes to its nearest centroid, the smaller number of equally near ones, and every centroid with members moves
    to their mean, rounded down; then the vectors are assigned once more. Repeated rows count and are returned each;
    a null key is the last to become a first centroid. With fewer than k vectors each is a centroid; an empty table
    gives no rows. A distance or inertia beyond a long is null. Other columns are not read and may have any name.
    """
    if key in RESULTS:
        raise ValueError(f"the key cannot be called {key}, as a column of the result is")
    vectors = stored(whole_vectors(df, key, column, width), "vectors")
    centroids = first_centroids(vectors, k, scale, salt)
    bisectors = Bisectors(centroids or [[0] * width], scale)
    for _ in range(rounds if centroids else 0):
        for cluster, members, sums in cluster_sums(vectors, bisectors):
            centroids[cluster] = [s // members for s in sums]
        bisectors = Bisectors(centroids, scale)
    found = stored(assigned(vectors, bisectors), "assigned")
    # A row per centroid. Clusters with a distance that is null have no inertia, and then there is no total either.
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: (r.inertia if r.known else None) for r in found.groupBy("cluster").agg(whole.alias("inertia"), (F.count("distance") == F.count("*")).alias("known")).collect()}
    total = None if None in inertia.values() else sum(inertia.values())

    def long(value) -> int | None:
        return int(value) if value is not None and value < LONG else None

    by_cluster = [(c, long(inertia.get(c)), centroid_digest(row)) for c, row in enumerate(centroids)]
    sums = F.array(*[F.lit(s).cast("long") for _, s, _ in by_cluster]) if by_cluster else F.array().cast("array<long>")
    digests = F.array(*[F.lit(d) for _, _, d in by_cluster]) if by_cluster else F.array().cast("array<string>")
    return found.select(
        F.col("_key").alias(key),
        "cluster",
        "distance",
        F.get(sums, "cluster").alias("cluster_inertia"),
        F.lit(long(total)).cast("long").alias("inertia"),
        F.get(digests, "cluster").alias("centroid_sha256"),
    )
