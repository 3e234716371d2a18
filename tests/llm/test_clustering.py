"""Centroid clustering against plain Python integers and its SQL, and on odd vectors."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from claimlens.llm import clustering


def brute(rows, width, k, rounds, scale=1024):
    kept = [
        (key, [math.floor(Fraction(x) * scale) for x in xs])
        for key, xs in rows
        if xs is not None and len(xs) == width and all(x is not None and math.isfinite(x) for x in xs)
    ]
    digest = lambda key: (key is None, hashlib.sha256(f"3:{key}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, members in groups.items():
            centroids[j] = [sum(column) // len(members) for column in zip(*members)]
    found = [(key, *nearest(v)) for key, v in kept]
    by = {j: sum(d for _, d, i in found if i == j) for j in range(k)}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    total = sum(by.values())
    return sorted(((key, j, d, by[j], total, names[j]) for key, d, j in found), key=str)


def frame(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return made.withColumns({c: F.lit("clash") for c in ("_key", "_x", "cluster", "distance", "inertia", "_hash")})


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_plain_integers(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(k % 5, 1, 6)]) for k in range(300)]
    # Integers that tie often, copies of a row, and everything that is left out.
    rows += [(400 + k, [float(x) / 1024 for x in rng.integers(-2, 3, 6)]) for k in range(80)]
    rows += [rows[3]] * 40 + [(None, rows[5][1]), (501, None), (502, []), (503, [1.0] * 5), (504, [1.0] * 7), (505, [1.0] * 5 + [None])]
    rows += [(506, [1.0] * 5 + [float("nan")]), (507, [float("-inf")] + [1.0] * 5)]
    for k, rounds in ((8, 10), (3, 2), (1, 1)):
        found = clustering.centroid_clusters(frame(spark, rows), width=6, k=k, rounds=rounds)
        assert found.columns == ["vec_id", *clustering.RESULTS]
        assert collected(found) == brute(rows, 6, k, rounds)


def test_vectors_beyond_exact_doubles(spark):
    rows = [(k, [float(np.float32(x)) for x in np.random.default_rng(k).normal(0, 10.0**p, 4)]) for k, p in enumerate([0, 1, 4, 5, 5, 4, 1, 0] * 4)]
    assert collected(clustering.centroid_clusters(frame(spark, rows), width=4, k=3, rounds=4)) == brute(rows, 4, 3, 4)
    huge = [*rows, (99, [float(np.float32(x)) for x in (3e38, 0.0, 0.0, -3e38)])]
    made = {r.vec_id: r for r in clustering.centroid_clusters(frame(spark, huge), width=4, k=2, rounds=1).collect()}
    plain = {r[0]: r for r in brute(huge, 4, 2, 1)}
    for key, r in made.items():
        assert (r.cluster, r.centroid_sha256) == (plain[key][1], plain[key][5])
        assert r.distance == (plain[key][2] if plain[key][2] < 2**63 else None)
        assert r.inertia is None


def test_few_and_no_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    assert collected(clustering.centroid_clusters(frame(spark, rows), width=2)) == brute(rows, 2, 8, 10)
    assert clustering.centroid_clusters(frame(spark, rows), width=3).collect() == []
    assert clustering.centroid_clusters(frame(spark, rows).limit(0), width=2).collect() == []


def test_tie_goes_to_the_smaller_number():
    bisectors = clustering.Bisectors([[0, 0], [4, 0], [2, 2]], 1024)
    vectors = np.array([[2.0, 0.0], [3.0, 0.0], [2.0, 1.0]])
    assert bisectors.champions(vectors).tolist() == [bisectors.champion([int(x) for x in v]) for v in vectors] == [0, 1, 2]
