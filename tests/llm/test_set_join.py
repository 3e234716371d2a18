"""The heavy-light join against brute force over all pairs, and on odd texts."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimlens.llm import set_join


def shingles(text, width):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    return frozenset(" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1)))


def brute(rows, width=4, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for k, (key, _) in enumerate(rows):
        if key is not None:
            least[root(k)] = min(key, least.get(root(k), key))
    return sorted(((key, len(sets[k]), least.get(root(k))) for k, (key, _) in enumerate(rows)), key=str)


def frame(spark, rows):
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return made.withColumns({c: F.lit("clash") for c in ("_doc", "_text", "_seal", "node", "n", "f1", "e", "df", "least", "component_id")})


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def composed(seed):
    """Short and long texts with near copies of differing distance, chains, a common passage and hub-less groups."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choice(words, 40))
    rows = []
    for length in (1, 2, 3, 4, 5, 7, 9, 12, 16, 20, 24, 30, 36, 60, 150):
        for _ in range(3):
            text = list(rng.choice(words, length))
            rows.append(" ".join(text))
            for _ in range(4):
                edited = list(text)
                for place in rng.integers(0, length, max(1, length // 60)):
                    edited[place] = str(rng.choice(words))
                rows.append(" ".join(edited))
            # A chain: each loses another word of the one before.
            chain = list(text)
            for _ in range(3):
                chain = chain[1:] if rng.random() < 0.5 else chain[:-1]
                rows.append(" ".join(chain))
    rows += [" ".join(rng.choice(words, 25)) + " " + passage for _ in range(12)]
    # Copies of one text that is not there: every two of them differ in about as much as may be.
    missing = list(rng.choice(words, 90))
    for _ in range(25):
        edited = list(missing)
        edited[rng.integers(0, 90)] = str(rng.choice(words))
        rows.append(" ".join(edited))
    keys = rng.permutation(len(rows)) + 10
    odd = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (None, rows[0]), (None, "alone here"), (6, "É é"), (6, "É é"), (7, rows[8]), (7, rows[8]), (7, "another")]
    return [(int(k), t) for k, t in zip(keys, rows)] + odd


@pytest.mark.parametrize("most_light, block", [(32, 1_000_000), (0, 300), (14, 500), (32, 200)])
def test_equals_all_pairs(spark, monkeypatch, most_light, block):
    """Wherever the boundary lies, and however many blocks a cloud is cut into."""
    monkeypatch.setattr(set_join, "MOST_LIGHT", most_light)
    monkeypatch.setattr(set_join, "BLOCK", block)
    rows = composed(most_light + block)
    found = set_join.jaccard_components(frame(spark, rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert collected(found) == brute(rows)


def test_all_light(spark, monkeypatch):
    """Subsets alone, when lists would cost most."""
    monkeypatch.setattr(set_join, "SUBSET_COST", 0)
    rows = composed(3)
    assert collected(set_join.jaccard_components(frame(spark, rows))) == brute(rows)


def test_other_width_and_similarity(spark):
    rows = composed(4)[:150]
    assert collected(set_join.jaccard_components(frame(spark, rows), width=2, percent=60)) == brute(rows, 2, 60)


def test_empty_table(spark):
    assert set_join.jaccard_components(frame(spark, [(1, "a")]).limit(0)).collect() == []


def test_scan_connects_what_is_linked():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sets = []
        for _ in range(rng.integers(1, 6)):
            base = rng.integers(0, 10**6, rng.integers(1, 30))
            for _ in range(rng.integers(1, 8)):
                kept = base[rng.random(len(base)) < 0.95]
                sets.append(np.unique(np.append(kept, rng.integers(0, 50, 1))))
        size = np.array([len(x) for x in sets])
        links = set_join.scan(sets, size, rng.random(len(sets)), 85)
        linked = [(i, j) for i in range(len(sets)) for j in range(i) if 185 * len(np.intersect1d(sets[i], sets[j])) >= 85 * (size[i] + size[j])]
        assert labels(len(sets), links) == labels(len(sets), linked)


def labels(n, links):
    of = list(range(n))
    for u, v in links:
        a, b = of[u], of[v]
        of = [min(a, b) if x in (a, b) else x for x in of]
    return of
