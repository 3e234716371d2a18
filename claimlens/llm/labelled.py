"""Bounded labelled samples and the calibration that the classifiers share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import crc_of


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether a document is kept from learning; a null key is never learned from."""
    return F.coalesce(F.pmod(crc_of(key), F.lit(modulus)) == remainder, F.lit(True))


def labels_to_learn(labels: DataFrame, label: str, modulus: int, remainder: int, key: str = "doc_id") -> DataFrame:
    """``_doc`` and ``label`` of the rows that may be learned from, one per document (the higher of two labels)."""
    named = labels.select(F.col(key).alias("_doc"), F.col(label).cast("int").alias("label"))
    usable = named.where("_doc is not null and label is not null").where(~held_out(F.col("_doc"), modulus, remainder))
    return usable.groupBy("_doc").agg(F.max("label").alias("label"))


def spread_parts(text: Column, parts: int, size: int) -> Column:
    """Up to ``parts`` stretches of ``size`` characters, spaced evenly over the whole text."""
    whole = F.ceil(F.length(text) / size).cast("int")
    step = F.greatest(F.lit(1.0), whole / parts)
    at = F.transform(F.sequence(F.lit(0), F.least(whole, F.lit(parts)) - 1), lambda k: (F.floor(k * step) * size + 1).cast("int"))
    return F.when(whole > 0, F.transform(at, lambda a: F.substring(text, a, size))).otherwise(F.array(F.coalesce(text, F.lit(""))))


def sample_ids(wanted: DataFrame, per_label: dict) -> DataFrame:
    """At most so many documents of each label, chosen by a hash of their key: a fixed, small choice."""
    parts = [wanted.where(F.col("label") == value).orderBy(F.xxhash64("_doc"), "_doc").limit(most) for value, most in per_label.items()]
    made = parts[0]
    for part in parts[1:]:
        made = made.union(part)
    return made


def with_texts(ids: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The sampled documents' texts. The ids are bounded by the sample's size, so they may be broadcast."""
    named = docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).where("_text is not null")
    return named.join(F.broadcast(ids), "_doc")


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic model over the columns of ``x`` and a constant, by Newton's method."""
    scale = np.maximum(np.abs(x).mean(axis=0), 1e-9)
    full = np.column_stack((x / scale, np.ones(len(x))))
    w = np.zeros(full.shape[1])
    weight = weight / max(weight.sum(), 1e-9)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        gradient = full.T @ (weight * (p - y)) + ridge * np.append(w[:-1], 0) * 1e-2
        curve = (full * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ full + ridge * 1e-2 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1])


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
