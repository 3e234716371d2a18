"""Quality by compression: zstandard dictionaries of good and of bad text.

A text resembles the class whose dictionary compresses it better. Texts are cut into stretches, so that a
dictionary matters to the end of a long text, and all stretches of the whole text count. The difference of the two
compressed sizes over the text's size goes through a logistic curve fitted on labelled texts that the dictionaries
have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.labelled import fit_logistic, held_out, labels_to_learn, logistic, sample_ids, spread_parts, with_texts

# The dictionaries and the curve are learned from at most so many labelled documents of each class, and of each
# from at most PARTS stretches of STRETCH characters, spaced over the whole text.
PER_CLASS = 1_500
PARTS = 6
STRETCH = 1_024
DICTIONARY = 64 * 1_024
LEVEL = 3
# Learning rows: crc32 of the document's id, modulo this, is not HELD.
MODULUS, HELD = 3, 1


class Model(NamedTuple):
    good: bytes
    bad: bytes
    curve: np.ndarray


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; the texts themselves where they are too few to train on."""
    try:
        return zstd.train_dictionary(DICTIONARY, samples, k=256, d=8).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(samples)[-DICTIONARY:]


def _compressors(model: Model) -> list[zstd.ZstdCompressor]:
    made = []
    for blob in (model.good, model.bad):
        book = zstd.ZstdCompressionDict(blob) if blob else None
        if book:
            book.precompute_compress(level=LEVEL)
        made.append(zstd.ZstdCompressor(level=LEVEL, dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False))
    return made


def difference(texts: list[bytes], model: Model) -> np.ndarray:
    """Size under the bad dictionary less that under the good one, over the text's bytes; 0 for an empty text."""
    good, bad = _compressors(model)
    made = np.zeros(len(texts))
    for k, text in enumerate(texts):
        if text:
            cuts = [text[at : at + STRETCH] for at in range(0, len(text), STRETCH)]
            made[k] = (sum(len(bad.compress(c)) for c in cuts) - sum(len(good.compress(c)) for c in cuts)) / len(text)
    return made


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text") -> Model:
    """Dictionaries from two thirds of a bounded labelled sample, the curve from the other third.

    Without labels of both classes every score is the share of label 1 among the learning rows, or a half.
    """
    usable = labels_to_learn(labels, label, MODULUS, HELD, key)
    share = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    n0, n1 = share.get(0, 0), share.get(1, 0)
    if not n0 or not n1:
        p = min(max((n1 + 0.5) / (n0 + n1 + 1), 0.01), 0.99)
        return Model(b"", b"", np.array([0.0, np.log(p / (1 - p))]))
    sample = with_texts(sample_ids(usable, {0: PER_CLASS, 1: PER_CLASS}), docs, key, text)
    rows = sample.select("_doc", "label", spread_parts(F.col("_text"), PARTS, STRETCH).alias("parts")).collect()
    rows.sort(key=lambda r: (r._doc, r.parts))
    rest, books = [], {0: [], 1: []}
    seen = {0: 0, 1: 0}
    for r in rows:
        seen[r.label] += 1
        if seen[r.label] % 3 == 0:
            rest.append(r)
        else:
            books[r.label] += [p.encode()[:STRETCH] for p in r.parts if p]
    model = Model(_dictionary(books[1]), _dictionary(books[0]), np.array([1.0, 0.0]))
    if {r.label for r in rest} != {0, 1}:
        rest = rows
    x = difference(["".join(r.parts).encode() for r in rest], model)
    y = np.array([r.label for r in rest], dtype=float)
    weight = np.where(y == 1, n1 / y.sum(), n0 / (1 - y).sum())
    return model._replace(curve=fit_logistic(x[:, None], y, weight))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``key``, ``held_out``, ``score`` (0 to 1), ``predicted`` and ``difference``.

    Every row is scored by its whole text; a null text counts as empty, and an empty one has difference 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICTIONARY bytes

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode() if x else b"" for x in batch.column("_text").to_pylist()]
            x = difference(texts, shared.value)
            p = logistic(x[:, None], shared.value.curve)
            columns = [batch.column("_doc"), batch.column("held_out"), pa.array(p), pa.array(p >= 0.5).cast(pa.int32()), pa.array(x)]
            yield pa.RecordBatch.from_arrays(columns, [key, "held_out", "score", "predicted", "difference"])

    kind = dict(docs.dtypes)[key]
    named = docs.select(F.col(key).alias("_doc"), held_out(F.col(key), MODULUS, HELD).alias("held_out"), F.col(text).alias("_text"))
    return named.mapInArrow(work, f"`{key}` {kind}, held_out boolean, score double, predicted int, difference double")
