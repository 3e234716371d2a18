"""Packing by lexical retrieval: windows filled with the neighbours that a BM25 index returns.

Documents are indexed in shards of bounded size, each packed within one task and without a shuffle. In a shard every
window starts with a seed document; its BM25 neighbours that are still unused follow, best first, until the window
is full. The document that no longer fits is cut and its rest seeds the next window. What is left at a shard's end
is cut into sequences of a power of two, which need no padding: nothing is padded at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import kept, pieces
from claimlens.llm.tokens import Encoder

WINDOW = 2_048
END = 1
# Text of a shard: bounds the index and a task's memory. A single larger text makes a shard of its own.
SHARD_BYTES = 1_500_000
K1, B = 1.2, 0.75
# Sequence numbers of a task: the task's number times this, and on.
PER_TASK = 2**33


class Index:
    """An inverted index of token ids with BM25 weights; used documents drop out of the answers."""

    def __init__(self, documents: list[np.ndarray]):
        self.size = len(documents)
        size = np.array([len(d) for d in documents], dtype=np.int64)
        lengths = np.maximum(size, 1).astype(np.float64)
        # One sort of (document, term) for the whole shard.
        owner = np.repeat(np.arange(self.size, dtype=np.int64), size)
        flat = np.concatenate(documents).astype(np.int64) if documents else np.zeros(0, np.int64)
        pairs = np.sort((owner << 16) | flat)
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
        tf = np.diff(np.append(first, len(pairs))).astype(np.float64)
        owner, term = pairs[first] >> 16, pairs[first] & 0xFFFF
        self.terms, self.limits = term, np.searchsorted(owner, np.arange(self.size + 1))
        frequency = np.bincount(term, minlength=2**16)
        idf = np.log(1 + (self.size - frequency + 0.5) / (frequency + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean()) if self.size else lengths
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[owner])
        order = np.argsort(term, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.starts = np.concatenate(([0], np.cumsum(frequency)))
        self.unused = np.ones(self.size, dtype=bool)
        self.left = self.listed = self.size

    def use(self, document: int) -> None:
        """Take a document out; when a tenth are gone, their postings go as well."""
        self.unused[document] = False
        self.left -= 1
        if 10 * self.left < 9 * self.listed:
            stay = self.unused[self.owner]
            self.owner, self.weight = self.owner[stay], self.weight[stay]
            self.starts = np.concatenate(([0], np.cumsum(stay)))[self.starts]
            self.listed = self.left

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents by falling BM25 score for the seed's terms, those without a common term last."""
        held = self.terms[self.limits[seed] : self.limits[seed + 1]]
        low, size = self.starts[held], self.starts[held + 1] - self.starts[held]
        at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
        scores = np.bincount(self.owner[at], weights=self.weight[at], minlength=self.size)
        free = np.flatnonzero(self.unused)
        return free[np.argsort(-scores[free], kind="stable")]


def pack(documents: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset); a document's last id is the closing one."""
    index, made = Index([d[:-1] for d in documents]), []
    sequence, filled = 0, 0
    order = iter(range(len(documents)))
    window: list[tuple[int, int, int, int]] = []

    def add(document: int, start: int) -> int:
        """Put what fits into the window; where the document goes on."""
        nonlocal filled
        length = min(len(documents[document]) - start, WINDOW - filled)
        window.append((document, start, length, filled))
        filled += length
        return start + length

    def close() -> None:
        nonlocal filled, sequence
        made.extend((d, s, n, sequence, o) for d, s, n, o in window)
        window.clear()
        filled, sequence = 0, sequence + 1

    rest: tuple[int, int] | None = None
    while True:
        if rest is None:
            seed = next((d for d in order if index.unused[d]), None)
            if seed is None:
                break
            index.use(seed)
            rest = (seed, 0)
        seed, rest = rest[0], (rest[0], add(*rest))
        if rest[1] == len(documents[seed]):
            rest = None
        if rest is None and filled < WINDOW:
            for near in index.neighbours(seed):
                index.use(near)
                after = add(int(near), 0)
                if after < len(documents[near]):
                    rest = (int(near), after)
                if filled == WINDOW:
                    break
        if filled == WINDOW:
            close()
        elif rest is None:
            break
    # The open window at the end: cut at powers of two, largest first.
    left = list(window)
    total, at = filled, 0
    while at < total:
        size = 1 << ((total - at).bit_length() - 1)
        for d, s, n, o in left:
            low, high = max(o, at), min(o + n, at + size)
            if low < high:
                made.append((d, s + low - o, high - low, sequence, low - at))
        at, sequence = at + size, sequence + 1
    return made


def packed(docs: DataFrame, tokenizer: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece ``key``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset``.

    ``tokenizer`` is the path of a tokenizer file on the executors; by default the public one of 49 thousand words.
    Every row is packed, repeated rows and null keys as well; a null or empty text is its closing id alone. Every id
    lies in exactly one piece.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        encoder, first = kept(f"encoder {path}", lambda: Encoder(path)), TaskContext.get().partitionId() * PER_TASK
        for batch in batches:
            for part in pieces(batch, "_text", SHARD_BYTES):
                documents = [np.append(ids, np.uint16(END)) for ids in encoder.encode(part.column("_text"))]
                made = np.array(pack(documents), dtype=np.int64).reshape(-1, 5)
                crc = [zlib.crc32(documents[d][s : s + n].astype("<u4").tobytes()) for d, s, n in made[:, :3].tolist()]
                size = np.array([len(d) for d in documents], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_doc").take(pa.array(made[:, 0])),
                        pa.array(made[:, 1]),
                        pa.array(made[:, 2]),
                        pa.array(crc, pa.int64()),
                        pa.array(size[made[:, 0]]),
                        pa.array(made[:, 3] + first),
                        pa.array(made[:, 4]),
                    ],
                    [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
                first += int(made[:, 3].max(initial=-1)) + 1

    schema = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return docs.select(F.col(key).alias("_doc"), F.col(text).alias("_text")).mapInArrow(work, f"`{key}` {dict(docs.dtypes)[key]}, {schema}")
