"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its words with their counts. For each of SAMPLES draws, every term k has fixed gamma
variates r and c and a uniform b; with t = floor(ln w / r + b) and y = exp(r (t - b)), the draw picks the term of least
a = c / (y exp(r)) together with its t. Two texts draw the same pair with a chance equal to their generalised Jaccard
similarity, sum of minima over sum of maxima of the weights. A fingerprint keeps 16 bits of each pair.

The variates of a word and a draw come from a hash of both, so every word has its own and every task the same. They
are made for BLOCK words at a time, however many a text holds; a task keeps those of CACHED words that several texts share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import words as W
from claimlens.llm.tables import kept

SAMPLES = 128
# Words whose variates are made at once, and those whose variates a Python process keeps.
BLOCK, CACHED = 32_768, 24_576
# Words hashed together, few enough for a processor's cache.
HASHED = 256
PIECE_BYTES = 1_000_000


_DRAWS = W.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(W.BASE))
_TINY = np.float32(2**-24)


def variates(terms: np.ndarray) -> np.ndarray:
    """Four arrays (terms, SAMPLES) for word hashes: ln c - r, r, b, and ln a for a weight of 1.

    r and c are gamma variates of shape 2, each the sum of two exponential ones, from four uniform numbers of 24 bits.
    """
    made = np.empty((4, len(terms), SAMPLES), dtype=np.float32)

    def uniform(bits: np.ndarray, size: int) -> np.ndarray:
        found = bits.astype(np.int32).astype(np.float32)
        found += np.float32(0.5)
        found *= np.float32(2.0**-size)
        return found

    def gamma(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        found = uniform(low >> np.uint32(8), 24)
        found *= uniform(high >> np.uint32(8), 24)
        np.log(found, out=found)
        np.negative(found, out=found)
        return np.maximum(found, _TINY, out=found)

    for at in range(0, len(terms), HASHED):
        base, r, b, ones = made[:, at : at + HASHED]
        one = W.mix(terms[at : at + HASHED, None] + _DRAWS)
        two = W.mix(one ^ np.uint64(W.BASE))
        (low, high), (more, most) = ((x.view(np.uint32)[:, ::2], x.view(np.uint32)[:, 1::2]) for x in (one, two))
        r[:] = gamma(low, high)
        np.log(gamma(more, most), out=base)
        base -= r
        b[:] = uniform(((low & np.uint32(0xFF)) << np.uint32(8)) | (more & np.uint32(0xFF)), 16)
        # ln a = ln c - r (t - b) - r, and for a weight of 1 t = floor(b) = 0.
        np.multiply(r, b, out=ones)
        ones += base
    return made


class Cache:
    """Variates of words that came first in several texts of one piece; what it holds does not change any result."""

    def __init__(self) -> None:
        self.terms = np.zeros(0, dtype=np.uint64)  # sorted
        self.rows = np.zeros(0, dtype=np.int64)
        self.made = np.empty((4, CACHED, SAMPLES), dtype=np.float32)

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Rows of the words, -1 for those not held."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.rows[at], -1)

    def add(self, terms: np.ndarray) -> None:
        n = len(self.terms)
        for at in range(0, min(len(terms), CACHED - n), BLOCK):
            part = terms[at : min(at + BLOCK, CACHED - n)]
            self.made[:, n + at : n + at + len(part)] = variates(part)
        terms = terms[: CACHED - n]
        both = np.concatenate((self.terms, terms))
        order = np.argsort(both)
        self.terms, self.rows = both[order], np.concatenate((self.rows, np.arange(n, n + len(terms))))[order]


def weighted_terms(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All distinct words by hash, and text number, word number and count of every word of every text."""
    starts, ends, owner = W.split_words(raw, offsets, W.NOT_SPACE)
    terms, number = np.unique(W.hash_words(raw, starts, ends), return_inverse=True)
    size = max(len(terms), 1)
    pairs, count = np.unique(owner * size + number, return_counts=True)
    return terms, pairs // size, pairs % size, count


def sample(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16-bit samples (texts, SAMPLES); a text without words draws 0 everywhere.

    Words meet in blocks: those of the cache, then BLOCK others at a time. Each text keeps the least a of every draw with
    its word and t; of equal ones the word of lower hash, so that blocks do not matter.
    """
    texts = len(offsets) - 1
    terms, text, term, count = weighted_terms(raw, offsets)
    cache = kept(f"variates {CACHED} {SAMPLES}", Cache)
    row = cache.find(terms)
    if len(cache.terms) < CACHED:
        held_by = np.bincount(term, minlength=len(terms))
        new = np.flatnonzero((row < 0) & (held_by > 1))
        cache.add(terms[new[np.argsort(-held_by[new], kind="stable")]])
        row = cache.find(terms)
    others = np.flatnonzero(row < 0)
    block = np.zeros(len(terms), dtype=np.int64)
    block[others] = 1 + np.arange(len(others)) // BLOCK
    row[others] = np.arange(len(others)) % BLOCK
    least = np.full((texts, SAMPLES), np.inf, dtype=np.float32)
    chosen = np.zeros((texts, SAMPLES), dtype=np.uint64)
    steps = np.zeros((texts, SAMPLES), dtype=np.int64)
    order = np.argsort(block[term], kind="stable")
    limits = np.searchsorted(block[term[order]], np.arange(block.max(initial=0) + 2))
    for k in range(len(limits) - 1):
        own = order[limits[k] : limits[k + 1]]
        if not len(own):
            continue
        made = cache.made if k == 0 else variates(terms[others[(k - 1) * BLOCK : k * BLOCK]])
        edges = np.append(np.flatnonzero(np.diff(text[own], prepend=-1)), len(own))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            part = own[lo:hi]
            _draw(made, row[term[part]], terms[term[part]], count[part], int(text[part[0]]), least, chosen, steps)
    mixed = W.mix(chosen * np.uint64(W.BASE) + steps.view(np.uint64))
    return np.where(np.isinf(least), 0, np.maximum(mixed >> np.uint64(48), np.uint64(1))).astype(np.uint16)


_COLUMNS = np.arange(SAMPLES)


def _draw(made: np.ndarray, rows: np.ndarray, terms: np.ndarray, n: np.ndarray, text: int, least: np.ndarray, chosen: np.ndarray, steps: np.ndarray) -> None:
    """Draw from some words of one text, in order of their hashes, and keep what beats the text's earlier draws."""
    for at in range(0, len(rows), BLOCK):
        own, hashes, counts = rows[at : at + BLOCK], terms[at : at + BLOCK], n[at : at + BLOCK]
        base, r, b, ones = made
        a = ones[own]
        many = np.flatnonzero(counts > 1)
        if len(many):
            here = own[many]
            t = np.floor(np.log(counts[many], dtype=np.float32)[:, None] / r[here] + b[here])
            a[many] = base[here] - r[here] * (t - b[here])
        best = a.argmin(axis=0)
        value, word = a[best, _COLUMNS], hashes[best]
        step = np.zeros(SAMPLES, dtype=np.int64)
        if len(many):
            place = np.minimum(np.searchsorted(many, best), len(many) - 1)
            step = np.where(many[place] == best, t[place, _COLUMNS].astype(np.int64), 0)
        won = (value < least[text]) | ((value == least[text]) & (word < chosen[text]))
        least[text][won], chosen[text][won], steps[text][won] = value[won], word[won], step[won]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=-1)


def as_text(samples: np.ndarray) -> list[str]:
    """Four hexadecimal digits for each sample."""
    return [row.astype(">u2").tobytes().hex() for row in samples]


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many code points from the start of ``following``, or all it has."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


LEAST = -(2**63)
# Ranges for every shuffle partition, so that several meet in each and even it out.
RANGES_PER_PARTITION = 4


def in_key_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``_range``, ``_key``, ``_null``, ``_lent`` and ``_packed`` (compressed text), in descending order of keys.

    Keys are cut into contiguous ranges at their quantiles. Each range is sorted in one partition and followed by the
    row that comes next in the order, lent by the next range; the last range borrows the very first row. Only one
    number per range is collected, and texts move once, compressed. A null key comes last, a null text is empty.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LEAST)).alias("_key"), F.col(key).isNull().alias("_null"), F.col(text).alias("_text"))
    ranges = RANGES_PER_PARTITION * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    limits = np.array(sorted({int(x) for x in keyed.approxQuantile("_key", [k / ranges for k in range(1, ranges)], 0.2 / ranges)}), dtype=np.int64)

    def number(keys: np.ndarray) -> np.ndarray:
        return len(limits) - np.searchsorted(limits, keys, "right")

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.sort(np.asarray(batch.column(0)))
            places = number(keys)
            last = np.append(places[1:] != places[:-1], True) if len(keys) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(places[last], pa.int32()), pa.array(keys[last])], ["_range", "_key"])

    tops = keyed.select("_key").mapInArrow(greatest, "_range int, _key long").groupBy("_range").agg(F.max("_key").alias("_key")).collect()
    tops = sorted((r["_range"], r["_key"]) for r in tops)
    borrower = {top: tops[k - 1][0] for k, (_, top) in enumerate(tops)}

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight = zstd.ZstdCompressor(level=3)
        for batch in batches:
            keys, null = batch.column("_key"), batch.column("_null")
            packed = pa.array([tight.compress((x or "").encode()) for x in batch.column("_text").to_pylist()], pa.binary())
            places = pa.array(number(np.asarray(keys)), pa.int32())
            lent = [borrower.get(k) for k in keys.to_pylist()]
            rows = pa.RecordBatch.from_arrays([places, keys, null, pa.array([False] * len(keys)), packed], ORDERED)
            yield rows
            chosen = [k for k, to in enumerate(lent) if to is not None]
            if chosen:
                at = pa.array(chosen, pa.int64())
                to = pa.array([lent[k] for k in chosen], pa.int32())
                yield pa.RecordBatch.from_arrays([to, keys.take(at), null.take(at), pa.array([True] * len(chosen)), packed.take(at)], ORDERED)

    rows = keyed.mapInArrow(pack, "_range int, _key long, _null boolean, _lent boolean, _packed binary")
    return rows.repartition("_range").sortWithinPartitions("_range", "_lent", F.desc("_key"), F.desc(F.xxhash64("_packed")))


ORDERED = ["_range", "_key", "_null", "_lent", "_packed"]


def samples_of(texts: list[str]) -> np.ndarray:
    raw, offsets = W.text_bytes(pa.array(texts, pa.large_string()))
    return sample(raw, offsets)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the fingerprints of its text and of its edited text, which borrows from the next document.

    The next document is that of the next lower key, after the lowest that of the highest; a single document follows
    itself. Columns: ``key``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited`` and ``near_next`` (share of equal samples). A null text is empty; texts without words all have
    the fingerprint of the empty set, and likeness 1 to each other. Rows that share a key follow each other in the
    order of a hash of their texts.
    """

    def rows(held: list[tuple], made: list[np.ndarray], edits: list[str], changed: np.ndarray) -> pa.RecordBatch:
        own, after = np.array(made[:-1]), np.array(made[1:])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None if h[1] else h[0] for h in held[:-1]], pa.int64()),
                pa.array([len(h[2]) for h in held[:-1]], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]),
                pa.array(as_text(own)),
                pa.array(as_text(changed)),
                pa.array(likeness(own, changed)),
                pa.array(likeness(own, after)),
            ],
            [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstd.ZstdDecompressor()
        place, held, made, size = None, [], [], 0

        def flush() -> pa.RecordBatch | None:
            nonlocal held, made, size
            edits = [edited(a[2], b[2]) for a, b in zip(held, held[1:])]
            new = [h[2] for h in held[len(made) :]]
            both = samples_of(new + edits)  # together, as they share most of their words
            made += list(both[: len(new)])
            done = rows(held, made, edits, both[len(new) :]) if edits else None
            held, made, size = held[-1:], made[-1:], 0
            return done

        for batch in batches:
            for where, number, null, lent, packed in zip(*(batch.column(c).to_pylist() for c in ORDERED)):
                if where != place:
                    if held and (done := flush()):
                        yield done
                    place, held, made, ended = where, [], [], False
                if ended:
                    continue  # of several rows that share the lent key only the first follows
                ended = lent
                held.append((number, null, loose.decompress(packed).decode()))
                size += len(packed)
                if size > PIECE_BYTES // 3 and (done := flush()):
                    yield done
        if held and (done := flush()):
            yield done

    schema = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_key_order(docs, key, text).mapInArrow(work, f"`{key}` long, {schema}")
