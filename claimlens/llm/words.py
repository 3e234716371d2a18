"""Words of whole UTF-8 texts, found and hashed for many texts at once.

A column of texts is one run of bytes with offsets. Word limits come from a table of 256 flags, so a class of
characters must be a class of bytes: ASCII characters by choice, all others together. A word's hash is a
polynomial over random byte values modulo 2**64 with an odd base, taken as a difference of prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from claimlens.llm.tables import kept

BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACES
# Digits, lower-case a-z and every byte of a character beyond ASCII.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_VALUES = np.random.Generator(np.random.PCG64(20_231)).integers(1, 2**63, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n at least."""
    size = 1 << max(n + 1, 2**20).bit_length()

    def make() -> tuple[np.ndarray, np.ndarray]:
        made = []
        for base in (BASE, pow(BASE, -1, 2**64)):
            p = np.ones(size, dtype=np.uint64)
            filled, factor = 1, base
            while filled < size:
                p[filled : 2 * filled] = p[:filled] * np.uint64(factor)
                filled, factor = 2 * filled, factor * factor % 2**64
            made.append(p)
        return made[0], made[1]

    return kept(f"powers {size}", make) if size <= 2**23 else make()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each starts; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count and len(column):
        # A null may in principle own bytes; give it none.
        size = np.where(np.asarray(column.is_valid()), np.diff(offsets), 0)
        if size.sum() != offsets[-1] - offsets[0]:
            return text_bytes(pa.array([x or b"" for x in column.to_pylist()], pa.large_binary()))
    return raw[offsets[0] : offsets[-1]] if len(column) else raw[:0], offsets - offsets[0]


def split_words(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every maximal run of ``inside`` bytes; runs end with their text."""
    if not len(raw):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    flag = inside[raw]
    edge = np.empty(len(raw) + 1, dtype=bool)
    edge[0], edge[-1] = flag[0], flag[-1]
    np.not_equal(flag[1:], flag[:-1], out=edge[1:-1])
    limits = np.unique(offsets[1:-1])
    limits = limits[(limits > 0) & (limits < len(raw))]
    joined = limits[flag[limits] & flag[limits - 1]]
    marks = np.flatnonzero(edge)
    if len(joined):  # a run that crosses a limit ends there and another starts
        marks = np.sort(np.concatenate((marks, joined, joined)), kind="stable")
    starts, ends = marks[::2], marks[1::2]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the byte runs."""
    up, down = powers(len(raw))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[raw] * up[: len(raw)], out=sums[1:])
    found = (sums[ends] - sums[starts]) * down[starts]
    return mix(found + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, owner: np.ndarray, texts: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words with their texts; fewer words make one shingle of all of them."""
    count = np.bincount(owner, minlength=texts)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    full = np.zeros(0, np.uint64)
    kept = np.zeros(0, np.int64)
    if n >= width:
        kept = np.flatnonzero(owner[: n - width + 1] == owner[width - 1 :])
        full = np.zeros(n - width + 1, dtype=np.uint64)
        for k in range(width):
            full = full * np.uint64(BASE) + words[k : n - width + 1 + k]
        full = mix(full[kept] + np.uint64(width))
    short = np.flatnonzero((count > 0) & (count < width))
    first = np.cumsum(count) - count
    few = np.zeros(len(short), dtype=np.uint64)
    for k in range(width - 1):
        has = count[short] > k
        few[has] = few[has] * np.uint64(BASE) + words[first[short[has]] + k]
    few = mix(few + count[short].astype(np.uint64))
    return np.concatenate((full, few)), np.concatenate((owner[kept], short))
