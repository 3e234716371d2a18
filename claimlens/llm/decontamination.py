"""Benchmark decontamination with suffix arrays over the training texts.

The training texts are cut into shards of bounded size, each worked on by one task at a time. A shard's word-level
suffix array is sorted, and every test suffix is looked up in it by binary search, word by word: the interval of
training suffixes that begin with the test window gives all verbatim occurrences and where they are. A training
suffix enters the array only if its first two words stand together in some test window (or its first word is a
window by itself), as no other suffix can lie in such an interval.

The test set is worked on in blocks of bounded size, each broadcast and matched against all training texts; no
training row is shuffled. Words are runs of digits, letters a-z and characters beyond ASCII, after A-Z become
lower case. Windows are ``width`` consecutive words of an item; an item of fewer words, but not none, is one
window. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import words as W
from claimlens.llm.tables import pieces, without_keys

WIDTH = 10
SHARD_BYTES = 2_000_000
# Test texts of one broadcast block, in bytes.
BLOCK_BYTES = 8_000_000


class Block(NamedTuple):
    """Windows of a block of test items over a dense vocabulary of their words."""

    vocabulary: np.ndarray  # sorted word hashes
    windows: np.ndarray  # word numbers, -1 beyond a short window's end; distinct rows
    lengths: np.ndarray
    pairs: np.ndarray  # sorted codes of the first two words of windows
    singles: np.ndarray  # sorted first words of windows of one word
    owners: np.ndarray  # item numbers, by window
    bounds: np.ndarray  # where each window's owners start
    items: list[str]


def test_block(rows: list[tuple[str, str]], width: int = WIDTH) -> Block:
    """The windows of test items given as (id, text)."""
    items = sorted({i for i, _ in rows})
    number = {i: k for k, i in enumerate(items)}
    raw, offsets = W.text_bytes(pa.array([t or "" for _, t in rows], pa.string()))
    raw = W.LOWER[raw]
    starts, ends, owner = W.split_words(raw, offsets, W.LETTERS)
    vocabulary, ids = np.unique(W.hash_words(raw, starts, ends), return_inverse=True)
    made: dict[tuple[int, ...], set[int]] = {}
    for k, (item, _) in enumerate(rows):
        lo, hi = np.searchsorted(owner, [k, k + 1])
        own = ids[lo:hi].tolist()
        for at in range(max(len(own) - width + 1, min(len(own), 1))):
            made.setdefault(tuple(own[at : at + width]), set()).add(number[item])
    order = sorted(made)
    windows = np.full((len(order), width), -1, dtype=np.int64)
    for k, w in enumerate(order):
        windows[k, : len(w)] = w
    lengths = np.array([len(w) for w in order], dtype=np.int64)
    size = max(1, len(vocabulary))
    long = lengths > 1
    pairs = np.unique(windows[long, 0] * size + windows[long, 1]) if width > 1 else np.zeros(0, np.int64)
    owners = np.array([i for w in order for i in sorted(made[w])], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum([len(made[w]) for w in order]))).astype(np.int64)
    return Block(vocabulary, windows, lengths, pairs, np.unique(windows[~long, 0]), owners, bounds, items)


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), dtype=bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def suffix_array(ids: np.ndarray, owner: np.ndarray, block: Block) -> np.ndarray:
    """Sorted starts of the training suffixes that a test suffix can match.

    ``ids`` is padded by -1 beyond the last word; a suffix ends with its text. Order is by word numbers up to the
    windows' width, below which no search looks.
    """
    width = block.windows.shape[1]
    size = max(1, len(block.vocabulary))
    n = len(owner)
    first, second = ids[:n], ids[1 : n + 1]
    inside = np.append(owner[1:] == owner[:-1], False) if n else np.zeros(0, bool)
    starts = (first >= 0) & inside & (second >= 0)
    starts[starts] = _among(first[starts] * size + second[starts], block.pairs)
    if len(block.singles):
        starts |= (first >= 0) & _among(first, block.singles)
    at = np.flatnonzero(starts)
    if not len(at):
        return at
    keys = [np.where((at + d < n) & (owner[np.minimum(at + d, n - 1)] == owner[at]), ids[at + d], -1) for d in range(width)]
    return at[np.lexsort(keys[::-1])]


def binary_search(ids: np.ndarray, owner: np.ndarray, suffixes: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interval of suffixes that begin with each test window that occurs: window numbers, from, to."""
    n, live = len(owner), np.arange(len(block.windows))
    low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(suffixes), dtype=np.int64)

    def word(place: np.ndarray, depth: int) -> np.ndarray:
        start = suffixes[place]
        at = np.minimum(start + depth, n - 1)
        return np.where((start + depth < n) & (owner[at] == owner[start]), ids[at], -1)

    def bound(lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, depth: int, after: bool) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            middle = (lo[open_] + hi[open_]) // 2
            here = word(middle, depth)
            right = here <= wanted[open_] if after else here < wanted[open_]
            lo[open_] = np.where(right, middle + 1, lo[open_])
            hi[open_] = np.where(right, hi[open_], middle)
        return lo

    for depth in range(block.windows.shape[1]):
        asks = block.lengths[live] > depth
        wanted = block.windows[live, depth]
        lo, hi = bound(low, high, wanted, depth, False), bound(low, high, wanted, depth, True)
        low, high = np.where(asks, lo, low), np.where(asks, hi, high)
        found = low < high
        live, low, high = live[found], low[found], high[found]
        if not len(live):
            break
    return live, low, high


def match_shard(column: pa.Array, block: Block) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Per text: its words, the places of its hit words, and the numbers of the items that occur in it."""
    texts = len(column)
    raw, offsets = W.text_bytes(column)
    raw = W.LOWER[raw]
    starts, ends, owner = W.split_words(raw, offsets, W.LETTERS)
    count = np.bincount(owner, minlength=texts)
    hit = np.zeros(len(owner) + 1, dtype=np.int64)
    item_text = np.zeros((0, 2), dtype=np.int64)
    if len(owner) and len(block.windows):
        hashes = W.hash_words(raw, starts, ends)
        place = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
        ids = np.where(block.vocabulary[place] == hashes, place, -1)
        ids = np.concatenate((ids, np.full(block.windows.shape[1], -1)))
        suffixes = suffix_array(ids, owner, block)
        window, low, high = binary_search(ids, owner, suffixes, block)
        if len(window):
            size = high - low
            which = np.repeat(np.arange(len(window)), size)
            at = suffixes[np.repeat(low, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
            np.add.at(hit, at, 1)
            np.add.at(hit, at + block.lengths[window][which], -1)
            seen = np.unique(np.stack((owner[at], window[which]), axis=1), axis=0)
            held = block.bounds[seen[:, 1] + 1] - block.bounds[seen[:, 1]]
            own = np.repeat(block.bounds[seen[:, 1]], held) + np.arange(held.sum()) - np.repeat(np.cumsum(held) - held, held)
            item_text = np.unique(np.stack((np.repeat(seen[:, 0], held), block.owners[own]), axis=1), axis=0)
    marked = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
    first = np.cumsum(count) - count
    text_of = owner[marked]
    cuts = np.searchsorted(text_of, np.arange(texts + 1))
    items = np.searchsorted(item_text[:, 0], np.arange(texts + 1))
    places = [marked[cuts[k] : cuts[k + 1]] - first[k] for k in range(texts)]
    return count, places, [item_text[items[k] : items[k + 1], 1] for k in range(texts)]


def test_blocks(tests: DataFrame, item: str, text: str, width: int, block_bytes: int) -> Iterator[Block]:
    """The test set in blocks of bounded size, each read by itself; items of null text have no words."""
    named = tests.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where("t is not null")
    total = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    for k in range(blocks):
        part = named.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else named
        yield test_block([(r.i, r.t) for r in part.collect()], width)


def occurrences(
    docs: DataFrame,
    tests: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: ``key``, ``n_words``, ``n_hit``, ``longest`` (longest run of hit words), ``hits`` (word places)
    and ``items`` (ids of the test items with occurring windows, as sorted strings).

    A null or empty text has no words. Every input row gives one row, repeated ones too, however many blocks there are.
    An empty test set, or items without words, hit nothing.
    """
    made = []
    context = docs.sparkSession.sparkContext
    schema = f"_doc {dict(docs.dtypes)[key]}, _sig long, n_words long, hits array<int>, items array<string>"
    for block in test_blocks(tests, item, item_text, width, block_bytes):
        shared = context.broadcast(block)

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch, "_text", SHARD_BYTES):
                    count, places, items = match_shard(part.column("_text"), shared.value)
                    names = [[shared.value.items[i] for i in found] for found in items]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column("_doc"),
                            part.column("_sig"),
                            pa.array(count, pa.int64()),
                            pa.array(places, pa.list_(pa.int32())),
                            pa.array(names, pa.list_(pa.string())),
                        ],
                        ["_doc", "_sig", "n_words", "hits", "items"],
                    )

        narrow = docs.select(F.col(key).alias("_doc"), F.xxhash64(text).alias("_sig"), F.col(text).alias("_text"))
        made.append(narrow.mapInArrow(match, schema))
    found = made[0]
    if len(made) > 1:
        for part in made[1:]:
            found = found.unionByName(part)
        merged = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("hits", "items")]
        found = found.groupBy("_doc", "_sig").agg(F.max("n_words").alias("n_words"), *merged)
        # Rows that share key and text have the same matches; each gets its own again.
        rows = docs.select(F.col(key).alias("_row"), F.xxhash64(text).alias("_row_sig"))
        same = F.col("_row").eqNullSafe(F.col("_doc")) & (F.col("_row_sig") == F.col("_sig"))
        found = rows.join(found, same).drop("_row", "_row_sig")
    else:
        found = found.withColumn("items", F.array_sort("items"))
    run = F.aggregate(
        "hits",
        F.struct(F.lit(-2).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda a, x: F.struct(
            x.alias("last"),
            F.when(x == a["last"] + 1, a["run"] + 1).otherwise(1).alias("run"),
            F.greatest(a["most"], F.when(x == a["last"] + 1, a["run"] + 1).otherwise(1)).alias("most"),
        ),
        lambda a: a["most"],
    )
    return found.select(
        F.col("_doc").alias(key),
        F.col("_sig"),
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        run.cast("long").alias("longest"),
        "hits",
        "items",
    )


def item_digest(items: str = "items"):
    """sha256 of the sorted item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)


def drop_contaminated(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents in which no test window occurs, all their columns as they were.

    Only the keys of affected documents move; rows that share key and text share their fate.
    """
    bad = occurrences(docs, tests, key, text, **options).where("n_hit > 0").select(key, "_sig").distinct()
    return without_keys(docs, bad, [F.col(key), F.xxhash64(text)])
