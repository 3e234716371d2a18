"""Exact removal of repeated byte strings with sharded suffix arrays.

Every byte covered by a string of LENGTH bytes that also starts earlier is removed: in a document with a smaller key,
or earlier in the same one. The suffix arrays need only hold places where an answer is open:

1. Every window of LENGTH bytes has an anchor, its least-hashing stretch of GRAM bytes. Equal strings have equal
   anchors, so strings are compared only among windows of one anchor value. Consecutive windows with one anchor
   value are a run; the bytes it covers are its context.
2. Runs meet by anchor. A run with the context of an earlier one is covered as a whole. Equal strings have GRAM equal
   bytes before their anchor or after it, so a context that agrees with no other one of its anchor on either side needs
   nothing more, unless the anchor recurs within a run.
3. The first runs of all other contexts are laid into suffix arrays (:mod:`claimlens.llm.suffix_array`), one for each
   shard of whole anchors. Neighbours that share LENGTH bytes are one string, and all but its earliest start are
   covered.
4. Covered stretches are joined with the texts, merged and cut out.

Anchors that very many documents share (found on a sample of documents, and so only a matter of how work is dealt) are
dealt by context in step 2. In step 3, contexts of an anchor with more than MANY open ones are cut into parts of windows
alike at both ends and dealt by these ends as well; parts of which there are still more than MANY are cut into single
strings. So no shard depends on how often a passage occurs. Texts move compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm import words as W
from claimlens.llm.suffix_array import Texts, suffix_order
from claimlens.llm.tables import stored

LENGTH = 100
GRAM = 32
# A run is cut after so many windows, which bounds a context to RUN + LENGTH - 1 bytes. Only a run in which its anchor recurs
# has more than LENGTH - GRAM + 1 windows, so no other one is cut; the number must fit in 7 bits.
RUN = 96
# Contexts of one suffix array, in bytes; whole anchors only, of at most MANY contexts each.
SHARD_BYTES = 1_500_000
MANY = 30_000
# The ends of a window, and the stretches within an end of which the least-hashing one counts.
ENDS, GRAM_ENDS = 32, 8
# One document in SAMPLE looks for anchors in more than HOT_SHARE of the sampled documents.
SAMPLE, HOT_SHARE, HOT_LEAST = 64, 0.01, 32
SALTS = 1_024
LEAST = -(2**63)
# A place is one number: 23 bits of the text's hash, to tell apart rows that share a key, then the start.
SIG_BITS, START_BITS = 23, 40
_STARTS = 2**START_BITS - 1

_TABLE = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, 256, dtype=np.uint64)


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` consecutive bytes; ``gram`` is a power of two."""
    made, step, factor = _TABLE[raw], 1, W.BASE
    while step < gram:
        made = made[:-step] * np.uint64(factor) + made[step:]
        step, factor = 2 * step, factor * factor % 2**64
    return W.mix(made)


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    made, reach = values, 1
    while 2 * reach <= width:
        made = np.minimum(made[:-reach], made[reach:])
        reach *= 2
    return np.minimum(made[: len(values) - width + 1], made[width - reach :]) if reach < width else made


def runs(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, number of windows, whether the anchor recurs, and the anchor's sides, for each run of one text.

    The sides are hashes of the ``gram`` bytes before and after the anchor, 24 bits each, 0 where the context ends sooner.
    A window holds one of them whole, as ``length`` is at least three times ``gram`` less one.
    """
    width = length - gram + 1
    if len(raw) < length:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool), none
    hashes = gram_hashes(raw, gram)
    least = _slide(hashes, width)
    edge = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.concatenate(([0], edge))
    count = np.diff(np.concatenate((first, [len(least)])))
    anchor = least[first]
    # Two windows of a run can be equal only if a later one lies behind the anchor of the first.
    held = hashes[first[:, None] + np.arange(width)] == anchor[:, None]
    lead = held.argmax(axis=1)
    again = count - 1 > lead
    at, end = first + lead, first + count + length - 1
    before = np.where(lead >= gram, (hashes[np.maximum(at - gram, 0)] >> np.uint64(40)) | np.uint64(1), np.uint64(0))
    after = np.where(at + 2 * gram <= end, (hashes[np.minimum(at + gram, len(hashes) - 1)] >> np.uint64(40)) | np.uint64(1), np.uint64(0))
    sides = ((before << np.uint64(24)) | after).view(np.int64)
    if (count > RUN).any():
        parts = -(-count // RUN)
        which = np.repeat(np.arange(len(first)), parts)
        at = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
        first, anchor, again, count = first[which] + at * RUN, anchor[which], again[which] | (parts[which] > 1), np.minimum(count[which] - at * RUN, RUN)
        sides = sides[which]
    return anchor, first, count, again, sides


def context_hashes(raw: np.ndarray, first: np.ndarray, count: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """A hash of the bytes that each run covers."""
    return W.hash_words(raw, first, first + count + length - 1)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    sig = F.pmod(F.xxhash64(text), F.lit(2**SIG_BITS))
    number = F.coalesce(F.col(key).cast("long"), F.lit(LEAST))
    return docs.select(number.alias("doc"), sig.alias("sig"), F.col(key).isNull().alias("null"), F.col(text).alias("_text"))


def hot_anchors(keyed: DataFrame) -> list[int]:
    """Anchors of more than HOT_SHARE of the documents in a sample: at most some thousands."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, values = 0, []
            for t in batch.column("_text"):
                if t.is_valid:
                    texts += 1
                    values.append(np.unique(runs(np.frombuffer(t.as_py().encode(), np.uint8))[0]).view(np.int64))
            found = np.concatenate([*values, np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.ones(len(found), np.int64))], ["h", "n"])

    part = keyed.where(F.pmod(F.xxhash64("doc", "sig"), F.lit(SAMPLE)) == 0)
    total = part.count()
    counts = part.mapInArrow(find, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return [r.h for r in counts.where(F.col("n") > max(HOT_LEAST, HOT_SHARE * total)).collect()]


# Columns of a run: anchor; 57 bits of its context's hash and 7 of its windows' number; place. ``again``: the anchor recurs.
# With ``repeat``, a covered stretch instead: a hash of its place, its number of windows, its place.
RUN_SCHEMA = "h long, c long, doc long, at long, sides long, again boolean, repeat boolean"
RUN_NAMES = ["h", "c", "doc", "at", "sides", "again", "repeat"]


def _joined(doc: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows, those that follow one another in a text as one."""
    order = np.lexsort((at, doc))
    doc, at, end = doc[order], at[order], (at + windows)[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > end[:-1])
    first = np.flatnonzero(new)
    return doc[first], at[first], (np.maximum.reduceat(end, first) if len(first) else end) - at[first]


def _runs_of(keyed: DataFrame) -> DataFrame:
    """All runs whose context did not come earlier in the same batch; consecutive ones of those that did, as one stretch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            held = 0

            def flush() -> pa.RecordBatch:
                h, c, doc, at, sides, again = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((at, doc, c, h))
                h, c, doc, at, sides, again = (x[order] for x in (h, c, doc, at, sides, again))
                same = np.zeros(len(h), dtype=bool)
                same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
                # A row equal to the first in its place as well is a repeated row, not a later place.
                first = np.maximum.accumulate(np.where(~same, np.arange(len(h)), 0))
                again = (np.bincount(first, weights=again, minlength=len(h)) > 0)[first]
                same &= (doc != doc[first]) | (at != at[first])
                done, place, windows = _joined(doc[same], at[same], c[same] & 127)
                spread = W.mix((done ^ place).view(np.uint64)).view(np.int64)
                none = np.zeros(len(done), dtype=np.int64)
                columns = zip((h, c, doc, at, sides, again), (spread, windows, done, place, none, none.astype(bool)))
                settled = np.repeat([False, True], [int((~same).sum()), len(done)])
                return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate((x[~same], y))) for x, y in columns), pa.array(settled)], RUN_NAMES)

            for doc, sig, text in zip(batch.column("doc").to_pylist(), batch.column("sig").to_pylist(), batch.column("_text")):
                raw = np.frombuffer(text.as_py().encode(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
                anchor, first, count, again, sides = runs(raw)
                if not len(anchor):
                    continue
                context = (context_hashes(raw, first, count) << np.uint64(7)) | count.astype(np.uint64)
                parts.append([anchor.view(np.int64), context.view(np.int64), np.full(len(first), doc), first + (sig << START_BITS), sides, again])
                held += len(first)
                if held > 400_000:
                    yield flush()
                    parts, held = [], 0
            if parts:
                yield flush()

    return keyed.mapInArrow(work, RUN_SCHEMA)


def _shared(group: np.ndarray, side: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Those of ``rows`` that agree with another one in group and side."""
    rows = rows[np.lexsort((side[rows], group[rows]))]
    same = (group[rows][1:] == group[rows][:-1]) & (side[rows][1:] == side[rows][:-1])
    return rows[np.append(same, False) | np.append(False, same)] if len(rows) else rows


MET_NAMES = ["h", "windows", "doc", "at", "covered", "open"]


def _met_runs(found: DataFrame, hot: list[int]) -> DataFrame:
    """``covered`` runs, and the first runs of contexts whose strings must still be compared (``open``)."""
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)
    salted = found.withColumns({"hot": is_hot, "salt": F.when(is_hot, F.pmod("c", F.lit(SALTS))).otherwise(0)})
    ordered = salted.repartition("h", "salt").sortWithinPartitions("h", "salt", "c", "doc", "at")
    names = [*RUN_NAMES, "hot"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None  # the rows of the last anchor, which the next batch may go on with
        for batch in batches:
            now = pa.Table.from_batches([batch.select(names)])
            rest = pa.concat_tables([rest, now]) if rest is not None else now
            h = np.asarray(rest.column("h"))
            cut = len(h) - int((h[::-1] != h[-1]).argmax()) if len(h) and h[0] != h[-1] else 0
            if cut:
                yield from judge(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and rest.num_rows:
            yield from judge(rest)

    def judge(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        h, c, doc, at, sides, again, repeat, own_hot = (np.asarray(rows.column(n).combine_chunks().to_numpy(zero_copy_only=False)) for n in names)
        if repeat.any():
            rows_done = [h, c, doc, at, repeat, ~repeat]
            yield pa.RecordBatch.from_arrays([pa.array(x[repeat]) for x in rows_done], MET_NAMES)
            h, c, doc, at, sides, again, own_hot = (x[~repeat] for x in (h, c, doc, at, sides, again, own_hot))
        n = len(h)
        if not n:
            return
        new_h, new_c = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
        first = np.maximum.accumulate(np.where(new_c, np.arange(n), 0))
        covered = ~new_c & ((doc != doc[first]) | (at != at[first]))
        group = np.cumsum(new_h) - 1
        recurs = np.bincount(group, weights=again)[group] > 0
        open_ = new_c & (recurs | own_hot)
        for side in (sides >> 24, sides & 0xFFFFFF):
            open_[_shared(group, side, np.flatnonzero(new_c & (side != 0)))] = True
        keep = np.flatnonzero(covered | open_)
        made = [h[keep], c[keep] & 127, doc[keep], at[keep], covered[keep], open_[keep]]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], MET_NAMES)

    schema = "h long, windows long, doc long, at long, covered boolean, open boolean"
    return ordered.select(*names).mapInArrow(work, schema)


def _packed_texts(keyed: DataFrame) -> DataFrame:
    """Texts compressed one by one, which move as about two thirds of what Spark's own compression leaves."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tight = zstd.ZstdCompressor(level=3)
        for batch in batches:
            blobs = [tight.compress(t.encode()) if t else b"" for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(blobs, pa.binary())], [*names, "packed"])

    names = ["doc", "sig", "null"]
    return keyed.mapInArrow(pack, "doc long, sig long, null boolean, packed binary")


def _sig(at: str = "at"):
    return F.shiftright(at, START_BITS)


def _contexts(open_runs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Open runs with their bytes (CONTEXT); those of an anchor with many contexts in parts that agree at their ends."""
    many = stored(open_runs.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > MANY), "many")
    marked = open_runs.join(many, "h", "left").withColumn("hot", F.col("n").isNotNull())
    wanted = marked.groupBy("doc", _sig().alias("sig")).agg(F.collect_list(F.struct("h", "at", "windows", "hot")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstd.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            crowded: list[tuple[int, int, int, bytes]] = []
            for doc, asked, packed in zip(*(batch.column(n).to_pylist() for n in ("doc", "runs", "packed"))):
                text = loose.decompress(packed)
                for run in asked:
                    start = run["at"] & _STARTS
                    context = text[start : start + run["windows"] + LENGTH - 1]
                    if run["hot"]:
                        crowded.append((run["h"], doc, run["at"], context))
                    else:
                        out.append((run["h"], doc, run["at"], run["windows"], context, False))
            out += earliest(parts_of(crowded), True)
            if out:
                yield _context_batch(out)

    joined = _packed_texts(keyed).join(wanted, ["doc", "sig"]).select("doc", "runs", "packed")
    return joined.mapInArrow(cut, CONTEXT_SCHEMA)


def _strings(contexts: DataFrame) -> DataFrame:
    """Contexts cut into single strings, each a context of its own shard."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = (
                (xxhash.xxh3_64_intdigest(context[k : k + LENGTH]) - 2**63, doc, at + k, context[k : k + LENGTH])
                for doc, at, windows, context in zip(*(batch.column(n).to_pylist() for n in ("doc", "at", "windows", "context")))
                for k in range(windows)
            )
            out = earliest(pieces, False)
            if out:
                yield _context_batch(out)

    return contexts.select("doc", "at", "windows", "context").mapInArrow(cut, CONTEXT_SCHEMA)


def parts_of(contexts: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
    """Contexts (anchor, doc, at, bytes) in parts: consecutive windows with the same least GRAM_ENDS bytes in both their ends.

    Equal strings have equal ends, so they meet in one shard of the parts as well.
    """
    if not contexts:
        return
    size = np.array([len(c[3]) for c in contexts])
    windows = size - LENGTH + 1
    starts = np.cumsum(size) - size
    least = _slide(gram_hashes(np.frombuffer(b"".join(c[3] for c in contexts), np.uint8), GRAM_ENDS), ENDS - GRAM_ENDS + 1)
    owner = np.repeat(np.arange(len(contexts)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = starts[owner] + offset
    anchor = np.array([c[0] for c in contexts], dtype=np.int64).view(np.uint64)[owner]
    shard = W.mix(least[place] * np.uint64(W.BASE) + W.mix(least[place + LENGTH - ENDS] + anchor)).view(np.int64)
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shard[1:] != shard[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(owner)))
    for key, own, off, n in zip(shard[first].tolist(), owner[first].tolist(), offset[first].tolist(), count.tolist()):
        _, doc, at, context = contexts[own]
        yield key, doc, at + off, context[off : off + n + LENGTH - 1]


def earliest(pieces: Iterable[tuple[int, int, int, bytes]], part: bool) -> list[tuple]:
    """Of equal pieces (shard, doc, at, bytes) the earliest as a row (CONTEXT); the others as covered stretches."""
    known: dict[tuple[int, bytes], tuple[int, int]] = {}
    later: list[tuple[int, int, int]] = []
    for shard, doc, at, context in pieces:
        place = (doc, at)
        held = known.setdefault((shard, context), place)
        if place < held:
            known[shard, context] = place
            place, held = held, place
        if place != held:
            later.append((*place, len(context) - LENGTH + 1))
    out: list[tuple] = []
    if later:
        covered = _joined(*np.array(later, dtype=np.int64).T)
        out = [(None, doc, at, n, None, False) for doc, at, n in zip(*(x.tolist() for x in covered))]
    return out + [(shard, doc, at, len(context) - LENGTH + 1, context, part) for (shard, context), (doc, at) in known.items()]


# A context and the shard it goes to; without a shard and bytes, a covered stretch. ``part``: of a context cut by its ends.
CONTEXT = ["shard", "doc", "at", "windows", "context", "part"]
CONTEXT_SCHEMA = "shard long, doc long, at long, windows long, context binary, part boolean"


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 4, pa.binary(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], CONTEXT)


def repeated_starts(context: list[bytes], windows: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Which context and which of its windows are equal to a window that starts earlier, by a suffix array."""
    texts = Texts(context)
    owner = np.repeat(np.arange(len(context)), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    positions = texts.starts[owner] + offset
    placed, alike = suffix_order(texts, positions, length)
    row = np.searchsorted(positions, placed)  # positions ascend
    own, off = owner[row], offset[row]
    group = np.cumsum(~alike)
    where = at[own] + off
    order = np.lexsort((where, doc[own], group))
    group, own, off, where = group[order], own[order], off[order], where[order]
    first = np.ones(len(group), dtype=bool)
    first[1:] = group[1:] != group[:-1]
    lead = np.maximum.accumulate(np.where(first, np.arange(len(group)), 0))
    later = (doc[own] != doc[own[lead]]) | (where != where[lead])
    return own[later], off[later]


def _stretches(own: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive windows of a context as one stretch: context, first window, number."""
    order = np.lexsort((off, own))
    own, off = own[order], off[order]
    new = np.ones(len(own), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (off[1:] != off[:-1] + 1)
    at = np.flatnonzero(new)
    return own[at], off[at], np.diff(np.append(at, len(own)))


def _sorted_shards(contexts: DataFrame) -> DataFrame:
    """Covered stretches (doc, at, windows) among the contexts of each shard key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held, last = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            _, doc, at, windows, context = zip(*rows)
            doc, at, windows = (np.array(x, dtype=np.int64) for x in (doc, at, windows))
            own, first, count = _stretches(*repeated_starts(list(context), windows, doc, at))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(doc[own]), pa.array(at[own] + first), pa.array(count)], ["doc", "at", "windows"])

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("shard", "doc", "at", "windows", "context"))):
                if held > SHARD_BYTES and row[0] != last:
                    yield from flush()
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
                last = row[0]
        if rows:
            yield from flush()

    ordered = contexts.repartition("shard").sortWithinPartitions("shard")
    return ordered.select("shard", "doc", "at", "windows", "context").mapInArrow(work, "doc long, at long, windows long")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans (from, to) with those that touch or overlap as one."""
    made: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if made and low <= made[-1][1]:
            made[-1] = (made[-1][0], max(high, made[-1][1]))
        else:
            made.append((low, high))
    return made


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``kept`` (bytes) and ``spans`` (from, to).

    Texts are UTF-8 bytes, and strings are judged on the input. A null text is empty; a text shorter than a string
    keeps all. Rows that share a key are placed in the order of a hash of their texts; repeated rows are one place and
    keep or lose the same bytes. A null key comes before all others. ``kept`` may cut a character in two.
    """
    keyed = _keyed(docs, key, text)
    met = stored(_met_runs(_runs_of(keyed), hot_anchors(keyed)), "runs")
    contexts = stored(_contexts(met.where("open"), keyed), "contexts")
    crowded = stored(contexts.where("part").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("shard"), "crowded")
    strings = stored(_strings(contexts.join(crowded, "shard", "left_semi")), "strings")
    placed = contexts.where("shard is not null").join(crowded, "shard", "left_anti").select(*CONTEXT)
    covered = (
        met.where("covered")
        .select("doc", "at", "windows")
        .union(contexts.where("shard is null").select("doc", "at", "windows"))
        .union(strings.where("shard is null").select("doc", "at", "windows"))
        .union(_sorted_shards(placed.union(strings.where("shard is not null"))))
    )
    spans = covered.groupBy("doc", _sig().alias("sig")).agg(F.collect_list(F.struct("at", "windows")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstd.ZstdDecompressor()
        for batch in batches:
            rows = []
            for packed, found in zip(*(batch.column(n).to_pylist() for n in ("packed", "found"))):
                raw = loose.decompress(packed) if packed else b""
                gone = merged([(f["at"] & _STARTS, (f["at"] & _STARTS) + f["windows"] + LENGTH - 1) for f in found or ()])
                last, kept = 0, []
                for low, high in gone:
                    kept.append(raw[last:low])
                    last = high
                left = b"".join([*kept, raw[last:]])
                rows.append((len(raw), len(raw) - len(left), len(gone), hashlib.sha256(left).hexdigest(), left, [{"low": a, "high": b} for a, b in gone]))
            doc = pa.array([None if null else d for d, null in zip(batch.column("doc").to_pylist(), batch.column("null").to_pylist())], pa.int64())
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary(), pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))]
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([doc, *columns], [key, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    joined = _packed_texts(keyed).join(spans, ["doc", "sig"], "left").select("doc", "null", "packed", "found")
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<low: bigint, high: bigint>>"
    return joined.mapInArrow(cut, f"`{key}` long, {schema}")

