"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

Fast similarity sketching throws a set's elements into the sketch's bins in rounds. Round i < SIZE sends every
element to a hashed bin with a value in [i, i + 1), and round SIZE + b sends every element to bin b; a bin keeps its
least value, and a set is done when all bins are filled. Every coordinate is thus filled, equal coordinates estimate
the Jaccard similarity with concentration bounds, and a set of n elements needs about n + SIZE log SIZE steps.

Texts with equal shingle sets are one node. Nodes that share a band of ROWS coordinates are candidates: with 32
bands of 4 a pair at similarity 0.8 shares none with a chance of 5 in 10**8, and 13 on average. In each bucket every
node is compared with the bucket's least one, its hub. Pairs whose sketches agree in LIKELY of the coordinates (over
four deviations below 0.8) are verified on both full sets.

Nodes joined by candidates of at least LOOSE agreement form a cloud. A bucket whose nodes beside the hub lie in several
clouds is not settled by its hub: its nodes meet in blocks, and two clouds that hold a likely pair become one. A cloud
whose nodes are not all linked by then is gone through in blocks: every two blocks meet in a task that compares sketches
and then full sets of nodes in different components, and returns one link per pair of components. No step lists the
pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimlens.llm import words as W
from claimlens.llm.components import components
from claimlens.llm.tables import pieces, stored, without_keys

SIZE = 128
ROWS = 4
BANDS = SIZE // ROWS
LIKELY, LOOSE = 0.64, 0.45
PIECE_BYTES = 2_000_000
# Nodes of a block; sets are compared by products of 0/1 matrices, so many shingles at a time.
BLOCK = 512
COLUMNS = 4_096
# Nodes of a bucket that meet in one task, by sketches alone, and those compared at once.
MEETING = 4_096
TILE = 512
# Bits that tell apart the asked keys from others: of a section (as Spark's bitmaps have them), for each key, at most.
SECTION = 32_768
SPARSE = 32
MOST_BITS = 2**26
_EMPTY = np.uint64(2**64 - 1)
_SEEDS = W.mix(np.arange(1, 2 * SIZE + 1, dtype=np.uint64) * np.uint64(W.BASE))


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order of text and value, with the number of each one's text."""
    raw, offsets = W.text_bytes(column)
    raw = W.LOWER[raw]
    starts, ends, owner = W.split_words(raw, offsets, W.NOT_SPACE)
    hashes, text = W.shingle_hashes(W.hash_words(raw, starts, ends), owner, len(column), width)
    order = np.argsort(hashes)
    order = order[np.argsort(text[order].astype(np.uint16 if len(column) < 2**16 else np.int64), kind="stable")]
    hashes, text = hashes[order], text[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], text[new]


def sketches(hashes: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """The sketch of every set, a row of SIZE coordinates; an empty set's bins stay empty."""
    made = np.full(texts * SIZE, _EMPTY, dtype=np.uint64)
    full = np.bincount(text, minlength=texts) == 0
    for step in range(2 * SIZE):
        mixed = W.mix(hashes ^ _SEEDS[step])
        bins = (mixed & np.uint64(SIZE - 1)).astype(np.int64) if step < SIZE else step - SIZE
        # The round stands in the top 8 bits, so an earlier round's value is always less.
        np.minimum.at(made, text * SIZE + bins, (np.uint64(step) << np.uint64(56)) | (mixed >> np.uint64(8)))
        done = (made.reshape(texts, SIZE) != _EMPTY).all(axis=1)
        if (done & ~full).any():
            full |= done
            left = ~full[text]
            hashes, text = hashes[left], text[left]
        if not len(hashes):
            break
    return made.reshape(texts, SIZE)


def band_keys(made: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different for equal values in different bands."""
    parts = made.reshape(len(made), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        keys = W.mix(keys * np.uint64(W.BASE) + parts[:, :, k])
    return keys


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width), pa.int32()), pa.array(values.ravel(), kind))


def sketched(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """Per document ``_doc``, ``n`` shingles, ``f1`` and ``f2`` (128 bits of its set), ``bands`` and ``sketch`` bytes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", PIECE_BYTES):
                column, texts = part.column("_text"), part.num_rows
                hashes, owner = shingle_sets(column, width)
                count = np.bincount(owner, minlength=texts)
                one, two = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
                np.add.at(one, owner, W.mix(hashes ^ np.uint64(W.BASE)))
                np.add.at(two, owner, W.mix(hashes + np.uint64(W.BASE)))
                made = sketches(hashes, owner, texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_doc"),
                        pa.array(count, pa.int64()),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        _lists(band_keys(made).view(np.int64), pa.int64()),
                        pa.array([row.tobytes() for row in (made >> np.uint64(40)).astype(np.uint8)], pa.binary()),
                    ],
                    ["_doc", "n", "f1", "f2", "bands", "sketch"],
                )

    schema = "_doc long, n long, f1 long, f2 long, bands array<long>, sketch binary"
    return docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text")).mapInArrow(sketch, schema)


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return W.text_bytes(column)[0].reshape(len(column), SIZE)


def sketched_pairs(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes that agree loosely, and whether they are ``likely`` to meet the similarity."""
    side = nodes.select("node", "n", "sketch")
    u = side.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    v = side.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_sketch_rows(batch.column("su")) == _sketch_rows(batch.column("sv"))).mean(axis=1) * 80 / percent
            nu, nv = np.asarray(batch.column("nu")), np.asarray(batch.column("nv"))
            likely = (agree >= LIKELY) & (100 * np.minimum(nu, nv) >= percent * np.maximum(nu, nv))
            made = pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(likely)], ["u", "v", "likely"])
            yield made.filter(pa.array(likely | (agree >= LOOSE)))

    return pairs.join(u, "u").join(v, "v").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(check, "u long, v long, likely boolean")


def marked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows whose ``_doc`` is among ``asked`` and a few others, found without moving any.

    Every asked key sets a bit, about one in SPARSE and at most MOST_BITS of all, in sections that go to all tasks.
    """
    bits = min(MOST_BITS, SECTION << max(0, (SPARSE * asked.count() - 1) // SECTION).bit_length())
    place = F.pmod(F.xxhash64("_doc"), F.lit(bits))
    sections = asked.groupBy((place / SECTION).cast("int").alias("_section")).agg(F.bitmap_construct_agg(place % SECTION).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (place % SECTION / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("_section", (place / SECTION).cast("int")).join(F.broadcast(sections), "_section")
    return held.where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0).drop("_section", "_bits")


def shingle_blobs(texts: DataFrame, width: int) -> DataFrame:
    """``_doc`` and ``members``, the sorted shingle hashes of each text."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", PIECE_BYTES):
                hashes, owner = shingle_sets(part.column("_text"), width)
                cuts = np.searchsorted(owner, np.arange(part.num_rows + 1))
                blobs = [hashes[cuts[k] : cuts[k + 1]].tobytes() for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("_doc"), pa.array(blobs, pa.binary())], ["_doc", "members"])

    return texts.select("_doc", "_text").mapInArrow(sets, "_doc long, members binary")


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets meet the similarity. Of rows that share a key each text is tried."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("mu"), batch.column("mv")):
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (a, b))
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    u = members.select(F.col("_doc").alias("u"), F.col("members").alias("mu"))
    v = members.select(F.col("_doc").alias("v"), F.col("members").alias("mv"))
    met = pairs.join(u, "u").join(v, "v").select("u", "v", "mu", "mv").mapInArrow(meet, "u long, v long")
    return met.distinct()


def block_links(sets: list[np.ndarray], made: np.ndarray, component: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """One pair of components for every two that a pair of nodes, one of ``left`` and one of ``right``, links."""
    size = np.array([len(x) for x in sets], dtype=np.int64)
    agree = np.zeros((len(left), len(right)), dtype=np.int32)
    for k in range(SIZE):
        agree += made[left, k][:, None] == made[right, k][None, :]
    wanted = (agree >= LIKELY * percent / 80 * SIZE) & (component[left][:, None] != component[right][None, :])
    keep_l, keep_r = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    if not len(keep_l):
        return []
    wanted, left, right = wanted[keep_l][:, keep_r], left[keep_l], right[keep_r]
    nodes = np.unique(np.concatenate((left, right)))
    row = np.repeat(np.arange(len(nodes)), size[nodes])
    values, column, count = np.unique(np.concatenate([sets[k] for k in nodes]), return_inverse=True, return_counts=True)
    # Shingles of a single node are in no intersection.
    number = np.cumsum(count > 1) - 1
    shared = count[column] > 1
    row, column = row[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    place_l, place_r = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    common = np.zeros((len(left), len(right)), dtype=np.float64)
    for low in range(0, int(number[-1]) + 1, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        held = np.zeros((len(nodes), COLUMNS), dtype=np.float32)
        held[row[a:b], column[a:b] - low] = 1
        common += held[place_l] @ held[place_r].T
    linked = wanted & (100 * common >= percent * (size[left][:, None] + size[right][None, :] - common))
    at_l, at_r = np.nonzero(linked)
    u, v = component[left[at_l]], component[right[at_r]]
    return sorted(set(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist())))


def _dealt(blocks: str) -> tuple[Column, Column]:
    """A node's own block of so many, and an array of the pairs of blocks (i, j) in which that block meets all others."""
    meets = F.transform(
        F.sequence(F.lit(0), F.col(blocks) - 1),
        lambda other: F.struct(F.least("own", other).alias("i"), F.greatest("own", other).alias("j")),
    )
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int"), meets


def tied_clouds(made: np.ndarray, size: np.ndarray, cloud: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> set[tuple[int, int]]:
    """The pairs of different clouds that a likely pair of nodes, one of ``left`` and one of ``right``, ties."""
    found: set[tuple[int, int]] = set()
    for a in range(0, len(left), TILE):
        one = left[a : a + TILE]
        for b in range(0, len(right), TILE):
            two = right[b : b + TILE]
            other = cloud[one][:, None] != cloud[two][None, :]
            if not other.any():
                continue
            agree = np.zeros(other.shape, dtype=np.uint8)
            for x, y in zip(made[one].T, made[two].T):
                agree += x[:, None] == y[None, :]
            u, v = np.nonzero(other & (agree >= LIKELY * percent / 80 * SIZE))
            u, v = one[u], two[v]
            near = 100 * np.minimum(size[u], size[v]) >= percent * np.maximum(size[u], size[v])
            u, v = cloud[u[near]], cloud[v[near]]
            found.update(zip(np.minimum(u, v).tolist(), np.maximum(u, v).tolist()))
    return found


def bucket_ties(shared: DataFrame, clouds: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of clouds tied by a likely pair of nodes in a bucket, neither being its hub.

    A node in no cloud is one of its own. Hubs have met every node of their buckets before. Buckets of at most MEETING
    nodes are dealt whole to groups of about as many; larger ones are cut into blocks, and every two of them meet.
    """
    own = shared.where("node > hub").select("bucket", "node").join(clouds.withColumnRenamed("component", "cloud"), "node", "left")
    own = stored(own.withColumn("cloud", F.coalesce("cloud", "node")), "dealt")
    mixed = own.groupBy("bucket").agg(F.min("cloud").alias("a"), F.max("cloud").alias("b"), F.count("*").alias("size"))
    mixed = stored(mixed.where("a < b").select("bucket", "size", F.ceil(F.col("size") / MEETING).cast("int").alias("blocks")), "open")
    whole = mixed.where("blocks = 1").agg(F.sum("size")).first()[0] or 0
    at, meets = _dealt("blocks")
    group = F.when(F.col("blocks") > 1, F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket"), F.lit(whole // MEETING + 1)))
    rows = own.join(mixed, "bucket").join(nodes.select("node", "n", "sketch"), "node").withColumn("own", at)
    rows = rows.select((F.col("blocks") > 1).alias("cut"), group.alias("group"), "bucket", "cloud", "n", "sketch", "own", F.inline(meets))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        made = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SIZE)
        bucket, cloud, size, block = (np.asarray(table.column(c)) for c in ("bucket", "cloud", "n", "own"))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        found: set[tuple[int, int]] = set()
        order = np.argsort(bucket, kind="stable")
        for one in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            left, right = one[block[one] == i], one[block[one] == j]
            found |= tied_clouds(made, size, cloud, left, right, percent)
        ties = sorted(found)
        return pa.table({"u": pa.array([u for u, _ in ties], pa.int64()), "v": pa.array([v for _, v in ties], pa.int64())})

    return rows.groupBy("cut", "group", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def cloud_links(clouds: DataFrame, label: DataFrame, nodes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between components of one cloud, verified on full sets.

    ``clouds`` and ``label`` give the cloud and the component of nodes. A cloud's nodes are dealt to blocks, and every
    two blocks meet in a group of their own.
    """
    own = clouds.select("node", F.col("component").alias("cloud")).join(label, "node", "left")
    own = stored(own.withColumn("component", F.coalesce("component", "node")), "clouds")
    roots = own.select(F.col("cloud").alias("node"), "cloud").distinct().join(label, "node", "left")
    # The least node of a cloud is its name and not among the rows above.
    own = own.unionByName(roots.withColumn("component", F.coalesce("component", "node")))
    mixed = own.groupBy("cloud").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("size"))
    mixed = stored(mixed.where("a < b").select("cloud", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "mixed")
    open_ = own.join(mixed, "cloud").join(nodes.select("node", "sketch"), "node")
    at, meets = _dealt("blocks")
    rows = open_.withColumn("own", at).join(members.withColumnRenamed("_doc", "node"), "node")
    rows = rows.select("cloud", "component", "sketch", "members", "own", F.inline(meets))

    def compare(table: pa.Table) -> pa.Table:
        component, block = np.asarray(table.column("component")), np.asarray(table.column("own"))
        sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in table.column("members")]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = block_links(sets, _sketch_rows(table.column("sketch")), component, left, right, percent)
        return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})

    return rows.groupBy("cloud", "i", "j").applyInArrow(compare, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``component_id`` (least key reachable) and ``kept``.

    Words are runs of characters other than white space, A-Z in lower case; a document's set holds its distinct
    shingles of ``width`` words, or its whole sequence where it has fewer. Documents are linked where the sets'
    intersection is at least ``percent`` of their union. A null or empty text, or one of spaces, has an empty set
    and is linked with nothing. Repeated rows share a component, and all rows with its id are kept. A document
    without a key takes the component of its equals, or none, and is then kept.
    """
    made = stored(sketched(docs, key, text, width), "sketched")
    filled = made.where("n > 0")
    # The partial aggregate sends one row per distinct set and task, however large a group of copies is.
    firsts = stored(filled.groupBy("f1", "f2").agg(F.min("_doc").alias("node")).where("node is not null"), "firsts")
    nodes = made.join(firsts.select(F.col("node").alias("_doc"), F.col("f1").alias("g1"), F.col("f2").alias("g2")), "_doc")
    nodes = nodes.where("f1 = g1 and f2 = g2").dropDuplicates(["f1", "f2"])
    nodes = stored(nodes.select(F.col("_doc").alias("node"), "n", "bands", "sketch"), "nodes")
    buckets = nodes.select("node", F.explode("bands").alias("bucket"))
    hubs = stored(buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1"), "hubs")
    shared = stored(buckets.join(hubs.select("bucket", "hub"), "bucket"), "buckets")
    stars = shared.where("node > hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    pairs = stored(sketched_pairs(stars, nodes, percent), "pairs")
    clouds = stored(components(pairs.select("u", "v")), "clouds")
    ties = stored(bucket_ties(shared, clouds, nodes, percent), "ties")
    met = pairs.select("u", "v").union(ties)
    if not ties.isEmpty():
        clouds = stored(components(met), "clouds")
    asked = met.select(F.col("u").alias("_doc")).union(met.select(F.col("v").alias("_doc"))).distinct()
    asked = stored(asked, "asked")
    texts = marked(docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text")), asked).join(asked, "_doc")
    members = stored(shingle_blobs(texts, width), "members")
    links = stored(verified(pairs.where("likely").select("u", "v"), members, percent), "links")
    first = stored(components(links), "labels")
    more = stored(cloud_links(clouds, first, nodes, members, percent), "more")
    last = first if more.isEmpty() else stored(components(links.union(more)), "labels")
    by_set = firsts.join(last, "node", "left").select("f1", "f2", F.coalesce("component", "node").alias("_component"))
    by_set = stored(by_set, "by_set")
    joined = made.select("_doc", "n", "f1", "f2").join(by_set, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("_doc"))
    return joined.select(F.col("_doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("_doc")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that :func:`near_duplicates` keeps, all their columns as they were."""
    judged = near_duplicates(docs, key, text, width, percent)
    gone = judged.groupBy(key).agg(F.max("kept").alias("kept")).where(~F.col("kept")).select(key)
    return without_keys(docs, gone, [F.col(key).cast("long")])
