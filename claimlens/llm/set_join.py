"""Documents joined by the Jaccard similarity of their shingle sets: a size-aware heavy-light join, exact at any size.

A linked pair shares at least ``need(n)`` elements, the given percentage of the larger set. Texts with equal sets are
one node. Two screens drop nodes that cannot have a partner, and neither can lose a link: of each set's least elements
by hash, enough must lie among those of some other set; and of all its elements, at least ``need(n)`` must lie in another
set that is left. What remains are the shared elements of each node, the rarest first.

Light nodes have fewer elements than the boundary. They enumerate the subsets of fixed sizes, down to ``need(n)``, of
their shared elements; a linked pair meets in its intersection. All sets of one subset are compared with the smallest of
them by their sizes alone: if two of them are linked through the subset, both are linked with that one.

Heavy nodes scan inverted lists. The lists of the rarest elements, one more than a set can lack, tie nodes into clouds,
outside of which there is no link. In a block of a cloud the most typical node scans the lists of its elements first and
counts what it shares with every other; from then on only nodes that are not in the largest component scan. Clouds of
several blocks hold their most typical nodes in each; nodes that then are in another component than the largest one meet
the remaining blocks. No step lists the pairs of a group.

The boundary is the size at which the subsets to enumerate and the list entries to scan are fewest in sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm import words as W
from claimlens.llm.components import components
from claimlens.llm.near_dedup import shingle_sets
from claimlens.llm.tables import checkpointed, pieces, stored

PIECE_BYTES = 2_000_000
# Shared elements that the first screen asks for, in percent of the set.
SCREEN = 5
# Light nodes are at most this large: four elements may be left out of 32, about 41,000 subsets.
MOST_LIGHT = 32
# Elements of a block, and the typical nodes that all blocks of a cloud hold.
BLOCK = 1_000_000
TYPICAL = 4
# What enumerating one subset costs beside one entry of a list: it is shuffled, the entry is added up in place.
SUBSET_COST = 20
RESULTS = ("n_shingles", "component_id")


def need(n, percent: int):
    """The least intersection of a set of ``n`` elements with a linked one."""
    return (percent * n + 99) // 100


def screen(n):
    return (SCREEN * n + 99) // 100


def _need(n: Column, percent: int) -> Column:
    return F.floor((percent * n + 99) / 100)


def fingerprints(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set, which tell sets apart."""
    one, two = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
    np.add.at(one, owner, W.mix(hashes ^ np.uint64(W.BASE)))
    np.add.at(two, owner, W.mix(hashes + np.uint64(W.BASE)))
    return one.view(np.int64), two.view(np.int64)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values.view(np.int64)))


def shingled(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Per row of ``_doc``, ``_text`` and ``_seal``: ``n`` shingles, fingerprints ``f1`` and ``f2``, and ``least``, the
    set's least elements that the first screen looks at."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", PIECE_BYTES):
                hashes, owner = shingle_sets(part.column("_text"), width)
                n = np.bincount(owner, minlength=part.num_rows)
                place = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
                first = np.minimum(n, n - need(n, percent) + screen(n))
                f1, f2 = fingerprints(hashes, owner, part.num_rows)
                least = _lists(hashes[place < first[owner]], np.cumsum(first))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_doc"), part.column("_seal"), pa.array(n), pa.array(f1), pa.array(f2), least], ["_doc", "_seal", "n", "f1", "f2", "least"]
                )

    return docs.mapInArrow(shingle, "_doc long, _seal long, n long, f1 long, f2 long, least array<long>")


def shared_rows(rows: DataFrame) -> DataFrame:
    """The rows (node, n, e) whose element lies in several of them, with that number ``df``."""
    counts = stored(rows.groupBy("e").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    return rows.join(counts, "e")


def set_members(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """``node``, ``n`` and ``members`` of the given nodes, from the text of their first document."""
    asked = nodes.select("node", "n", "f1", "f2", F.col("_first").alias("_asked"), F.col("_seal").alias("_as"))
    met = docs.join(asked, F.col("_doc").eqNullSafe(F.col("_asked")) & (F.col("_seal") == F.col("_as")))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "_text", PIECE_BYTES):
                hashes, owner = shingle_sets(part.column("_text"), width)
                f1, f2 = fingerprints(hashes, owner, part.num_rows)
                same = (f1 == np.asarray(part.column("f1"))) & (f2 == np.asarray(part.column("f2")))
                made = [part.column("node"), part.column("n"), _lists(hashes, np.searchsorted(owner, np.arange(1, part.num_rows + 1)))]
                yield pa.RecordBatch.from_arrays(made, ["node", "n", "members"]).filter(pa.array(same))

    found = met.select("node", "n", "f1", "f2", "_text").mapInArrow(members, "node long, n long, members array<long>")
    return found.dropDuplicates(["node"])


def boundary(live: DataFrame, percent: int) -> int:
    """Sets of fewer elements enumerate subsets, the others scan: the size that makes both together cheapest."""
    lacking = (F.size("shared") - _need(F.col("n"), percent)).cast("int")
    scanned = F.aggregate(F.slice("shared", F.lit(1), lacking + 1), F.lit(0).cast("long"), lambda s, x: s + x["df"])
    small = live.where(F.col("n") <= MOST_LIGHT)
    rows = small.groupBy("n", F.size("shared").alias("m")).agg(F.count("*").alias("nodes"), F.sum(scanned).alias("entries")).collect()
    costs = []
    for limit in range(1, MOST_LIGHT + 2):
        cost = 0
        for r in rows:
            subsets = sum(comb(r.m, d) for d in range(r.m - need(r.n, percent) + 1))
            cost += r.nodes * subsets * SUBSET_COST if r.n < limit else r.entries
        costs.append((cost, limit))
    return min(costs)[1]


def light_links(light: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that connect every two light nodes linked with each other."""

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, shared in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "elements"))):
                values = np.array(shared, dtype=np.int64).view(np.uint64)
                parts = W.mix(values ^ np.uint64(W.BASE)), W.mix(values + np.uint64(W.BASE))
                for left_out in range(len(values) - need(n, percent) + 1):
                    rows = comb(len(values), left_out)
                    chosen = np.array(list(combinations(range(len(values)), left_out)), dtype=np.int64).reshape(rows, left_out)
                    keys = [pa.array((p.sum() - p[chosen].sum(axis=1, dtype=np.uint64)).view(np.int64)) for p in parts]
                    size = np.full(rows, len(values) - left_out)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, node)), pa.array(np.full(rows, n)), pa.array(size), *keys], ["node", "n", "c", "k1", "k2"])

    rows = stored(light.select("node", "n", F.col("shared.e").alias("elements")).mapInArrow(subsets, "node long, n long, c long, k1 long, k2 long"), "subsets")
    hubs = rows.groupBy("c", "k1", "k2").agg(F.min(F.struct("n", "node")).alias("hub"), F.count("*").alias("sets")).where("sets > 1")
    met = rows.join(hubs, ["c", "k1", "k2"]).where(F.col("node") != F.col("hub.node"))
    linked = (100 + percent) * F.col("c") >= percent * (F.col("n") + F.col("hub.n"))
    return met.where(linked).select(F.col("hub.node").alias("u"), F.col("node").alias("v")).distinct()


class Lists:
    """Inverted lists over the elements that several of the given sets hold."""

    def __init__(self, sets: list[np.ndarray], size: np.ndarray, percent: int):
        self.size, self.percent = size, percent
        length = np.array([len(x) for x in sets], dtype=np.int64)
        _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        held = count[column] > 1
        owner = np.repeat(np.arange(len(sets)), length)[held]
        number = np.cumsum(count > 1) - 1
        self.column = number[column[held]]
        self.first = np.searchsorted(owner, np.arange(len(sets) + 1))
        order = np.argsort(self.column, kind="stable")
        self.posting = owner[order]
        self.start = np.searchsorted(self.column[order], np.arange(int(number[-1]) + 2 if len(number) else 1))

    def partners(self, u: int) -> np.ndarray:
        """All sets linked with ``u``: its lists are scanned and their entries added up by set."""
        own = self.column[self.first[u] : self.first[u + 1]]
        low, length = self.start[own], self.start[own + 1] - self.start[own]
        if not len(own):
            return own
        at = np.arange(int(length.sum())) + np.repeat(low - (np.cumsum(length) - length), length)
        common = np.bincount(self.posting[at], minlength=len(self.size))
        found = np.flatnonzero((common > 0) & ((100 + self.percent) * common >= self.percent * (self.size + self.size[u])))
        return found[found != u]


def scan(sets: list[np.ndarray], size: np.ndarray, typical: np.ndarray, percent: int, component: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of places that connect all linked ones: every set that is not in the largest component scans.

    A pair in two components has one outside of the largest, which scans. ``component`` tells which sets are known to
    be connected; ``typical`` orders the sets until one component is clearly the largest.
    """
    lists = Lists(sets, size, percent)
    group = np.arange(len(sets)) if component is None else np.unique(component, return_inverse=True)[1].astype(np.int64)
    waiting = np.ones(len(sets), dtype=bool)
    links: list[tuple[int, int]] = []
    order = np.argsort(-typical, kind="stable")
    while True:
        largest = np.bincount(group).argmax()
        outside = waiting & (group != largest)
        if not outside.any():
            return links
        first = order[waiting[order]][0]
        # The most typical set of all while it helps, then those outside.
        u = first if len(links) == 0 else order[outside[order]][0]
        waiting[u] = False
        for v in lists.partners(u).tolist():
            if group[v] != group[u]:
                links.append((int(u), v))
                group[group == group[v]] = group[u]


def _sets(table: pa.Table) -> list[np.ndarray]:
    column = table.column("elements").combine_chunks()
    ends = np.cumsum(np.asarray(column.value_lengths(), dtype=np.int64))
    return np.split(np.asarray(column.flatten()), ends[:-1]) if len(ends) else []


def _links(pairs: set[tuple[int, int]]) -> pa.Table:
    found = sorted(pairs)
    return pa.table({"u": pa.array([u for u, _ in found], pa.int64()), "v": pa.array([v for _, v in found], pa.int64())})


def heavy_links(live: DataFrame, limit: int, percent: int) -> DataFrame:
    """Links (u, v) that connect every two nodes linked with each other, one of them of ``limit`` elements at least."""
    n = F.col("n")
    indexed = live.where(n >= need(limit, percent)).withColumn("typical", F.aggregate("shared", F.lit(0).cast("double"), lambda s, x: s + x["df"]) / n)
    rarest = F.slice("shared", F.lit(1), (F.size("shared") - _need(n, percent) + 1).cast("int"))
    entries = stored(indexed.select("node", "n", "typical", F.explode(rarest["e"]).alias("e")), "entries")
    hubs = entries.groupBy("e").agg(F.max(F.struct("typical", "node"))["node"].alias("hub"), F.max("n").alias("largest"), F.count("*").alias("sets"))
    hubs = hubs.where((F.col("sets") > 1) & (F.col("largest") >= limit)).select("e", "hub")
    ties = entries.join(hubs, "e").where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    tied = stored(components(ties), "clouds")
    roots = tied.select(F.col("component").alias("node"), "component").distinct()
    cloud = tied.unionByName(roots).withColumnRenamed("component", "cloud")
    rows = indexed.join(cloud, "node").select("cloud", "node", "n", "typical", F.col("shared.e").alias("elements"))
    rows = stored(rows, "clouded")
    sizes = rows.groupBy("cloud").agg(F.sum(F.size("elements")).alias("elements"), F.max("n").alias("largest"))
    sizes = sizes.where(F.col("largest") >= limit).withColumn("blocks", F.ceil(F.col("elements") / BLOCK).cast("int"))
    sizes = stored(sizes.select("cloud", "elements", "blocks"), "sizes")
    bins = (sizes.where("blocks = 1").agg(F.sum("elements")).first()[0] or 0) // BLOCK + 1
    # Clouds of one block are dealt whole to bins of about a block.
    block = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("cloud"), F.lit(bins)))
    own = rows.join(sizes.drop("elements"), "cloud").withColumn("block", block.cast("long"))
    several = sizes.where("blocks > 1").select("cloud", "blocks")
    # At most TYPICAL rows per cloud and task, and then per cloud.
    top = F.row_number().over(Window.partitionBy("cloud").orderBy(F.col("typical").desc(), "node")).alias("place")
    leaders = rows.join(several, "cloud").select("*", top).where(F.col("place") <= TYPICAL).drop("place")
    leaders = leaders.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = own.select(*leaders.columns).union(leaders).withColumn("apart", F.when(F.col("blocks") > 1, F.col("cloud")))

    def meet(table: pa.Table) -> pa.Table:
        place = {c: np.asarray(table.column(c).combine_chunks()) for c in ("cloud", "node", "n", "typical")}
        sets, found = _sets(table), set()
        for c in np.unique(place["cloud"]):
            # A leader dealt to this block as its own is there twice.
            at = np.flatnonzero(place["cloud"] == c)
            at = at[np.unique(place["node"][at], return_index=True)[1]]
            node = place["node"][at]
            for u, v in scan([sets[k] for k in at], place["n"][at], place["typical"][at], percent):
                found.add((int(min(node[u], node[v])), int(max(node[u], node[v]))))
        return _links(found)

    inside = stored(dealt.groupBy("apart", "block").applyInArrow(meet, "u long, v long"), "inside")
    if several.isEmpty():
        return inside
    return inside.union(_outside_links(rows.join(several, "cloud"), inside, percent))


def _outside_links(rows: DataFrame, inside: DataFrame, percent: int) -> DataFrame:
    """Links of the nodes that their blocks left outside the largest component of a cloud of several blocks."""
    label = stored(components(inside), "labels")
    rows = rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = stored(rows, "open")
    sizes = rows.groupBy("cloud", "component").agg(F.count("*").alias("nodes"))
    largest = sizes.groupBy("cloud").agg(F.max(F.struct("nodes", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    rows = rows.join(stored(largest, "main"), "cloud").withColumn("outside", F.col("component") != F.col("main"))
    chunks = rows.where("outside").groupBy("cloud").agg(F.ceil(F.sum(F.size("elements")) / BLOCK).cast("int").alias("chunks"))
    rows = stored(rows.join(chunks, "cloud"), "loose")
    # Every node is in a block; those outside are dealt to chunks as well, and each chunk meets each block.
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    chunk = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("chunks")).cast("int")
    kept = rows.select("cloud", "node", "n", "typical", "component", "elements", F.lit(False).alias("asks"), block.alias("i"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("j"))
    asks = rows.where("outside").select("cloud", "node", "n", "typical", "component", "elements", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), chunk.alias("j"))

    def meet(table: pa.Table) -> pa.Table:
        node, size, component, asks = (np.asarray(table.column(c).combine_chunks()) for c in ("node", "n", "component", "asks"))
        lists, found = Lists(_sets(table), size, percent), set()
        for u in np.flatnonzero(asks).tolist():
            other = component[lists.partners(u)]
            for v in np.unique(other[other != component[u]]).tolist():
                found.add((min(int(component[u]), v), max(int(component[u]), v)))
        return _links(found)

    return kept.union(asks).groupBy("cloud", "i", "j").applyInArrow(meet, "u long, v long").distinct()


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: ``key``, ``n_shingles`` and ``component_id``, the least key reachable by links.

    Words are runs of characters other than white space, A-Z in lower case; a document's set holds its distinct
    shingles of ``width`` words, or its whole sequence where it has fewer. Documents are linked where the sets'
    intersection is at least ``percent`` of their union. A null or empty text, or one of spaces, has an empty set and is
    linked with nothing. Every row is a document: repeated rows share a component, and a document without a key links
    others, takes the least key it reaches, and has none where it reaches none. Texts of any length are taken whole;
    other columns are not read and may have any name.
    """
    if key in RESULTS:
        raise ValueError(f"the key cannot be called {key}, as a column of the result is")
    rows = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_seal"))
    sets = stored(shingled(rows, width, percent), "sets")
    filled = sets.where("n > 0")
    # The partial aggregate sends one row per distinct set and task, however large a group of copies is.
    first = F.min(F.struct(F.col("_doc").isNull().alias("without"), "_doc", "_seal"))
    nodes = filled.groupBy("f1", "f2").agg(F.max("n").alias("n"), first.alias("first"))
    nodes = nodes.select("f1", "f2", "n", F.col("first._doc").alias("_first"), F.col("first._seal").alias("_seal"))
    # The number is fixed by being written.
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    chosen = nodes.select("node", F.col("f1").alias("g1"), F.col("f2").alias("g2"), "_first", F.col("_seal").alias("_own"))
    same = (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("_seal") == F.col("_own")) & F.col("_doc").eqNullSafe(F.col("_first"))
    least = stored(filled.join(chosen, same).select("node", "n", "least"), "least")
    met = shared_rows(least.select("node", "n", F.explode("least").alias("e"))).groupBy("node").agg(F.count("*").alias("met"))
    wanted = F.floor((SCREEN * _need(F.col("n"), percent) + 99) / 100)
    open_nodes = stored(nodes.join(met, "node").where(F.col("met") >= wanted).drop("met"), "screened")

    members = stored(set_members(rows, open_nodes, width), "members")
    shared = shared_rows(members.select("node", "n", F.explode("members").alias("e")))
    live = shared.groupBy("node").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("df", "e"))).alias("shared"))
    live = stored(live.where(F.size("shared") >= _need(F.col("n"), percent)), "live")

    limit = boundary(live, percent)
    links = stored(light_links(live.where(F.col("n") < limit), percent).union(heavy_links(live, limit, percent)).distinct(), "links")
    label = stored(components(links), "labels")
    label = label.unionByName(label.select(F.col("component").alias("node"), "component").distinct())
    grouped = nodes.select("node", "_first").join(label, "node")
    reached = checkpointed(grouped.groupBy("component").agg(F.min("_first").alias("_reached")))
    by_set = nodes.join(grouped.select("node", "component").join(reached, "component").select("node", "_reached"), "node", "left")
    by_set = stored(by_set.select("f1", "f2", F.coalesce("_reached", "_first").alias("_reached")), "by_set")
    joined = sets.select("_doc", "n", "f1", "f2").join(by_set, ["f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("_reached")).otherwise(F.col("_doc"))
    return joined.select(F.col("_doc").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
