"""Alignment of two tokenizers over every distinct text of a corpus.

Texts are shuffled whole and counted, so that each distinct one is tokenized and aligned once; its copies only weigh its
pairs. Both tokenizers cut a text where white space follows something else, and neither joins what lies on the two
sides. The stretches between, white space and the word behind it, are aligned by themselves and kept; a text is a
sequence of such stretches. Texts with carriage returns, unusual white space or control characters are aligned whole.

A pair's count is the number of documents that hold it linked. The most frequent pairs, at most MOST_PAIRS, go to all
tasks as a sorted table; the links that it does not hold are joined with the other pairs by a shuffle, in which no pair
is frequent. Every link gets its count one way or the other, at any size.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import kept, pieces, stored

MOST_PAIRS = 2**19
# Aligned stretches kept between texts, in two generations: a full younger one becomes the older.
MOST_STRETCHES = 60_000
LONGEST = 48
PIECE_BYTES = 1_000_000
# Stretches that A encodes in one call, and the longest of them.
JOINED = 500
LONG = 200
# A pair's two ids in one number, and the number of its text above it.
PAIR_BITS = 40
_UNUSUAL = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
# What is beyond Latin Extended-B is left to the tokenizer's own tables of letters.
_FOREIGN = re.compile("[\u0250-\U0010ffff]")
# Fixed value: how byte-level tokenizers cut a text into words.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_STRETCH = re.compile(r"\s*\S+|\s+")
_SPACE = "\u2581"


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def piece_count(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()


def byte_level_table() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, the others
    for the characters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Aligned:
    """What one stretch, or a whole text, adds: counts, link codes as bytes and its groups as text."""

    __slots__ = ("n_a", "n_b", "n_groups", "links", "groups")

    def __init__(self, n_a: int, n_b: int, n_groups: int, links: bytes, groups: bytes):
        self.n_a, self.n_b, self.n_groups, self.links, self.groups = n_a, n_b, n_groups, links, groups


class Aligner:
    """Aligns texts by a byte-level tokenizer file (A) and a piece model (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # A task has one core; threads of its own would only compete with other tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as file:
            setup = json.load(file)
        entries = setup["model"]["vocab"]
        byte = byte_level_table()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.bytes_a[k] = bytes(byte[c] for c in entry)
        self.ranked = self._ranked(setup)
        pieces_b = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces_b)]
        # Where white space begins, no piece may go on, or stretches could not be encoded apart.
        self.apart = not any(re.search(f"[^{_SPACE}]{_SPACE}|[\t\n]", p) for p in pieces_b)
        self.space_b = self.b.piece_to_id(_SPACE)
        # The text of an id with each sign that may follow it among groups.
        self.text_a = [f"{k}{sign}".encode() for k in range(len(self.bytes_a)) for sign in ",|"]
        self.text_b = [f"{k}{sign}".encode() for k in range(len(self.bytes_b)) for sign in ",;"]
        self.size_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.size_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        self.known: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def _ranked(self, setup: dict):
        """An encoder that merges by ids, if the file's merges are in the order of the ids they make; None otherwise."""
        import tiktoken

        model, cut = setup["model"], setup["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"]["".join(m)] for m in merges]
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and not setup["normalizer"]
        if not plain or made != list(range(256, 256 + len(made))):
            return None
        special = {t["id"] for t in setup["added_tokens"]}
        ranks = {b: k for k, b in enumerate(self.bytes_a) if k not in special}
        return tiktoken.Encoding("a", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})

    def _entries(self, stretches: list[str]) -> list[list[int]]:
        """A's ids of every stretch. Ordinary ones go in rows, as in a text, to a faster encoder of the same entries."""
        made: list[list[int]] = [[]] * len(stretches)
        joined = []
        if self.ranked:
            joined = [k for k, s in enumerate(stretches) if len(s) <= LONG and not s[-1].isspace() and not _UNUSUAL.search(s) and not _FOREIGN.search(s)]
        for at in range(0, len(joined), JOINED):
            row = joined[at : at + JOINED]
            ids = self.ranked.encode_ordinary("".join([stretches[k] for k in row]))
            # No word goes across white space, so every stretch ends with a token.
            ends = np.cumsum(self.size_a[ids])
            cuts = np.searchsorted(ends, np.cumsum([len(stretches[k].encode()) for k in row])) + 1
            low = 0
            for k, high in zip(row, cuts.tolist()):
                made[k], low = ids[low:high], high
        alone = sorted(set(range(len(stretches))) - set(joined))
        for k, e in zip(alone, self.a.encode_batch_fast([stretches[k] for k in alone], add_special_tokens=False)):
            made[k] = e.ids
        return made

    def _pieces(self, stretches: list[str]) -> list[list[int]]:
        """B's ids of stretches of a text to which its space has been added."""
        asked = [s[1:] if s[0] == " " else s for s in stretches]
        made = self.b.encode(asked, num_threads=1)
        # B adds a space of its own: it stands for the one taken off, or is dropped where none was.
        return [ids[1:] if s[0] != " " else ids or [self.space_b] for s, ids in zip(stretches, made)]

    def align(self, stretches: list[str]) -> list[Aligned | None]:
        """Each stretch by itself; None where the joined bytes of A or B are not its own."""
        if not stretches:
            return []
        ids_a = self._entries(stretches)
        ids_b = self._pieces(stretches)
        text = [s.encode() for s in stretches]
        good = [
            b"".join(map(self.bytes_a.__getitem__, a)) == t == b"".join(map(self.bytes_b.__getitem__, b))
            for a, b, t in zip(ids_a, ids_b, text)
        ]
        place = [k for k, g in enumerate(good) if g]
        made: list[Aligned | None] = [None] * len(stretches)
        if not place:
            return made
        count_a = np.array([len(ids_a[k]) for k in place])
        count_b = np.array([len(ids_b[k]) for k in place])
        a = np.concatenate([ids_a[k] for k in place]).astype(np.int64)
        b = np.concatenate([ids_b[k] for k in place]).astype(np.int64)
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        stops = np.zeros((2, int(end_a[-1]) + 1), dtype=bool)
        stops[0, end_a] = stops[1, end_b] = True
        # Between two neighbouring ends of either side lie one token of A and one of B: each such part is a link.
        parts = np.flatnonzero(stops[0] | stops[1])
        in_a, in_b = stops[0, parts], stops[1, parts]
        link = a[np.cumsum(in_a) - in_a] * len(self.bytes_b) + b[np.cumsum(in_b) - in_b]
        both = in_a & in_b
        # Groups end where both sides do. A's ids of a group stand before B's.
        last_a, last_b = stops[1, end_a], stops[0, end_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        first_b = np.searchsorted(group_b, np.arange(int(both.sum()) + 1))
        first_a = np.searchsorted(group_a, np.arange(int(both.sum()) + 1))
        signs = np.empty(len(a) + len(b), dtype=np.int64)
        signs[np.arange(len(a)) + first_b[group_a]] = 2 * a + last_a
        signs[np.arange(len(b)) + first_a[group_b + 1]] = 2 * b + last_b + len(self.text_a)
        words = self.text_a + self.text_b
        signs = signs.tolist()
        ends_a, ends_b = np.cumsum(count_a), np.cumsum(count_b)
        limits = end_a[ends_a - 1]
        ends_link = np.searchsorted(parts, limits, "right")
        groups = np.cumsum(both)[ends_link - 1]
        at_link = at_sign = at_group = 0
        for k, n_a, n_b, to_link, to_group in zip(place, count_a.tolist(), count_b.tolist(), ends_link.tolist(), groups.tolist()):
            to_sign = at_sign + n_a + n_b
            written = b"".join(map(words.__getitem__, signs[at_sign:to_sign]))
            made[k] = Aligned(n_a, n_b, to_group - at_group, link[at_link:to_link].tobytes(), written[:-1])
            at_link, at_sign, at_group = to_link, to_sign, to_group
        return made

    def texts(self, texts: list[str | None]) -> list[list[Aligned] | None]:
        """The aligned stretches of every text; None for a text without tokens."""
        split: list[list[str] | None] = []
        for t in texts:
            if not t:
                split.append(None)
            elif self.apart and not _UNUSUAL.search(t):
                split.append(_STRETCH.findall(" " + t))
            else:
                split.append([" " + t])
        if len(self.known) > MOST_STRETCHES:
            self.known, self.older = {}, self.known
        here: dict[str, Aligned | None] = {}
        new = []
        for s in set().union(*[x for x in split if x]):
            if s in self.known:
                here[s] = self.known[s]
            elif s in self.older:
                here[s] = self.known[s] = self.older[s]
            else:
                new.append(s)
        at = 0
        while at < len(new):
            to, size = at, 0
            while to < len(new) and size < PIECE_BYTES // 4:
                size += len(new[to]) + 8
                to += 1
            fresh = dict(zip(new[at:to], self.align(new[at:to])))
            here.update(fresh)
            self.known.update((s, x) for s, x in fresh.items() if len(s) <= LONGEST)
            at = to
        made: list[list[Aligned] | None] = []
        for x in split:
            found = None if x is None else list(map(here.__getitem__, x))
            made.append(None if found is None or None in found else found)
        return made


def _kept_aligner(path_a: str, path_b: str) -> Aligner:
    return kept(f"aligner {path_a} {path_b}", lambda: Aligner(path_a, path_b))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(values, pa.int32()))


def aligned_texts(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per row of ``_digest``, ``_text`` and ``copies``: the text's measures, and its distinct pairs (``a``, ``b``) with
    how often each is linked in it (``times``). A text without tokens has none."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _kept_aligner(path_a, path_b)
        size_b = len(aligner.bytes_b)
        for batch in batches:
            for part in pieces(batch, "_text", PIECE_BYTES):
                found = aligner.texts(part.column("_text").to_pylist())
                counts = np.array([[sum(x.n_a for x in f), sum(x.n_b for x in f), sum(x.n_groups for x in f)] if f else [0, 0, 0] for f in found], dtype=np.int64)
                links = [b"".join([x.links for x in f]) if f else b"" for f in found]
                written = [hashlib.sha256(b";".join([x.groups for x in f])).hexdigest() if f else "" for f in found]
                n_links = np.array([len(x) // 8 for x in links], dtype=np.int64)
                codes = np.frombuffer(b"".join(links), dtype=np.int64) | np.repeat(np.arange(len(found)) << PAIR_BITS, n_links)
                pairs, times = np.unique(codes, return_counts=True)
                ends = np.searchsorted(pairs, np.arange(1, len(found) + 1) << PAIR_BITS)
                a, b = np.divmod(pairs & (2**PAIR_BITS - 1), size_b)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("_digest"),
                        part.column("copies"),
                        *[pa.array(counts[:, k]) for k in range(3)],
                        pa.array(n_links),
                        pa.array(written),
                        *[_lists(x, ends) for x in (a, b, times)],
                    ],
                    ["_digest", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"],
                )

    schema = "_digest binary, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"
    return texts.select("_digest", "_text", "copies").mapInArrow(align, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``a``, ``b``, ``count`` (documents that hold the pair linked) and ``best``: whether it is the highest of its ``a``."""
    rows = aligned.select("copies", F.inline(F.arrays_zip("a", "b")))
    counted = stored(rows.groupBy("a", "b").agg(F.sum("copies").alias("count")), "pairs")
    # One row per id of A, so its size is bounded by the vocabulary.
    highest = counted.groupBy("a").agg(F.max("count").alias("_highest"))
    return counted.join(F.broadcast(highest), "a").select("a", "b", "count", (F.col("count") == F.col("_highest")).alias("best"))


def frequency_limit(pairs: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` pairs reach it. Counts are binned by eighths of a power of two."""
    step = F.floor(8 * F.log2(F.col("count").cast("double")))
    bins = pairs.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("count").alias("least"), F.max("count").alias("top"))
    bins = sorted(bins.collect(), key=lambda r: -r.least)
    total, limit = 0, (bins[0].top + 1 if bins else 1)
    for r in bins:
        total += r.pairs
        if total > most:
            break
        limit = r.least
    return limit


def frequent_table(pairs: DataFrame, limit: int, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted codes of the pairs whose count reaches the limit, their counts, and which are best."""
    table = pairs.where(F.col("count") >= limit).select((F.col("a").cast("long") * size_b + F.col("b")).alias("code"), "count", "best").toArrow()
    code, count, best = (np.asarray(table.column(c).combine_chunks()) for c in ("code", "count", "best"))
    order = np.argsort(code)
    return code[order], count[order], best[order].astype(bool)


def scored(aligned: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray], size_b: int) -> DataFrame:
    """Adds ``n_best`` and ``count_sum`` over the frequent pairs; ``a``, ``b`` and ``times`` keep the others."""
    shared = aligned.sparkSession.sparkContext.broadcast(frequent)
    own = [c for c in aligned.columns if c not in ("copies", "a", "b", "times")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, best = shared.value
        for batch in batches:
            size = np.asarray(batch.column("a").value_lengths(), dtype=np.int64)
            a, b, times = (np.asarray(batch.column(c).flatten(), dtype=np.int64) for c in ("a", "b", "times"))
            asked = a * size_b + b
            at = np.minimum(np.searchsorted(code, asked), max(len(code) - 1, 0))
            held = code[at] == asked if len(code) else np.zeros(len(asked), dtype=bool)
            ends = np.cumsum(size)

            def per_text(values: np.ndarray) -> np.ndarray:
                sums = np.concatenate(([0], np.cumsum(values)))
                return sums[ends] - sums[ends - size]

            n_best = per_text(np.where(held, times * best[at], 0) if len(code) else times * 0)
            total = per_text(np.where(held, times * count[at], 0) if len(code) else times * 0)
            rest = np.cumsum(per_text(~held))
            made = [batch.column(c) for c in own] + [pa.array(n_best), pa.array(total)] + [_lists(x[~held], rest) for x in (a, b, times)]
            yield pa.RecordBatch.from_arrays(made, [*own, "n_best", "count_sum", "a", "b", "times"])

    kinds = ", ".join(f"{c} {t}" for c, t in aligned.select(*own).dtypes)
    return aligned.mapInArrow(score, f"{kinds}, n_best long, count_sum long, a array<int>, b array<int>, times array<int>")


MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align_tokenizers(
    docs: DataFrame, key: str = "doc_id", text: str = "text", paths: tuple[str, str] | None = None, most: int = MOST_PAIRS
) -> DataFrame:
    """One row per document: ``key``, ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``
    and ``groups_sha256``.

    ``paths`` name a byte-level tokenizer file (A) and a piece model (B), on every executor. A encodes a space and the
    text, B the text, to which it adds the space. Byte offsets where tokens of both end cut them into groups; every two
    tokens whose bytes overlap are a link. A pair's count is the number of documents, copies included, that hold it
    linked; ``n_best`` counts the links whose pair has the highest count of its A id, ties included, and ``count_sum``
    adds up the counts of all links. Null and empty texts, and those whose bytes A or B does not give back, have zeros
    and an empty digest. Texts of any length are taken whole. Repeated rows, and rows without a key, each count as a
    document and get a row. Other columns are not read and may have any name.
    """
    if key in (*MEASURES, "groups_sha256"):
        raise ValueError(f"the key cannot be called {key}, as a column of the result is")
    path_a, path_b = paths or default_paths()
    size_b = piece_count(path_b)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    digest = F.unhex(F.sha2(F.col("_text"), 256))
    texts = rows.where("_text <> ''").groupBy("_text").agg(F.count("*").alias("copies")).withColumn("_digest", digest)
    aligned = stored(aligned_texts(texts, path_a, path_b), "aligned")
    pairs = stored(pair_counts(aligned), "counted")
    limit = frequency_limit(pairs, most)
    measured = stored(scored(aligned, frequent_table(pairs, limit, size_b), size_b), "measured")
    rare = measured.select("_digest", F.inline(F.arrays_zip("a", "b", "times"))).join(pairs.where(F.col("count") < limit), ["a", "b"])
    rare = rare.groupBy("_digest").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_more_best"), F.sum(F.col("times") * F.col("count")).alias("_more_count")
    )
    whole = measured.drop("a", "b", "times").join(rare, "_digest", "left")
    whole = whole.withColumn("n_best", F.col("n_best") + F.coalesce("_more_best", F.lit(0)))
    whole = whole.withColumn("count_sum", F.col("count_sum") + F.coalesce("_more_count", F.lit(0))).drop("_more_best", "_more_count")
    keyed = rows.select("_key", F.when(F.col("_text") != "", digest).alias("_digest"))
    found = keyed.join(stored(whole, "whole"), "_digest", "left")
    return found.select(F.col("_key").alias(key), *[F.coalesce(c, F.lit(0)).alias(c) for c in MEASURES], F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
