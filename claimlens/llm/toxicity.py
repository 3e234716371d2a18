"""Toxicity of deobfuscated text: a noisy channel from written tokens back to words.

A token that may be disguised (signs among letters, letters drawn out, single letters in a row) is a lattice: each
character can stand for itself, for the letters it imitates, or for nothing, and a run of one letter for one or two.
Viterbi decoding under a character trigram model of the whole corpus picks the likeliest spelling. The restored text
is scored by words and word beginnings that labelled toxic texts hold far more often than chance allows.

Tokens and rows of single characters of any length are decoded, in work linear in their length. A token longer than
LONGEST is read by the parts between its signs; parts that are themselves longer, and single characters set apart by
signs or spaces, are restored as one stretch of letters in which lexicon words are searched for.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.labelled import fit_logistic, held_out, labels_to_learn, logistic, sample_ids, with_texts
from claimlens.llm.tables import pieces, stored

# Word weights are learned from at most so many labelled documents: toxic, and clean ones.
TOXIC_SAMPLE, CLEAN_SAMPLE = 2_500, 5_000
# The largest lexicon; entries of least evidence go first.
LEXICON = 50_000
MODULUS, HELD = 5, 0
# Evidence an entry needs, as log likelihood ratio against the share of toxic documents, and the least ratio of rates.
EVIDENCE, RATIO = 14.0, 20.0
PREFIXES = (4, 5, 6, 7, 8)
# The longest word of the lexicon, and the longest token that is read as one word.
LONGEST = 32
# Tokens kept between texts, and the text whose trigrams are counted at once.
CACHE = 400_000
PIECE_BYTES = 1_000_000

# The letters that a sign may stand for.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i",
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
# Log probabilities of the channel: a sign for a letter, a sign for nothing, a run of a letter for one or for two.
SUBSTITUTE, DELETE, SHORTEN = math.log(0.3), math.log(0.05), math.log(0.5)
# Letters in the model beside a-z are one class; 0 is the limit of a word.
SYMBOLS = len(LETTERS) + 2
_NUMBER = {c: k + 1 for k, c in enumerate(LETTERS)}

_TOKEN = re.compile(r"\S+")
# Signs that may be letters at the front of a token, at its end when it is trimmed closely, and at its end otherwise.
_FRONT, _CLOSE, _END = "@$!|+(<€£¡", "@+€£", "@$!|+€£"
_GLUE = re.compile(r"(?:[^\w@$!|+(<€£¡]|_)+")
_MANY = re.compile(r"(.)\1{3,}", re.DOTALL)
_PLAIN = re.compile(r"[^\W\d_]+")
_DRAWN = re.compile(r"([^\W\d_])\1\1")
_RUN = re.compile(r"(?<!\S)(?:[^\W_]|[@$!])(?:[ .\-_*]{1,3}(?:[^\W_]|[@$!])){3,}(?!\S)")


class Model(NamedTuple):
    trigrams: np.ndarray  # log P(c | a, b), [a, b, c]
    words: frozenset[str]
    starts: frozenset[str]
    curve: np.ndarray


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Counts of three successive symbols in the texts' words, word limits included."""
    table = np.full(0x250, SYMBOLS - 1, dtype=np.int64)
    table[:0x80] = 0
    for c, k in _NUMBER.items():
        table[ord(c)] = table[ord(c.upper())] = k
    table[[0xA0, 0x85]] = 0
    code = np.frombuffer(("  ".join(["", *texts, ""])).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbol = table[np.minimum(code, 0x24F)]
    keep = np.ones(len(symbol), dtype=bool)
    keep[2:] = (symbol[2:] != 0) | (symbol[1:-1] != 0) | (symbol[:-2] != 0)  # two limits at most stand together
    symbol = symbol[keep]
    flat = (symbol[:-2] * SYMBOLS + symbol[1:-1]) * SYMBOLS + symbol[2:]
    return np.bincount(flat, minlength=SYMBOLS**3)


def log_trigrams(counts: np.ndarray) -> np.ndarray:
    """Trigram probabilities, smoothed by bigrams and those by single symbols."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5))


def language_model(docs: DataFrame, text: str) -> np.ndarray:
    """The trigram model of all texts; every task sends its counts of each trigram once per batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.zeros(SYMBOLS**3, dtype=np.int64)
            for part in pieces(batch, "_text", PIECE_BYTES):
                made += trigram_counts([x for x in part.column("_text").to_pylist() if x])
            seen = np.flatnonzero(made)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(made[seen], pa.int64())], ["g", "n"])

    rows = docs.select(F.col(text).alias("_text")).mapInArrow(count, "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for g, n in rows:  # at most SYMBOLS ** 3 of them
        counts[g] = n
    return log_trigrams(counts)


def decode(token: str, trigrams: np.ndarray) -> str:
    """The likeliest spelling of a written token, by Viterbi over its lattice; states are the last two letters."""
    steps: list[list[tuple[str, float]]] = []
    for found in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = found[1], len(found[0])
        if c.isalpha():
            readings = [(c, 0.0)] if n == 1 else [(c, SHORTEN * (n - 1) if n > 2 else SHORTEN), (c * 2, 0.0 if n == 2 else SHORTEN * (n - 2))]
        else:
            readings = [(x * k, SUBSTITUTE * k) for x in IMITATES.get(c, "") for k in range(1, min(n, 2) + 1)] + [("", DELETE)]
        steps.append(readings)
    last = SYMBOLS - 1
    # A path is its cost and its letters, linked backwards, so that the work is linear in the token's length.
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for readings in steps:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, made) in paths.items():
            for letters, channel in readings:
                x, y, total = a, b, cost + channel
                for c in letters:
                    z = _NUMBER.get(c, last)
                    total += trigrams[x, y, z]
                    x, y = y, z
                if (x, y) not in after or total > after[x, y][0]:
                    after[x, y] = (total, (made, letters) if letters else made)
        paths = after
    ends = [(cost + trigrams[a, b, 0], made) for (a, b), (cost, made) in paths.items()]
    best = max(cost for cost, _ in ends)
    return max(_spelled(made) for cost, made in ends if cost == best)


def _spelled(path: tuple | None) -> str:
    made = []
    while path is not None:
        path, letters = path
        made.append(letters)
    return "".join(reversed(made))


def _trimmed(token: str, front: str, end: str) -> str:
    """``token`` without the signs around it that are not named."""
    a, b = 0, len(token)
    while a < b and not (token[a].isalnum() or token[a] == "_" or token[a] in front):
        a += 1
    while a < b and not (token[b - 1].isalnum() or token[b - 1] == "_" or token[b - 1] in end):
        b -= 1
    return token[a:b]


def _word_readings(bare: str, token: str, trigrams: np.ndarray) -> tuple[str, ...]:
    if _PLAIN.fullmatch(bare):
        return (bare, decode(bare, trigrams)) if _DRAWN.search(bare) else (bare,)
    parts = _PLAIN.findall(bare)
    # Most of a disguised word is letters or their imitations, and some of it letters.
    if not parts or 2 * sum(c.isalpha() or c in IMITATES for c in bare) < len(bare):
        return tuple(parts)
    # Where signs stand among the letters, those at the end may be letters as well.
    light = _trimmed(token, _FRONT, _END)
    return (*parts, *{decode(bare, trigrams), decode(light, trigrams)})


def _shortened(token: str) -> tuple[str, str]:
    """A token with runs of a character cut to three, which read alike however long, and what is left without its edges."""
    token = _MANY.sub(r"\1\1\1", token)
    return token, _trimmed(token, _FRONT, _CLOSE)


def read_words(token: str, trigrams: np.ndarray) -> list[tuple[str, ...]]:
    """The readings of each word of a lower-case token: one word, or those between the signs of a long token.

    A word's readings are its own letters, and its restored spelling if it may be disguised.
    """
    token, bare = _shortened(token)
    if len(bare) <= LONGEST:
        return [_word_readings(bare, token, trigrams)] if bare else []
    return [_word_readings(part, part, trigrams) for part in _GLUE.split(bare) if 1 < len(part) <= LONGEST]


def readings(token: str, trigrams: np.ndarray) -> tuple[str, ...]:
    """All words a lower-case token may stand for."""
    return tuple(w for ways in read_words(token, trigrams) for w in ways)


def stretches(token: str, trigrams: np.ndarray) -> list[tuple[str, ...]]:
    """Readings of the stretches of a long token that are not words by themselves: long parts, and characters set apart."""
    bare = _shortened(token)[1]
    if len(bare) <= LONGEST:
        return []
    made, single = [], []
    for part in [*_GLUE.split(bare), ""]:
        if len(part) == 1:
            single.append(part)
            continue
        if len(single) > 3:
            made.append((decode("".join(single), trigrams),))
        single = []
        if len(part) > LONGEST:
            made.append(_word_readings(part, part, trigrams))
    return made


def spaced(text: str, trigrams: np.ndarray) -> list[str]:
    """Restored letters of every row of single characters, however long."""
    return [decode(re.sub(r"[ .\-_*]", "", found[0]), trigrams) for found in _RUN.finditer(text)]


def words_within(letters: str, words: frozenset[str], sizes: list[int]) -> int:
    """How many words of the lexicon stand in a row of letters, from the left, longest first, none over another."""
    n = at = 0
    while at < len(letters):
        size = next((k for k in sizes if at + k <= len(letters) and letters[at : at + k] in words), 0)
        n += size > 0
        at += size or 1
    return n


def _entries(word: str) -> list[str]:
    return [*([word] if len(word) <= LONGEST else []), *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def _count_entries(sample: DataFrame, trigrams) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for label, text in zip(batch.column("label").to_pylist(), batch.column("_text").to_pylist()):
                low, own = text.lower(), set()
                for token in set(_TOKEN.findall(low)):
                    own.update(readings(token, trigrams.value))
                own.update(spaced(low, trigrams.value))
                found[label].update({e for w in own if len(w) > 2 for e in _entries(w)})
            names = list(found[0].keys() | found[1].keys())
            counts = [pa.array([found[k][x] for x in names], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *counts], ["entry", "clean", "toxic"])

    rows = sample.select("label", "_text").mapInArrow(count, "entry string, clean long, toxic long")
    return rows.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def hits(texts: list[str | None], model: Model, known: dict[str, int]) -> np.ndarray:
    """Tokens of each whole text that read as lexicon entries. ``known`` keeps tokens' counts between calls."""
    made = np.zeros(len(texts))
    # Words of fewer than four letters are too common inside others.
    sizes = sorted({len(w) for w in model.words if len(w) >= 4}, reverse=True)
    for k, text in enumerate(texts):
        if not text:
            continue
        low, total = text.lower(), 0
        for token in low.split():
            n = known.get(token)
            if n is None:
                n = token_hits(token, model, sizes)
                if len(token) <= 2 * LONGEST:
                    if len(known) >= CACHE:
                        known.clear()
                    known[token] = n
            total += n
        # A row of single characters may hold several words.
        made[k] = total + sum(words_within(word, model.words, sizes) for word in spaced(low, model.trigrams))
    return made


def token_hits(token: str, model: Model, sizes: list[int]) -> int:
    """How many words of a token read as lexicon entries, those in its long stretches included."""

    def listed(w: str) -> bool:
        return w in model.words or not model.starts.isdisjoint(w[:p] for p in PREFIXES if len(w) >= p)

    total = sum(any(map(listed, ways)) for ways in read_words(token, model.trigrams))
    if len(token) > LONGEST:
        total += sum(max((words_within(w, model.words, sizes) for w in ways), default=0) for ways in stretches(token, model.trigrams))
    return total


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text") -> Model:
    """The corpus model, the lexicon and the curve. Without labels of both classes every score is the learning share."""
    trigrams = language_model(docs, text)
    usable = stored(labels_to_learn(labels, label, MODULUS, HELD, key), "labels")
    share = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    n0, n1 = share.get(0, 0), share.get(1, 0)
    none: frozenset[str] = frozenset()
    if not n0 or not n1:
        p = min(max((n1 + 0.5) / (n0 + n1 + 1), 0.01), 0.99)
        return Model(trigrams, none, none, np.array([0.0, math.log(p / (1 - p))]))
    shared = docs.sparkSession.sparkContext.broadcast(trigrams)
    sample = stored(with_texts(sample_ids(usable, {1: TOXIC_SAMPLE, 0: CLEAN_SAMPLE}), docs, key, text).repartition(12, "_doc"), "sample")
    size = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    t, c = size.get(1, 0) + 1e-9, size.get(0, 0) + 1e-9
    k, n, p = F.col("toxic"), F.col("toxic") + F.col("clean"), t / (t + c)
    other = F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - p)))).otherwise(0.0)
    evidence = k * F.log(F.when(k > 0, k) / (n * p)) + other
    found = (
        _count_entries(sample, shared)
        .withColumn("evidence", evidence)
        .where((F.col("evidence") >= EVIDENCE) & (k / t >= RATIO * (F.col("clean") / c)))
        .orderBy(F.desc("evidence"), "entry")
        .limit(LEXICON)
        .collect()
    )
    words = frozenset(r.entry for r in found if r.entry[0] != "^")
    starts = frozenset(r.entry[1:] for r in found if r.entry[0] == "^")
    model = Model(trigrams, words, starts, np.array([1.0, 0.0]))
    rows = scored(sample.withColumn("_held", F.lit(False)), model, "_doc", "_text", "label int", ["label"]).select("label", "n_hits").collect()
    x = np.array([r.n_hits for r in rows], dtype=float)
    y = np.array([r.label for r in rows], dtype=float)
    weight = np.where(y == 1, n1 / max(y.sum(), 1), n0 / max((1 - y).sum(), 1))
    return model._replace(curve=fit_logistic(np.log1p(x)[:, None], y, weight))


def scored(docs: DataFrame, model: Model, key: str, text: str, more: str = "", carry: list[str] | None = None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON and SYMBOLS ** 3
    carry = carry or []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            n = hits(batch.column("_text").to_pylist(), shared.value, known)
            p = logistic(np.log1p(n)[:, None], shared.value.curve)
            columns = [batch.column("_doc"), batch.column("_held"), pa.array(p), pa.array(p >= 0.5).cast(pa.int32()), pa.array(n, pa.int64())]
            names = [key, "held_out", "score", "predicted", "n_hits", *carry]
            yield pa.RecordBatch.from_arrays(columns + [batch.column(c) for c in carry], names)

    named = docs.select(F.col(key).alias("_doc"), "_held", F.col(text).alias("_text"), *carry)
    kind = dict(docs.dtypes)[key]
    extra = f", {more}" if more else ""
    return named.mapInArrow(work, f"`{key}` {kind}, held_out boolean, score double, predicted int, n_hits long{extra}")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``key``, ``held_out``, ``score`` (0 to 1), ``predicted`` and ``n_hits``.

    Whole texts are restored and scored, tokens and lines of any length too; null and empty texts have no hits. Every
    input row gives one row, and rows that share a key are scored one by one.
    """
    return scored(docs.withColumn("_held", held_out(F.col(key), MODULUS, HELD)), model, key, text)
