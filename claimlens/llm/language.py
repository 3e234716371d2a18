"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A forward and a backward recurrent layer read the bytes; at every position both states together give the
probabilities of the languages, and a document's probabilities are the mean over its positions. The state starts
anew every WINDOW bytes, so that all windows of a batch advance side by side, however long a text is. The network
is trained by backpropagation through time on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimlens.llm import words as W
from claimlens.llm.labelled import held_out, spread_parts, with_texts
from claimlens.llm.tables import pieces, stored, without_keys

UNKNOWN = "und"
HIDDEN = 8
WINDOW = 96
# The network learns from at most so many documents of each language, and of each from at most PARTS stretches of
# WINDOW characters, spaced over the whole text. Where there are many languages, each has an even share of SAMPLE, though
# at least LEAST_EACH documents.
PER_LANGUAGE, SAMPLE, LEAST_EACH = 600, 60_000, 20
PARTS = 6
STEPS, LANES, RATE = 260, 192, 0.02
# Windows that every language is trained with at least; many languages take more steps.
LEAST_WINDOWS = 1_000
MODULUS, HELD = 4, 2
PIECE_BYTES = 1_000_000
# The most languages a network learns, the most frequent ones; there are fewer codes of languages than that.
LANGUAGES = 8_000
SALTS = 256


class Net(NamedTuple):
    """Per direction: input tables (256, 3H), recurrent weights (H, 3H), recurrent bias; then the output layer."""

    table: np.ndarray
    recurrent: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    names: list[str]


def new_net(names: list[str], seed: int = 7) -> Net:
    rng = np.random.default_rng(seed)
    h, n = HIDDEN, len(names)
    shapes = [(2, 256, 3 * h), (2, h, 3 * h), (2, 3 * h), (2 * h, n), (n,)]
    scales = [0.5, 0.4, 0.0, 0.3, 0.0]
    return Net(*[(rng.standard_normal(s) * k).astype(np.float32) for s, k in zip(shapes, scales)], names)


def _run(net: Net, way: int, x: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, H, lanes) of one direction over bytes ``x`` (T, lanes); dead positions pass the state on.

    A gate is a logistic function, written as (1 + tanh(half)) / 2. Lanes lie innermost, so that every step works
    on long contiguous rows.
    """
    h, (steps, lanes) = HIDDEN, x.shape
    states = np.empty((steps, h, lanes), dtype=net.table.dtype)
    state = np.zeros((h, lanes), dtype=net.table.dtype)
    table, recurrent, bias = net.table[way], np.ascontiguousarray(net.recurrent[way].T), net.bias[way][:, None]
    half = table.dtype.type(0.5)
    whole = live.all(axis=1)
    for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
        given = np.ascontiguousarray(table[x[t]].T)
        back = recurrent @ state
        back += bias
        gates = given[: 2 * h] + back[: 2 * h]
        gates *= half
        np.tanh(gates, out=gates)
        gates += 1
        gates *= half
        reset, update = gates[:h], gates[h:]
        fresh = reset * back[2 * h :]
        fresh += given[2 * h :]
        np.tanh(fresh, out=fresh)
        after = state - fresh
        after *= update
        after += fresh
        if not whole[t]:
            after = np.where(live[t], after, state)
        if keep is not None:
            keep.append((t, state, back, gates, fresh))
        states[t] = state = after
    return states


def _softmax(z: np.ndarray) -> np.ndarray:
    """Over the last axis but one."""
    z = np.exp(z - z.max(axis=-2, keepdims=True))
    z /= z.sum(axis=-2, keepdims=True)
    return z


def pooled(net: Net, x: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Sums (languages, lanes) of the language probabilities at all live positions."""
    h = HIDDEN
    ahead, behind = _run(net, 0, x, live), _run(net, 1, x, live)
    one, two, bias = np.ascontiguousarray(net.out[:h].T), np.ascontiguousarray(net.out[h:].T), net.out_bias[:, None]
    sums = np.zeros((len(net.names), x.shape[1]))
    for t in range(len(x)):
        sums += _softmax(one @ ahead[t] + two @ behind[t] + bias) * live[t]
    return sums


def gradients(net: Net, x: np.ndarray, live: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all live positions, and its gradients by backpropagation through time."""
    h = HIDDEN
    kept: tuple[list, list] = ([], [])
    both = np.concatenate([_run(net, way, x, live, kept[way]) for way in (0, 1)], axis=1)
    p = _softmax(net.out.T @ both + net.out_bias[:, None])
    steps, lanes = x.shape
    total = max(int(live.sum()), 1)
    at = np.arange(lanes)
    loss = -float((np.log(p[:, label, at] + 1e-9) * live).sum()) / total
    d = p
    d[:, label, at] -= 1
    d *= (live / d.dtype.type(total))[:, None, :]
    made = [np.zeros_like(a) for a in net[:5]]
    made[3] = np.einsum("thl,tkl->hk", both, d, optimize=True)
    made[4] = d.sum(axis=(0, 2))
    down = net.out @ d
    order = np.argsort(x.ravel(), kind="stable")
    used, starts = np.unique(x.ravel()[order], return_index=True)
    for way in (0, 1):
        later = np.zeros((h, lanes), dtype=d.dtype)
        inputs = np.zeros((steps, 3 * h, lanes), dtype=d.dtype)
        for t, state, back, gates, fresh in reversed(kept[way]):
            grad = down[t, way * h : (way + 1) * h] + later
            reset, update = gates[:h], gates[h:]
            g = np.where(live[t], grad, 0)
            d_fresh = g * (1 - update) * (1 - fresh * fresh)
            d_update = g * (state - fresh) * update * (1 - update)
            d_reset = d_fresh * back[2 * h :] * reset * (1 - reset)
            inputs[t] = np.concatenate((d_reset, d_update, d_fresh))
            d_back = np.concatenate((d_reset, d_update, d_fresh * reset))
            made[1][way] += state @ d_back.T
            made[2][way] += d_back.sum(axis=1)
            later = np.where(live[t], g * update, grad) + net.recurrent[way] @ d_back
        rows = inputs.transpose(0, 2, 1).reshape(-1, 3 * h)[order]
        made[0][way][used] = np.add.reduceat(rows, starts, axis=0)
    return loss, made


def train(windows: np.ndarray, live: np.ndarray, label: np.ndarray, names: list[str], steps: int = STEPS, seed: int = 7) -> Net:
    """A network fitted by Adam on random windows (bytes, rows by window), as many of each language.

    Languages take their turns over the lanes of all steps. There are ``steps`` of these, or more until every language
    has had LEAST_WINDOWS.
    """
    steps = max(steps, -(-len(names) * LEAST_WINDOWS // LANES))
    net, rng = new_net(names, seed), np.random.default_rng(seed)
    by = [np.flatnonzero(label == k) for k in range(len(names))]
    first = [np.zeros_like(a) for a in net[:5]]
    second = [np.zeros_like(a) for a in net[:5]]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by[k % len(names)]) for k in range((step - 1) * LANES, step * LANES)])
        _, grads = gradients(net, windows[pick].T.copy(), live[pick].T.copy(), label[pick])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for a, g, m, v in zip(net[:5], grads, first, second):
            g = g / max(1.0, size)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def cut_windows(raw: np.ndarray, offsets: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (rows, width) of all texts, which positions are live, and each window's text number."""
    count = -(-np.diff(offsets) // width)
    text = np.repeat(np.arange(len(count)), count)
    at = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * width
    size = np.minimum(offsets[1:][text] - at, width)
    places = at[:, None] + np.arange(width)
    live = np.arange(width) < size[:, None]
    return np.where(live, raw[np.minimum(places, max(len(raw) - 1, 0))], 0).astype(np.uint8) if len(text) else np.zeros((0, width), np.uint8), live, text


def document_probabilities(column: pa.Array, net: Net) -> np.ndarray:
    """Mean probabilities over every byte of each text; all zero for an empty one."""
    raw, offsets = W.text_bytes(column)
    windows, live, text = cut_windows(raw, offsets)
    sums = np.zeros((len(column), len(net.names)))
    lanes = 4_096
    # Whole windows first: then only the last slices have dead positions.
    order = np.argsort(~live[:, -1], kind="stable")
    for at in range(0, len(order), lanes):
        own = order[at : at + lanes]
        alive = np.ascontiguousarray(live[own].T)
        np.add.at(sums, text[own], pooled(net, np.ascontiguousarray(windows[own].T), alive).T)
    return sums / np.maximum(np.diff(offsets), 1)[:, None]


def sample_languages(usable: DataFrame, names: list[str]) -> DataFrame:
    """``_doc`` and ``label`` of as many documents of each language, those of least hash, each document once.

    The least ones of each salt are found first, so a frequent language does not gather in one task.
    """
    each = min(PER_LANGUAGE, max(LEAST_EACH, SAMPLE // len(names)))
    chance = F.xxhash64("_doc")
    known = usable.where(F.col("label").isin(names)) if len(names) >= LANGUAGES else usable
    near = known.withColumn("_salt", F.pmod(F.hash("_doc"), F.lit(SALTS)))
    for by in (Window.partitionBy("_salt", "label"), Window.partitionBy("label")):
        near = near.withColumn("_rank", F.row_number().over(by.orderBy(chance, "_doc"))).where(F.col("_rank") <= each)
    return near.select("_doc", "label").dropDuplicates(["_doc"])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Net:
    """A network trained on documents of known language outside the held-out part; of no language where none is known."""
    named = docs.select(F.col(key).alias("_doc"), F.col(lang).alias("label")).where("_doc is not null and label is not null")
    usable = stored(named.where(~held_out(F.col("_doc"), MODULUS, HELD)), "languages")
    names = sorted(r.label for r in usable.groupBy("label").count().orderBy(F.desc("count"), "label").limit(LANGUAGES).collect())
    if not names:
        return new_net([])
    ids = sample_languages(usable, names)
    rows = with_texts(ids, docs, key, text).select("_doc", "label", spread_parts(F.col("_text"), PARTS, WINDOW).alias("parts")).collect()
    pairs = sorted((r._doc, part, r.label) for r in rows for part in r.parts if part)
    raw, offsets = W.text_bytes(pa.array([part for _, part, _ in pairs], pa.string()))
    windows, live, owner = cut_windows(raw, offsets)
    number = {name: k for k, name in enumerate(names)}
    label = np.array([number[pairs[k][2]] for k in owner], dtype=np.int64)
    known = np.unique(label)
    if len(known) < len(names):  # a language whose texts are all empty teaches nothing
        names, label = [names[k] for k in known], np.searchsorted(known, label)
    return train(windows, live, label, names) if len(names) else new_net([])


def predict(docs: DataFrame, net: Net, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``key``, ``held_out``, ``lang_pred`` and ``score``, the mean probability of the predicted language.

    A null text, one without a letter, or any text under a network that knows no language is ``und`` with score 0.
    Every other text gets a learned language, by all its bytes. Every input row gives one row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some tens of KB, by the number of languages

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(shared.value.names, dtype=object)
        for batch in batches:
            for part in pieces(batch, "_text", PIECE_BYTES):
                best, p = np.full(part.num_rows, UNKNOWN, dtype=object), np.zeros(part.num_rows)
                if len(names):
                    made = document_probabilities(part.column("_text"), shared.value)
                    lettered = np.asarray(part.column("_lettered").to_pylist(), dtype=bool)
                    best = np.where(lettered, names[made.argmax(axis=1)], UNKNOWN)
                    p = np.where(lettered, np.minimum(made.max(axis=1), 1.0), 0.0)
                columns = [part.column("_doc"), part.column("held_out"), pa.array(best, pa.string()), pa.array(p, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, [key, "held_out", "lang_pred", "score"])

    named = docs.select(
        F.col(key).alias("_doc"),
        held_out(F.col(key), MODULUS, HELD).alias("held_out"),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_lettered"),
        F.col(text).alias("_text"),
    )
    return named.mapInArrow(work, f"`{key}` {dict(docs.dtypes)[key]}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, net: Net, key: str = "doc_id", text: str = "text", least: float = 0.3) -> DataFrame:
    """The documents with a recognised language: not ``und``, and of a mean probability of at least ``least``.

    Where the network knows so many languages that 1.2 times an even chance is less than ``least``, that suffices.
    Rejection is by key, so rows that share a key go only if all of them are rejected.
    """
    least = min(least, 1.2 / max(len(net.names), 1))
    judged = predict(docs, net, key, text)
    kept = ((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).cast("int")
    gone = judged.groupBy(key).agg(F.max(kept).alias("_kept")).where("_kept = 0").select(key)
    return without_keys(docs, gone, [F.col(key)])
