"""Suffix arrays by Lyndon grouping, for many short texts side by side.

Every suffix starts with its longest Lyndon word, which ends where the next smaller suffix starts. Suffixes are
grouped by that word, and the order of the words is the order of the groups. Inside a group the suffixes are ordered
by the groups that the next-smaller pointers lead to, one after the other: a group's order follows from groups that
are final, and no suffix is ever renamed.

All steps work on arrays over all texts at once. A pointer is found from right to left: the candidate after a suffix
is passed over, along its own pointer, while it is the larger one, so that each text is gone through once. Groups are
formed by sorting words in stretches of SYMBOLS characters instead of by moving single suffixes between buckets.
"""

from __future__ import annotations

import numpy as np

# Characters of a comparison key: 9 bits each, 0 for the end of a text.
SYMBOLS = 7
_BITS = 9
_KEEP = np.array([0, *(((1 << _BITS * k) - 1) << _BITS * (SYMBOLS - k) for k in range(1, SYMBOLS + 1))], dtype=np.int64)
_LAST = np.int64((1 << _BITS) - 1)


class Texts:
    """Texts laid out in one array with ends between them, and the keys of their positions."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(size + SYMBOLS) - size - SYMBOLS
        self.ends = self.starts + size
        gap = bytes(SYMBOLS)
        raw = np.frombuffer(gap.join([*texts, gap]), dtype=np.uint8).astype(np.int64) + 1
        total = int(size.sum()) + SYMBOLS * len(texts)
        raw[total:] = 0
        for k in range(SYMBOLS):
            raw[self.ends + k] = 0
        self.size = total
        self.keys = np.zeros(total + SYMBOLS, dtype=np.int64)
        for k in range(SYMBOLS):
            self.keys[:total] |= raw[k : total + k] << (_BITS * (SYMBOLS - 1 - k))


def _larger(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the suffix at ``a`` is larger than that at ``b``; both in one text, so never equal."""
    x, y = keys[a], keys[b]
    made = x > y
    same = np.flatnonzero((x == y) & ((x & _LAST) != 0))
    at_a, at_b = a[same], b[same]
    while len(same):
        at_a, at_b = at_a + SYMBOLS, at_b + SYMBOLS
        x, y = keys[at_a], keys[at_b]
        made[same] = x > y
        more = (x == y) & ((x & _LAST) != 0)
        same, at_a, at_b = same[more], at_a[more], at_b[more]
    return made


def next_smaller(texts: Texts) -> np.ndarray:
    """For every position the start of the next smaller suffix of its text, or the text's end."""
    pointer = np.arange(texts.size + SYMBOLS, dtype=np.int64)
    size = texts.ends - texts.starts
    order = np.argsort(-size, kind="stable")
    ends, size = texts.ends[order], size[order]
    for step in range(1, int(size[0]) + 1 if len(size) else 0):
        at = ends[: int(np.searchsorted(-size, -step, "right"))] - step
        after = at + 1
        pointer[at] = after
        lanes, own = at, after
        while len(lanes):
            larger = _larger(texts.keys, own, lanes)
            lanes, own = lanes[larger], pointer[own[larger]]
            pointer[lanes] = own
    return pointer


def _refine(order: np.ndarray, group: np.ndarray, active: np.ndarray, key: np.ndarray) -> None:
    """Sort the places ``active`` of ``order`` (whole groups, in order) by ``key`` within their groups.

    ``group`` holds, by place, the first place of its group, and is brought up to date.
    """
    by = np.lexsort((key, group[active]))
    order[active] = order[active[by]]
    own, key = group[active], key[by]
    new = np.ones(len(active), dtype=bool)
    new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
    group[active] = active[np.maximum.accumulate(np.where(new, np.arange(len(active)), 0))]


def _tied(group: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Of ``places`` (whole groups), those in groups of two and more."""
    own = group[places]
    same = np.zeros(len(places) + 1, dtype=bool)
    same[1:-1] = own[1:] == own[:-1]
    return places[same[:-1] | same[1:]]


def lyndon_groups(texts: Texts, pointer: np.ndarray) -> np.ndarray:
    """The rank of every position's Lyndon word among all words; ends of texts have rank -1."""
    live = np.flatnonzero(texts.keys[: texts.size])
    length = pointer[live] - live
    word = texts.keys[live] & _KEEP[np.minimum(length, SYMBOLS)]
    by = np.argsort(word, kind="stable")
    order, word = by, word[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = word[1:] != word[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    done, places = SYMBOLS, np.arange(len(by))
    while True:
        places = _tied(group, places)
        # Words of a group that are all used up are equal; the used-up word of a mixed group sorts first by 0.
        left = length[order[places]] - done
        top = np.zeros(len(by), dtype=bool)
        top[group[places[left > 0]]] = True
        places = places[top[group[places]]]
        if not len(places):
            break
        at = order[places]
        left = np.clip(length[at] - done, 0, SYMBOLS)
        _refine(order, group, places, texts.keys[np.minimum(live[at] + done, texts.size)] & _KEEP[left])
        done += SYMBOLS
    rank = np.full(texts.size + SYMBOLS, -1, dtype=np.int64)
    rank[live[order]] = group
    return rank


def suffix_order(texts: Texts, positions: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``positions`` in the order of their suffixes, and for each whether it shares ``depth`` characters with the one before.

    The order is that of whole suffixes up to ties in the first ``depth`` characters.
    """
    pointer = next_smaller(texts)
    rank = lyndon_groups(texts, pointer)
    first = rank[positions]
    by = np.argsort(first, kind="stable")
    order, first = by, first[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = first[1:] != first[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    reach, places = pointer[positions], np.arange(len(by))
    while True:
        places = _tied(group, places)
        at = order[places]
        open_ = (reach[at] - positions[at] < depth) & (rank[reach[at]] >= 0)
        # Members of a group have the same words so far, so only the end of a text tells some of them apart.
        top = np.zeros(len(by), dtype=bool)
        top[group[places[open_]]] = True
        places = places[top[group[places]]]
        if not len(places):
            break
        _refine(order, group, places, rank[reach[order[places]]])
        at = order[places]
        reach[at] = np.where(rank[reach[at]] >= 0, pointer[reach[at]], reach[at])
    placed = positions[order]
    alike = np.zeros(len(placed), dtype=bool)
    if len(placed) > 1:
        alike[1:] = _share(texts.keys, placed[:-1], placed[1:], depth)
    return placed, alike


def _share(keys: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Whether two suffixes agree in their first ``depth`` characters."""
    same, at = np.arange(len(a)), 0
    while at < depth and len(same):
        keep = _KEEP[min(SYMBOLS, depth - at)]
        x, y = keys[np.minimum(a[same] + at, len(keys) - 1)] & keep, keys[np.minimum(b[same] + at, len(keys) - 1)] & keep
        low = np.int64((1 << _BITS) - 1) << (_BITS * (SYMBOLS - min(SYMBOLS, depth - at)))
        same = same[(x == y) & ((x & low) != 0)]
        at += SYMBOLS
    made = np.zeros(len(a), dtype=bool)
    made[same] = True
    return made
