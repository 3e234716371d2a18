"""Token ids of whole texts by a public byte-pair tokenizer file, each distinct word of a call encoded once.

The tokenizer drops white space and never joins what it separates, so texts are split at ASCII white space and every
distinct word is encoded by itself. Words of Latin letters are lowered and cut into the tokenizer's parts here, and a
faster encoder of the same entries takes many of them as one text; any other word, where Unicode rules of the two sides
could differ, goes to the tokenizer. Both ways give the same ids. No words are kept between calls: looking them up in a
large store takes longer than encoding them.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from claimlens.llm.alignment import byte_level_table

# Longer words are left to the tokenizer.
LONGEST = 100
# Words of one text.
JOINED = 5_000
# Control characters, unusual spaces, fractions and all beyond Latin Extended-B are left to the tokenizer.
_UNUSUAL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xb2\xb3\xb9\xbc-\xbeİɐ-\U0010ffff]")
# How the tokenizer changes and cuts texts, and what its pattern matches in the words cut here.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def _ranked(setup: dict):
    """An encoder of parts that merges by ids, a space ending each part, and whether an id ends a part.

    None twice if the file treats texts in another way, or if its merges are not in the order of the ids they make.
    """
    import tiktoken

    model, cuts = setup["model"], (setup.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    suffix, entries, byte = model.get("end_of_word_suffix"), model["vocab"], byte_level_table()
    if not suffix or cuts[0].get("pattern") != {"Regex": _PATTERN} or (setup.get("normalizer") or {}).get("normalizers") != _NORMAL:
        return None, None
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    single = {entries.get(c + end) for c in byte for end in ("", suffix)}
    if single != set(range(512)) or [entries.get(a + b) for a, b in merges] != list(range(512, len(entries))):
        return None, None
    ranks, closing = {}, np.zeros(2**16, dtype=bool)
    for entry, k in entries.items():
        closing[k] = entry.endswith(suffix)
        ranks[bytes(byte[c] for c in entry.removesuffix(suffix)) + b" " * int(closing[k])] = k
    return tiktoken.Encoding("parts", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}), closing


class Encoder:
    """Encodes texts into 16-bit ids by the tokenizer file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # A task has one core; threads of its own would only compete with other tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            self.ranked, self.closing = _ranked(json.load(file))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, words: list[str]) -> list[bytes]:
        """The ids of every word by the tokenizer itself."""
        return self._whole(words)

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ordinary words one after another, and how many are each word's."""
        words = [w.lower() for w in words]
        cut = [[w] if w.isalpha() else _PARTS.findall(w) for w in words]
        parts = list(chain.from_iterable(cut))
        ids = self.ranked.encode_to_numpy(" ".join([*parts, ""]), disallowed_special=()).astype(np.uint16)
        ends = np.concatenate(([0], np.flatnonzero(self.closing[ids]) + 1))
        if len(ends) != len(parts) + 1 or sum(map(len, parts)) != sum(map(len, words)):
            made = self._apart(words)
            return np.frombuffer(b"".join(made), np.uint16), np.array([len(x) // 2 for x in made], dtype=np.int64)
        return ids, np.diff(ends[np.cumsum([0, *map(len, cut)])])

    def _words(self, words: list[str]) -> pa.Array:
        """The ids of every word, as bytes."""
        rare = _UNUSUAL.search(" ".join(words)) or len(max(words, key=len, default="")) > LONGEST
        other = {k for k, w in enumerate(words) if len(w) > LONGEST or _UNUSUAL.search(w)} if rare else set()
        plain = [w for k, w in enumerate(words) if k not in other] if other else words
        rows = [self._joined(plain[at : at + JOINED]) for at in range(0, len(plain), JOINED)]
        ids = np.concatenate([np.zeros(0, np.uint16), *(ids for ids, _ in rows)])
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(2 * n for _, n in rows)]))
        made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(plain), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
        if not other:
            return made
        last = self._apart([words[k] for k in sorted(other)])
        order = np.concatenate((np.delete(np.arange(len(words)), sorted(other)), sorted(other)))
        return pa.concat_arrays([made, pa.array(last, pa.large_binary())]).take(pa.array(np.argsort(order)))

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """The ids of every text; none for a null or empty one."""
        if self.closing is None:
            texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
            return [np.frombuffer(x, np.uint16) for x in self._whole([t or "" for t in texts])]
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.large_string())
        if not len(texts):
            return []
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = split.flatten().dictionary_encode()
        made = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist()).take(coded.indices)
        ends, ids = np.frombuffer(made.buffers()[1], np.int64), np.frombuffer(made.buffers()[2], np.uint16)
        limits = (ends[split.offsets.to_numpy()] // 2).tolist()
        return [ids[a:b] for a, b in zip(limits, limits[1:])]
