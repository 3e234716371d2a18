"""Tokenizer alignment against whole texts encoded at once and compared byte by byte."""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left
from collections import Counter

import pytest
from pyspark.sql import functions as F

from claimlens.llm import alignment

TEXTS = [
    "the quick brown fox",
    "the quick brown fox",
    "  leading, trailing and   inner spaces \n\n tabs\t\there  ",
    "line one\nline two\r\n\r\nline three \n",
    "don't we'll I'm 12345 3.14 -- <|endoftext|> </s> <s> <0x41> <unk>",
    "ÄÖ éé ñandú 東京都 日本 🙂 ½ Ω≈ç",
    "a▁b and more",
    "no break space \x1c control \x00 byte !\x85!",
    "\n",
    " ",
    "\t x",
    "x" * 5_000 + " " + "ab" * 700,
    "once upon a time " * 400,
    "",
    None,
    None,
    "Zalgo z̶̡͈a̸ text​ joined",
]


def brute(texts):
    path_a, path_b = alignment.default_paths()
    aligner = alignment.Aligner(path_a, path_b)
    vocabulary = json.load(open(path_a))["model"]["vocab"]
    byte = alignment.byte_level_table()
    entry = {k: bytes(byte[c] for c in e) for e, k in vocabulary.items()}
    made = []
    for text in texts:
        if not text:
            made.append(None)
            continue
        a = aligner.a.encode(" " + text, add_special_tokens=False).ids
        b = aligner.b.encode(text)

        def piece(k):
            p = aligner.b.id_to_piece(k)
            return bytes([int(p[3:5], 16)]) if aligner.b.is_byte(k) else p.replace("▁", " ").encode()

        whole = (" " + text).encode()
        if b"".join(entry[k] for k in a) != whole or b"".join(map(piece, b)) != whole:
            made.append(None)
            continue
        spans_a, spans_b = [], []
        for spans, ids, size in ((spans_a, a, lambda k: len(entry[k])), (spans_b, b, lambda k: len(piece(k)))):
            at = 0
            for k in ids:
                spans.append((at, at + size(k), k))
                at += size(k)
        cuts = sorted({e for _, e, _ in spans_a} & {e for _, e, _ in spans_b})
        held = [([], []) for _ in cuts]
        for side, spans in enumerate((spans_a, spans_b)):
            for _, e, k in spans:
                held[bisect_left(cuts, e)][side].append(str(k))
        groups = [f"{','.join(x)}|{','.join(y)}" for x, y in held]
        links, j = [], 0
        for s, e, k in spans_a:
            while spans_b[j][1] <= s:
                j += 1
            i = j
            while i < len(spans_b) and spans_b[i][0] < e:
                links.append((k, spans_b[i][2]))
                i += 1
        made.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    counts = Counter(pair for m in made if m for pair in set(m[3]))
    highest = Counter()
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    return [
        (m[0], m[1], m[2], len(m[3]), sum(counts[p] == highest[p[0]] for p in m[3]), sum(counts[p] for p in m[3]), m[4]) if m else (0, 0, 0, 0, 0, 0, "")
        for m in made
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k if k % 7 else None, t) for k, t in enumerate(TEXTS)]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return made.withColumns({c: F.lit("clash") for c in ("_key", "_text", "_digest", "copies", "a", "b", "times", "count", "best", "n_a")})


@pytest.mark.parametrize("most", [2**19, 40, 0])
def test_equals_whole_texts(docs, most):
    """However few pairs are held by all tasks, the others get their counts as well."""
    expected = sorted(((k if k % 7 else None, *row) for k, row in enumerate(brute(TEXTS))), key=str)
    found = alignment.align_tokenizers(docs, most=most)
    assert found.columns == ["doc_id", *alignment.MEASURES, "groups_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected


def test_given_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    expected = sorted((r.doc_id, *m) for r, m in zip(rows, brute([r.text for r in rows])))
    found = alignment.align_tokenizers(spark.read.parquet(f"{small}/documents.parquet"))
    assert sorted(tuple(r) for r in found.collect()) == expected


def test_empty_table(docs):
    assert alignment.align_tokenizers(docs.limit(0)).collect() == []


def test_few_stretches_are_kept(monkeypatch):
    """Texts align alike when the kept stretches are dropped again and again."""
    paths = alignment.default_paths()
    whole = alignment.Aligner(*paths).texts(TEXTS)
    monkeypatch.setattr(alignment, "MOST_STRETCHES", 2)
    small = alignment.Aligner(*paths)
    for t, w in zip(TEXTS, whole):
        (s,) = small.texts([t])
        assert (s is None) == (w is None)
        assert s is None or [(x.links, x.groups) for x in s] == [(x.links, x.groups) for x in w]
