"""The text operators against brute force on small tables, and on nulls, empty and odd input."""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from claimlens.llm import (
    components,
    decontamination,
    fingerprints,
    language,
    line_dedup,
    near_dedup,
    packing,
    quality,
    substring_dedup,
    suffix_array,
    tokens,
    toxicity,
    url_filters,
)
from claimlens.llm.queries import QUERIES, URL_RULES
from claimlens.llm.tables import table

WORDS = "the of and tion ere ing thousand river stone quiet lamp over under north glass seven".split()
# Names that the operators use inside.
CLASHING = ["_doc", "_sig", "_text", "_gone", "_key", "_best", "_new", "n_removed", "hits", "rule", "host", "kept", "score", "doc", "at", "node"]


def passage(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[k] + str(rng.integers(0, 40)) for k in rng.integers(0, len(WORDS), n))


BASE = passage(1, 120)
ODD = [
    (1, BASE),
    (2, BASE),
    (3, BASE.replace("stone", "stome", 1)),
    (4, None),
    (5, ""),
    (6, "   \n\t "),
    (7, "one"),
    (8, "one"),
    (9, "a" * 3_000),
    (10, passage(2, 60) + "\n" + passage(3, 30) + "\n" + passage(4, 30) + "\n" + passage(5, 30)),
    (11, "x\n" + passage(3, 30) + "\n" + passage(4, 30) + "\n" + passage(5, 30) + "\ny"),
    (12, "ÄÖ éé ñandú 東京 \x00 \u2028 ½ <|endoftext|> don't"),
    (13, passage(6, 6_000)),
    (14, "12 34 !!"),
    (15, "line\n" * 9 + "end"),
    (2, BASE),
    (None, passage(7, 50)),
    (None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en" if n % 2 else None, f"s{n}", len(t or "")) for n, (k, t) in enumerate(ODD)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name in CLASHING:
        made = made.withColumn(name, F.lit("clash"))
    return made


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def by_id(rows):
    return {r.doc_id: r for r in rows}


# Suffix arrays and repeated strings


def test_suffix_order_is_that_of_the_suffixes():
    rng = np.random.default_rng(5)
    for trial in range(60):
        letters = [1, 2, 3, 26][trial % 4]
        texts = [bytes(rng.integers(0, letters, rng.integers(0, 60)).astype(np.uint8) + 97 * (trial % 2)) for _ in range(5)]
        laid = suffix_array.Texts([*texts, texts[0] * 2])
        held = {}
        for start, text in zip(laid.starts.tolist(), [*texts, texts[0] * 2]):
            held.update({start + k: text[k:] for k in range(len(text))})
        for depth in (5, 40):
            order, alike = suffix_array.suffix_order(laid, np.array(sorted(held), dtype=np.int64), depth)
            made = [held[k] for k in order.tolist()]
            for a, b, same in zip(made, made[1:], alike[1:]):
                assert a[:depth] <= b[:depth]
                assert bool(same) == (len(a) >= depth and a[:depth] == b[:depth])


def brute_removal(docs):
    """Spans and kept bytes by a set of all strings, in order of keys."""
    seen, made = set(), {}
    for key, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(raw[s : s + 100])
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        made[key] = (len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return made


def test_substring_dedup_equals_brute_force(spark, odd):
    got = substring_dedup.remove_repeats(odd).collect()
    assert len(got) == len(ODD)
    # Two rows share a null key; the one without text changes nothing.
    order = sorted(((k, t) for k, t in {(k, t) for k, t in ODD} if t is not None or k is not None), key=lambda x: (x[0] is not None, x[0] or 0))
    want = brute_removal(order)
    for r in got:
        if r.doc_id is None and not r.n_bytes:
            assert r.n_removed == 0
        else:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id]
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
            assert sum(s.high - s.low for s in r.spans) == r.n_removed


def test_substring_dedup_of_hot_and_periodic_text(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SAMPLE", 1)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 5)
    monkeypatch.setattr(substring_dedup, "MANY", 5)
    common = passage(9, 30)
    rows = [(k, passage(100 + k, 8 + k % 5) + " " + common + " " + passage(200 + k, 9)) for k in range(40)]
    rows += [(50, "ab" * 400), (51, "ab" * 90 + passage(300, 20)), (52, passage(301, 20) * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute_removal(rows)


def test_runs_are_cut_only_where_their_anchor_recurs():
    raw = np.frombuffer(passage(77, 4_000).encode(), np.uint8)
    anchor, first, count, again, _ = substring_dedup.runs(raw)
    assert count.sum() == len(raw) - 99 and (first == np.cumsum(count) - count).all()
    assert count.max() == 69 and not again[count == 69].any()
    assert substring_dedup.RUN < 128
    assert substring_dedup.runs(np.frombuffer(b"ab" * 400, np.uint8))[3].all()


def test_parts_of_crowded_contexts_hold_each_window_once():
    common = passage(9, 12).encode()
    texts = [passage(400 + k, 4 + k % 3).encode() + common + passage(500 + k, 3).encode() for k in range(20)]
    parts = list(substring_dedup.parts_of([(7, k, 1_000 * k, t) for k, t in enumerate(texts)]))
    shards, held = {}, []
    for shard, doc, at, context in parts:
        for s in range(len(context) - 99):
            held.append((doc, at - 1_000 * doc + s, context[s : s + 100]))
            shards.setdefault(context[s : s + 100], set()).add(shard)
    assert sorted(held) == sorted((k, s, t[s : s + 100]) for k, t in enumerate(texts) for s in range(len(t) - 99))
    assert all(len(s) == 1 for s in shards.values())
    assert len(parts) < len(held) / 3
    assert list(substring_dedup.parts_of([])) == []


def test_substring_dedup_query_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents", "doc_id", "text").orderBy("doc_id").collect()]
    got = QUERIES["op1_suffix_array_dedup"](spark, small).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_removal(docs)


# Line windows


def brute_lines(docs):
    seen, made = set(), {}
    for key, text in docs:
        lines = (text or "").split("\n")
        gone = set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        made[key] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return made


def test_line_dedup_equals_brute_force(odd):
    got = line_dedup.drop_repeated_lines(odd).collect()
    assert len(got) == len(ODD)
    want = brute_lines(sorted({(k, t) for k, t in ODD if k is not None and t is not None}))
    for r in got:
        if r.doc_id is not None and r.text is not None:
            assert (r.text, r.n_removed) == want[r.doc_id]
        assert r._sig == "clash" and r.hits == "clash"
    assert by_id(got)[4].text is None and by_id(got)[4].n_lines == 0
    assert by_id(got)[11].text == "x\ny"


# Near duplicates


def shingles(text, width):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k : k + width]) for k in range(max(len(words) - width + 1, min(len(words), 1)))}


def brute_components(docs, width):
    sets = {k: shingles(t, width) for k, t in docs}
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                label[high] = low
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup_equals_brute_force(odd, width):
    got = near_dedup.near_duplicates(odd, width=width).collect()
    want = brute_components({(k, t) for k, t in ODD if k is not None}, width)
    assert len(got) == len(ODD)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.component_id == r.doc_id)


def test_components_of_few_links_make_few_files(spark, monkeypatch):
    names = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    parts, full = [], components.checkpointed

    def counted(df):
        made = full(df)
        parts.append(made.rdd.getNumPartitions())
        return made

    monkeypatch.setattr(components, "checkpointed", counted)
    for k, v in names.items():
        spark.conf.set(k, v)
    found = components.components(spark.range(1, 60).select((F.col("id") * 2).alias("u"), (F.col("id") * 2 + 2).alias("v")))
    assert {r.node: r.component for r in found.collect()} == {k: 2 for k in range(4, 122, 2)}
    assert len(parts) > 4 and max(parts[1:]) <= components.LEAST_PARTS
    for k, v in before.items():
        spark.conf.set(k, v)


def test_near_dedup_moves_the_texts_it_asks_for(spark, monkeypatch):
    """Few others pass, rows of one key pass together, and with few bits all asked ones still pass."""
    rows = spark.range(40_000).select((F.col("id") % 20_000).alias("_doc"), F.lit("x").alias("_text"))
    rows = rows.union(spark.createDataFrame([(None, "n")], "_doc long, _text string"))
    asked = spark.range(0, 20_000, 100).withColumnRenamed("id", "_doc")
    for most in (near_dedup.MOST_BITS, 64):
        monkeypatch.setattr(near_dedup, "MOST_BITS", most)
        got = near_dedup.marked(rows, asked)
        assert got.columns == ["_doc", "_text"] and got.join(asked, "_doc").count() == 400
    monkeypatch.undo()
    assert near_dedup.marked(rows, asked).count() < 3_000
    assert near_dedup.marked(rows, asked.limit(0)).count() == 0


def test_near_dedup_reads_only_the_texts_of_candidates(spark, monkeypatch):
    seen, full = [], near_dedup.shingle_blobs

    def counted(texts, width):
        plan = texts._jdf.queryExecution().optimizedPlan().toString()
        seen.append("bitmap_construct_agg" in plan or "_bits" in plan)
        return full(texts, width)

    monkeypatch.setattr(near_dedup, "shingle_blobs", counted)
    docs = spark.createDataFrame([(k, passage(k, 30)) for k in range(20)] + [(20, passage(3, 30) + " end")], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert found == {**{k: k for k in range(20)}, 20: 3} and seen == [True]


def test_near_dedup_of_chains_and_large_groups(spark):
    words = passage(11, 200).split()
    # Each text differs a little from the one before, far ends not being alike; and many copies of another text.
    rows = [(100 + k, " ".join(words[4 * k : 4 * k + 60])) for k in range(30)]
    rows += [(1_000 + k, passage(12, 80) + f" end{k % 40}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=4).collect()}
    assert got == brute_components(rows, 4)


def composed(strangers: int, seed: int):
    """A near pair of 240 words, and strangers that hold 105 of these each and come before both in order of keys."""
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"w{k}" for k in rng.integers(0, 10**12, n)]
    own = fresh(240)
    rows = [(k, " ".join([own[x] for x in rng.permutation(240)[:105]] + fresh(135))) for k in range(strangers)]
    return rows + [(10**6, " ".join(own)), (10**6 + 1, " ".join(own[:220] + fresh(20)))]


def test_near_copies_that_share_all_their_buckets_with_strangers(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "MEETING", 100, raising=False)
    rows = composed(700, 28)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=1).collect()}
    number: dict[tuple, int] = {}
    sets = {k: {number.setdefault(x, len(number)) for x in shingles(t, 1)} for k, t in rows}
    alike = [(a, b) for a, b in combinations(sorted(sets), 2) if 180 * len(sets[a] & sets[b]) >= 80 * (len(sets[a]) + len(sets[b]))]
    assert alike == [(10**6, 10**6 + 1)]
    assert got == {k: (len(x), 10**6 if k == 10**6 + 1 else k) for k, x in sets.items()}


def test_every_coordinate_of_a_sketch_fills():
    rng = np.random.default_rng(3)
    sizes = [1, 2, 5, 60, 900]
    hashes = rng.integers(0, 2**63, sum(sizes), dtype=np.uint64)
    made = near_dedup.sketches(hashes, np.repeat(np.arange(5), sizes), 5)
    assert (made != 2**64 - 1).all()
    one, two = hashes[-900:], np.concatenate((hashes[-600:], rng.integers(0, 2**63, 300, dtype=np.uint64)))
    a, b = (near_dedup.sketches(x, np.zeros(900, np.int64), 1)[0] for x in (one, two))
    assert abs((a == b).mean() - 0.5) < 0.17


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 500: 400}


# Decontamination


def brute_hits(docs, tests):
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+").findall
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    windows: dict[tuple, set] = {}
    for item, text in tests:
        words = find(low(text))
        for k in range(max(len(words) - 9, min(1, len(words)))):
            windows.setdefault(tuple(words[k : k + 10]), set()).add(str(item))
    made = {}
    for key, text in docs:
        words, hit, items = find(low(text)), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                found = windows.get(tuple(words[k : k + n]))
                if found:
                    hit |= set(range(k, k + n))
                    items |= found
        made[key] = (len(words), len(hit), sorted(items))
    return made


TESTS = [(1, passage(13, 25)), (2, "Quiet lamp7"), (3, None), (4, ""), (10, passage(14, 10)), (10, passage(1, 14)), (11, "one")]


@pytest.mark.parametrize("block", [8_000_000, 60])
def test_decontamination_equals_brute_force(spark, odd, block):
    tests = spark.createDataFrame(TESTS, "item_id int, text string")
    got = decontamination.occurrences(odd, tests, block_bytes=block).collect()
    assert Counter(r.doc_id for r in got) == Counter(k for k, _ in ODD)
    twice = decontamination.occurrences(odd.union(odd), tests, block_bytes=block).collect()
    assert Counter((r.doc_id, r.n_hit) for r in twice) == Counter({k: 2 * n for k, n in Counter((r.doc_id, r.n_hit) for r in got).items()})
    want = brute_hits([(k, t) for k, t in ODD if k is not None], TESTS)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_hit, r["items"]) == want[r.doc_id]
    kept = decontamination.drop_contaminated(odd, tests, block_bytes=block)
    assert kept.columns == odd.columns
    bad = {k for k, v in want.items() if v[1]}
    assert bad and {r.doc_id for r in kept.collect()} == {k for k, _ in ODD} - bad


def test_decontamination_query_equals_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents", "doc_id", "text").collect()]
    tests = [(r.item_id, r.text) for r in table(spark, small, "benchmark", "item_id", "text").collect()]
    want = brute_hits(docs, tests)
    for r in QUERIES["op7_benchmark_decontamination"](spark, small).collect():
        words, hit, items = want[r.doc_id]
        digest = hashlib.sha256(",".join(items).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (words, hit, len(items), digest, hit > 0)


# Fingerprints


def test_fingerprints_follow_the_key_order(odd):
    got = fingerprints.fingerprints(odd).collect()
    assert len(got) == len(ODD)
    own = {k: t or "" for k, t in ODD if k is not None}
    keys = sorted(own, reverse=True)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.doc_id in (None, 2, 1):  # neighbours with rows that share a key are checked by their likeness
            continue
        after = own[keys[keys.index(r.doc_id) + 1]]
        assert r.edited_sha256 == hashlib.sha256(fingerprints.edited(own[r.doc_id], after).encode()).hexdigest()
        assert r.n_chars == len(own[r.doc_id])
    prints = by_id(got)
    assert prints[1].fingerprint == prints[2].fingerprint and prints[7].fingerprint == prints[8].fingerprint
    assert prints[8].near_next == 1.0 and prints[4].fingerprint == prints[5].fingerprint


def test_the_last_document_is_followed_by_the_first(spark):
    texts = {k: passage(400 + k, 30 + k) for k in range(50)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(7)
    for r in fingerprints.fingerprints(docs).collect():
        after = texts[r.doc_id - 1 if r.doc_id else 49]
        assert r.edited_sha256 == hashlib.sha256(fingerprints.edited(texts[r.doc_id], after).encode()).hexdigest()
    one = spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")
    assert fingerprints.fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_fingerprints_estimate_weighted_jaccard():
    texts = [passage(k, 300) for k in range(12)]
    others = [" ".join(t.split()[: 20 * k + 40]) for k, t in enumerate(texts)]
    got = fingerprints.likeness(fingerprints.samples_of(texts), fingerprints.samples_of(others))
    a, b = [Counter(t.split()) for t in texts], [Counter(t.split()) for t in others]
    want = [sum((x & y).values()) / sum((x | y).values()) for x, y in zip(a, b)]
    assert np.abs(got - want).max() < 0.17 and np.corrcoef(got, want)[0, 1] > 0.9


def test_fingerprints_of_long_vocabularies(monkeypatch):
    one, two, shared = (" ".join(f"{c}{k}" for k in range(100_000)) for c in "abc")
    prints = fingerprints.samples_of([one, two, one + " " + shared, two + " " + shared, one])
    assert fingerprints.likeness(prints[0], prints[1]) < 0.05
    assert abs(fingerprints.likeness(prints[2], prints[3]) - 1 / 3) < 0.17 and (prints[0] == prints[4]).all()
    # Neither the neighbours nor what the cache holds matters.
    texts = [passage(k, 300) for k in range(6)] + [one[:60_000] + " " + one[:30_000], ""]
    together = fingerprints.samples_of(texts)
    monkeypatch.setattr(fingerprints, "BLOCK", 50)
    monkeypatch.setattr(fingerprints, "kept", lambda name, make: make())
    assert all((fingerprints.samples_of([t])[0] == together[k]).all() for k, t in enumerate(texts))


# Packing


def test_new_words_are_encoded_many_to_a_text(monkeypatch):
    """Without threads of the tokenizer's own, and with the ids that it gives each word by itself."""
    import public_tokenizers

    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    encoder, calls = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    rng = np.random.default_rng(3)
    odd = ["".join(map(chr, row)).lower() for row in rng.integers(0x21, 0x250, (3_000, 5))]
    words = [w for w in odd if not tokens._UNUSUAL.search(w)] + "don't we'll 's ''s a_b _'re 12ab3 ª ñandú's <|endoftext|> x.y,z".split()
    want = [encoder.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    full = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda texts: (calls.append(len(texts)), full(texts))[1])
    assert [x.tolist() for x in encoder.encode(words)] == want
    assert sum(calls) <= 2 * len(words) / tokens.JOINED
    # A file that closes no words is asked word by word.
    encoder.closing = None
    assert [np.frombuffer(x, np.uint16).tolist() for x in encoder._apart(words)] == want


def test_encoder_equals_the_tokenizer():
    import public_tokenizers

    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t for _, t in ODD] + ["''s it's 'S x_y 1²", "Ωσς İ ŉ ǅ \xa0 \x1c", "a" * 200 + " b"]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from the store
        assert [x.tolist() for x in encoder.encode(texts)] == want


def test_ordinary_words_go_to_the_faster_encoder(monkeypatch):
    """The tokenizer itself gets each unusual or long word once, and nothing else of its text."""
    import public_tokenizers

    encoder, asked = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json")), []
    rng = np.random.default_rng(4)
    odd = ["".join(map(chr, row)) for row in rng.integers(0x21, 0x250, (2_000, 6))]
    usual = [w for w in odd if not tokens._UNUSUAL.search(w)] + [e.removesuffix("</w>") for e in encoder.tokenizer.get_vocab() if e.isascii()]
    rare = ["ΟΔΟΣ", "a\xa0b", "“Stone”", "東京", "e\u0301", "x" * 101]
    texts = [" ".join(usual), "river\x0b Stone\r\n" + " \t".join(rare), None, " ", "stone " + rare[2] + "\u2028river", rare[0]]
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    full = encoder._whole
    monkeypatch.setattr(encoder, "_whole", lambda words: (asked.extend(words), full(words))[1])
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert sorted(asked) == sorted([*rare, rare[2] + "\u2028river"])
    assert [x.tolist() for x in encoder.encode(pa.array(["?", *texts])[1:])] == want


def test_a_tokenizer_of_another_kind_gets_whole_texts(tmp_path):
    import json

    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        setup = json.load(file)
    setup["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(setup))
    encoder = tokens.Encoder(str(tmp_path / "cased.json"))
    assert encoder.encode(["River STONE"])[0].tolist() == encoder.tokenizer.encode("River STONE", add_special_tokens=False).ids


def check_pieces(rows, texts):
    """Every id of every row once, sequences gapless and full or a power of two."""
    import public_tokenizers

    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for key, text in texts:
        want[key] += len(encoder.encode([text])[0]) + 1
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == want
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    padded = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == packing.WINDOW or at & (at - 1) == 0
        padded += packing.WINDOW - at if at & (at - 1) else 0
    assert not padded


def test_packing_is_an_exact_round_trip(odd):
    rows = packing.packed(odd).collect()
    check_pieces(rows, ODD)
    import public_tokenizers

    encoder = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    ids = {k: encoder.encode([t])[0].tolist() + [packing.END] for k, t in ODD}
    for r in rows:
        if r.doc_id is not None:
            own = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4")
            assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])


def test_neighbours_come_by_falling_bm25():
    rng = np.random.default_rng(8)
    docs = [rng.integers(2, 60, rng.integers(5, 80)).astype(np.uint16) for _ in range(40)]
    index = packing.Index(docs)
    for used in range(1, 30):
        index.use(used)
    scores = []
    mean = np.mean([len(d) for d in docs])
    for d in docs:
        total = 0.0
        for t in set(docs[0].tolist()):
            n = sum(t in x for x in docs)
            tf = (d == t).sum()
            total += np.log(1 + (40 - n + 0.5) / (n + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        scores.append(total)
    got = index.neighbours(0).tolist()
    assert sorted(got) == [0, *range(30, 40)]
    assert got == sorted(got, key=lambda k: -round(scores[k], 9))


# URL filters


def test_trie_equals_a_scan_of_the_rules(spark):
    urls = ["http://a.Example.ORG/es/1?x", "https://org/", "http://example.org/en/1", "x://example.org/en/1#a", "http://org", "ftp://com/fr/", None, "no scheme"]
    urls += ["http://com/de/x", "http://xexample.org/es/", "http://a.com/fr", "://net/a", "", "http://b.com/de/?q://org/", "a\nb://org/x"]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate(urls * 2)], "page_id long, url string")
    for name in CLASHING:
        pages = pages.withColumn(name, F.lit("clash"))
    more = [url_filters.Rule("block", "org", "/"), url_filters.Rule("allow", "a.com", "/fr"), url_filters.Rule("block", "net", "")]
    rules = URL_RULES + more
    for size in (4_000_000, 5):
        old, url_filters.TRIE_CHARS = url_filters.TRIE_CHARS, size
        try:
            got = url_filters.judge(pages, rules).collect()
        finally:
            url_filters.TRIE_CHARS = old
        assert len(got) == 2 * len(urls)
        for r in got:
            fits = [x for x in rules if (r.host == x.host or r.host.endswith("." + x.host)) and r.path.startswith(x.path)]
            best = max(fits, key=lambda x: (x.host.count("."), len(x.path), x.verdict == "block"), default=None)
            assert (r.rule, r.verdict) == ((best.host + best.path, best.verdict) if best else (None, "allow"))
    assert {r.host for r in got if r.url is None or "://" not in r.url} == {""}


# Classifiers


def accuracy(rows, labels, column):
    known = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in known]
    one = [r.predicted == 1 for r in held if known[r.doc_id] == 1]
    zero = [r.predicted == 0 for r in held if known[r.doc_id] == 0]
    return np.mean(one), np.mean(zero)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op2_quality_classifier"](spark, folder).collect()
    one, zero = accuracy(rows, table(spark, folder, "labels", "doc_id", "quality"), "quality")
    assert one > 0.9 and zero > 0.7
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    rows = QUERIES["op8_toxicity"](spark, folder).collect()
    one, zero = accuracy(rows, table(spark, folder, "labels", "doc_id", "toxic"), "toxic")
    assert one > 0.8 and zero > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_disguised_words_are_restored():
    counts = toxicity.trigram_counts(["you are an idiot and a moron", "such a worthless clown is here", "good apple tree street"] * 50)
    model = toxicity.log_trigrams(counts)
    for token, word in [("1d10t", "idiot"), ("m0r0n", "moron"), ("w0rthle$$", "worthless"), ("idiooooot!!", "idiot"), ("c.l.o.w.n", "clown"), ("@pple", "apple")]:
        assert word in toxicity.readings(token, model)
    assert toxicity.spaced("you i d i o t", model) == ["idiot"]
    assert toxicity.readings("street,", model) == ("street",)


def test_disguises_of_any_length_are_restored():
    counts = toxicity.trigram_counts(["you are stupid and an idiot", "good apple tree street hello more words"] * 50)
    trigrams = toxicity.log_trigrams(counts)
    model = toxicity.Model(trigrams, frozenset({"stupid", "idiot", "moron"}), frozenset(), np.array([1.0, 0.0]))
    assert "stupid" in toxicity.readings("st" + 38 * "u" + "pid", trigrams)
    line = " ".join("good apple tree stupid street more words".replace(" ", "") * 5)
    assert len(line) > 300 and toxicity.spaced(line, trigrams)[0].count("stupid") == 5
    filler = "-".join("apple" for _ in range(20))
    texts = {
        "st" + 38 * "u" + "pid": 1,
        "hello,this,is,stupid,and,more,words": 1,
        line: 5,
        "  ".join("you stupid and idiot good apple tree".replace(" ", "") * 9): 18,
        filler + "-s-t-u-p-i-d-" + filler: 1,
        "https://apple.tree/street/street/street/1d10t/more?words=stupid": 2,
        "appletreestreethellomorewords" * 3 + "stupid" + "appletreestreet": 1,
        "a!?" * 50_000 + "b": 0,
        "goodapple" * 20_000: 0,
        "!?" * 50_000: 0,
    }
    assert toxicity.hits(list(texts), model, {}).tolist() == list(texts.values())


def test_language_on_held_out_documents(spark, small):
    rows = QUERIES["op6_language_id"](spark, small).collect()
    known = {r.doc_id: r.lang for r in table(spark, small, "documents", "doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out and known[r.doc_id]]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "LANES", 8)
    monkeypatch.setattr(language, "LEAST_WINDOWS", 400)
    names = [f"l{k:02d}" for k in range(12)]
    rng = np.random.default_rng(4)
    label = np.repeat(np.arange(12), 20)
    windows = (65 + 5 * label[:, None] + rng.integers(0, 5, (240, 16))).astype(np.uint8)
    net = language.train(windows, np.ones(windows.shape, bool), label, names)
    found = language.document_probabilities(pa.array([bytes(w).decode() for w in windows]), net).argmax(axis=1)
    assert np.mean(found == label) > 0.95
    monkeypatch.setattr(language, "SAMPLE", 100)
    usable = spark.range(30_000).selectExpr("id as _doc", "concat('x', case when id % 3 = 0 then 0 else id % 700 end) as label")
    size = {r.label: r["count"] for r in language.sample_languages(usable, [f"x{k}" for k in range(700)]).groupBy("label").count().collect()}
    assert len(size) == 700 and set(size.values()) == {language.LEAST_EACH}
    even = language.Net(*[x * 0 for x in net[:5]], names)
    docs = spark.createDataFrame([(1, "abc"), (2, "12"), (3, None)], "doc_id long, text string")
    assert [r.doc_id for r in language.keep_identified(docs, even, least=0.05).collect()] == [1]
    assert [r.doc_id for r in language.keep_identified(docs, even).collect()] == []
    assert [r.doc_id for r in language.keep_identified(docs, new_peak(even)).collect()] == [1]


def new_peak(net):
    """The network, sure of its third language by 0.15."""
    bias = net.out_bias.copy()
    bias[2] = np.log(0.15 * 11 / 0.85)
    return net._replace(out_bias=bias)


def test_gradients_of_the_network():
    rng = np.random.default_rng(0)
    net = language.new_net(["a", "b", "c"])
    net = language.Net(*[x.astype(np.float64) for x in net[:5]], net.names)
    x, live, label = rng.integers(0, 256, (6, 5)), rng.random((6, 5)) > 0.2, rng.integers(0, 3, 5)
    _, grads = language.gradients(net, x, live, label)
    for k, array in enumerate(net[:5]):
        place = (0, x[2, 1], 3) if k == 0 else tuple(rng.integers(0, s) for s in array.shape)
        old, found = array[place], []
        for step in (1e-4, -1e-4):
            array[place] = old + step
            found.append(language.gradients(net, x, live, label)[0])
        array[place] = old
        assert (found[0] - found[1]) / 2e-4 == pytest.approx(grads[k][place], abs=1e-6)


def test_pooled_probabilities_do_not_depend_on_neighbours():
    net = language.new_net(["a", "b"])
    texts = ["short", "x" * 500, "", "été " * 60]
    together = language.document_probabilities(pa.array(texts), net)
    for k, t in enumerate(texts):
        assert np.allclose(language.document_probabilities(pa.array([t]), net)[0], together[k], atol=1e-5)


def test_classifiers_score_odd_rows(spark, odd):
    labels = spark.createDataFrame([(k, int(k in (1, 9, 12)), int(k in (9, 12))) for k in range(1, 16)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        for learn in (labels, labels.limit(0), labels.where(f"{label} = 1")):
            rows = module.score(odd, module.fit(odd, learn.select("doc_id", label))).collect()
            assert len(rows) == len(ODD)
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    net = language.fit(odd)
    rows = language.predict(odd, net).collect()
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 6, 14)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id in (1, 7, 12)} == {"en"}
    assert {r.lang_pred for r in language.predict(odd, language.fit(odd.limit(0))).collect()} == {"und"}
    assert language.keep_identified(odd, net).columns == odd.columns


def test_empty_tables(spark, empty):
    tests = spark.createDataFrame([], "item_id int, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(empty).columns == empty.columns
    assert fingerprints.fingerprints(empty).count() == 0
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert decontamination.occurrences(empty, tests).count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert packing.packed(empty).count() == 0
    assert url_filters.judge(empty.withColumn("url", F.lit("a")), URL_RULES).count() == 0
