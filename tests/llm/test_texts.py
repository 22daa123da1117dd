"""Frequencies, splitting, encoding and mixing."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkwell.llm import bpe, frequency, mixing, split


def test_frequencies(spark):
    rows = [("hot", f"c{i % 9}") for i in range(40)] + [("once", "c1"), ("once", "c1"), ("none", None), (None, "c2")]
    got = {r.term: (r.n_mentions, r.n_records, r.mark) for r in frequency.term_frequencies(spark.createDataFrame(rows, "term string, chunk_id string"), 3, 0.5).collect()}
    assert got == {"hot": (40, 9, "common"), "once": (2, 1, "rare"), "none": (0, 0, "rare"), None: (1, 1, "rare")}
    assert frequency.term_frequencies(spark.createDataFrame([], "term string, chunk_id string"), 3, 0.2).count() == 0


def check_pieces(text, limit, overlap):
    starts, ends = split.word_spans(text)
    words = [text[a:b] for a, b in zip(starts, ends, strict=True)]
    pos = 0
    for k, (first, n, kept, c, e) in enumerate(split.pieces(text, limit, overlap)):
        assert 0 < n <= limit and first + kept == pos and kept == (min(overlap, pos) if k else 0)
        assert text[c:e].split() == words[first : first + n] or not text[c:e].isascii()
        pos = first + n
    assert pos == len(words)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "a,", "x\n\ny", "z\n", " ", " q", "!", "Ünder?"]), max_size=80), st.integers(2, 12), st.integers(0, 11))
def test_pieces_hold_every_word(parts, limit, overlap):
    check_pieces(" ".join(parts), limit, min(overlap, limit - 1))


def test_pieces_cut_at_the_strongest_boundaries():
    text = "\n\n".join(" ".join(["w"] * 39 + ["end."]) for _ in range(5))
    assert [p[0] + p[2] for p in split.pieces(text, 100, 10)] == [0, 80, 160]
    check_pieces(" ".join(["word"] * 2001), 400, 100)
    assert split.pieces("  \n", 5, 1) == [] and split.pieces("", 5, 1) == []
    with pytest.raises(ValueError):
        split.split(None, 5, 5)


def test_split_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", 0), (2, None, 0), (3, "", 0), (4, "x " * 900, 0), (4, "x " * 900, 0), (None, "y", 0)], "doc_id long, text string, piece int")
    rows = split.split(docs).collect()
    assert Counter(r.doc_id for r in rows) == {1: 1, None: 1, 4: 2 * len(split.pieces("x " * 900, 400, 100))}
    assert [r.doc_id for r in split.oversized(docs).collect()] == [4]
    assert split.split(docs.limit(0)).count() == 0


TEXTS = ["", None, "Hello world's  tokens\n\n  and\ttabs ", "naïve Ünïcode — “quotes” 東京 🙂🙂", "<|endoftext|>", "a" * 3000, "   x​﻿", "é 123456 1½", "\x1c\x85\r\n"]


def reference_ids():
    import base64
    import os

    import tiktoken

    with open(os.path.join(bpe.DEFAULT_FOLDER, bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_ids_match_the_public_library(spark):
    rng = random.Random(3)
    texts = [*TEXTS, *("".join(rng.choices("abc xyz'’.,;ÄéΩ漢🙂\n\t 019", k=rng.randint(1, 60))) for _ in range(60))]
    encode = reference_ids()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    assert got == {i: encode(t or "") for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in bpe.token_counts(docs).collect()}
    assert counts == {i: len(x) for i, x in got.items()}
    assert bpe.encode(docs.limit(0)).count() == 0


def test_a_full_word_memory_changes_nothing():
    import pyarrow as pa

    words = [["Hello", " world"], [" again", "Hello"], []]
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([w], pa.list_(pa.string()))], names=["k", "w"]) for i, w in enumerate(words)]
    run = bpe._encoder(bpe.DEFAULT_FOLDER, bpe.VOCABULARY, False)
    free = [b.to_pylist() for b in run(iter(batches))]
    kept, bpe.MEMORY = bpe.MEMORY, 1
    try:
        assert [b.to_pylist() for b in run(iter(batches))] == free
    finally:
        bpe.MEMORY = kept


def test_mix_meets_its_shares(spark):
    rng = random.Random(5)
    rows = [(i, "word " * rng.randint(20, 60), rng.choice(["Big ", "big", "small", None, "unlisted"]) if i > 12 else "tiny") for i in range(700)]
    docs = spark.createDataFrame([*rows, (9000, None, "big"), (9001, "", "big")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 2), ("tiny", 0.1, 4), ("missing", 0.1, 3), (None, 0.2, 1)], "source string, target_share double, max_repeats int")
    found = mixing.mix(docs, weights)
    shares = {r.source: r for r in found.shares.collect()}
    records = found.records.collect()
    assert set(shares) == {"big", "small", "tiny", "missing"} and shares["missing"].selected_tokens == 0
    for s, want in (("big", 0.5), ("small", 0.3), ("tiny", 0.1)):
        assert abs(shares[s].actual_share - want / 0.9) < 0.02, s
    limits = {"big": 1, "small": 2, "tiny": 4}
    assert all(1 <= r.uses <= limits[r.source] for r in records) and len({r.doc_id for r in records}) == len(records)
    by = Counter()
    for r in records:
        by[r.source] += r.uses * r.n_tokens
    assert by == {s: shares[s].selected_tokens for s in limits}
    small = [r.uses for r in records if r.source == "tiny"]
    assert max(small) - min(small) <= 1
    assert sorted(map(tuple, mixing.mix(docs, weights).records.collect())) == sorted(map(tuple, records))
    half = mixing.mix(docs, weights, total=2000.0).shares.agg({"selected_tokens": "sum"}).first()[0]
    assert abs(half - 2000) < 250
    assert mixing.mix(docs.limit(0), weights).records.count() == 0


def test_long_words_equal_the_public_library(spark):
    rng, reference = random.Random(8), reference_ids()
    words = ["a" * 70_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "-" * 300, "ß" * 257, "".join(rng.choice("etaoinshr") for _ in range(5000)), "x" * 256, "x" * 257]
    docs = spark.createDataFrame([(i, f"before {w} after") for i, w in enumerate(words)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encode(docs).collect()}
    assert got == {i: reference(f"before {w} after") for i, w in enumerate(words)}
    # the heap and the recursion give the same ids
    merger = bpe.Merger(bpe.DEFAULT_FOLDER, bpe.VOCABULARY)
    for w in ["international", "aaaaaaaaaaaa", "abababcabcab", "Übergrößenträger", "1234567890"]:
        assert merger.encode_long(w) == merger.encode([w])[0].tolist()


def test_decoding_is_the_inverse(spark):
    texts = {1: "Plain, text 12.", 2: "", 3: None, 4: "naïve Straße 東京 🙂\n\n\t x", 5: "y " * 3000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()} == {k: v or "" for k, v in texts.items()}
    odd = spark.createDataFrame([(1, None), (2, [10**6]), (3, [bpe.ranks_of(bpe.DEFAULT_FOLDER, bpe.VOCABULARY)[b"\xff"]])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd).collect()} == {1: "", 2: "", 3: None}
    assert bpe.decode(odd.limit(0)).count() == 0


def test_a_long_text_is_decoded_from_several_queries():
    import pyarrow as pa

    encode = reference_ids()
    texts = ["naïve 東京 🙂 " * 9, "", "short"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([encode(t) for t in texts], pa.list_(pa.int32()))], names=["k", "ids"])
    kept, bpe.TOKENS = bpe.TOKENS, 5
    try:
        assert [b.column(1).to_pylist() for b in bpe._decoder(bpe.DEFAULT_FOLDER, bpe.VOCABULARY)([batch])] == [texts]
    finally:
        bpe.TOKENS = kept
