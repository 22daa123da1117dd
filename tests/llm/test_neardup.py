"""Near-duplicates against brute force: hot buckets, copies, nulls, short texts."""

import random
from itertools import combinations

import pytest

from inkwell.llm import neardup

SCHEMA = "doc_id long, text string, id string, fp string"


def shingle_set(text, k):
    w = neardup._WORD.findall(text.lower())
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(texts, k, threshold, least):
    sets = {i: shingle_set(t, k) for i, t in texts.items() if t and len(neardup._WORD.findall(t.lower())) >= max(least, k)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def corpus(n=60, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, i = {}, 0
    for _ in range(n):
        words = rng.choices(vocabulary, k=rng.randint(30, 90))
        for _ in range(rng.randint(1, 4)):
            edited = list(words)
            for _ in range(rng.randint(0, 3)):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            texts[i] = " ".join(edited)
            i += 1
    texts |= {i: None, i + 1: "", i + 2: "two words", i + 3: texts[0].upper(), i + 4: "  ".join(texts[0].split())}
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "clash", "clash") for k, t in texts.items()], SCHEMA)


@pytest.mark.parametrize("hot", [1, 512])
def test_pairs_match_brute_force(spark, hot):
    texts = corpus()
    found = neardup.near_duplicates(frame(spark, texts), 0.5, 3, 20, hot=hot)
    got = [tuple(r) for r in neardup.all_pairs(found).collect()]
    assert len(got) == len(set(got))
    expected = brute(texts, 3, 0.5, 20)
    # a pair near the threshold may fall to the signature; none beyond it may be added
    sets = {i: shingle_set(t, 3) for i, t in texts.items() if t}
    missed = {(a, b) for a, b in expected - set(got) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.55}
    assert set(got) <= expected and not missed


def test_groups_give_one_row_per_text(spark):
    texts = {1: "a b c d e f g h", 2: "A b c d e f g h!", 3: "a b c d e f g h i", 4: "q r s t u v w x", 5: None, 6: "a b"}
    got = {r.id: (r.group_id, r.n_links) for r in neardup.groups(neardup.near_duplicates(frame(spark, texts), 0.7, 3)).collect()}
    assert got == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0)}


def test_empty(spark):
    found = neardup.near_duplicates(frame(spark, {}).where("false"))
    assert found.pairs.count() == 0 and neardup.all_pairs(found).count() == 0 and neardup.groups(found).count() == 0


def test_the_index_keeps_its_promise():
    for s in (0.5, 0.6, 0.8, 0.9):
        x = neardup.index_for(s)
        assert x.miss_probability(s) <= 0.005 and x.bands * x.size == neardup.COMPONENTS
    # pigeonhole: any two signatures within the distance agree in some band on all but `errors` components
    rng = random.Random(2)
    x = neardup.Index(16, 1)
    for _ in range(300):
        differ = set(rng.sample(range(neardup.COMPONENTS), x.distance))
        assert any(sum(b * x.size + i in differ for i in range(x.size)) <= x.errors for b in range(x.bands))


def test_buckets_stream_across_batches():
    import pyarrow as pa

    keys = [1] * 3 + [2] * 9 + [3] + [4] * 2
    rows = list(range(len(keys)))
    for step in (1, 2, 5, 20):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step], pa.int64()), pa.array(rows[i : i + step], pa.int64())], names=["key", "id"]) for i in range(0, len(keys), step)]
        out = [tuple(r.values()) for b in neardup._buckets(4)(iter(batches)) for r in b.to_pylist()]
        assert sorted(r for r in out if not r[2]) == [(0, 1, False), (0, 2, False), (1, 2, False), (13, 14, False)]
        assert sorted(r[1] for r in out if r[2]) == list(range(3, 12)) and {r[0] for r in out if r[2]} == {2}


def test_blocks_of_hot_buckets_and_classes(spark):
    texts = corpus(40, seed=9)
    copies = {1000 + i: texts[0] for i in range(23)}
    found = neardup.near_duplicates(frame(spark, texts | copies), 0.6, 3, 20, hot=1, block=4)
    got = [tuple(r) for r in neardup.all_pairs(found, block=3).collect()]
    sets = {i: shingle_set(t, 3) for i, t in (texts | copies).items() if t}
    sure = {(a, b) for a, b in brute(texts | copies, 3, 0.6, 20) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.65}
    assert len(got) == len(set(got)) and sure <= set(got) <= brute(texts | copies, 3, 0.6, 20)


def test_misses_of_the_index():
    """What is guaranteed, and how often pairs beyond it fail to meet: measured on random signatures against the curve."""
    import numpy as np

    rng = np.random.default_rng(3)
    for similarity in (0.5, 0.8):
        index = neardup.index_for(similarity)

        def met(equal, index=index):
            return (equal.reshape(len(equal), index.bands, index.size).sum(axis=2) >= index.size - index.errors).any(axis=1)

        # every signature pair within the guaranteed distance meets
        near = np.ones((20_000, neardup.COMPONENTS), bool)
        for row in near:
            row[rng.choice(neardup.COMPONENTS, index.distance, replace=False)] = False
        assert met(near).all()
        for s in (similarity, similarity + 0.05, similarity + 0.1):
            measured = 1 - met(rng.random((200_000, neardup.COMPONENTS)) < s).mean()
            assert measured <= 0.005 and abs(measured - index.miss_probability(s)) < 0.0005
