"""Per-key results under skew: against brute force, at any piece size, with nulls, repeats and empty tables."""

from collections import Counter

import pytest

from inkwell.operators.hotkeys import heavy_keys, key_totals, mentions

INDEX = "index_id bigint, term string, term_to_chunks map<string,array<string>>"


def rows(spark, data):
    return spark.createDataFrame(data, INDEX)


SKEWED = [(i, "clash", {"hot": [f"chunk_{j % 37}" for j in range(60)] + [None], f"t{i % 5}": [f"chunk_{i}", f"chunk_{i}"], "none": None, "bare": [], "nulls": [None]}) for i in range(30)]


@pytest.mark.parametrize("piece", [1, 7, 4096])
def test_totals_match_brute_force_at_every_piece_size(spark, piece):
    got = {r.term: (r.n_elements, r.n_distinct) for r in key_totals(mentions(rows(spark, SKEWED)), piece=piece).collect()}
    n, seen = Counter(), {}
    for _, _, m in SKEWED:
        for t, ids in m.items():
            seen.setdefault(t, set()).update(x for x in ids or [] if x)
            n[t] += sum(x is not None for x in ids or [])
    assert got == {t: (n[t], len(s)) for t, s in seen.items()}


def test_a_hot_key_is_worked_on_in_pieces(spark):
    got = {r.term: r.n_pieces for r in key_totals(mentions(rows(spark, SKEWED)), piece=5).collect()}
    assert got["hot"] == 8 and got["none"] == 0


def test_heavy_keys_and_empty_tables(spark):
    assert [r.term for r in heavy_keys(mentions(rows(spark, SKEWED)), 0.5).collect()] == ["hot"]
    empty = rows(spark, [])
    assert key_totals(mentions(empty)).count() == 0 and heavy_keys(mentions(empty), 0.04).count() == 0
    assert key_totals(mentions(rows(spark, [(1, "x", None)]))).count() == 0
