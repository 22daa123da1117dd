"""Filters, order, deduplication, folds, review and vectors on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import chunking, components, folds, postprocess, review, vectors

SET = "ord int, chunk_id string, text string"


def chunk_set(spark, *texts):
    return spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(texts)], SET)


def ids(df):
    return [r.chunk_id for r in df.orderBy("ord").collect()]


def test_tiers_and_filters(spark):
    c = chunk_set(spark, "Marxism and the quaker bank", "Marxism and a bank", "x")
    assert ids(postprocess.ideology(c, ["quaker"])) == ["c0"]
    assert ids(postprocess.ideology(chunk_set(spark, "x", "y"), ["quaker"])) == ["c0", "c1"]
    assert ids(postprocess.finance_only(chunk_set(spark, "a bank", "a bank by the black sea", "z"), [r"black sea"])) == ["c0"]
    assert postprocess.ideology(chunk_set(spark), ["q"]).count() == 0
    t = {r.chunk_id: r.tier for r in postprocess.subject_tiers(chunk_set(spark, "a b", "a", "b", "in 1800", "in 1990", "none"), ["a", "b"]).collect()}
    assert t == {"c0": 1, "c1": 2, "c2": 3} or t == {"c0": 1, "c1": 2, "c2": 3, "c4": 4}
    assert postprocess.subject_tiers(chunk_set(spark, "x", "y"), ["zz"]).count() == 2


def test_comma_mentions(spark):
    c = chunk_set(spark, "Others met. There came Baring, hambro, and Gurney. It rained. More followed.", "Hambro was a bank.")
    got = {r.chunk_id: (r.reduced, r.text) for r in postprocess.reduce_comma_mentions(c, "Hambro").collect()}
    assert got["c1"] == (False, "Hambro was a bank.")
    assert got["c0"] == (True, "There came Baring, hambro, and Gurney. It rained.")


def test_dedup_is_first_occurrence_and_idempotent(spark):
    c = chunk_set(spark, "One. Two. one.", "TWO. Three.", "One.", None)
    once = postprocess.deduplicated(c)
    assert {r.chunk_id: r.text for r in once.collect()} == {"c0": "One. Two.", "c1": "Three."}
    assert sorted(map(tuple, postprocess.deduplicated(once).collect())) == sorted(map(tuple, once.collect()))


def test_text_of_each_term(spark):
    c = chunk_set(spark, "One. Two. one.", "TWO. Three.", "Zwei. Three. One.", "Four.", None)
    post = spark.createDataFrame([("a", "c0"), ("a", "c1"), ("a", "c2"), ("b", "c2"), ("b", "c1"), ("b", "c1"), ("c", "c3"), ("a", "c4")], "term string, chunk_id string")
    passages = postprocess.term_passages(post, c, 2)
    whole = postprocess.deduplicated(post.where("term <> 'c'").distinct().join(c, "chunk_id"), "term").select("term", "chunk_id", "ord", "text")
    assert sorted(map(tuple, passages.collect())) == sorted(map(tuple, whole.collect()))
    assert {r.term: r.text for r in postprocess.joined_texts(passages).collect()} == {"a": "One. Two. Three. Zwei.", "b": "TWO. Three. Zwei. One."}


def test_prepared_text_is_the_text(spark, tmp_path):
    from inkwell.queries import results

    spark.createDataFrame([(f"chunk_{i}", i, f"Same. Own {i}.") for i in range(25)], "chunk_id string, doc_id long, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    spark.createDataFrame([({"vessel row": [f"chunk_{i}" for i in range(25)]},)], "term_to_chunks map<string,array<string>>").write.parquet(str(tmp_path / "indices.parquet"))
    assert [tuple(r) for r in results.prepared_text(spark, str(tmp_path)).collect()] == [("vessel row", "Same. " + " ".join(f"Own {i}." for i in range(25)))]


def test_prepared_text_is_made_for_the_first_term_that_has_one_and_written_by_another_task(spark, tmp_path):
    from inkwell.queries import results

    texts = [(f"chunk_{i}", i, " \n" if i < 25 else f"Same. Own {i}. SAME.") for i in range(75)]
    spark.createDataFrame([*texts, ("chunk_80", 80, None)], "chunk_id string, doc_id long, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    # the first has blank chunks only, the second too few, the third is the one, the fourth comes later
    filed = {"vessel row": range(25), "Vessel row": range(25, 49), "Vessel Row": [*range(25, 50), 80, 99], "vessel": range(50, 75)}
    spark.createDataFrame([({t: [f"chunk_{i}" for i in ids] for t, ids in filed.items()},)], "term_to_chunks map<string,array<string>>").write.parquet(str(tmp_path / "indices.parquet"))
    made = results.prepared_text(spark, str(tmp_path))
    assert [tuple(r) for r in made.collect()] == [("Vessel Row", "Same. " + " ".join(f"Own {i}." for i in range(25, 50)))]
    # no aggregate takes a whole text, and the task that writes the row does not hold what it was made of
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "min_by" not in plan and plan.lstrip().startswith("Exchange SinglePartition")


def test_order_and_samples(spark):
    c = chunk_set(spark, "in 1907", "none", "in 1850", *["in 1901"] * 7)
    assert [r.chunk_id for r in postprocess.by_year(c).collect()][:2] == ["c2", "c3"]
    s = postprocess.stratified(c).collect()
    assert [r.chunk_id for r in s] == ["c0", "c1", "c2", "c3", "c4", "c5", "c6"]
    assert len(postprocess.stratified(c, total=3).collect()) == 3
    assert postprocess.upper_median(spark.createDataFrame([(y,) for y in (1, 2, 3, 4)], "y int"), "y").first().median == 3
    assert postprocess.upper_median(spark.createDataFrame([], "y int"), "y").first().median is None
    p = postprocess.period_sample(chunk_set(spark, *["gold in 1850"] * 3, *["tin in 1950"] * 20), ["gold"], [], 2)
    assert p.count() == 2 + 15


@pytest.mark.parametrize("n", [1, 3, 50])
def test_places_are_exact_over_all_rows(spark, n):
    rows = spark.createDataFrame([(i % 7, i) for i in range(101)], "a int, b int").repartition(n)
    got = [(r.a, r.b) for r in postprocess.placed(rows, "a", "b").orderBy("place").collect()]
    assert got == sorted((i % 7, i) for i in range(101))
    assert {r["count"] for r in postprocess.batches(rows, 20, "a", "b").groupBy("batch").count().collect()} == {20, 1}
    assert postprocess.token_batch_size() == 380 and postprocess.adaptive_batch(60) == (15, 2)


def test_context(spark):
    c = chunk_set(spark, "b", "a").withColumn("filename", F.lit(None).cast("string"))
    assert postprocess.context(c, "passages").first().context == "Found 2 relevant passages:\n\n[Unknown]\nb\n\n[Unknown]\na"
    assert postprocess.context(c, "prompt").first().context == "[Source 1: Unknown]\nb\n\n---\n[Source 2: Unknown]\na\n"


def test_folds(spark):
    rows = [(1, 0, "a", "One. Two. Three."), (1, 1, "b", "Two. Three. Four."), (1, 2, "c", "Else."), (2, 0, "d", "One. Two.")]
    merged = {r.chunk_id: (r.merged_id, r.text, r.n_merged) for r in folds.merge_adjacent(spark.createDataFrame(rows, "doc_id int, pos int, chunk_id string, text string")).collect()}
    assert merged == {"a": ("a", "One. Two. Three. Four.", 2), "b": ("a", None, 2), "c": ("c", "Else.", 1), "d": ("d", "One. Two.", 1)}
    text = " ".join(f"w{i}." for i in range(250)) + " " + " ".join(["x"] * 130)
    packed = folds.packed(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string"), 100).orderBy("piece").collect()
    assert " ".join(r.text for r in packed) == text and max(r.n_words for r in packed) <= 100 and {r.doc_id for r in packed} == {1}
    words = " ".join(f"v{i}" for i in range(500))
    a, b = " ".join(words.split()[:400]), " ".join(words.split()[300:])
    assert not folds.mergeable(a, b)


def test_endnotes_by_overlap(spark):
    docs = spark.createDataFrame([(1, "aaaa bbbb\ncccc")], "doc_id int, text string")
    paras = spark.createDataFrame([(1, 0, "aaaa bbbb", ["1"]), (1, 1, "cccc", ["2"])], "doc_id int, para int, text string, endnote_ids array<string>")
    c = spark.createDataFrame([(1, "k0", "aaaa"), (1, "k1", "bbbb cccc"), (1, "k2", "zz")], "doc_id int, chunk_id string, text string")
    assert sorted(map(tuple, folds.endnotes_in_chunks(c, docs, paras).collect())) == [("k0", "1"), ("k1", "1"), ("k1", "2")]


def test_review(spark):
    a = spark.createDataFrame([(1, "In 1900 a. B. C. D.\n\nIn 1850 x."), (2, ""), (3, "Panic of 1907 and 1990.")], "answer_id int, answer string")
    s = spark.createDataFrame([(1, "from 1700 to 2005, panic of 1907"), (3, "panic of 1907")], "answer_id int, text string")
    got = {(r.answer_id, r.criterion): r for r in review.review(a, s).collect()}
    assert len(got) == 12
    assert not got[1, "paragraph_length"].passed and got[1, "paragraph_length"].score == 0.75
    assert got[1, "chronological_flow"].issues[0] == "Year 1900 mentioned after 1850 (backwards jump of 50 years)"
    assert got[1, "full_history"].issues[0].startswith("Answer stops at 1900, but chunks go to 2005") and got[2, "full_history"].details == "No chunks provided for comparison"
    assert got[3, "panics_coverage"].passed and not got[1, "panics_coverage"].passed
    flags = a.select(review.needs_grounding(F.col("answer")).alias("g"), review.too_long(F.col("answer")).alias("l"), review.stops_early(F.col("answer"), F.lit(2005)).alias("s")).collect()
    assert [tuple(r) for r in flags] == [(True, True, True), (True, False, True), (True, False, True)]


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(120, 6)).astype(float)
    v[5] = v[7]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, [0.0] * 6), (901, None)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 12)
    top = [r.vec_id for r in vectors.top_k(rows, v[3].tolist(), 5).collect()]
    assert top == sorted(range(120), key=lambda j: (-s[3, j], j))[:5]
    got: dict = {}
    for r in vectors.top_k_each(rows, 50, 4, block=40).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q in (0, 50, 100):
        assert [got[q][k] for k in (1, 2, 3, 4)] == sorted((j for j in range(120) if j != q), key=lambda j: (-s[q, j], j))[:4]


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (4, 6), (6, 6), (9, 8), (3, 10), (10, 11), (11, 12), (12, 13)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 10, 11, 12, 13], 1), **dict.fromkeys([4, 5, 6], 4), 8: 8, 9: 8}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_incremental(spark):
    c = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", None), ("4", "y")], "chunk_id string, text string")
    done = chunking.hashed(c.where("text = 'y'")).select("chunk_hash", F.lit("v1").alias("prompt_version"))
    assert [r.text_preview for r in chunking.unseen(c, done, "v1").collect()] == ["x"]
    assert chunking.unseen(c, done, "v2").count() == 2
    s = chunking.prefilter_stats(c, ["x"]).first()
    assert (s.total, s.relevant, s.filtered, s.pct) == (4, 2, 2, 50.0)
    assert chunking.prefilter_stats(c.limit(0), ["x"]).first().pct == 0


def test_places_of_skewed_orders(spark):
    # all rows share the first order column, and half of them the second too
    rows = spark.range(10_000).selectExpr("1 AS a", "IF(id % 2 = 0, 0, id) AS b", "id")
    placed = postprocess.placed(rows, "a", "b", "id").orderBy("place").collect()
    assert [r.place for r in placed] == list(range(10_000)) and [(r.b, r.id) for r in placed] == sorted((r.b, r.id) for r in placed)


def test_contexts_in_batches(spark):
    c = chunk_set(spark, *[f"t{i} in {1990 - i}" for i in range(5)]).withColumn("filename", F.lit("f")).withColumn("grp", F.lit("g"))
    found = postprocess.contexts(c, "passages", "grp", size=2).orderBy("batch").collect()
    assert [(r.batch, r.n) for r in found] == [(0, 2), (1, 2), (2, 1)] and found[0].context.startswith("Found 5 relevant passages:\n\n[f]\nt0") and found[1].context.startswith("[f]\nt2")
    assert postprocess.contexts(c, "prompt", "grp", by_year=True).first().context.startswith("[Source 1: f]\nt4 in 1986")
    assert postprocess.contexts(c.limit(0), "prompt", "grp").count() == 0


def test_endnotes_of_windows(spark):
    from inkwell.operators import chunking

    docs = spark.createDataFrame([(1, "aa bb\ncc dd ee\nff aa bb")], "doc_id long, text string")
    paras = spark.createDataFrame([(1, 0, "aa bb", ["1"]), (1, 1, "cc dd ee", ["2"]), (1, 2, "ff aa bb", ["3"])], "doc_id long, para int, text string, endnote_ids array<string>")
    found = folds.endnotes_in_windows(chunking.chunk(docs, 3, 1), paras, hop=2)
    # windows: aa bb cc | cc dd ee | ee ff aa | aa bb
    assert sorted(map(tuple, found.collect())) == [("1_0", "1"), ("1_0", "2"), ("1_1", "2"), ("1_2", "2"), ("1_2", "3"), ("1_3", "3")]


def test_words_that_need_a_capital(spark):
    c = chunk_set(spark, "a black market in bonds", "a Black banker", "a black banker", "the Black Sea bank", "no money")
    kept = postprocess.finance_only(c, [r"\bblack sea\b"], capitalised={"black": ["black banker"]})
    assert [r.text for r in kept.orderBy("ord").collect()] == ["a Black banker", "a black banker"]
    assert postprocess.reduce_comma_mentions(c, "black", from_chunks=20).where("reduced").count() == 0


def test_pairs_of_chunks_that_merge(spark):
    run = "one two three four five six seven"
    rows = [(1, 0, "a", f"{run} eight. X."), (1, 1, "b", f"Zero {run} nine. Y."), (1, 2, "c", "Y. Z."), (2, 0, "d", "Q.")]
    found = {(r.chunk_id, r.next_id): (r.share, r.phrases, r.merges) for r in folds.pair_merges(spark.createDataFrame(rows, "doc_id int, pos int, chunk_id string, text string")).collect()}
    assert found == {("a", "b"): (0.0, 1, True), ("b", "c"): (0.5, 0, True)}
