"""Extraction, index, graphs and retrieval on small fixtures."""

import itertools

import pytest

from inkwell import lexicons as L
from inkwell.operators import extract, index, retrieve

CHUNKS = "chunk_id string, text string"


def chunks(spark, *texts):
    return spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], CHUNKS)


def pairs(df):
    return sorted((r.term, r.chunk_id) for r in df.collect())


def test_names(spark):
    c = chunks(spark, "Nathan Mayer Rothschild met Deutsche Bank.", None, "", "Siegmund Warburg's")
    assert pairs(extract.surnames(c)) == [("Rothschild", "c0"), ("Warburg", "c3")]
    assert pairs(extract.middle_names(c)) == [("Mayer", "c0")]


def test_firms(spark):
    c = chunks(spark, "<italic>Kuhn Loeb</italic>, <italic>Bank</italic>, <italic>, and</italic>", "<italic>Park</italic> NB grew; First NB of Boston too")
    assert pairs(extract.firms(c)) == [("First NB", "c1"), ("First National Bank", "c1"), ("Kuhn Loeb", "c0"), ("Park", "c1"), ("Park NB", "c1"), ("Park National Bank", "c1")]


def test_acronyms(spark):
    c = chunks(spark, "The SEC (Securities Exchange Commission) and World Trade Organization (WTO).", "SEC, or Some Longer Name Commission Here", "bank (of the river)")
    found = {r.acronym: r.full_name for r in extract.acronym_definitions(c, {"BOE": "Bank of England"}).collect()}
    assert found == {"SEC": "Securities Exchange Commission", "WTO": "World Trade Organization", "BOE": "Bank of England"}
    d = spark.createDataFrame([("BOE", "Bank of England"), ("DOJ", "Law and Order")], "acronym string, full_name string")
    t = chunks(spark, "BOE and BOE", "the bank of england, law & order", "BOES")
    assert pairs(extract.acronym_tokens(t, d)) == [("BOE", "c0"), ("boe", "c0")]
    assert pairs(extract.acronym_names(t, d)) == [("BOE", "c1"), ("DOJ", "c1"), ("boe", "c1"), ("doj", "c1")]
    assert pairs(extract.acronym_places(chunks(spark, "FRS New York and FRS Nowhere"), ["FRS"])) == [("FRS New York", "c0")]


def test_codes_panics_changes(spark):
    c = chunks(spark, "BA1933 passed", "Panic of 1907 and crisis of <b>1907</b>, panic of 19077", "Rosen changed his name to Ross", "Rosen formerly Ross née Katz")
    assert pairs(extract.law_terms(c)) == [("BA1933", "c0"), ("Bankruptcy Act 1933", "c0"), ("ba1933", "c0"), ("bankruptcy act 1933", "c0")]
    assert pairs(extract.panic_terms(c)) == [("panic of 1907", "c1"), ("panic_of_1907", "c1")]
    assert extract.panic_terms(c, [1825]).count() == 0
    assert [tuple(r) for r in extract.name_changes(c).collect()] == [("rosen", "ross")]


def test_surnames_of_any_form(spark):
    c = chunks(spark, "Telbappel, Samuel and Alexander Damse-Naukin", "Edwd. Gulki; x'Ab Count Otto von der Lippe Senfil's", "Samuel Telbappel Damse Naukin, Edwd Gulki")
    names = ["telbappel, samuel", "alexander damse-naukin", "damse naukin", "edwd. gulki", "count otto von der lippe", "senfil's", "'ab", "gulki;", "gulki", "samuel"]
    found = extract.surname_search(c, spark.createDataFrame([(n,) for n in names], "surname string"))
    want = [("'ab", "c1"), ("alexander damse-naukin", "c0"), ("count otto von der lippe", "c1"), ("damse naukin", "c2"), ("edwd. gulki", "c1"), ("gulki", "c1"), ("gulki", "c2")]
    want += [("samuel", "c0"), ("samuel", "c2"), ("senfil's", "c1"), ("telbappel, samuel", "c0")]
    assert sorted((r.surname, r.chunk_id) for r in found.collect()) == want


def test_words_surnames_relations(spark):
    c = chunks(spark, "The Warburgs, de Rothschild; WARBURG", "warburger")
    names = spark.createDataFrame([("Warburg",), ("de rothschild",), ("",)], "surname string")
    assert sorted((r.surname, r.chunk_id) for r in extract.surname_search(c, names).collect()) == [("Warburg", "c0"), ("de rothschild", "c0")]
    r = chunks(spark, "Anna married Otto")
    assert sorted((x.a, x.b) for x in extract.related(r, [("kin", r"([A-Z][a-z]+) married ([A-Z][a-z]+)", False)]).collect()) == [("Anna", "Otto"), ("Otto", "Anna")]
    assert [tuple(x) for x in extract.patterns_found(r, {"otto": [(r"married ([A-Z][a-z]+)", 5)]}).collect()] == [("otto", "otto", 5)]


MENTIONS = [("a", "1"), ("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("b", "3"), ("c", "3"), ("Quakers", "4")]


@pytest.fixture
def post(spark):
    return index.postings(spark.createDataFrame(MENTIONS, "term string, chunk_id string")).cache()


def test_postings(spark, post):
    assert {(r.term, r.tf, r.df) for r in index.terms(post).collect()} == {("a", 3, 2), ("b", 3, 3), ("c", 1, 1), ("Quakers", 1, 1)}
    assert {r.term for r in index.frequent(index.terms(post), ["c"]).collect()} == {"a", "b", "c"}
    s = index.duplicate_stats(spark.createDataFrame(MENTIONS, "term string, chunk_id string")).first()
    assert (s.terms, s.ids, s.distinct_ids, s.duplicates) == (4, 8, 7, 1)
    assert index.duplicate_stats(spark.createDataFrame([], "term string, chunk_id string")).first().ids == 0


def test_groups_are_idempotent_and_disjoint(spark, post):
    groups = {"quaker": ["quaker", "quakers"], "x y": ["a", "c"]}
    once = index.merge_groups(post, groups)
    assert pairs(once) == pairs(index.merge_groups(once, groups))
    assert {("x y", "3"), ("x_y", "1"), ("c", "1"), ("quaker", "4")} <= set(pairs(once)) and ("Quakers", "4") not in pairs(once)
    with pytest.raises(ValueError):
        index.merge_groups(post, {"p": ["s"], "q": ["s"]})


def test_graphs(spark, post):
    edges = {(r.a, r.b): r.weight for r in index.cooccurrence(post).collect()}
    by: dict = {}
    for t, c in set(MENTIONS):
        by.setdefault(c, set()).add(t)
    brute: dict = {}
    for ts in by.values():
        for a, b in itertools.combinations(sorted(ts), 2):
            brute[a, b] = brute.get((a, b), 0) + 1
    assert edges == brute
    top = index.associations(index.cooccurrence(post), top=1, least=1).collect()
    assert {(r.entity, r.other) for r in top} == {("a", "b"), ("b", "a"), ("c", "b")}
    assert ("friends", "4") in pairs(index.with_parents(post, {"friends": ["quakers"]}))
    assert index.children_of(["Friends", "x"], {"friends": ["quakers"]}) == ["Friends", "quakers", "x"]


def test_retrieval(spark, post):
    def ids(df):
        return sorted(r.chunk_id for r in df.collect())

    assert ids(retrieve.intersection(post, [["A"], ["b"]])) == ["1", "2"]
    assert ids(retrieve.intersection(post, [["a", "c"], ["b"]])) == ["1", "2", "3"]
    assert ids(retrieve.intersection(post, [])) == []
    assert ids(retrieve.union(post, ["a", "c"])) == ["1", "2", "3"]
    assert ids(retrieve.difference(retrieve.union(post, ["b"]), retrieve.union(post, ["a"]))) == ["3"]
    assert ids(retrieve.tiered(retrieve.union(post, ["zz"]), retrieve.union(post, ["c"]), retrieve.union(post, ["a"]))) == ["3"]
    assert ids(retrieve.tiered(retrieve.union(post, ["zz"]))) == []
    c = spark.createDataFrame([(str(i), t) for i, t in enumerate(["x", "in 1850", "in 1900", "panic 1950", "y"])], CHUNKS)
    found = retrieve.search(post, c, "a's", 1)
    assert ids(found) == ["1"]
    assert ids(retrieve.augmented_later(retrieve.union(post, ["a"]), post, c, ["b"])) == ["1", "2", "3"]
    assert ids(retrieve.augmented_crisis(retrieve.union(post, ["a"]), post, c, ["b"], ["panic"])) == ["1", "2", "3"]
    assert ids(retrieve.with_aliases(retrieve.union(post, ["zz"]), post, "the BOE", {"boe": ["c"]})) == ["3"]
    assert ids(retrieve.with_aliases(retrieve.union(post, ["b"]), post, "the BOE", {"boe": ["Quakers"]})) == ["1", "2", "3"]
    assert retrieve.overlap(post, ["a"], ["b"]).first().asDict() == {"first": 2, "second": 3, "both": 2}


def test_comparisons(spark):
    a = spark.createDataFrame([("k", "1"), ("k", "2"), ("m", "1")], "key string, v string")
    b = spark.createDataFrame([("k", "2"), ("n", "3")], "key string, v string")
    got = {r.key: r.relation for r in index.compare_sets(a, b, "key", "v").collect()}
    assert got == {"k": "superset", "m": "disjoint", "n": "disjoint"}
    truth = spark.createDataFrame([("g", "A"), ("g", "B ")], "grp string, name string")
    assert index.evaluation(truth, spark.createDataFrame([("g", "b")], "grp string, name string")).first().accuracy == 0.5


def test_lexicon_file(tmp_path):
    (tmp_path / "x.json").write_text('{"a": ["b"]}')
    assert L.load(tmp_path / "x.json") == {"a": ["b"]} and L.load(tmp_path / "none.json") == {}


def test_term_choices(spark):
    names = ["Bank of X", "runner", "Runner", "iPhone", "abc", "1234", "aaaa", "lowercase", "the", "station", "SEC", "gold"]
    t = spark.createDataFrame([(n, 1, 1) for n in names], "term string, tf long, df long")
    assert {r.term for r in index.linkable(t, ["the"]).collect()} == {"Bank of X", "Runner", "iPhone", "lowercase"}
    split = {r.term: (r.kept, r.batch) for r in index.presplit(t, 5).collect()}
    assert split["SEC"] == (True, None) and len(split) == len(names)
    assert sorted(b for k, b in split.values() if not k) == [0] * 5 + [1] * 5 + [2]
    m = spark.createDataFrame([("Brahmin", "c0"), ("brahmin", "c1"), ("brahmin", "c2"), ("x", "c2")], "term string, chunk_id string")
    got = extract.disambiguated(m, chunks(spark, "in India and Boston", "of Boston", "none"), "brahmin", [("hindu", ["india"]), ("boston brahmin", ["boston"])])
    assert pairs(got) == [("boston brahmin", "c1"), ("hindu", "c0"), ("x", "c2")]
    texts = spark.createDataFrame([("vessel row", "a"), ("Vessel", "b"), ("row", "c")], "term string, text string")
    assert [tuple(r) for r in retrieve.prepared(texts, ["nothing", "vessel", "vessel row"]).collect()] == [("Vessel", "b")]
    assert retrieve.prepared(texts, ["zz"]).count() == 0 and retrieve.prepared(texts, []).count() == 0


def test_dictionary_both_ways(spark):
    from inkwell.operators import dictionary

    keys = ["kuhn-loeb", "public utility holding company act 1935", "o'neil", "a & b", "& b", "low", "c++", "the bank", "bank of the north"]
    texts = ["the kuhn-loeb firm, kuhn - loeb", "the public utility holding company act 1935.", "o'neil and x& bank", "a & b", "lower low", "c++x c++", "the bank of the north", None, ""]
    c = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    k = spark.createDataFrame([(x,) for x in keys], "key string")
    for plain in (False, True):
        sent, joined = ({tuple(r) for r in dictionary.hits(c, k, plain, bound).collect()} for bound in (1 << 20, 0))
        assert sent == joined and sent
    assert {tuple(r) for r in dictionary.hits(c, k).collect()} >= {("k0", "kuhn-loeb"), ("k1", "public utility holding company act 1935"), ("k2", "o'neil"), ("k3", "a & b"), ("k4", "low"), ("k6", "bank of the north"), ("k6", "the bank")}
    assert dictionary.hits(c, k.limit(0)).count() == 0 and dictionary.hits(c.limit(0), k).count() == 0


def test_pairs_of_wide_chunks(spark):
    p = spark.createDataFrame([(f"t{i:02}", "x", 1) for i in range(23)] + [("t01", "y", 1), ("t02", "y", 1), ("t05", "z", 1)], "term string, chunk_id string, tf long")
    one, many = ({tuple(r) for r in index.cooccurrence(p, block).collect()} for block in (512, 4))
    assert one == many and len(one) == 23 * 22 // 2 and ("t01", "t02", 2) in one


def test_names_with_commas_and_changes(spark):
    c = chunks(spark, "The Diversity, Equity, and Inclusion rule.", "Levy changed his name to Lee. Ash formerly Oak.", "a née b, formerly C")
    d = spark.createDataFrame([("DEI", "Diversity, Equity, and Inclusion")], "acronym string, full_name string")
    assert {r.term for r in extract.acronym_names(c, d).collect()} == {"DEI", "dei"}
    assert {tuple(r) for r in extract.name_changes(c).collect()} == {("levy", "lee"), ("levy", "oak")}
