"""Defective pairs, name variants and subjects on invented fixtures."""

import random
from collections import Counter

import numpy as np
import pytest

from inkwell.llm import names, pairs, subjects

REQUEST, RESPONSE = "request_id long, job_id string, question string, received_at string, answer string", "response_id long, job_id string, status string, answer string, polled_at timestamp"

GOOD = "The merchants of the harbour kept long lists of sealed letters, and the clerks copied them every winter."
CASES = {
    "empty": ["", None, " ​", "N/A", "<p></p>", "**Overview**", "null", "[]", "…"],
    "copies_question": ["Who kept the sealed letters of the harbour?", "You asked: who kept the sealed letters of the harbour", "**who kept  the sealed letters of harbour**"],
    "refusal": ["I can't help with that request.", "Unfortunately, I have to decline. Please ask an archivist.", "No relevant information found.", "I'd rather not speculate about sealed letters."],
    "other_language": ["Die Kaufleute der Stadt führten lange Listen über die Briefe, und man kopierte sie jeden Winter für das Archiv."],
    "truncated": [GOOD + " The clerks copied the", GOOD + "\n\n[Truncated]", GOOD + "\n\n2.", GOOD + " They (and", "The merchants kept the lett"],
    None: [GOOD, GOOD[:-1], "Yes, in 1907.", 'A clerk wrote "I cannot answer this" and left, yet the merchants of the harbour did reply in the winter.', "Who kept the sealed letters of the harbour?\n\n" + GOOD],
}


def test_refusals_with_a_slot_are_aligned():
    judge = pairs.Judge()
    assert judge.refuses("I am unable to provide any details about the letters.")
    assert judge.refuses("I am unable to provide facts about the letters of the harbour.")
    assert judge.refuses("I cannot provide information about the sealed letters that the merchants of the old harbour kept in the winter of 1907.")
    assert judge.refuses("Die Frage nach den Briefen der Kaufleute kann ich leider nicht beantworten.")
    assert judge.refuses("Zu den Briefen, die die Kaufleute der Stadt im Winter 1907 lange Zeit führten, liegen keine Angaben vor.")
    assert not judge.refuses("I provide information about the sealed letters of the harbour.")
    assert not judge.refuses("They cannot be found, and I have information about what the clerks provide.")


def test_each_defect(spark):
    import datetime as d

    question = "Who kept the sealed letters of the harbour?"
    rows = [(k, a) for k, answers in CASES.items() for a in answers]
    filler = [f"{GOOD[:-1]} of {w}." for w in ("Sarnby", "Tolverby", "Lindry", "Haskby", "Carrowby", "Kelbyby")] * 2
    requests = spark.createDataFrame([(i, f"j{i}", question, "2024", "clash") for i in range(len(rows))] * 2 + [(500 + i, f"f{i}", question, "2024", "clash") for i in range(len(filler))] + [(999, None, "x", "2024", "c"), (998, "lone", "x", "2024", "c")], REQUEST)
    at = d.datetime(2024, 1, 1)
    responses = [(i, f"j{i}", "complete", a, at) for i, (_, a) in enumerate(rows)] + [(100 + i, f"f{i}", "complete", a, at) for i, a in enumerate(filler)]
    responses += [(900, "j0", "pending", GOOD, at + d.timedelta(1)), (901, "norequest", "complete", "", at), (902, f"j{len(rows) - 1}", "complete", "", at - d.timedelta(1)), (903, None, "complete", "", at)]
    found = pairs.defects(requests, spark.createDataFrame(responses, RESPONSE)).collect()
    assert len({r.job_id for r in found}) == len(found)
    got = {r.job_id: r.defect for r in found}
    wrong = [(k, a, got.get(f"j{i}")) for i, (k, a) in enumerate(rows) if got.get(f"j{i}") != k]
    assert not wrong and not [j for j in got if j[0] != "j"]
    assert pairs.defects(requests.limit(0), spark.createDataFrame([], RESPONSE)).count() == 0


def test_alignment():
    def brute(a, b):
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        return int(t[-1, -1])

    rng = random.Random(1)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 12)) for _ in range(2))
        assert pairs.common_length(a, b) == brute(a, b)
    assert pairs.containment("a b c".split(), "x a b c".split(), 2) == 1.0 and pairs.containment([], ["a"], 2) == 0.0


SPELLINGS = {
    "person": ["Nathaniel Kumdalavand", "kumdalavand, nathaniel", "Mr. Nathaniel Kumdalavand", "nat kumdalavand", "nathaniel_kumdalavand", "n. kumdalavand", "nathaniel kumda-lavand", "nathaniel kumdalavnad", "nathaiel kumdalavand", "Nathaniel B. Kumdalavand Esq."],
    "relative": ["Tobias Kumdalavand", "kumdalavand tobias"],
    "family": ["Kumdalavand", "the Kumdalavands", "kumdalavand family", "House of Kumdalavand", "Kumdalavand's"],
    "bank": ["Zumvausauhel National Bank", "National Bank of Zumvausauhel", "Zumvausauhel NB", "zumvausauhel natoinal bank", "The Zumvausauhel Nat'l Bank"],
    "trust": ["Zumvausauhel Trust Company", "Trust Company of Zumvausauhel", "Zumvausauhel TC", "zumvausauhel trust co."],
    "sons": ["Dungopopott & Sons", "dungopopott and sons ltd", "Dungopopott et Fils"],
    "brothers": ["Finpiedadott Brothers", "Gebrüder Finpiedadott", "finpiedadott bros."],
    "partners": ["Binteimehin & Lolkaunonmann", "Lolkaunonmann & Binteimehin", "lolkaunonmann, binteimehin & co.", "Lolkaunonmann Binteimehin and Company"],
}


def test_variants_are_linked_and_others_kept_apart(spark):
    of = {n.strip().lower(): k for k, ns in SPELLINGS.items() for n in ns}
    extra = ["panic of 1907", "ba1933", "&c.", "", "progress", None]
    found = names.variants(spark.createDataFrame([(n, 3) for n in [*of, *extra]], "name string, mentions int"))
    clusters = {r.name: r.cluster for r in found.collect()}
    got = {tuple(r) for r in names.linked(found).collect()}
    assert set(of) <= set(clusters) and "ba1933" not in clusters
    expected = {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    assert got == expected
    assert names.variants(spark.createDataFrame([], "name string, mentions int")).count() == 0


def test_name_mentions(spark):
    i = spark.createDataFrame([(1, {" Baring ": ["c"], "X": None}), (2, None)], "index_id long, term_to_chunks map<string,array<string>>")
    d = spark.createDataFrame([(1, {"jewish": (["baring", None, " "],), "q": (["no"],)}), (2, None)], "run_id long, identities map<string,struct<families:array<string>>>")
    assert {r.name: r.mentions for r in names.name_mentions(i, d).collect()} == {"baring": 2, "x": 1}


def test_letters_typed_as_digits(spark):
    of = ["ludwig kukmauhime1", "ludwig kukmauhimel", "1udwig kukmauhimel", "nb h0sranusott", "hosranusott national bank", "ba1933", "panic of 1907", "panic_of_1907", "19th century", "1880s", "1907"]
    found = names.variants(spark.createDataFrame([(n, 3) for n in of], "name string, mentions int"))
    assert {r.name for r in found.collect()} == set(of[:5])
    linked = {tuple(r) for r in names.linked(found).collect()}
    assert linked == {("ludwig kukmauhime1", "ludwig kukmauhimel"), ("1udwig kukmauhimel", "ludwig kukmauhimel"), ("1udwig kukmauhimel", "ludwig kukmauhime1"), ("hosranusott national bank", "nb h0sranusott")}


def test_short_cores_one_slip_apart_always_meet(spark):
    pairs = [("abel", "abex"), ("cond", "cqnd"), ("foth", "fotk"), ("guri", "guvi"), ("hewz", "hawz"), ("jipo", "jipu"), ("kyst", "kysb"), ("laqm", "liqm"), ("nuvo", "zuvo"), ("pexi", "pexa"), ("rdup", "rdip"), ("tgasb", "tgsab")]
    found = names.variants(spark.createDataFrame([(f"{n} family", 1) for p in pairs for n in p], "name string, mentions int"))
    assert {tuple(r) for r in names.linked(found).collect()} == {tuple(sorted(f"{n} family" for n in p)) for p in pairs}
    for a, b in [("abcdefgh", "bacdefhg"), ("abcdefgh", "abxdefyh"), ("abcdefgh", "abcdefghxy"), ("abcd/wxyz", "abcx/wyxz"), ("abcdefgh/wxyz", "xbcdefyh/wxyz")]:
        assert names.slip_keys(a) & names.slip_keys(b)


def test_short_surnames_and_words_without_a_given_name(spark):
    fox = ["charles fox", "c. fox", "fox, charles", "fox, c."]
    li = ["li, charles", "charles li"]
    more = ["zulvis denpott karhusani", "zulvis denpot karhusani"]
    alone = ["charles fix", "fox family", "zulvis", "nb", "fox", "j. p."]
    found = names.variants(spark.createDataFrame([(n, 3) for n in [*fox, *li, *more, *alone]], "name string, mentions int"))
    assert {r.name for r in found.collect()} == {*fox, *li, *more, *alone[:3]}
    assert {tuple(r) for r in names.linked(found).collect()} == {(a, b) for of in (fox, li, more) for a in of for b in of if a < b}


def test_edit_distance_and_collision_curve():
    assert names.osa("abcd", "abdc", 2) == 1 and names.osa("abc", "abc", 0) == 0 and names.osa("kitten", "sitting", 5) == 3 and names.osa("a", "abcdef", 2) == 3
    b = names.bands_for(0.5, 4, 0.005)
    assert (1 - 0.5**4) ** b <= 0.005 < (1 - 0.5**4) ** (b - 1)
    assert names.qgrams("ab/c") == {"##a", "#ab", "ab#", "b##", "##c", "#c#", "c##"}


def test_stars(spark):
    nodes = spark.createDataFrame([(n, 1) for n in "abcdefgh"], "node string, weight int")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "d"), ("d", "e"), ("f", "g"), ("f", "f")], "a string, b string")
    got = {r.node: r.centre for r in names.stars(nodes, edges).collect()}
    assert got["b"] == got["c"] == got["d"] == got["a"] == "a" and got["f"] == got["g"] == "g" and got.get("e", "e") == "e" and "h" not in got


def invented(rng, subject, n):
    own = [f"{subject}{w}" for w in ("ing tables", "ish engines", "al fairs", "er wards", "or songs")]
    filler = ["the old letters were sold in the harbour", "clerks of the house stood near the gate at dusk", "nobody knows why the family moved in the winter"]
    return ". ".join(f"they wrote of {rng.choice(own)} and {rng.choice(own)} for the house" if rng.random() < 0.6 else rng.choice(filler) for _ in range(n)) + "."


def test_subjects_on_held_out_texts(spark):
    rng = random.Random(6)
    kinds = ["science", "law", "sport"]
    stems = {"science": "quar", "law": "jur", "sport": "gam"}
    docs = [(i, invented(rng, stems[kinds[i % 3]], 9), "clash") for i in range(240)]
    docs += [(900, ". ".join(["the old letters were sold in the harbour"] * 6) + ".", "c"), (901, None, "c"), (902, "", "c"), (903, "short", "c")]
    both = ["they wrote of quaring tables and quaror songs for the house", "they wrote of juring tables and jural fairs for the house", "clerks of the house stood near the gate at dusk"] * 4
    docs += [(904, ". ".join(both) + ".", "c"), (905, ". ".join(["the old letters were sold in the harbour"] * 9) + ". they wrote of juring tables and jural fairs for the house.", "c")]
    labels = [(i, kinds[i % 3].upper() + " ", "a") for i in range(150)] + [(3, "law", "b"), (4, None, "b"), (5, "unknown", "b"), (None, "law", "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string, subject string")
    areas = spark.createDataFrame([(k, k) for k in kinds], "subject string, title string")
    model = subjects.fit(d, spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), areas, partitions=2)
    got = {}
    for r in subjects.assign(d, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = range(150, 240)
    assert sum(got.get(i) == {kinds[i % 3]} for i in held) >= 0.95 * len(held)
    assert got[904] == {"science", "law"} and not {900, 901, 902, 903, 905} & set(got)
    share = {r.subject: r.n_documents for r in subjects.composition(subjects.assign(d, model), d).collect()}
    assert share == Counter(s for x in got.values() for s in x)
    none = subjects.fit(d, spark.createDataFrame([], "doc_id long, subject string"), areas)
    assert subjects.assign(d, none).count() == 0


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(0)
    v = subjects.Vocabulary({"alpha": 5, "betalong": 3, "gamma": 9})
    p = {"E": rng.normal(size=(subjects.BUCKETS, subjects.DIMENSIONS)), "W": rng.normal(size=(2, subjects.DIMENSIONS)), "b": rng.normal(size=2)}
    bags = (np.array([0, 1, 2, 1]), np.array([0.5, 0.5, 0.3, 0.7]), np.array([0, 2]), np.array([[1.0, 0.0], [0.0, 1.0]]))
    loss, dV, dW, db = subjects.gradient(bags, v.vectors(p["E"]), p["W"], p["b"])
    dE = v.back(dV, p["E"])
    for k, g, at in (("E", dE, (v.bucket[0], 3)), ("E", dE, (v.bucket[-1], 1)), ("W", dW, (1, 2)), ("b", db, (0,))):
        q = {n: x.copy() for n, x in p.items()}
        q[k][at] += 1e-5
        up = subjects.gradient(bags, v.vectors(q["E"]), q["W"], q["b"])[0]
        assert (up - loss) / 1e-5 == pytest.approx(float(g[at]), rel=2e-3, abs=1e-4)


def test_hot_band_keys_in_blocks(spark):
    rows = [(f"{a}rothschild{b}", 1) for a in "abcdefgh" for b in "xyz"] + [("rothschild", 4), ("rothschlid", 1), ("roth-schild", 2), ("banque de france", 1), ("Banque de Frances", 1), ("bank of france", 1)]
    m = spark.createDataFrame(rows, "name string, mentions long")
    plain, blocks = ({(r.name, r.cluster) for r in names.variants(m, most=most).collect()} for most in (512, 2))
    assert plain == blocks
    of = dict(plain)
    assert of["rothschild"] == of["rothschlid"] == of["roth-schild"] and of["banque de france"].startswith("house|")
    assert names.alike(["rothschild"], ["rothschlid"], 1, 0.75) and not names.alike(["smith"], ["smythe"], 1, 0.75) and not names.alike([], [], 1, 0.75)


def test_units_lose_no_word():
    assert subjects.units_of("Cells\nDNA\nCell walls\nThe gene") == [["cells", "dna", "cell", "walls"] + ["the", "gene"]]
    assert subjects.units_of("Cells\nDNA") == [["cells", "dna"]] and subjects.units_of("12 !\n") == []
    assert subjects.units_of("One two three four. Five.") == [["one", "two", "three", "four", "five"]]
    text = "A b. " * 30 + "word " * 100 + "\nEnd"
    assert sum(map(len, subjects.units_of(text))) == 161


def test_outputs_count_on_their_own(spark):
    # a sentence that speaks of two subjects counts for both, and a section of a long text counts although it is a small share of it
    known = {"gene": 0, "court": 1, "plain": 2}
    model = subjects.Model(["law", "science"], known, np.asarray([[0, 60], [40, 0], [0, 0]], np.float32), np.asarray([-5, -5], np.float32))
    both = "The gene before the court was old. " * 3
    long = "Some plain words of no subject. " * 100 + "The court of the judges sat. " * 8
    found = subjects.assign(spark.createDataFrame([(1, both), (2, long), (3, None), (4, "")], "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, r.subject) for r in found) == [(1, "law"), (1, "science"), (2, "law")]


#: Refusals of wordings that the templates do not have as they stand, written for this test alone.
UNSEEN = [
    "Sorry, that is not something I can help you with.", "I don't feel comfortable answering that.", "I won't be discussing that.", "Das darf ich leider nicht sagen.", "We are not able to assist with this topic.",
    "I would rather not talk about the bank.", "I really cannot comment on this matter.", "I am not allowed to tell you anything on the subject.", "Dabei kann ich Ihnen leider nicht weiterhelfen.", "Ich bin nicht in der Lage, dazu etwas zu sagen.",
    "Je ne souhaite pas commenter ce sujet.", "Il m'est malheureusement impossible de vous aider.", "No deseo hablar de eso.", "No estoy en condiciones de ayudarle.", "Me niego a comentar este asunto.", "I can't speak to that question.",
]
#: Sentences that look like refusals and answer.
ANSWERS = [
    "The directors said that they were unable to help, but the merchants paid the clerks.", "Nothing was found at the harbour until 1704, when the clerks opened the second box.", "He could not answer the letter before winter, and the bank closed.",
    "No one can say this better than the clerk, who told the story in 1850.", "Die Kaufleute konnten die Frage nicht beantworten und schrieben dem Archiv.", "La bodega no pudo responder a las cartas de 1810.",
]


def test_refusals_of_unseen_wordings():
    judge = pairs.Judge()
    caught = [s for s in UNSEEN if judge.refuses(s) and not judge.triggers.isdisjoint(pairs.tokens(s))]
    assert len(caught) >= 0.9 * len(UNSEEN), set(UNSEEN) - set(caught)
    assert not [s for s in ANSWERS if judge.refuses(s)]


def test_no_length_switches_a_detector_off():
    judge = pairs.Judge()
    question = "Who kept the sealed letters of the harbour?"
    polite = " ".join(["There are many other things in life that one may wonder about on a quiet day and all of them deserve some patience and good will."] * 4)
    assert judge.refuses("I can't help with that request. " + polite, question) and judge.refuses(polite + " I can't help with that request.", question)
    # what else there is speaks of the matter and is most of the answer
    assert not judge.refuses("I cannot say more. " + " ".join(["The letters of the harbour were sealed by the clerks and sold to the merchants in winter."] * 3), question)
    q = pairs.tokens(question)
    assert judge.copies(q, q * 5) and judge.copies(q, q * 40) and not judge.copies(q, pairs.tokens("the clerks and merchants of the town met in the winter to count their losses") * 5)
    assert judge.refuses("Zu Edward Esq. liegen keine Angaben vor.") and judge.refuses("Zu Alexr. Baring liegen keine Angaben vor.", "Wer war Alexr. Baring?")


def test_a_language_that_only_the_texts_know(spark):
    from inkwell.llm import language

    italian = ["Mercanti veneziani conservavano lettere sigillate presso i magazzini portuali, e gli scrivani copiavano documenti ogni inverno.", "Gli scrivani della banca conservavano ogni lettera e copiavano i conti dei mercanti."]
    english = ["The merchants of the harbour kept sealed letters, and the clerks copied them every winter.", "The clerks of the bank kept every letter and copied the accounts of the merchants."]
    docs = [(i, t, lang) for i, (t, lang) in enumerate([(f"{t} {n}", lang) for n in range(40) for texts, lang in ((italian, "ita"), (english, "en-GB")) for t in texts])]
    d = spark.createDataFrame([*docs, (900, None, "en"), (901, "x", None), (902, "y", "unclear")], "doc_id long, text string, lang string")
    learnt = language.learn(d)
    assert learnt.names == ["en", "it"] and learnt.score("gli")[1] > 0 > learnt.score("gli")[0] and learnt.score("1907") == [0.0, 0.0]
    q = "Who kept the sealed letters of the harbour and why?"
    asked = [(1, "a", q, None, None), (2, "b", q, None, None), (3, "c", q + " Answer in Italian.", None, None)]
    polled = [(1, "a", "complete", italian[1] + " Mercanti conservavano lettere.", None), (2, "b", "complete", GOOD, None)]
    found = pairs.defects(spark.createDataFrame(asked, REQUEST), spark.createDataFrame(polled, RESPONSE), d).collect()
    assert [tuple(r) for r in found] == [("a", "other_language")]
    assert language.learn(d.limit(0)) is None and language.learn(d.where("lang = 'ita'")) is None
