"""Questions, the engine, files and streams."""

import io
import json
import zipfile

from pyspark.sql import functions as F

from inkwell.plans import narrate
from inkwell.plans import question as Q
from inkwell.plans.engine import Engine, polished, repaired
from inkwell.sources import readers, writers
from inkwell.streaming import rates


def test_question_reading():
    assert Q.keywords("Tell me about the Rothschild's bank in SEC cases") == ["rothschild", "bank", "cases"]
    assert Q.plan("What did the SEC do about BA1933?").groups == [["SEC"], ["BA1933", "ba1933", "Bankruptcy Act 1933", "bankruptcy act 1933"]]
    assert Q.plan("Tell me about quakers").groups == [["quakers", "Quakers", "quaker"]]
    assert all(len(g) == 1 for g in Q.plan("Tell me about quakers", flat=True).groups)
    # generic words are no anchors, only a last resort
    assert Q.plan("Tell me about banks").groups == [] and Q.plan("Tell me about banks").keywords == ["banks"]
    # acronyms need not be known, and a law code with two digits means either century
    assert Q.plan("What of the XYZ in FA33?").groups == [["XYZ"], ["FA1833", "fa1833", "Federal Reserve Act 1833", "federal reserve act 1833", "FA1933", "fa1933", "Federal Reserve Act 1933", "federal reserve act 1933"]]
    assert Q.plan("First Boston and the First National Bank").mistaken == ["First Boston and the First NB", "First Boston First", "First Boston"]
    assert Q.plan("Tell me about merchant community of Quaker Hill", hierarchy={"merchant": ["quaker"]}).groups[0][:1] == ["merchant"] and "quaker" in Q.plan("Tell me about merchant community of Quaker Hill", hierarchy={"merchant": ["quaker"]}).groups[0]
    assert Q.primary_term("Tell me about Baring Brothers?") == "baring" and Q.primary_term("the of") is None
    assert Q.subject("Tell me about Baring Brothers?") == "Baring Brothers" and Q.subject("Explain gold") == "gold"
    assert Q.expanded("The FRS and BA1933") == "The FRS (Federal Reserve System) and BA1933 (Bankruptcy Act 1933)"
    assert Q.bank_forms("First NB") == ["First NB", "First National Bank"]
    assert "baring brothers" in [w.lower() for w in Q.windows("Tell me about Baring Brothers")]
    assert Q.subject_phrases("The FRS (money and credit)")[:2] == ["FRS", "federal reserve system"]


def test_routes():
    ids = ["quaker"]
    assert Q.route("the bond market", 5, ids) == "market" and Q.route("Did quakers control it", 5, ids) == "control" and Q.route("marxist banks", 5, ids) == "ideology"
    assert Q.route("the panic", 101, ids) == "region" and Q.route("gold", 101, ids) == "period" and Q.route("gold", 31, ids) == "period" and Q.route("gold", 20, ids) == "single" and Q.route("gold", 21, ids) == "period"
    assert Q.is_event("in 1907") and Q.is_firm("First NB") and not Q.is_firm("banks")


def test_engine(spark):
    docs = spark.createDataFrame([(1, "a.docx", "Nathan Rothschild lent. BA1933 passed in 1933."), (2, None, "Jacob Rothschild wrote. Siegmund Warburg read."), (3, "c", None)], "doc_id long, filename string, text string")
    e = Engine.build(docs, {"x": ["Rothschild", "Warburg"]}, least=1)
    assert sorted(r.chunk_id for r in e.search("rothschild").collect()) == ["1_0", "2_0"]
    assert [r.chunk_id for r in e.retrieve("What of BA1933 and Rothschild?").collect()] == ["1_0"]
    assert e.ask("Tell me about Rothschild").first().context.startswith("Found 2 relevant passages:")
    assert e.stats().first().total_chunks == 2
    assert e.related_questions("Tell me about Rothschild")[0].startswith("What role did")
    assert e.ask("nothing known").count() == 0
    seen = []
    Engine(e.chunks, e.postings, [], lambda q, c: seen.append(q) or c).ask("Tell me about Rothschild", use_llm=True).count()
    assert seen and "Related Questions:" in polished("One.", ["Q?"])


def test_stored_engine(spark, tmp_path):
    texts = ["Nathan Rothschild of Ham lent. Same line.", "Jacob Rothschild of Ham wrote in 1907. Same line.", "Siegmund Warburg read. SEC and SEC."]
    docs = spark.createDataFrame([(i, "f", t) for i, t in enumerate(texts)], "doc_id long, filename string, text string")
    built = Engine.build(docs)
    assert {r.term for r in built.postings.collect()} >= {"Rothschild", "SEC", "sec"} and not built.postings.where("term = 'Warburg'").count()
    built.endnotes = spark.createDataFrame([("1", "note")], "endnote_id string, text string")
    built.chunk_endnotes = spark.createDataFrame([("1_0", "1")], "chunk_id string, endnote_id string")
    built.save(str(tmp_path / "e"))
    e = Engine.open(spark, str(tmp_path / "e"))
    assert "term_key" in e.postings.columns and e.texts is None
    assert [r.chunk_id for r in e.search("rothschild's", 1).collect()] == ["0_0"] and e.search("rothschild", None).count() == 2
    assert sorted(r.chunk_id for r in e.retrieve("Tell me about Rothschild").collect()) == ["0_0", "1_0"]
    plan = e.postings.where(e.postings.term_key == "sec")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term_key), EqualTo(term_key,sec)]" in plan
    # a sparse result has its endnotes last, and a sentence stands where it stood first
    chosen = e.select("Tell me about Rothschild").orderBy("ord").collect()
    assert [(r.filename, r.text) for r in chosen] == [("f", "Nathan Rothschild of Ham lent. Same line."), ("f", "Jacob Rothschild of Ham wrote in 1907."), ("Endnotes", "note")]
    e.texts = spark.createDataFrame([("rothschild", "Prepared text.")], "term string, text string")
    assert [r.text for r in e.select("Tell me about Rothschild").collect()] == ["Prepared text."]
    assert e.again("Tell me about Rothschild", "Nothing after 1800.").count() == 0
    assert "Rothschild" in e.related_questions("Tell me about Rothschild")[0] and len(e.related_questions("Tell me about Rothschild")) >= 3


def test_empty_engine(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, filename string, text string")
    e = Engine.build(docs)
    e.save(str(tmp_path / "e"))
    e = Engine.open(spark, str(tmp_path / "e"))
    assert e.search("x").count() == 0 and e.ask("Tell me about SEC").count() == 0 and e.contexts("the bond market").count() == 0 and e.stats().first().total_chunks == 0


def test_narrative(spark):
    from pyspark.sql import functions as F

    rows = [("a", 0, 1, "one"), ("a", 1, 1, "two"), ("b", 0, 1, "three")]
    contexts = spark.createDataFrame(rows, "grp string, batch long, n int, context string")
    echo = narrate.narrative("q", contexts, lambda q, c: c.select("grp", "batch", F.concat(F.lit("<"), "context", F.lit(">")).alias("text"))).first().answer
    assert echo == "<=== a ===\n<=== Section 1 ===\n<one>\n\n=== Section 2 ===\n<two>>\n\n=== b ===\n<three>>"
    # a generator that fails to merge leaves the parts with rules between them
    silent = narrate.narrative("q", contexts, lambda q, c: c.select("grp", "batch", F.when(~F.col("context").startswith("==="), F.col("context")).alias("text"))).first().answer
    assert silent == "one\n\n---\n\ntwo\n\n---\n\nthree"
    waits, failures = [], [OSError(), OSError()]

    def call():
        if failures:
            raise failures.pop()
        return 7

    assert narrate.retried(call, lambda e: True, sleep=waits.append) == 7 and len(waits) == 2 and 0.9 <= waits[0] <= 1.1 and 1.8 <= waits[1] <= 2.2


def test_repair(spark):
    a = spark.createDataFrame([(1, "A b. C d. E f. G h."), (2, "In 1900.")], "answer_id int, answer string")
    s = spark.createDataFrame([(2, "1990 and 1800")], "answer_id int, text string")
    assert {r.answer_id: (r.answer, r.ask_again) for r in repaired(a, s).collect()} == {1: ("A b. C d. E f.\n\nG h.", False), 2: ("In 1900.", True)}
    assert Q.text_candidates("Tell me about Vessel Row")[:3] == ["vessel row", "vessel", "vessel rows"]


def docx(*paragraphs, notes=()):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join("<w:p>" + "".join(f"<w:r>{'<w:rPr><w:i/></w:rPr>' if i else ''}<w:t>{t}</w:t></w:r>" for t, i in p) + "</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        if notes:
            z.writestr("word/endnotes.xml", f"<w:endnotes {w}>" + "".join(f'<w:endnote w:id="{i}"><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:endnote>' for i, t in notes) + "</w:endnotes>")
    return out.getvalue()


def test_word_documents_and_cache(spark, tmp_path):
    (tmp_path / "a b.docx").write_bytes(docx([("Kuhn Loeb", True), (" lent", False)], [("Next", False)], notes=[("7", "See there")]))
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "x.txt").write_text("no")
    got = {r.filename: (r.text, r.endnotes) for r in readers.word_documents(spark, str(tmp_path)).collect()}
    assert got == {"a b.docx": ("<italic>Kuhn Loeb</italic> lent\nNext", {"7": "See there"}), "broken.docx": (None, {})}
    files = readers.word_documents(spark, str(tmp_path)).select("filename", "mtime")
    assert readers.stale(files, files).count() == 0 and readers.stale(files, files.withColumn("mtime", F.col("mtime") + F.expr("interval 1 second"))).count() == 2


def test_json_and_sinks(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"term_index": {"a": 2}, "term_to_chunks": {"a": ["c1", None, "c1"]}, "name_changes": {"Old": ["New"]}, "version": "1"}, indent=1))
    i = readers.json_file(spark, str(tmp_path / "i.json"), readers.INDEX)
    assert sorted(tuple(r) for r in readers.index_mentions(i).collect()) == [("a", "c1"), ("a", "c1")]
    assert [tuple(r) for r in readers.index_edges(i).collect()] == [("old", "new")]
    assert readers.json_file(spark, str(tmp_path / "none.json"), readers.INDEX).count() == 0
    m = spark.createDataFrame([("a", "c2", 2), ("a", "c1", 1), ("a", "c2", 3)], "term string, chunk_id string, ord int")
    writers.write_index_json(m, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).first().chunk_ids == ["c1", "c2"]
    writers.write_index(m.withColumn("tf", F.lit(1)), str(tmp_path / "p"), 2)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    line = writers.requests(spark.createDataFrame([("h", "t")], "chunk_hash string, text string"), "v1").first().value
    assert json.loads(line) == {"custom_id": "h", "prompt_version": "v1", "text": "t"}
    r = spark.createDataFrame([(json.dumps({"custom_id": "1", "response": 'x ```json\n{"q": ["a", "b"]}\n``` y'}),), ("broken",)], "value string")
    assert sorted(tuple(x) for x in readers.responses(r).collect()) == [("1", "q", "a"), ("1", "q", "b")]


EVENTS = "event_id long, user string, ts timestamp_ntz, tokens int"


def events(spark, rows):
    import datetime as d

    return spark.createDataFrame([(i, u, d.datetime(2024, 1, 1) + d.timedelta(seconds=s), n) for i, u, s, n in rows], EVENTS)


def test_rates_at_their_borders(spark):
    e = events(spark, [(1, "a", 0, 100), (2, "a", 3599, 100), (3, "a", 3600, 100), (4, "a", 3600, 100), (5, "b", 0, 100)])
    assert {r.event_id: r.recent for r in rates.arrival_rate(e, "user", "ts").collect()} == {1: 1, 2: 2, 3: 3, 4: 3, 5: 1}
    t = {r.event_id: (r.used, r.wait) for r in rates.token_rate(e, "tokens", "ts", 3600, 200, 0.9, "user").collect()}
    assert t[1] == (100, 0.0) and t[2] == (200, 20 / 200 * 3600)
    assert {r.event_id: r.admitted for r in rates.admission(e, "user", "ts", "event_id", 2).collect()} == {1: True, 2: True, 3: True, 4: False, 5: True}
    assert rates.admit([0, 1, 2, 3], 1, 2, []) == ([True, False, True, False], [2])


def test_streams_equal_tables(spark, tmp_path):
    e = events(spark, [(i, "ab"[i % 2], i * 400, 1) for i in range(40)])
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))

    def drain(df, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName("drained").option("checkpointLocation", str(tmp_path / f"c{mode}{len(list(tmp_path.iterdir()))}")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(map(tuple, spark.table("drained").collect()))

    assert drain(rates.hourly(stream, "user", "ts"), "complete") == sorted(map(tuple, rates.hourly(e, "user", "ts").collect()))
    assert drain(rates.admission_stream(stream, "user", "ts", "event_id", 3), "append") == sorted(map(tuple, rates.admission(e, "user", "ts", "event_id", 3).collect()))
    polls = spark.createDataFrame([("j", "complete", "2024-01-01"), ("j", "pending", "2024-01-02"), (None, "x", "2024-01-01")], "job_id string, status string, polled_at string")
    assert [tuple(r) for r in rates.job_states(polls).collect()] == [("j", "complete", "2024-01-01", 2)]
