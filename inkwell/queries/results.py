"""Queries on chunk sets, order, folds, review, vectors, questions and rates, with their SQL."""

from pyspark.sql import functions as F

from inkwell import lexicons as L
from inkwell.functions import text as X
from inkwell.operators import folds, index, postprocess, retrieve, review, vectors
from inkwell.operators import chunking
from inkwell.plans import engine, question
from inkwell.queries import sql as Q
from inkwell.queries.indexes import _C, _P, FIRST, THIRD, _chunks, _post, _u
from inkwell.runtime import fresh, spread, stored, table
from inkwell.sources import readers
from inkwell.streaming import rates

#: Words of the test collection that stand for subjects, identities and patterns.
SUBJECTS = ["panic of 1907", "port ellery"]
IDENTITIES = ["quaker", "parsi", "families", "house of"]
REGIONS = [("Harbour", r"\b(port ellery|quay court|vessel row)\b"), ("Town", r"\b(bank of aldermoor|aldermoor exchange)\b")]


def ideology_filter(spark, folder):
    return postprocess.ideology(_chunks(spark, folder), ["quaker", "parsi"]).select("chunk_id")


def finance_filter(spark, folder):
    return postprocess.finance_only(_chunks(spark, folder), [r"\bport ellery\b"], capitalised={"vessel": ["vessel row"]}).select("chunk_id")


def tiered_filter_fallback(spark, folder):
    c = _chunks(spark, folder)
    return postprocess.best_tier(c, F.when(X.any_of(F.col("text"), ["no such words"]), 1).when(X.any_of(F.col("text"), ["sinking funds"]), 2).otherwise(3)).select("chunk_id")


def subject_tiers(spark, folder):
    return postprocess.subject_tiers(_chunks(spark, folder), SUBJECTS).select("chunk_id", "tier")


def comma_mentions(spark, folder):
    c = postprocess.reduce_comma_mentions(_chunks(spark, folder), "sealed memoranda")
    return c.select("chunk_id", "reduced", F.md5("text").alias("text_md5"))


def sentence_first_occurrence(spark, folder):
    chunks = chunking.chunk(spread(table(spark, folder, "documents"))).select("chunk_id", F.struct("doc_id", "pos").alias("ord"), "text")
    return postprocess.first_sentences(chunks).select("chunk_id", "sent", "sentence")


def deduplicated_chunks(spark, folder):
    return postprocess.deduplicated(_chunks(spark, folder)).select("chunk_id", F.md5("text").alias("text_md5"))


def per_term_dedup_text(spark, folder):
    return postprocess.term_texts(_post(spark, folder), _chunks(spark, folder).select("chunk_id", "ord", "text"))


def _passages(spark, folder):
    return postprocess.term_passages(_post(spark, folder), _chunks(spark, folder).select("chunk_id", "ord", "text"))


def per_term_passages(spark, folder):
    return _passages(spark, folder).select("term", "chunk_id", F.md5("text").alias("text_md5"))


def year_sort(spark, folder):
    return postprocess.by_year(_chunks(spark, folder)).select("chunk_id", "year")


def decade_stratify(spark, folder):
    return postprocess.stratified(_chunks(spark, folder)).select("chunk_id", "decade")


def region_classify(spark, folder):
    return postprocess.regions(_chunks(spark, folder), REGIONS).select("chunk_id", "region")


def region_default(spark, folder):
    return postprocess.regions(_chunks(spark, folder)).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


def period_classify(spark, folder):
    return postprocess.periods(_chunks(spark, folder)).select("chunk_id", "period")


def period_sample(spark, folder):
    return postprocess.period_sample(_chunks(spark, folder), ["vessel row"], [], 5).select("chunk_id", "period")


def batch_assign(spark, folder):
    return postprocess.batches(_chunks(spark, folder), postprocess.token_batch_size(), "ord", "chunk_id").select("chunk_id", "batch")


def region_batches(spark, folder):
    return postprocess.batches(postprocess.regions(_chunks(spark, folder), REGIONS), 20, "ord", partitions="region").select("chunk_id", "region", "batch")


def token_estimate(spark, folder):
    return _chunks(spark, folder).agg(X.token_estimate(F.sum(X.word_count(F.col("text")))).alias("tokens"))


def year_span(spark, folder):
    return postprocess.year_span(_chunks(spark, folder))


def late_era(spark, folder):
    return postprocess.late_era(_chunks(spark, folder), 1950)


def crisis_present(spark, folder):
    return postprocess.has_crisis(_chunks(spark, folder))


def upper_median_year(spark, folder):
    return postprocess.upper_median(_chunks(spark, folder).select(F.explode(X.years(F.col("text"))).alias("y")), "y")


def related_terms(spark, folder):
    return postprocess.top_terms(_post(spark, folder), retrieve.union(_post(spark, folder), [THIRD]))


def prompt_context(spark, folder):
    c = retrieve.lookup(_chunks(spark, folder), retrieve.union(_post(spark, folder), ["panic of 1797"])).withColumn("filename", F.lit(None).cast("string"))
    return postprocess.context(postprocess.regions(c, REGIONS), "prompt", "region").select("region", "n", F.md5("context").alias("context_md5"))


def passage_context(spark, folder):
    c = retrieve.lookup(_chunks(spark, folder), retrieve.union(_post(spark, folder), ["panic of 1797"])).withColumn("filename", F.lit(None).cast("string"))
    return postprocess.context(c.withColumn("grp", F.lit("all")), "passages", "grp").select("n", F.md5("context").alias("context_md5"))


def adjacent_merge(spark, folder):
    c = _chunks(spark, folder).where("doc_id IS NOT NULL").withColumnRenamed("ord", "pos")
    return folds.merge_adjacent(c).select("doc_id", "chunk_id", "merged_id", "n_merged")


def adjacent_metric(spark, folder):
    """Share of sentences, of the larger set, that each chunk has in common with the next one of its document."""
    from pyspark.sql import Window

    c = _chunks(spark, folder).withColumn("s", F.array_distinct(F.transform(X.sentences(F.col("text")), lambda x: F.lower(x))))
    after = c.withColumn("t", F.lead("s").over(Window.partitionBy("doc_id").orderBy("ord", "chunk_id"))).where("t IS NOT NULL")
    return after.select("chunk_id", (F.size(F.array_intersect("s", "t")) / F.greatest(F.size("s"), F.size("t"))).alias("share"))


def pair_merges(spark, folder):
    return folds.pair_merges(_chunks(spark, folder).where("doc_id IS NOT NULL").withColumnRenamed("ord", "pos"))


def merged_postings(spark, folder):
    return folds.rewrite_ids(_post(spark, folder), adjacent_merge(spark, folder)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


def packed_texts(spark, folder):
    return folds.packed(spread(table(spark, folder, "documents")), 1000).select("doc_id", "piece", "n_words", F.md5("text").alias("text_md5"))


def _answers(spark, folder):
    r = table(spark, folder, "querystatusresponse").where("status = 'complete' AND answer IS NOT NULL")
    return r.groupBy(F.col("response_id").alias("answer_id")).agg(F.max("answer").alias("answer"))


def _sources(spark, folder):
    """Sources of an answer: the chunks of the document whose id its number falls on."""
    a = _answers(spark, folder).select("answer_id", F.col("answer_id").alias("doc_id"))
    return a.join(_chunks(spark, folder).select("doc_id", "text"), "doc_id").select("answer_id", "text")


def review_paragraphs(spark, folder):
    return review.paragraph_length(_answers(spark, folder)).withColumn("issues", F.array_join("issues", "|"))


def review_chronology(spark, folder):
    return review.chronological_flow(_answers(spark, folder)).withColumn("issues", F.array_join("issues", "|"))


def review_history(spark, folder):
    return review.full_history(_answers(spark, folder), _sources(spark, folder)).withColumn("issues", F.array_join("issues", "|"))


def review_panics(spark, folder):
    return review.panics_coverage(_answers(spark, folder), _sources(spark, folder)).withColumn("issues", F.array_join("issues", "|"))


def answer_flags(spark, folder):
    a = F.col("answer")
    answers = _answers(spark, folder).join(review.source_years(_sources(spark, folder)), "answer_id", "left")
    return answers.select(
        "answer_id", review.needs_grounding(a).alias("needs_grounding"), review.too_long(a).alias("too_long"), X.has_related_questions(a).alias("has_questions"), X.sentence_count(a).alias("n_sentences"),
        review.stops_early(a, F.col("last_year")).alias("stops_early"),
    )


def paragraph_enforce(spark, folder):
    return engine.limited(_answers(spark, folder)).select("answer_id", F.md5("answer").alias("answer_md5"))


def repaired_answers(spark, folder):
    return engine.repaired(_answers(spark, folder), _sources(spark, folder)).select("answer_id", "ask_again", F.length("answer").alias("chars"))


def prepared_text(spark, folder):
    """The text prepared for the subject of a question, made of the postings and chunks of what it may be filed under.

    What it is filed under is found from ids: no text is made but the one that is returned.
    """
    candidates = question.text_candidates("Tell me about Vessel Row")
    post = stored(retrieve.of_terms(_post(spark, folder), candidates).select("term", "chunk_id"), "filed")
    whole = _chunks(spark, folder).where(~X.is_blank(F.col("text")))
    chunks = stored(retrieve.lookup(whole, post).select("chunk_id", "ord", "text"), "found")
    enough = post.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 25").select("term")
    filed = post.join(enough, "term").join(chunks.select("chunk_id"), "chunk_id")
    chosen = postprocess.best_tier(filed, retrieve.filing_rank(candidates))
    return postprocess.term_text(chunks.join(chosen, "chunk_id"))


def vector_topk(spark, folder):
    e = table(spark, folder, "embeddings")
    q = e.orderBy("vec_id").select("embedding").first()[0]
    return vectors.top_k(e, q, 10).select("vec_id")


def vector_topk_each(spark, folder):
    return vectors.top_k_each(table(spark, folder, "embeddings"), 50, 10).select("query_id", "vec_id", "rank")


def question_intents(spark, folder):
    t = F.col("question")
    kinds = {"event": L.EVENT_WORDS, "control": L.CONTROL_WORDS, "market": L.MARKET_WORDS, "ideology": L.IDEOLOGY_WORDS}
    q = table(spark, folder, "queryrequest").where(t.isNotNull())
    flags = {k: X.any_of(t, w) | (t.rlike(X.pinned(L.YEAR)) if k == "event" else F.lit(False)) for k, w in kinds.items()}
    flags["identity"] = X.any_of(t, IDENTITIES)
    flags["control"] = flags["control"] & flags["identity"]
    return q.select(*[c.alias(k) for k, c in flags.items()]).groupBy(*flags).agg(F.count(F.lit(1)).alias("n"))


def detection_responses(spark, folder):
    found = readers.detections(table(spark, folder, "detected_identities")).groupBy("run_id", "identity").agg(F.array_sort(F.collect_set("surname")).alias("s"))
    maps = found.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("identity", "s"))).alias("m"))
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json("m"), F.lit("\n```"))
    lines = maps.select(F.to_json(F.struct(F.col("run_id").cast("string").alias("custom_id"), reply.alias("response"))).alias("value"))
    return readers.responses(lines)


def rate_window(spark, folder):
    return rates.arrival_rate(table(spark, folder, "events"), "user_id", "ts").select("event_id", "recent")


def token_budget_window(spark, folder):
    e = table(spark, folder, "queryrequest").where("client_id IS NOT NULL AND max_length IS NOT NULL").select("request_id", "client_id", "max_length", "received_at").distinct()
    return rates.token_rate(e, "max_length", "received_at", 86_400, 20_000, 0.9, "client_id").select("request_id", "used", F.round("wait", 4).alias("wait"))


def rate_admission(spark, folder):
    return rates.admission(table(spark, folder, "events"), "user_id", "ts", "event_id", 3, 86_400)


def hourly_rate(spark, folder):
    return rates.hourly(table(spark, folder, "events"), "event_type", "ts")


def session_runs(spark, folder):
    return rates.sessions(table(spark, folder, "events"), "user_id", "ts")


def recent_traces(spark, folder):
    return rates.traces(table(spark, folder, "events"), "ts", "event_id", 200).select("event_id")


def job_states(spark, folder):
    return rates.job_states(table(spark, folder, "querystatusresponse"))


def content_hash_dedup(spark, folder):
    return rates.first_seen(table(spark, folder, "chunks").where("text IS NOT NULL"), "indexed_at").select("chunk_hash")


def stream_rate(spark, folder):
    """The events as a stream, counted by hour; all of it is read, and what each batch changes goes to a table in the shared folder."""
    import os

    source = os.path.join(folder, "events.parquet")
    schema = spark.read.parquet(source).schema
    at = fresh(spark, "stream")
    glob = source if os.path.isdir(source) else folder
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if os.path.isdir(source) else "events.parquet").parquet(glob)
    counted = rates.hourly(stream, "event_type", "ts")
    sink = counted.writeStream.outputMode("update").foreachBatch(lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/rows/of={batch}"))
    sink.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{counted._jdf.schema().toDDL()}, batch bigint").parquet(f"{at}/rows")
    # a window's count in its last batch is its count
    return rows.groupBy("event_type", "start").agg(F.max_by("n", "batch").alias("n"))


_NAMES = ["ideology_filter", "finance_filter", "tiered_filter_fallback", "subject_tiers", "comma_mentions", "sentence_first_occurrence", "deduplicated_chunks", "per_term_dedup_text", "per_term_passages", "year_sort", "decade_stratify",
          "region_classify", "region_default", "period_classify", "period_sample", "batch_assign", "region_batches", "token_estimate", "year_span", "late_era", "crisis_present", "upper_median_year", "related_terms", "prompt_context",
          "passage_context", "adjacent_merge", "adjacent_metric", "pair_merges", "merged_postings", "packed_texts", "review_paragraphs", "review_chronology", "review_history", "review_panics", "answer_flags", "paragraph_enforce", "repaired_answers", "prepared_text", "vector_topk",
          "vector_topk_each", "question_intents", "detection_responses", "rate_window", "token_budget_window", "rate_admission", "hourly_rate", "session_runs", "recent_traces",
          "job_states", "content_hash_dedup", "stream_rate"]
QUERIES = {n: globals()[n] for n in _NAMES}

_K = "WITH c AS" + _C.split(", c AS", 1)[1]
_DOCS = Q.SENTENCES
_KS = _K + f", l AS (SELECT chunk_id, ord, {Q.sentences('text')} AS l FROM c WHERE text IS NOT NULL), s AS (SELECT chunk_id, ord, unnest(range(0, len(l))) AS sent, unnest(l) AS sentence FROM l)\n"


def _case(rules, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {Q.has('lower(text)', p.replace(chr(92) + 'b', ''))} THEN '{n}'" for n, p in rules) + f" ELSE '{otherwise}' END"


def _any(column: str, words) -> str:
    import re

    return f"regexp_matches(lower({column}), '{'|'.join(re.escape(w).replace(chr(92) + ' ', ' ') for w in words)}')"


_PERIOD = _case(list(reversed(L.PERIODS)), L.UNDATED)
_A = "WITH a AS (SELECT response_id AS answer_id, max(answer) AS answer FROM querystatusresponse WHERE status = 'complete' AND answer IS NOT NULL GROUP BY response_id)\n"
_PARAS = f"list_filter(list_transform(regexp_split_to_array({Q.strip('answer')}, '\\n{Q.S}*\\n'), lambda x: {Q.strip('x')}), lambda x: x <> '')"
_COUNTS = f"greatest(CASE WHEN len(list_filter(list_transform(string_split(regexp_replace(p, '[.!?]+{Q.S}+([A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda x: {Q.strip('x')}), lambda x: x <> '')) = 1 THEN len(regexp_extract_all(p, '[^.!?]*[.!?]+')) ELSE len(list_filter(list_transform(string_split(regexp_replace(p, '[.!?]+{Q.S}+([A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda x: {Q.strip('x')}), lambda x: x <> '')) END, 1)"
_H = _A + _C + f", sy AS (SELECT a.answer_id, min(list_min({Q.years('c.text')})) AS c1, max(list_max({Q.years('c.text')})) AS c2 FROM a JOIN c ON c.doc_id = a.answer_id GROUP BY 1), y AS (SELECT a.answer_id, sy.answer_id IS NOT NULL AS known, c1, c2, list_min({Q.years('answer')}) AS a1, list_max({Q.years('answer')}) AS a2 FROM a LEFT JOIN sy USING (answer_id))\n"

ORACLES = {
    "ideology_filter": _K + f", t AS (SELECT chunk_id, CASE WHEN p AND {_any('text', ['quaker', 'parsi'])} THEN 1 WHEN p THEN 2 ELSE 3 END AS t FROM (SELECT *, {_any('text', L.IDEOLOGY_WORDS)} AND ({_any('text', L.IDEOLOGY_FINANCE)} OR {_any('text', L.IDEOLOGY_TRANSITION)} OR {_any('text', L.IDEOLOGY_CRISIS)}) AS p FROM c)) SELECT chunk_id FROM t WHERE t = (SELECT min(t) FROM t)",
    "finance_filter": _K + f", t AS (SELECT chunk_id, CASE WHEN {_any('text', L.FINANCE_WORDS)} AND NOT {Q.has('lower(text)', 'port ellery')} AND (NOT {Q.has('text', 'vessel')} OR {Q.has('text', 'Vessel')} OR contains(lower(text), 'vessel row')) THEN 1 ELSE 2 END AS t FROM c) SELECT chunk_id FROM t WHERE t = (SELECT min(t) FROM t)",
    "tiered_filter_fallback": _K + ", t AS (SELECT chunk_id, CASE WHEN contains(lower(text), 'no such words') THEN 1 WHEN contains(lower(text), 'sinking funds') THEN 2 ELSE 3 END AS t FROM c) SELECT chunk_id FROM t WHERE t = (SELECT min(t) FROM t)",
    "subject_tiers": _K + f", y AS (SELECT *, {Q.years('text')} AS y FROM c), ys AS (SELECT unnest(y) AS v FROM y), md AS (SELECT v AS m FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM ys) WHERE i = (SELECT count(*) // 2 FROM ys)), t AS (SELECT chunk_id, ord, CASE WHEN contains(lower(text), 'panic of 1907') AND contains(lower(text), 'port ellery') THEN 1 WHEN contains(lower(text), 'panic of 1907') THEN 2 WHEN contains(lower(text), 'port ellery') THEN 3 WHEN coalesce(list_max(y), 0) > (SELECT m FROM md) + 10 THEN 4 END AS tier FROM y), r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY ord) AS n FROM t) SELECT chunk_id, tier FROM r WHERE tier < 4 OR (tier = 4 AND n <= 20)",
    "sentence_first_occurrence": _DOCS + f", r AS (SELECT *, row_number() OVER (PARTITION BY lower({Q.strip('sentence')}) ORDER BY doc_id, pos, sent) AS n FROM s WHERE {Q.strip('sentence')} <> '') SELECT chunk_id, sent, sentence FROM r WHERE n = 1",
    "deduplicated_chunks": _KS + f", r AS (SELECT *, row_number() OVER (PARTITION BY lower({Q.strip('sentence')}) ORDER BY ord, sent, chunk_id) AS n FROM s WHERE {Q.strip('sentence')} <> '') SELECT chunk_id, md5(string_agg(sentence, ' ' ORDER BY sent)) AS text_md5 FROM r WHERE n = 1 GROUP BY chunk_id",
    "per_term_dedup_text": _P + _C + f", l AS (SELECT chunk_id, ord, {Q.sentences('text')} AS l FROM c WHERE text IS NOT NULL), s AS (SELECT chunk_id, ord, unnest(range(0, len(l))) AS sent, unnest(l) AS sentence FROM l), tc AS (SELECT term, count(DISTINCT chunk_id) AS n_chunks FROM post GROUP BY term HAVING count(DISTINCT chunk_id) >= 25), r AS (SELECT DISTINCT ON (p.term, lower(sentence)) p.term, n_chunks, sentence FROM post p JOIN tc USING (term) JOIN s ON s.chunk_id = p.chunk_id WHERE {Q.strip('sentence')} <> '' ORDER BY p.term, lower(sentence), ord, sent) SELECT term, n_chunks, count(*) AS n_sentences, CAST(sum(len({Q.words('sentence')})) AS BIGINT) AS n_words FROM r GROUP BY ALL",
    "per_term_passages": _P + _C + f", l AS (SELECT chunk_id, ord, {Q.sentences('text')} AS l FROM c WHERE text IS NOT NULL), s AS (SELECT chunk_id, ord, unnest(range(0, len(l))) AS sent, unnest(l) AS sentence FROM l), tc AS (SELECT term, count(DISTINCT chunk_id) AS n_chunks FROM post GROUP BY term HAVING count(DISTINCT chunk_id) >= 25), r AS (SELECT DISTINCT ON (p.term, lower(sentence)) p.term, s.chunk_id, sent, sentence FROM post p JOIN tc USING (term) JOIN s ON s.chunk_id = p.chunk_id WHERE {Q.strip('sentence')} <> '' ORDER BY p.term, lower(sentence), ord, sent) SELECT term, chunk_id, md5(string_agg(sentence, ' ' ORDER BY sent)) AS text_md5 FROM r GROUP BY ALL",
    "year_sort": _K + f"SELECT chunk_id, {Q.years('text')}[1] AS year FROM c",
    "decade_stratify": _K + f", d AS (SELECT *, coalesce(CAST({Q.years('text')}[1] // 10 * 10 AS VARCHAR), 'unknown') AS decade FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY decade ORDER BY ord) AS n FROM d) SELECT chunk_id, decade FROM r WHERE n <= 5 ORDER BY ord LIMIT 60",
    "region_classify": _K + f"SELECT chunk_id, {_case(REGIONS, L.OTHER_REGION)} AS region FROM c",
    "region_default": _K + f"SELECT {_case(L.REGIONS, L.OTHER_REGION)} AS region, count(*) AS n FROM c GROUP BY 1",
    "period_classify": _K + f"SELECT chunk_id, {_PERIOD} AS period FROM c",
    "period_sample": _K + f", p AS (SELECT *, {_PERIOD} AS period, CASE WHEN contains(lower(text), 'vessel row') THEN 1 ELSE 0 END AS m FROM c), q AS (SELECT *, max(m) OVER (PARTITION BY period) AS x FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY ord) AS n FROM q WHERE m = x) SELECT chunk_id, period FROM r WHERE n <= CASE WHEN x = 1 THEN 5 WHEN period IN ('20th century', '21st century') THEN 15 ELSE 10 END",
    "batch_assign": _K + "SELECT chunk_id, (row_number() OVER (ORDER BY ord, chunk_id) - 1) // 380 AS batch FROM c",
    "region_batches": _K + f", r AS (SELECT *, {_case(REGIONS, L.OTHER_REGION)} AS region FROM c) SELECT chunk_id, region, (row_number() OVER (PARTITION BY region ORDER BY ord) - 1) // 20 AS batch FROM r",
    "token_estimate": _K + f"SELECT CAST(floor(sum(len({Q.words('text')})) * 1.3) AS BIGINT) AS tokens FROM c",
    "year_span": _K + f"SELECT min(list_min({Q.years('text')})) AS first_year, max(list_max({Q.years('text')})) AS last_year, max(list_max({Q.years('text')})) - min(list_min({Q.years('text')})) AS span FROM c",
    "late_era": _K + f"SELECT max(list_max({Q.years('text')})) - min(list_min({Q.years('text')})) > 10 OR max(list_max({Q.years('text')})) >= 1950 AS late FROM c",
    "crisis_present": _K + f"SELECT bool_or({_any('text', L.CRISIS_TERMS)}) AS crisis FROM c",
    "upper_median_year": _K + f", y AS (SELECT unnest({Q.years('text')}) AS y FROM c) SELECT y AS median FROM (SELECT y, row_number() OVER (ORDER BY y) - 1 AS i FROM y) WHERE i = (SELECT count(*) // 2 FROM y)",
    "related_terms": _P + f", p AS (SELECT DISTINCT term FROM post WHERE chunk_id IN {_u(THIRD)}), z AS (SELECT term, count(DISTINCT chunk_id) AS df FROM post WHERE term IN (SELECT term FROM p) GROUP BY term ORDER BY df DESC, term DESC LIMIT 8) SELECT term, df, row_number() OVER (ORDER BY df DESC, term DESC) AS rank FROM z",
    "prompt_context": _P + _C + f", r AS (SELECT *, {_case(REGIONS, L.OTHER_REGION)} AS region FROM c WHERE chunk_id IN {_u('panic of 1797')}), q AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY ord) AS i FROM r) SELECT region, CAST(count(*) AS INTEGER) AS n, md5(string_agg('[Source ' || i || ': Unknown]' || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY ord)) AS context_md5 FROM q GROUP BY region",
    "passage_context": _P + _C + f"SELECT CAST(count(*) AS INTEGER) AS n, md5('Found ' || count(*) || ' relevant passages:' || chr(10) || chr(10) || string_agg('[Unknown]' || chr(10) || text, chr(10) || chr(10) ORDER BY ord)) AS context_md5 FROM c WHERE chunk_id IN {_u('panic of 1797')} HAVING count(*) > 0",
    "adjacent_metric": _K + f", s AS (SELECT chunk_id, doc_id, ord, list_distinct(list_transform({Q.sentences('text')}, lambda x: lower(x))) AS s FROM c WHERE text IS NOT NULL), n AS (SELECT chunk_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY ord, chunk_id) AS t FROM s) SELECT chunk_id, len(list_intersect(s, t)) / greatest(len(s), len(t)) AS share FROM n WHERE t IS NOT NULL",
    "review_paragraphs": _A + f", p AS (SELECT answer_id, {_PARAS} AS ps FROM a), b AS (SELECT answer_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM p), n AS (SELECT answer_id, i, {_COUNTS} AS n FROM b WHERE NOT (p LIKE '**%' AND NOT contains(p, chr(10)))), g AS (SELECT a.answer_id, count(n.i) AS total, count(*) FILTER (n > 3) AS long, coalesce(array_to_string(list('Paragraph ' || i || ' has ' || n || ' sentences (max 3)' ORDER BY i) FILTER (n > 3)[1:5], '|'), '') AS issues FROM a LEFT JOIN n USING (answer_id) GROUP BY a.answer_id) SELECT answer_id, 'paragraph_length' AS criterion, long = 0 AS passed, greatest(0, 1 - long / greatest(total, 1) * 0.5) AS score, CASE WHEN long = 0 THEN 'All ' || total || ' paragraphs are ≤3 sentences' ELSE long || '/' || total || ' paragraphs exceed 3 sentences' END AS details, issues FROM g",
    "review_history": _H + """, i AS (SELECT *, c2 - a2 AS gap, list_filter([CASE WHEN c2 >= 1900 AND a2 < 1900 THEN '20th century' END, CASE WHEN c2 >= 2000 AND a2 < 2000 THEN '21st century' END, CASE WHEN c2 >= 1800 AND a1 > 1800 THEN '18th century' END], lambda x: x IS NOT NULL) AS eras FROM y),
j AS (SELECT *, CASE WHEN NOT known OR c1 IS NULL THEN [] WHEN a1 IS NULL THEN ['Missing all historical coverage: chunks go to ' || c2] ELSE list_filter([CASE WHEN gap > 20 THEN 'Answer stops at ' || a2 || ', but chunks go to ' || c2 || ' (gap: ' || gap || ' years)' END, CASE WHEN a1 > c1 + 50 THEN 'Answer starts at ' || a1 || ', but chunks start at ' || c1 || ' (missing early period)' END, CASE WHEN len(eras) > 0 THEN 'Missing eras: ' || array_to_string(eras, ', ') END], lambda x: x IS NOT NULL) END AS s FROM i)
SELECT answer_id, 'full_history' AS criterion, len(s) = 0 AS passed, CASE WHEN len(s) = 0 THEN 1.0 WHEN a1 IS NULL THEN 0.0 WHEN gap > 0 THEN greatest(0.0, 1.0 - gap / 100.0) ELSE 0.8 END AS score, CASE WHEN NOT known THEN 'No chunks provided for comparison' WHEN c1 IS NULL THEN 'No years found in chunks' WHEN a1 IS NULL THEN 'Answer has no years, but chunks span ' || c1 || '-' || c2 WHEN len(s) = 0 THEN 'Full coverage: answer spans ' || a1 || '-' || a2 || ', chunks span ' || c1 || '-' || c2 ELSE 'Incomplete coverage: answer ' || a1 || '-' || a2 || ', chunks ' || c1 || '-' || c2 || ' (gap: ' || gap || ' years)' END AS details, array_to_string(s, '|') AS issues FROM j""",
    "vector_topk": "SELECT vec_id FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings ORDER BY vec_id LIMIT 1)) DESC, vec_id LIMIT 10",
    "vector_topk_each": "WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS s FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM p QUALIFY rank <= 10",
    "question_intents": f"SELECT {_any('question', L.EVENT_WORDS)} OR {Q.has('question', Q.YEARS)} AS event, {_any('question', IDENTITIES)} AS identity, {_any('question', L.CONTROL_WORDS)} AND {_any('question', IDENTITIES)} AS control, {_any('question', L.MARKET_WORDS)} AS market, {_any('question', L.IDEOLOGY_WORDS)} AS ideology, count(*) AS n FROM queryrequest WHERE question IS NOT NULL GROUP BY ALL",
    "detection_responses": Q.DETECTIONS + "SELECT DISTINCT CAST(run_id AS VARCHAR) AS custom_id, identity, surname FROM d",
    "rate_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS recent FROM events",
    "token_budget_window": "WITH e AS (SELECT DISTINCT request_id, client_id, max_length, received_at FROM queryrequest WHERE client_id IS NOT NULL AND max_length IS NOT NULL), u AS (SELECT request_id, CAST(sum(max_length) OVER (PARTITION BY client_id ORDER BY epoch_us(received_at) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM e) SELECT request_id, used, round(CASE WHEN used - 18000 > 0 THEN (used - 18000) / 20000 * 86400 ELSE 0.0 END, 4) AS wait FROM u",
    "hourly_rate": "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL",
    "recent_traces": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "job_states": "WITH r AS (SELECT *, CASE WHEN status IN ('complete', 'error') THEN 2 WHEN status = 'processing' THEN 1 ELSE 0 END AS r FROM querystatusresponse WHERE job_id IS NOT NULL), b AS (SELECT job_id, max({'r': r, 'polled_at': polled_at, 'status': status}) AS b, count(*) AS polls FROM r GROUP BY job_id) SELECT job_id, b.status AS status, b.polled_at AS polled_at, polls FROM b",
    "content_hash_dedup": "SELECT DISTINCT md5(text) AS chunk_hash FROM chunks WHERE text IS NOT NULL",
    "stream_rate": "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL",
    "session_runs": "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k",
}

#: b: the blocks of each answer (answer_id, i, p) without headers, in order.
_BLOCKS = _A + f", p AS (SELECT answer_id, {_PARAS} AS ps FROM a), q AS (SELECT answer_id, unnest(range(1, len(ps) + 1)) AS i, unnest(ps) AS p FROM p), b AS (SELECT * FROM q WHERE NOT (p LIKE '**%' AND NOT contains(p, chr(10))))"
#: f: each chunk with the head of its merged chunk, by a fold over the chunks of a document.
_FOLD = _K.replace("WITH c AS", "WITH RECURSIVE c AS", 1) + f""", o AS (SELECT doc_id, chunk_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY ord, chunk_id) AS i FROM c WHERE text IS NOT NULL AND doc_id IS NOT NULL),
f AS (SELECT doc_id, i, chunk_id, chunk_id AS head, 1 AS n, text FROM o WHERE i = 1 UNION ALL
SELECT doc_id, i + 1, id, CASE WHEN m THEN head ELSE id END, CASE WHEN m THEN n + 1 ELSE 1 END, CASE WHEN m THEN merged ELSE t END FROM (
SELECT f.*, o.chunk_id AS id, o.text AS t, n < 3 AND len(list_intersect(x, y)) >= 0.5 * greatest(len(x), len(y)) AND NOT (len(v) >= 100 AND len(w) >= 100 AND v[len(v) - 99 :] = w[1:100]) AS m,
array_to_string(list_concat(u, list_filter(z, lambda s: NOT list_contains(x, lower(s)))), ' ') AS merged
FROM (SELECT f.*, {Q.sentences('f.text')} AS u, list_distinct(list_transform({Q.sentences('f.text')}, lambda s: lower(s))) AS x, {Q.words('f.text')} AS v FROM f) f
JOIN (SELECT *, {Q.sentences('text')} AS z, list_distinct(list_transform({Q.sentences('text')}, lambda s: lower(s))) AS y, {Q.words('text')} AS w FROM o) o ON o.doc_id = f.doc_id AND o.i = f.i + 1))
"""
_E = "sealed memoranda"
_LIST = f"(regexp_matches(low, ',{Q.S}+{_E}(?:,|{Q.S}+and|{Q.S}*$)') OR regexp_matches(low, '^{_E},{Q.S}+'))"
_MAIN = f"(regexp_matches(low, '(?m)^(?:[^.]*[^{Q.W}.])?{_E}(?:$|[^{Q.W}])') OR regexp_matches(low, '(?:^|[^{Q.W}]){_E}{Q.S}+(?:{'|'.join(L.SUBJECT_VERBS + L.SUBJECT_NOUNS)})') OR contains(low, '<italic>{_E}'))"

ORACLES |= {
    "comma_mentions": _K + f""", t AS (SELECT chunk_id, text, contains(low, '{_E}') AND {_LIST} AND NOT {_MAIN} AS reduced FROM (SELECT *, lower(text) AS low FROM c WHERE text IS NOT NULL)),
s AS (SELECT *, {Q.sentences('text')} AS s FROM t), p AS (SELECT *, list_position(list_transform(s, lambda x: contains(lower(x), '{_E}')), true) AS n FROM s),
k2 AS (SELECT *, {Q.words(f"array_to_string(CASE WHEN n > 0 THEN list_filter(s, lambda x, i: contains(lower(x), '{_E}') OR i = n + 1) ELSE s END, ' ')")} AS w, array_to_string(CASE WHEN n > 0 THEN list_filter(s, lambda x, i: contains(lower(x), '{_E}') OR i = n + 1) ELSE s END, ' ') AS j FROM p)
SELECT chunk_id, reduced, md5(CASE WHEN reduced THEN CASE WHEN len(w) > 100 THEN array_to_string(w[1:100], ' ') || '...' ELSE j END ELSE text END) AS text_md5 FROM k2 UNION ALL SELECT chunk_id, false, NULL FROM c WHERE text IS NULL""",
    "adjacent_merge": _FOLD + "SELECT doc_id, chunk_id, head AS merged_id, CAST(count(*) OVER (PARTITION BY head) AS INTEGER) AS n_merged FROM f",
    "merged_postings": _FOLD.replace("WITH RECURSIVE", _P.replace("WITH e", "WITH RECURSIVE e", 1) + ",", 1) + ", z AS (SELECT term, coalesce(head, post.chunk_id) AS chunk_id, sum(tf) AS tf FROM post LEFT JOIN f USING (chunk_id) GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM z GROUP BY term",
    "pair_merges": _K + f""", s AS (SELECT chunk_id, doc_id, ord, list_distinct(list_transform({Q.sentences('text')}, lambda x: lower(x))) AS s FROM c WHERE text IS NOT NULL AND doc_id IS NOT NULL),
r AS (SELECT *, list_distinct(flatten(list_transform(list_transform(s, lambda x: {Q.words('x')}), lambda w: list_transform(range(1, len(w) - 5), lambda i: array_to_string(w[i : i + 6], ' '))))) AS r FROM s),
n AS (SELECT *, lead(chunk_id) OVER x AS next_id, lead(s) OVER x AS s2, lead(r) OVER x AS r2 FROM r WINDOW x AS (PARTITION BY doc_id ORDER BY ord, chunk_id)),
g AS (SELECT chunk_id, next_id, len(list_intersect(s, s2)) / greatest(len(s), len(s2)) AS share, CAST(len(list_intersect(r, r2)) AS INTEGER) AS phrases FROM n WHERE next_id IS NOT NULL) SELECT *, share > 0.3 OR phrases > 0 AS merges FROM g""",
    "review_chronology": _BLOCKS + f""", y AS (SELECT answer_id, {Q.years('answer')} AS y FROM a), e AS (SELECT answer_id, unnest(range(1, len(y) + 1)) AS i, unnest(y) AS v FROM y),
f AS (SELECT x.answer_id, x.v AS av, z.v AS bv, min({{'i': x.i, 'j': z.i}}) AS o FROM e x JOIN e z ON x.answer_id = z.answer_id AND x.i < z.i AND x.v - z.v > 10 GROUP BY ALL),
j AS (SELECT answer_id, count(*) AS nf, list('Year ' || av || ' mentioned after ' || bv || ' (backwards jump of ' || (av - bv) || ' years)' ORDER BY o) AS s FROM f GROUP BY answer_id),
m AS (SELECT answer_id, i, list_min({Q.years('p')}) AS v FROM b), h AS (SELECT answer_id, v, row_number() OVER (PARTITION BY answer_id ORDER BY i) AS k, lead(v) OVER (PARTITION BY answer_id ORDER BY i) AS nv FROM m WHERE v IS NOT NULL),
g AS (SELECT answer_id, count(*) AS np, list('Paragraph ' || k || ' (' || v || ') comes before paragraph ' || (k + 1) || ' (' || nv || ') - non-chronological organization' ORDER BY k) AS s FROM h WHERE v - nv > 20 GROUP BY answer_id),
z AS (SELECT y.answer_id, coalesce(len(y.y), 0) AS n, coalesce(nf, 0) AS nf, coalesce(np, 0) AS np, CASE WHEN coalesce(len(y.y), 0) < 2 THEN [] ELSE list_concat(coalesce(j.s, []), coalesce(g.s[1:3], [])) END AS s FROM y LEFT JOIN j USING (answer_id) LEFT JOIN g USING (answer_id))
SELECT answer_id, 'chronological_flow' AS criterion, len(s) = 0 AS passed, CASE WHEN len(s) = 0 THEN 1.0 ELSE greatest(0.0, 1.0 - nf / greatest(n, 1) * 0.3 - np * 0.2) END AS score,
CASE WHEN n < 2 THEN 'Insufficient years to check chronological flow' WHEN len(s) = 0 THEN 'Chronological flow maintained across ' || n || ' year mentions' ELSE nf || ' backwards chronological jumps detected' || CASE WHEN np > 0 THEN ', ' || np || ' non-chronological paragraphs' ELSE '' END END AS details, array_to_string(s[1:5], '|') AS issues FROM z""",
    "review_panics": _A + _C + ", x AS (SELECT DISTINCT a.answer_id, c.text FROM a JOIN c ON c.doc_id = a.answer_id), r AS ("
    + " UNION ALL ".join(f"SELECT answer_id, '{w} ' || unnest(regexp_extract_all(lower(text), '{w}(?:[^.]*?[^{Q.W}.])?({Q.YEARS})(?:$|[^{Q.W}])', 1)) AS c FROM x" for w in L.CRISIS_WORDS)
    + " UNION ALL " + " UNION ALL ".join(f"SELECT answer_id, 'panic/crisis {y}' FROM x WHERE contains(text, '{y}')" for y in L.CRISIS_YEARS)
    + """), k AS (SELECT DISTINCT answer_id FROM x), s AS (SELECT answer_id, list(DISTINCT c ORDER BY c) AS c FROM r GROUP BY answer_id),
z AS (SELECT a.answer_id, k.answer_id IS NOT NULL AS known, coalesce(s.c, []) AS c, list_filter(coalesce(s.c, []), lambda v: len(list_filter(string_split(v, ' '), lambda w: contains(lower(a.answer), w))) = 0) AS m FROM a LEFT JOIN k USING (answer_id) LEFT JOIN s USING (answer_id))
SELECT answer_id, 'panics_coverage' AS criterion, NOT known OR len(m) = 0 AS passed, CASE WHEN NOT known OR len(m) = 0 THEN 1.0 ELSE (len(c) - len(m)) / len(c) END AS score,
CASE WHEN NOT known THEN 'No chunks provided for panic check' WHEN len(c) = 0 THEN 'No panics/crises found in chunks' WHEN len(m) = 0 THEN 'All ' || len(c) || ' panics/crises from chunks are mentioned' ELSE 'Missing ' || len(m) || '/' || len(c) || ' panics/crises: ' || array_to_string(m[1:3], ', ') END AS details,
CASE WHEN NOT known THEN '' ELSE array_to_string(list_transform(m[1:5], lambda v: 'Missing panic/crisis: ' || v), '|') END AS issues FROM z""",
    "answer_flags": _BLOCKS + _C + f""", n AS (SELECT answer_id, {_COUNTS} AS n FROM b), w AS (SELECT answer_id, {_COUNTS.replace('(p,', '(answer,')} AS n_sentences FROM a), l AS (SELECT answer_id, string_split(answer, chr(10)) AS l FROM a),
sy AS (SELECT a.answer_id, max(list_max({Q.years('c.text')})) AS c2 FROM a JOIN c ON c.doc_id = a.answer_id GROUP BY 1)
SELECT a.answer_id, length(answer) < 300 OR len({_PARAS}) < 3 OR contains(lower(answer), 'no relevant information found') AS needs_grounding, coalesce((SELECT max(n) FROM n WHERE n.answer_id = a.answer_id) > 3, false) AS too_long,
contains(lower(answer), 'related questions') OR len(list_filter(l[greatest(len(l) - 29, 1) :], lambda x: contains(x, '?'))) >= 3 AS has_questions, CAST(n_sentences AS INTEGER) AS n_sentences,
c2 IS NOT NULL AND (list_max({Q.years('answer')}) IS NULL OR c2 - list_max({Q.years('answer')}) > 10) AS stops_early FROM a JOIN w USING (answer_id) JOIN l USING (answer_id) LEFT JOIN sy USING (answer_id)""",
    "paragraph_enforce": _A + f""", p AS (SELECT answer_id, answer, unnest(range(1, len({_PARAS}) + 1)) AS i, unnest({_PARAS}) AS p FROM a), q AS (SELECT answer_id, i, p, p LIKE '**%' AND NOT contains(p, chr(10)) AS h, list_filter(list_transform(string_split(regexp_replace(p, '([.!?]){Q.S}+(\\p{{Lu}})', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {Q.strip('x')}), lambda x: x <> '') AS s FROM p),
g AS (SELECT answer_id, i, CASE WHEN h THEN [p] ELSE list_transform(list_transform(range(0, len(s), 3), lambda k: array_to_string(s[k + 1 : k + 3], ' ')), lambda x: CASE WHEN regexp_matches(x, '[.!?]$') THEN x ELSE x || '.' END) END AS g FROM q),
j AS (SELECT answer_id, string_agg(array_to_string(g, chr(10) || chr(10)), chr(10) || chr(10) ORDER BY i) AS j FROM g GROUP BY answer_id) SELECT a.answer_id, md5(CASE WHEN coalesce(j, '') <> '' THEN j ELSE answer END) AS answer_md5 FROM a LEFT JOIN j USING (answer_id)""",
    "prepared_text": ORACLES["per_term_passages"].replace("md5(string_agg(sentence, ' ' ORDER BY sent)) AS text_md5", "min(ord) AS ord, string_agg(sentence, ' ' ORDER BY sent) AS text").replace("s.chunk_id, sent, sentence FROM", "s.chunk_id, ord, sent, sentence FROM").replace(") SELECT term, chunk_id, min(ord)", "), pt AS (SELECT term, chunk_id, min(ord)")
    + "), t AS (SELECT term, string_agg(text, ' ' ORDER BY ord, chunk_id) AS text FROM pt WHERE term IN ('vessel row', 'Vessel row', 'Vessel Row') GROUP BY term) SELECT term, text FROM t ORDER BY list_position(['vessel row', 'Vessel row', 'Vessel Row'], term) LIMIT 1",
    "rate_admission": """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
f AS (SELECT event_id, user_id, i, true AS admitted, [t] AS held FROM e WHERE i = 1 UNION ALL SELECT event_id, user_id, i, len(h) < 3, CASE WHEN len(h) < 3 THEN list_append(h, t) ELSE h END
FROM (SELECT e.event_id, e.user_id, e.i, e.t, list_filter(f.held, lambda x: x > e.t - 86400000000) AS h FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)) SELECT event_id, user_id, admitted FROM f""",
    "packed_texts": f"""WITH RECURSIVE d AS (SELECT doc_id, {Q.sentences('text')} AS l FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, unnest(range(len(l))) AS k, unnest(l) AS x FROM d), w AS (SELECT doc_id, k, {Q.words('x')} AS w FROM s),
p AS (SELECT doc_id, k, unnest(range(0, len(w), 1000)) AS b, w FROM w WHERE len(w) > 0), q AS (SELECT doc_id, len(w[b + 1 : b + 1000]) AS n, array_to_string(w[b + 1 : b + 1000], ' ') AS t, row_number() OVER (PARTITION BY doc_id ORDER BY k, b) AS i FROM p),
f AS (SELECT doc_id, i, 0 AS piece, n AS held, n, t FROM q WHERE i = 1 UNION ALL SELECT q.doc_id, q.i, CASE WHEN held + q.n > 1000 THEN piece + 1 ELSE piece END, CASE WHEN held + q.n > 1000 THEN q.n ELSE held + q.n END, q.n, q.t FROM f JOIN q ON q.doc_id = f.doc_id AND q.i = f.i + 1)
SELECT doc_id, piece, CAST(sum(n) AS INTEGER) AS n_words, md5(string_agg(t, ' ' ORDER BY i)) AS text_md5 FROM f GROUP BY doc_id, piece""",
}
