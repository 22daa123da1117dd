"""Queries on the index, its graphs and boolean retrieval, with their SQL."""

from pyspark.sql import functions as F

from inkwell import lexicons as L
from inkwell.operators import extract, folds, index, retrieve
from inkwell.plans.engine import Engine
from inkwell.queries import sql as Q
from inkwell.queries.texts import GROUPS, middle
from inkwell.runtime import table
from inkwell.sources import readers

#: Terms of the test collection.
PLACES = ["Bank of Aldermoor", "Port Ellery", "Aldermoor Exchange", "Ellery Clearing House", "Vessel Row", "Quay Court"]
FIRST, SECOND, THIRD = "Bank of Aldermoor", "Vessel Row", "Quay Court"


def _mentions(spark, folder):
    return readers.index_mentions(table(spark, folder, "indices"))


def _post(spark, folder):
    return index.postings(_mentions(spark, folder))


def _chunks(spark, folder):
    """One row per chunk id: repeated rows of the store count once."""
    c = table(spark, folder, "chunks").where("chunk_id IS NOT NULL")
    return c.groupBy("chunk_id").agg(F.min(F.struct("doc_id", "text")).alias("c")).select("chunk_id", F.substring("chunk_id", 7, 20).cast("bigint").alias("ord"), "c.doc_id", "c.text")


def postings_terms(spark, folder):
    return index.terms(_post(spark, folder))


def frequent_terms(spark, folder):
    return index.frequent(postings_terms(spark, folder), list(L.ACRONYMS))


def meaningful_terms(spark, folder):
    return index.meaningful(postings_terms(spark, folder), L.STOP_WORDS, [g for gs in L.SAMPLE_GROUPS.values() for g in gs], 25)


def linkable_terms(spark, folder):
    return index.linkable(postings_terms(spark, folder), L.STOP_WORDS)


def posting_lists(spark, folder):
    return index.posting_lists(_post(spark, folder)).select("term", F.array_join("chunk_ids", ",").alias("chunk_ids"))


def posting_duplicates(spark, folder):
    return index.duplicate_stats(_mentions(spark, folder))


def term_group_merge(spark, folder):
    merged = index.merge_groups(_post(spark, folder), {"quay court": ["quay court", "vessel row"], "panic": ["panic of 1907", "panic of 1920"]})
    return merged.select("term", "chunk_id", "tf")


def cooccurrence_edges(spark, folder):
    return index.cooccurrence(_post(spark, folder))


def assoc_topk(spark, folder):
    return index.associations(cooccurrence_edges(spark, folder))


def hierarchy_parents(spark, folder):
    return index.with_parents(_post(spark, folder), {"Harbour": ["port ellery", "quay court", "vessel row"], "Town": ["bank of aldermoor", "port ellery"]})


def hierarchy_children(spark, folder):
    return retrieve.union(_post(spark, folder), index.children_of(["harbour"], {"harbour": ["port ellery", "quay court"]}))


def _detected(spark, folder):
    return readers.detections(table(spark, folder, "detected_identities"))


def identity_augmented(spark, folder):
    return index.with_identities(_post(spark, folder), _detected(spark, folder).select("identity", F.col("surname").alias("name"))).groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def identity_rollup(spark, folder):
    return index.identity_rollup(_detected(spark, folder))


def _identity_chunks(spark, folder):
    post = _post(spark, folder).withColumn("surname", F.lower(F.trim("term")))
    return post.join(_detected(spark, folder).select("identity", "surname").distinct(), "surname").select("identity", "chunk_id").distinct()


def identity_volume(spark, folder):
    return index.identity_volume(_identity_chunks(spark, folder)).select("identity", F.md5(F.array_join("chunk_ids", ",")).alias("ids_md5"), "chunk_count")


def identity_detections_merged(spark, folder):
    merged = index.with_detections(_post(spark, folder), _identity_chunks(spark, folder), L.SAMPLE_GROUPS)
    return merged.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"))


def several_identities(spark, folder):
    return index.several_identities(_detected(spark, folder)).select("surname", F.array_join("identities", ",").alias("identities"), "n")


def identity_crosstab(spark, folder):
    return index.crosstab(_detected(spark, folder), ["jewish", "quaker", "parsi", "german"], 2)


def groups_volume(spark, folder):
    return index.group_volume(_post(spark, folder), GROUPS)


def top_families(spark, folder):
    return index.top_families(identity_rollup(spark, folder), ["progress", "colonial", "industry"], 25, 2)


def presplit_terms(spark, folder):
    return index.presplit(postings_terms(spark, folder)).select("term", "kept", "batch")


def disambiguated_terms(spark, folder):
    found = extract.disambiguated(_mentions(spark, folder), _chunks(spark, folder), "quay court", [("quay court (harbour)", ["port ellery"]), ("quay court (town)", ["bank of aldermoor"])])
    return index.terms(index.postings(found))


def index_vs_detection(spark, folder):
    left = _identity_chunks(spark, folder)
    right = _post(spark, folder).select(F.lower(F.trim("term")).alias("identity"), "chunk_id").distinct().join(left.select("identity").distinct(), "identity", "left_semi")
    return index.compare_sets(left, right, "identity", "chunk_id")


def detection_accuracy(spark, folder):
    d = _detected(spark, folder)
    first = d.groupBy("identity").agg(F.min("run_id").alias("m"))
    truth = d.join(first, "identity").where("run_id = m").select(F.col("identity").alias("grp"), F.col("surname").alias("name"))
    found = d.join(first, "identity").where("run_id <> m").select(F.col("identity").alias("grp"), F.col("surname").alias("name"))
    return index.evaluation(truth, found)


def merged_sources(spark, folder):
    scores = _detected(spark, folder).groupBy("surname").agg(F.count(F.lit(1)).alias("score"))
    fixed = scores.where("score >= 12")
    return index.merged_sources(fixed, scores, "surname")


def dominant_files(spark, folder):
    runs = table(spark, folder, "detected_identities").select("run_id", F.coalesce("filename", F.lit("Unknown")).alias("place"))
    counts = _detected(spark, folder).join(runs.distinct(), "run_id").groupBy("surname", "place").agg(F.count(F.lit(1)).alias("n"))
    return index.dominant(identity_rollup(spark, folder), counts)


def retrieve_intersection(spark, folder):
    return retrieve.intersection(_post(spark, folder), [[FIRST], [SECOND]])


def retrieve_grouped_variants(spark, folder):
    return retrieve.intersection(_post(spark, folder), [[FIRST, "Port Ellery"], [SECOND, THIRD]])


def retrieve_union(spark, folder):
    return retrieve.union(_post(spark, folder), [SECOND, THIRD])


def retrieve_difference(spark, folder):
    post = _post(spark, folder)
    return retrieve.difference(retrieve.union(post, [FIRST]), retrieve.union(post, [SECOND]))


def retrieve_with_fallback(spark, folder):
    post = _post(spark, folder)
    return retrieve.tiered(retrieve.union(post, ["no such phrase"]), retrieve.intersection(post, [[FIRST], ["no such term"]]), retrieve.union(post, [THIRD]))


def posting_overlap(spark, folder):
    return retrieve.overlap(_post(spark, folder), [FIRST], [SECOND, THIRD])


def search_term(spark, folder):
    return retrieve.search(_post(spark, folder), _chunks(spark, folder), "quay court's", None, ("ord",)).select("chunk_id", F.md5("text").alias("text_md5"))


def retrieve_later(spark, folder):
    post, chunks = _post(spark, folder), _chunks(spark, folder)
    ids = retrieve.intersection(post, [[FIRST], ["panic of 1907"]])
    return retrieve.augmented_later(ids, post, chunks, [SECOND])


def retrieve_crisis(spark, folder):
    post, chunks = _post(spark, folder), _chunks(spark, folder)
    return retrieve.augmented_crisis(retrieve.union(post, [THIRD]), post, chunks, [FIRST], L.CRISIS_TERMS, 20)


def retrieve_aliases(spark, folder):
    post = _post(spark, folder)
    return retrieve.with_aliases(retrieve.union(post, ["nothing"]), post, "What of the Harbour Office?", {"harbour office": ["Port Ellery", "Quay Court"]})


def retrieve_expanded(spark, folder):
    changes = readers.index_edges(table(spark, folder, "indices"))
    return retrieve.expanded_search(_post(spark, folder), [THIRD], changes, assoc_topk(spark, folder))


def phrase_proximity(spark, folder):
    return retrieve.proximity(_post(spark, folder), _chunks(spark, folder), "Port Ellery", "Quay Court")


def name_change_edges(spark, folder):
    return readers.index_edges(table(spark, folder, "indices"))


def engine_stats(spark, folder):
    return Engine(table(spark, folder, "chunks"), _post(spark, folder)).stats()


def endnotes_search(spark, folder):
    return retrieve.endnote_search(folds.endnotes_of(table(spark, folder, "documents")), "letters", 20)


def endnotes_of_chunks(spark, folder):
    docs = table(spark, folder, "documents")
    notes = folds.endnotes_of(docs)
    links = notes.join(_chunks(spark, folder).select("chunk_id", "doc_id"), "doc_id").select("chunk_id", "endnote_id")
    post = _post(spark, folder)
    # the first term by name that has five to nine chunks, some with endnotes
    noted = post.join(links.select("chunk_id").distinct(), "chunk_id", "left_semi").select("term").distinct()
    few = post.groupBy("term").agg(F.count_distinct("chunk_id").alias("n")).where("n BETWEEN 5 AND 9").join(noted, "term", "left_semi").agg(F.min("term").alias("term"))
    ids = post.join(few, "term", "left_semi").select("chunk_id").distinct()
    return retrieve.with_endnotes(ids, links, notes.select("endnote_id", "text").distinct())


def stale_files(spark, folder):
    """Files against the cache of what was ingested in the first half of the time."""
    d = table(spark, folder, "documents").where("filename IS NOT NULL AND mtime IS NOT NULL")
    return readers.stale(d.select("filename", "mtime").distinct(), d.where(F.col("ingested_at") < middle(d, "ingested_at")))


_NAMES = ["postings_terms", "frequent_terms", "meaningful_terms", "linkable_terms", "posting_lists", "posting_duplicates", "term_group_merge", "cooccurrence_edges", "assoc_topk", "hierarchy_parents", "hierarchy_children",
          "identity_augmented", "identity_rollup", "identity_volume", "identity_detections_merged", "several_identities", "identity_crosstab", "groups_volume", "top_families", "presplit_terms", "disambiguated_terms", "index_vs_detection", "detection_accuracy", "merged_sources", "dominant_files",
          "retrieve_intersection", "retrieve_grouped_variants", "retrieve_union", "retrieve_difference", "retrieve_with_fallback", "posting_overlap", "search_term", "retrieve_later", "retrieve_crisis", "retrieve_aliases",
          "retrieve_expanded", "phrase_proximity", "name_change_edges", "engine_stats", "endnotes_search", "endnotes_of_chunks", "stale_files"]
QUERIES = {n: globals()[n] for n in _NAMES}

_P = Q.POSTINGS
_T = _P + ", t AS (SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM post GROUP BY term)\n"
_ROLL = "SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM (SELECT term, chunk_id, sum(tf) AS tf FROM u GROUP BY ALL) GROUP BY term"
_C = ", c AS (SELECT chunk_id, CAST(substr(chunk_id, 7) AS BIGINT) AS ord, (min({'doc_id': doc_id, 'text': text})).doc_id AS doc_id, (min({'doc_id': doc_id, 'text': text})).text AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)\n"
_EDGES = ", s AS (SELECT DISTINCT chunk_id, term FROM post), g AS (SELECT x.term AS a, y.term AS b, count(*) AS weight FROM s x JOIN s y ON x.chunk_id = y.chunk_id AND x.term < y.term GROUP BY ALL)\n"
_ASSOC = ", b AS (SELECT a AS entity, b AS other, weight FROM g WHERE weight >= 3 UNION ALL SELECT b, a, weight FROM g WHERE weight >= 3), a AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY weight DESC, other) AS rank FROM b QUALIFY rank <= 10)\n"
_D = ", " + Q.DETECTIONS[5:]
_IC = _P + _D + ", ic AS (SELECT DISTINCT d.identity, post.chunk_id FROM post JOIN d ON lower(trim(post.term)) = d.surname)\n"
_SAMPLE = [(s.lower(), c) for c, vs in L.SAMPLE_GROUPS.items() for s in dict.fromkeys([c, c.replace(" ", "_"), *vs, *(v.replace(" ", "_") for v in vs)])]
_OUT = [(c, t) for c, vs in L.SAMPLE_GROUPS.items() for t in dict.fromkeys([c, c.replace(" ", "_"), *vs])]


def _u(*terms: str) -> str:
    return f"(SELECT DISTINCT chunk_id FROM post WHERE lower(term) IN ({Q.listed(t.lower() for t in terms)}))"


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + Q.listed(r) + ")" for r in rows) + ")"


_MERGE = "ms AS (SELECT * FROM {s} AS x(spelling, canonical)), mo AS (SELECT * FROM {o} AS x(canonical, term)), mu AS (SELECT ms.canonical, chunk_id, sum(tf) AS tf FROM {p} p JOIN ms ON lower(p.term) = ms.spelling GROUP BY ALL), u AS (SELECT term, chunk_id, tf FROM {p} WHERE lower(term) NOT IN (SELECT spelling FROM ms) UNION ALL SELECT mo.term, chunk_id, tf FROM mu JOIN mo USING (canonical))\n"

ORACLES = {
    "postings_terms": _T + "SELECT * FROM t",
    "frequent_terms": _T + f"SELECT * FROM t WHERE tf >= 2 OR term IN ({Q.listed(L.ACRONYMS)})",
    "meaningful_terms": _T + f"SELECT * FROM t WHERE length(term) > 1 AND lower(term) NOT IN ({Q.listed(L.STOP_WORDS)}) AND df > 25 AND (regexp_matches(term, '^\\p{{Lu}}') OR lower(term) IN ({Q.listed(g for gs in L.SAMPLE_GROUPS.values() for g in gs)}) OR regexp_matches(lower(term), 'nb|bank|co'))",
    "linkable_terms": _T + f"SELECT * FROM t WHERE length(term) >= 4 AND lower(trim(term)) NOT IN ({Q.listed(L.STOP_WORDS)}) AND NOT regexp_matches(lower(trim(term)), '^[0-9]+$') AND replace(lower(trim(term)), substr(lower(trim(term)), 1, 1), '') <> '' AND NOT (regexp_matches(lower(trim(term)), '(?:{'|'.join(index.WORD_ENDINGS)})$') AND NOT regexp_matches(term, '^\\p{{Lu}}')) AND (contains(term, ' ') OR regexp_matches(term, '\\p{{Lu}}') OR length(term) >= 8)",
    "posting_lists": _P + "SELECT term, string_agg(chunk_id, ',' ORDER BY chunk_id) AS chunk_ids FROM post GROUP BY term",
    "posting_duplicates": _P + "SELECT count(*) AS terms, CAST(sum(n) AS BIGINT) AS ids, CAST(sum(k) AS BIGINT) AS distinct_ids, CAST(sum(n) - sum(k) AS BIGINT) AS duplicates FROM (SELECT term, sum(tf) AS n, count(*) AS k FROM post GROUP BY term)",
    "term_group_merge": _P + ", " + _MERGE.format(s=_values([("quay court", "quay court"), ("quay_court", "quay court"), ("vessel row", "quay court"), ("vessel_row", "quay court"), ("panic", "panic"), ("panic of 1907", "panic"), ("panic_of_1907", "panic"), ("panic of 1920", "panic"), ("panic_of_1920", "panic")]), o=_values([("quay court", "quay court"), ("quay court", "quay_court"), ("quay court", "vessel row"), ("panic", "panic"), ("panic", "panic of 1907"), ("panic", "panic of 1920")]), p="post") + "SELECT term, chunk_id, CAST(tf AS BIGINT) AS tf FROM u",
    "cooccurrence_edges": _P + _EDGES + "SELECT * FROM g",
    "assoc_topk": _P + _EDGES + _ASSOC + "SELECT * FROM a",
    "hierarchy_parents": _P + f", h AS (SELECT * FROM {_values([('Harbour', 'port ellery'), ('Harbour', 'quay court'), ('Harbour', 'vessel row'), ('Town', 'bank of aldermoor'), ('Town', 'port ellery')])} AS x(parent, child)), u AS (SELECT * FROM post UNION ALL SELECT parent, chunk_id, tf FROM post JOIN h ON lower(term) = child) SELECT term, chunk_id, CAST(sum(tf) AS BIGINT) AS tf FROM u GROUP BY ALL",
    "hierarchy_children": _P + "SELECT * FROM " + _u("harbour", "port ellery", "quay court"),
    "identity_augmented": _P + _D + ", n AS (SELECT DISTINCT lower(trim(identity)) AS identity, surname FROM d), u AS (SELECT * FROM post UNION ALL SELECT identity, chunk_id, tf FROM post JOIN n ON lower(term) = surname)\n" + _ROLL,
    "identity_rollup": Q.DETECTIONS + "SELECT identity, surname, count(*) AS n, row_number() OVER (PARTITION BY identity ORDER BY count(*) DESC, surname) AS rank FROM d GROUP BY identity, surname",
    "identity_volume": _IC + "SELECT identity, md5(string_agg(chunk_id, ',' ORDER BY chunk_id)) AS ids_md5, count(*) AS chunk_count FROM ic GROUP BY identity",
    "identity_detections_merged": _IC + ", pp AS (SELECT term, chunk_id, sum(tf) AS tf FROM (SELECT * FROM post UNION ALL SELECT unnest(list_distinct([lower(identity), replace(lower(identity), ' ', '_')])), chunk_id, 1 FROM ic) GROUP BY ALL), " + _MERGE.format(s=_values(_SAMPLE), o=_values(_OUT), p="pp") + _ROLL,
    "several_identities": Q.DETECTIONS + "SELECT surname, string_agg(DISTINCT identity, ',' ORDER BY identity) AS identities, count(DISTINCT identity) AS n FROM d GROUP BY surname HAVING count(DISTINCT identity) > 1",
    "identity_crosstab": Q.DETECTIONS + ", n AS (SELECT surname, identity, count(*) AS n FROM d GROUP BY ALL HAVING count(*) >= 2) SELECT surname, " + ", ".join(f"CAST(sum(n) FILTER (identity = '{i}') AS BIGINT) AS {i}" for i in ("jewish", "quaker", "parsi", "german")) + " FROM n GROUP BY surname",
    "groups_volume": _P + ", g AS (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(term), '{'|'.join(ks)}') THEN '{g}'" for g, ks in GROUPS.items()) + " ELSE 'Other' END AS grp FROM post) SELECT grp, count(*) AS n, count(*) * 100.0 / (SELECT count(*) FROM post) AS pct FROM g GROUP BY grp",
    "index_vs_detection": _IC + ", rr AS (SELECT DISTINCT lower(trim(term)) AS identity, chunk_id FROM post WHERE lower(trim(term)) IN (SELECT identity FROM ic)), f AS (SELECT coalesce(ic.identity, rr.identity) AS identity, ic.chunk_id AS a, rr.chunk_id AS b FROM ic FULL JOIN rr ON ic.identity = rr.identity AND ic.chunk_id = rr.chunk_id), k AS (SELECT identity, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS in_both, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right FROM f GROUP BY identity) SELECT *, CASE WHEN only_left = 0 AND only_right = 0 THEN 'equal' WHEN in_both = 0 THEN 'disjoint' WHEN only_left = 0 THEN 'subset' WHEN only_right = 0 THEN 'superset' ELSE 'overlap' END AS relation FROM k",
    "detection_accuracy": Q.DETECTIONS + ", f AS (SELECT identity, min(run_id) AS m FROM d GROUP BY identity), t AS (SELECT DISTINCT identity AS grp, surname FROM d JOIN f USING (identity) WHERE run_id = m), h AS (SELECT DISTINCT identity AS grp, surname, 1 AS hit FROM d JOIN f USING (identity) WHERE run_id <> m) SELECT grp, count(*) AS expected, count(hit) AS hit, count(hit) / count(*) AS accuracy FROM t LEFT JOIN h USING (grp, surname) GROUP BY grp",
    "merged_sources": Q.DETECTIONS + ", s AS (SELECT surname, count(*) AS score FROM d GROUP BY surname) SELECT surname, score, 'fixed' AS source FROM s WHERE score >= 12 UNION ALL SELECT * FROM (SELECT surname, score, 'detected' FROM s WHERE score < 12 ORDER BY score DESC, surname LIMIT 10)",
    "dominant_files": Q.DETECTIONS + ", f AS (SELECT identity, surname, row_number() OVER (PARTITION BY identity ORDER BY count(*) DESC, surname) AS rank FROM d GROUP BY identity, surname), p AS (SELECT DISTINCT run_id, coalesce(filename, 'Unknown') AS place FROM detected_identities), c AS (SELECT surname, place, count(*) AS n FROM d JOIN p USING (run_id) GROUP BY ALL), z AS (SELECT identity, place, sum(n) AS n FROM f JOIN c USING (surname) WHERE rank <= 10 GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY n DESC, place) AS r FROM z QUALIFY r <= 3) SELECT identity, string_agg(place, ', ' ORDER BY r) AS places FROM q GROUP BY identity",
    "top_families": Q.DETECTIONS + "SELECT identity, surname, count(*) AS n, row_number() OVER (PARTITION BY identity ORDER BY count(*) DESC, surname) AS rank FROM d WHERE surname NOT IN ('progress', 'colonial', 'industry') GROUP BY identity, surname HAVING count(*) >= 2 QUALIFY rank <= 25",
    "presplit_terms": _T + "SELECT term, regexp_matches(term, '^\\p{Lu}{3,}$') AS kept, CASE WHEN NOT regexp_matches(term, '^\\p{Lu}{3,}$') THEN (row_number() OVER (PARTITION BY regexp_matches(term, '^\\p{Lu}{3,}$') ORDER BY term) - 1) // 250 END AS batch FROM t",
    "disambiguated_terms": _P + _C + ", n AS (SELECT m.term, m.chunk_id FROM m WHERE m.chunk_id IS NOT NULL AND lower(m.term) <> 'quay court' UNION ALL SELECT CASE WHEN contains(lower(c.text), 'port ellery') THEN 'quay court (harbour)' WHEN contains(lower(c.text), 'bank of aldermoor') THEN 'quay court (town)' END, m.chunk_id FROM m JOIN c USING (chunk_id) WHERE lower(m.term) = 'quay court'), pp AS (SELECT term, chunk_id, count(*) AS tf FROM n WHERE term IS NOT NULL GROUP BY ALL) SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM pp GROUP BY term",
    "retrieve_intersection": _P + f"SELECT chunk_id FROM {_u(FIRST)} INTERSECT SELECT chunk_id FROM {_u(SECOND)}",
    "retrieve_grouped_variants": _P + f"SELECT chunk_id FROM {_u(FIRST, 'Port Ellery')} INTERSECT SELECT chunk_id FROM {_u(SECOND, THIRD)}",
    "retrieve_union": _P + f"SELECT * FROM {_u(SECOND, THIRD)}",
    "retrieve_difference": _P + f"SELECT chunk_id FROM {_u(FIRST)} EXCEPT SELECT chunk_id FROM {_u(SECOND)}",
    "retrieve_with_fallback": _P + f"SELECT * FROM {_u(THIRD)}",
    "posting_overlap": _P + f"SELECT (SELECT count(*) FROM {_u(FIRST)}) AS first, (SELECT count(*) FROM {_u(SECOND, THIRD)}) AS second, (SELECT count(*) FROM {_u(FIRST)} JOIN {_u(SECOND, THIRD)} USING (chunk_id)) AS both",
    "search_term": _P + _C + f"SELECT chunk_id, md5(text) AS text_md5 FROM c WHERE chunk_id IN {_u(THIRD)}",
    "retrieve_later": _P + _C + f", ids AS (SELECT chunk_id FROM {_u(FIRST)} INTERSECT SELECT chunk_id FROM {_u('panic of 1907')}), y AS (SELECT chunk_id, list_max({Q.years('text')}) AS y FROM c), mx AS (SELECT coalesce(max(y), 0) AS m FROM y WHERE chunk_id IN (SELECT chunk_id FROM ids)) SELECT chunk_id FROM ids UNION SELECT chunk_id FROM y WHERE chunk_id IN {_u(SECOND)} AND y > (SELECT m FROM mx)",
    "retrieve_crisis": _P + _C + f"SELECT chunk_id FROM {_u(THIRD)} UNION SELECT chunk_id FROM (SELECT chunk_id FROM c WHERE chunk_id IN {_u(FIRST)} AND chunk_id NOT IN {_u(THIRD)} AND regexp_matches(lower(text), '{'|'.join(L.CRISIS_TERMS)}') ORDER BY chunk_id LIMIT 20)",
    "retrieve_aliases": _P + f"SELECT * FROM {_u('Port Ellery', 'Quay Court')}",
    "retrieve_expanded": _P + _EDGES + _ASSOC + f", e2 AS (SELECT lower(unnest(map_keys(name_changes))) AS o, unnest(map_values(name_changes)) AS ns FROM indices), n AS (SELECT o, lower(unnest(ns)) AS n FROM e2), x AS (SELECT n AS t FROM n WHERE o = lower('{THIRD}') UNION SELECT o FROM n WHERE n = lower('{THIRD}') UNION SELECT lower(other) FROM a WHERE lower(entity) = lower('{THIRD}') AND rank <= 5 UNION SELECT lower('{THIRD}')) SELECT DISTINCT chunk_id FROM post WHERE lower(term) IN (SELECT t FROM x)",
    "phrase_proximity": _P + _C + f"SELECT chunk_id, {Q.has('lower(text)', f'port ellery{Q.S}+quay court')} AS phrase, {Q.has('lower(text)', f'quay court{Q.S}+port ellery')} AS reversed_phrase, len(list_filter(string_split(lower(text), chr(10)), lambda x: contains(x, 'port ellery') AND contains(x, 'quay court'))) > 0 AS same_line FROM c WHERE chunk_id IN {_u('Port Ellery')} AND chunk_id IN {_u('Quay Court')}",
    "name_change_edges": "WITH e AS (SELECT lower(unnest(map_keys(name_changes))) AS old_name, unnest(map_values(name_changes)) AS ns FROM indices), n AS (SELECT old_name, lower(unnest(ns)) AS new_name FROM e) SELECT DISTINCT old_name, new_name FROM n WHERE new_name IS NOT NULL",
    "engine_stats": _P + _EDGES + "SELECT (SELECT count(DISTINCT chunk_id) FROM chunks) AS total_chunks, count(DISTINCT term) AS indexed_terms, (SELECT count(*) FROM g) AS entity_associations FROM post",
    "endnotes_search": "SELECT * FROM (SELECT doc_id, unnest(map_keys(endnotes)) AS endnote_id, unnest(map_values(endnotes)) AS text FROM documents) WHERE contains(lower(text), 'letters') ORDER BY endnote_id LIMIT 20",
    "endnotes_of_chunks": _P + _C + f", n AS (SELECT doc_id, unnest(map_keys(endnotes)) AS endnote_id, unnest(map_values(endnotes)) AS text FROM documents), i AS (SELECT DISTINCT chunk_id FROM post WHERE term = (SELECT min(term) FROM (SELECT term FROM post GROUP BY term HAVING count(DISTINCT chunk_id) BETWEEN 5 AND 9) WHERE term IN (SELECT term FROM post JOIN c USING (chunk_id) JOIN n USING (doc_id)))) SELECT c.chunk_id, n.endnote_id, n.text FROM i JOIN c USING (chunk_id) JOIN n USING (doc_id)",
    "stale_files": "WITH d AS (SELECT filename, mtime, ingested_at FROM documents WHERE filename IS NOT NULL AND mtime IS NOT NULL), m AS (SELECT min(ingested_at) + (max(ingested_at) - min(ingested_at)) / 2 AS m FROM d) SELECT DISTINCT filename, mtime FROM d WHERE (filename, mtime) NOT IN (SELECT (filename, mtime) FROM d, m WHERE ingested_at < m)",
}
