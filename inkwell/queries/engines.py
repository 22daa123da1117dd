"""Queries on the engine: building an index, opening a stored one, and answering questions, with their SQL."""

from pyspark.sql import functions as F

from inkwell import lexicons as L
from inkwell.operators import folds, index, retrieve
from inkwell.plans import engine
from inkwell.queries import sql as Q
from inkwell.queries import texts
from inkwell.queries.indexes import _C, _MERGE, _OUT, _P, _SAMPLE, FIRST, SECOND, _chunks, _post, _u, _values
from inkwell.queries.results import _case
from inkwell.runtime import exists, fresh, table
from inkwell.sources import readers

#: Engines that `_opened` has saved and opened, with their folders, by session and input.
_SAVED: dict[tuple[str, str], tuple[str, engine.Engine]] = {}
IDENTITIES = ["quaker", "parsi"]


def _opened(spark, folder):
    """The engine of the given index and chunks, saved and opened once a session: what a user has who built an index before."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SAVED or not exists(spark, _SAVED[key][0]):
        path = fresh(spark, "engine")
        chunks = _chunks(spark, folder)
        notes = folds.endnotes_of(table(spark, folder, "documents"))
        engine.Engine(
            chunks.select("chunk_id", "ord", F.lit("archive").alias("filename"), "text"), _post(spark, folder), changes=readers.index_edges(table(spark, folder, "indices")),
            endnotes=notes.groupBy("endnote_id").agg(F.min("text").alias("text")), chunk_endnotes=notes.join(chunks.select("chunk_id", "doc_id"), "doc_id").select("chunk_id", "endnote_id").distinct(),
        ).save(path)
        _SAVED[key] = path, engine.Engine.open(spark, path, identities=IDENTITIES)
    return _SAVED[key][1]


def stored_index(spark, folder):
    """The terms of the stored index, with mentions and chunks: saves it if this session has not."""
    return index.terms(_opened(spark, folder).postings)


def stored_search(spark, folder):
    return _opened(spark, folder).search("Quay Court's", 10).select("chunk_id", "filename", F.md5("text").alias("text_md5"))


def stored_intersection(spark, folder):
    return retrieve.intersection(_opened(spark, folder).postings, [[FIRST], [SECOND]])


def engine_retrieve(spark, folder):
    return _opened(spark, folder).retrieve("Tell me about Dunmerby and Haskby")


def engine_retrieve_phrase(spark, folder):
    return _opened(spark, folder).retrieve("Tell me about Quay Court")


def engine_retrieve_firm(spark, folder):
    return _opened(spark, folder).retrieve("What became of Haskby and the Dunmerby National Bank?")


def engine_retrieve_laws(spark, folder):
    return _opened(spark, folder).retrieve("What did BA1933 and SA34 change at Dunmerby?")


def engine_control(spark, folder):
    return _opened(spark, folder).retrieve("How did quaker families of Dunmerby control Haskby?")


def engine_ask(spark, folder):
    return _opened(spark, folder).ask("What happened at Quay Court in the panic of 1907?").select("grp", "batch", "n", F.md5("context").alias("context_md5"))


def engine_contexts(spark, folder):
    """What a language model is given for a question of the market: chunks by region and year, without repeated sentences."""
    return _opened(spark, folder).contexts("How did Dunmerby use the money market?").select("grp", "batch", "n", F.md5("context").alias("context_md5"))


def engine_endnotes(spark, folder):
    e = _opened(spark, folder)
    # the first term by name that has five to nine chunks, some with endnotes
    noted = e.postings.join(e.chunk_endnotes.select("chunk_id").distinct(), "chunk_id", "left_semi").select("term").distinct()
    few = e.postings.groupBy("term").agg(F.count_distinct("chunk_id").alias("n")).where("n BETWEEN 5 AND 9").join(noted, "term", "left_semi").agg(F.min("term").alias("term"))
    return e.endnotes_for(e.postings.join(few, "term", "left_semi").select("chunk_id").distinct())


def build_index(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "filename", "text")
    return index.terms(engine.Engine.build(docs, L.SAMPLE_GROUPS, lexicon=texts.LEXICON).postings)


_NAMES = ["stored_index", "stored_search", "stored_intersection", "engine_retrieve", "engine_retrieve_phrase", "engine_retrieve_firm", "engine_retrieve_laws", "engine_control", "engine_ask", "engine_contexts", "engine_endnotes", "build_index"]
QUERIES = {n: globals()[n] for n in _NAMES}

_TWO = f"(SELECT chunk_id FROM {_u('dunmerby', 'dunmerbys')} INTERSECT SELECT chunk_id FROM {_u('haskby', 'haskbys')})"
_QUAKER = _u("quaker", "quakers")
_EITHER = _u("dunmerby", "dunmerbys", "haskby", "haskbys")
_BA, _SA = ("ba1933", "bankruptcy act 1933"), ("sa1834", "sa1934", "securities act 1834", "securities act 1934")
_LAWS = f"(SELECT chunk_id FROM {_u(*_BA)} INTERSECT SELECT chunk_id FROM {_u(*_SA)})"


def _widest(both: str, either: str) -> str:
    """ids: the chunks of both, or of either where none has both."""
    return f", x AS (SELECT * FROM {both}), ids AS (SELECT chunk_id FROM x UNION SELECT chunk_id FROM {either} WHERE (SELECT count(*) FROM x) = 0)"


_LATER = f", y AS (SELECT chunk_id, list_max({Q.years('text')}) AS y FROM c), mx AS (SELECT coalesce(max(y), 0) AS m FROM y WHERE chunk_id IN (SELECT chunk_id FROM ids)) SELECT chunk_id FROM ids UNION SELECT chunk_id FROM y WHERE chunk_id IN {_EITHER} AND y > (SELECT m FROM mx)"
_KEPT = f", s AS (SELECT chunk_id, ord, unnest(range(0, len(l))) AS sent, unnest(l) AS sentence FROM (SELECT chunk_id, ord, {Q.sentences('text')} AS l FROM c WHERE chunk_id IN {_u('dunmerby', 'dunmerbys')} AND text IS NOT NULL)), r AS (SELECT *, row_number() OVER (PARTITION BY lower({Q.strip('sentence')}) ORDER BY ord, sent) AS n FROM s WHERE {Q.strip('sentence')} <> ''), kept AS (SELECT chunk_id, ord, string_agg(sentence, ' ' ORDER BY sent) AS text FROM r WHERE n = 1 GROUP BY ALL)"
ORACLES = {
    "stored_index": _P + "SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM post GROUP BY term",
    "stored_search": _P + _C + f"SELECT chunk_id, 'archive' AS filename, md5(text) AS text_md5 FROM c WHERE chunk_id IN {_u('quay court')} ORDER BY ord LIMIT 10",
    "stored_intersection": _P + f"SELECT chunk_id FROM {_u(FIRST)} INTERSECT SELECT chunk_id FROM {_u(SECOND)}",
    "engine_retrieve": _P + _C + _widest(_TWO, _EITHER) + _LATER,
    "engine_retrieve_phrase": _P + f"SELECT * FROM {_u('quay court')}",
    # a firm that is not indexed: all of its words that are, or nothing
    "engine_retrieve_firm": _P + _C + f", ids AS (SELECT * FROM {_TWO})" + _LATER,
    "engine_retrieve_laws": _P + _C + _widest(_LAWS, _u(*_BA, *_SA)) + _LATER.replace(_EITHER, _u("dunmerby", "dunmerbys", "change", "changes")),
    "engine_control": _P + _widest(f"({_TWO[1:-1]} INTERSECT SELECT chunk_id FROM {_QUAKER})", f"(SELECT * FROM {_EITHER} UNION SELECT * FROM {_QUAKER})") + " SELECT * FROM ids ORDER BY chunk_id LIMIT 8",
    "engine_ask": _P + _C + f", r AS (SELECT *, row_number() OVER (ORDER BY ord, chunk_id) - 1 AS i, count(*) OVER () AS total FROM c WHERE chunk_id IN {_u('quay court')}) SELECT 'all' AS grp, i // 380 AS batch, CAST(count(*) AS INTEGER) AS n, md5(CASE WHEN i // 380 = 0 THEN 'Found ' || any_value(total) || ' relevant passages:' || chr(10) || chr(10) ELSE '' END || string_agg('[archive]' || chr(10) || text, chr(10) || chr(10) ORDER BY ord)) AS context_md5 FROM r GROUP BY i // 380",
    "engine_contexts": _P + _C + _KEPT + f", g AS (SELECT *, {_case(L.REGIONS, L.OTHER_REGION)} AS grp, coalesce({Q.years('text')}[1], 1000000000) AS y FROM kept), z AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY y, ord) - 1 AS i FROM g) SELECT grp, i // 380 AS batch, CAST(count(*) AS INTEGER) AS n, md5(string_agg('[Source ' || (i % 380 + 1) || ': archive]' || chr(10) || text || chr(10), chr(10) || '---' || chr(10) ORDER BY i)) AS context_md5 FROM z GROUP BY ALL",
    "engine_endnotes": _P + _C + ", n AS (SELECT doc_id, unnest(map_keys(endnotes)) AS endnote_id, unnest(map_values(endnotes)) AS text FROM documents), t AS (SELECT min(term) AS term FROM (SELECT term FROM post GROUP BY term HAVING count(DISTINCT chunk_id) BETWEEN 5 AND 9) WHERE term IN (SELECT term FROM post JOIN c USING (chunk_id) JOIN n USING (doc_id))), i AS (SELECT DISTINCT endnote_id FROM post JOIN t USING (term) JOIN c USING (chunk_id) JOIN n USING (doc_id)) SELECT 'endnote_' || endnote_id AS chunk_id, 'Endnotes' AS filename, min(text) AS text FROM i JOIN n USING (endnote_id) GROUP BY endnote_id",
}


def _mentions() -> str:
    """mm: every mention of the index of `build_index`, by the fragments of the extractors' own SQL."""
    generic, crisis = Q.listed(L.GENERIC_NAME_WORDS), texts._CRISIS
    law = f"c AS (SELECT chunk_id, unnest({Q.found(Q.tagless('text'), f'(?:{texts._LAW})[0-9]{{4}}')}) AS c FROM k), b AS (SELECT chunk_id, c, CASE regexp_extract(c, '^([A-Z]+)', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LAW_PREFIXES.items()) + " END || ' ' || right(c, 4) AS f FROM c)"
    lexicon = " UNION ALL ".join(f"SELECT chunk_id, unnest(list_transform({Q.found(Q.tagless('text'), p, '(?i)')}, lambda x: regexp_replace(x, '([^{Q.W}])[^{Q.W}]', '\\1', 'g'))) AS h FROM k" for p in (f"old{Q.S}+believers?", f"court{Q.S}+bankers?", f"clearing{Q.S}+house"))
    plain = f"list_transform({{w}}, lambda x: regexp_replace(x, '^[^\\p{{{{L}}}}\\p{{{{N}}}}&]+|[^\\p{{{{L}}}}\\p{{{{N}}}}&]+$', '', 'g'))"
    name = "array_to_string(" + plain.format(w=Q.words("lower(full_name)")) + ", ' ')"
    text = "' ' || array_to_string(" + plain.format(w=Q.words("lower(" + Q.tagless("text") + ")")) + ", ' ') || ' '"
    return (
        texts._PARTS.rstrip() + f", r AS (SELECT chunk_id, p FROM q WHERE lower(p[len(p)]) NOT IN ({generic})), y AS (SELECT DISTINCT chunk_id, unnest({crisis}) AS y FROM k), {law}, h AS ({lexicon}), {texts._FIRMS}{texts._DEFINITIONS.rstrip()}"
        + f", names AS (SELECT DISTINCT acronym, unnest([f, regexp_replace(f, '(^| )and( |$)', '\\1&\\2', 'g')]) AS f FROM (SELECT acronym, {name} AS f FROM def)), big AS (SELECT chunk_id, {text} AS g FROM k),"
        + f" tok AS (SELECT DISTINCT chunk_id, unnest({Q.found(Q.tagless('text'), '[A-Z][A-Za-z]{1,9}')}) AS a FROM k), ac AS (SELECT DISTINCT chunk_id, a FROM tok WHERE a IN (SELECT acronym FROM def)), an AS (SELECT DISTINCT chunk_id, acronym AS a FROM big JOIN names ON contains(g, ' ' || f || ' ')),"
        " mm AS (SELECT p[len(p)] AS term, chunk_id FROM r UNION ALL SELECT unnest(p[2 : len(p) - 1]), chunk_id FROM r WHERE len(p) >= 3 UNION ALL SELECT * FROM firm UNION ALL SELECT unnest([c, lower(c), f, lower(f)]), chunk_id FROM b UNION ALL SELECT unnest(['panic_of_' || y, 'panic of ' || y]), chunk_id FROM y"
        " UNION ALL SELECT unnest(list_distinct([replace(h, ' ', '_'), replace(h, '_', ' ')])), chunk_id FROM h UNION ALL SELECT unnest([a, lower(a)]), chunk_id FROM ac UNION ALL SELECT unnest([a, lower(a)]), chunk_id FROM an)"
    )


_SPELLINGS = Q.listed(sorted({x.lower() for c, vs in L.SAMPLE_GROUPS.items() for v in (c, *vs) for x in (v, v.replace(" ", "_"))}))
ORACLES["build_index"] = (
    _mentions() + ", pa AS (SELECT term, chunk_id, count(*) AS tf FROM mm WHERE term <> '' GROUP BY ALL), fr AS (SELECT term FROM pa GROUP BY term HAVING sum(tf) >= 2 UNION SELECT unnest([acronym, lower(acronym)]) FROM def"
    + f" UNION SELECT term FROM pa WHERE lower(term) IN ({_SPELLINGS})), pp AS (SELECT * FROM pa WHERE term IN (SELECT term FROM fr)), " + _MERGE.format(s=_values(_SAMPLE), o=_values(_OUT), p="pp")
    + "SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM u GROUP BY term"
)
