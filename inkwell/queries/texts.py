"""Queries on chunks, sentences, text functions and extraction, with their SQL."""

from pyspark.sql import functions as F

from inkwell import lexicons as L
from inkwell.functions import text as X
from inkwell.operators import chunking, extract, index
from inkwell.queries import sql as Q
from inkwell.runtime import spread, table

#: Words of the test collection that stand for a keyword lexicon.
KEYWORDS = ["trust company", "national bank", "clearing house", "brothers"]
GROUPS = {"banks": ["national bank", "nb"], "trusts": ["trust company", "trust co"], "houses": ["clearing house", "exchange"]}
LEXICON = [r"\b(old believers?)\b", r"\b(court bankers?)\b", r"\b(clearing house)\b"]
ACRONYMS = sorted(L.ACRONYMS, key=lambda a: (-len(a), a))


def _docs(spark, folder):
    return spread(table(spark, folder, "documents"))


def chunks_of(spark, folder):
    return chunking.chunk(_docs(spark, folder))


def chunk_overlap(spark, folder):
    return chunks_of(spark, folder).select("doc_id", "pos", "chunk_id", F.md5("text").alias("text_md5"), "n_words")


def sentence_split(spark, folder):
    return chunking.sentences_of(_docs(spark, folder), "doc_id")


def sentence_shingles(spark, folder):
    s = chunking.sentences_of(_docs(spark, folder), "doc_id").where(F.col("sentence") != "")
    return s.select(F.explode(X.shingles(F.col("sentence"))).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sentence_subphrases(spark, folder):
    s = chunking.sentences_of(_docs(spark, folder), "doc_id")
    return s.select(F.explode(X.subphrases(F.col("sentence"), 5, 8)).alias("phrase")).groupBy("phrase").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def strip_tags(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(X.strip_tags(F.col("text"))).alias("spaced"), F.md5(X.strip_tags(F.col("text"), "")).alias("joined"))


def text_profile(spark, folder):
    t = F.col("text")
    d = _docs(spark, folder).where(t.isNotNull())
    return d.select(
        "doc_id", X.word_count(t).alias("n_words"), X.token_estimate(X.word_count(t)).alias("n_tokens"), F.md5(t).alias("md5"), X.preview(t).alias("preview"),
        F.length(X.truncated(t)).alias("truncated_chars"), F.md5(X.first_words(t)).alias("first_words_md5"), F.size(X.paragraphs(t)).alias("n_paragraphs"),
    )


def year_profile(spark, folder):
    t = F.col("text")
    return _docs(spark, folder).select("doc_id", F.size(X.years(t)).alias("n_years"), X.first_year(t).alias("first"), F.array_min(X.years(t)).alias("least"), F.array_max(X.years(t)).alias("most"), X.decade(X.first_year(t)).alias("decade"))


def canonical_terms(spark, folder):
    terms = table(spark, folder, "indices").select(F.explode(F.map_keys("term_to_chunks")).alias("term")).distinct()
    t = F.col("term")
    return terms.select("term", X.canonical(t).alias("canonical"), X.underscored(t).alias("underscored"), X.spaced(t).alias("spaced"), X.capitalized(t).alias("capitalized"), X.titled(t).alias("titled"), X.plural_toggled(F.lower(t)).alias("toggled"))


def prefilter_stats(spark, folder):
    return chunking.prefilter_stats(spread(table(spark, folder, "chunks")), KEYWORDS)


def middle(rows, column: str):
    """The time halfway between the first and the last."""
    t = rows.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    return t.select((F.col("a") + (F.col("b") - F.col("a")) / 2).alias("m")).select("m").scalar()


def incremental_chunks(spark, folder):
    """The chunks against the cache of those indexed in the first half of the time."""
    chunks = spread(table(spark, folder, "chunks"))
    cache = chunking.hashed(chunks.where(F.col("indexed_at") < middle(chunks, "indexed_at"))).select("chunk_hash", F.lit("v2").alias("prompt_version"))
    return chunking.unseen(chunks, cache, "v2")


def _counted(mentions):
    return index.terms(index.postings(mentions))


def surname_terms(spark, folder):
    return _counted(extract.surnames(chunks_of(spark, folder)))


def middle_name_terms(spark, folder):
    return _counted(extract.middle_names(chunks_of(spark, folder)))


def italic_firms(spark, folder):
    c = chunks_of(spark, folder)
    found = F.filter(F.transform(F.regexp_extract_all("text", F.lit(extract.ITALIC), F.lit(1)), X.strip), lambda f: F.length(f) < 100)
    return c.select(F.explode(found).alias("firm"), "chunk_id").groupBy("firm").agg(F.count(F.lit(1)).alias("tf"), F.count_distinct("chunk_id").alias("df"))


def firm_terms(spark, folder):
    return _counted(extract.firms(chunks_of(spark, folder)))


def law_terms(spark, folder):
    return _counted(extract.law_terms(chunks_of(spark, folder)))


def panic_terms(spark, folder):
    return _counted(extract.panic_terms(chunks_of(spark, folder)))


def panic_terms_listed(spark, folder):
    return _counted(extract.panic_terms(chunks_of(spark, folder), [int(y) for y in L.CRISIS_YEARS]))


def lexicon_terms(spark, folder):
    return _counted(extract.lexicon_terms(chunks_of(spark, folder), LEXICON))


def _definitions(spark, folder):
    return extract.acronym_definitions(chunks_of(spark, folder))


def acronym_definitions(spark, folder):
    return _definitions(spark, folder)


def acronym_terms(spark, folder):
    fixed = spark.createDataFrame(list(L.ACRONYMS.items()), "acronym string, full_name string")
    return _counted(extract.acronym_tokens(chunks_of(spark, folder), fixed))


def acronym_names(spark, folder):
    names = spark.createDataFrame([("EX", "Aldermoor Exchange"), ("CH", "Ellery Clearing House"), ("BA", "Bank of Aldermoor")], "acronym string, full_name string")
    return _counted(extract.acronym_names(chunks_of(spark, folder), names))


def acronym_places(spark, folder):
    return _counted(extract.acronym_places(chunks_of(spark, folder), ["NB", "TC"], ["of aldermoor", "zeknockipin", "vemvlhodel"]))


def word_terms(spark, folder):
    return _counted(extract.all_words(chunks_of(spark, folder)))


def name_changes(spark, folder):
    return extract.name_changes(chunks_of(spark, folder).select("chunk_id", F.col("text")))


def surname_search(spark, folder):
    found = table(spark, folder, "detected_identities").select(F.explode("identities").alias("i", "v")).select(F.explode("v.families").alias("s"))
    names = found.select(F.lower(F.trim("s")).alias("surname")).where("surname <> ''").distinct()
    hits = extract.surname_search(spread(table(spark, folder, "chunks")), names)
    return hits.groupBy("surname").agg(F.count(F.lit(1)).alias("n_chunks"))


def terms_present(spark, folder):
    terms = table(spark, folder, "indices").select(F.explode(F.map_keys("term_to_chunks")).alias("term")).distinct()
    return extract.terms_present(spread(table(spark, folder, "chunks")), terms).groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks"))


def keyword_context(spark, folder):
    return _docs(spark, folder).select("doc_id", F.explode(X.in_context(F.col("text"), "clearing house")).alias("context"))


def relations(spark, folder):
    shapes = [("with", r"([A-Z][a-z]+) and ([A-Z][a-z]+)", False), ("at", r"([A-Z][a-z]+) at ([A-Z][a-z]+)", True)]
    return extract.related(chunks_of(spark, folder), shapes)


def weighted_patterns(spark, folder):
    return extract.patterns_found(chunks_of(spark, folder), {"trust": [(r"([A-Z][a-z]+) Trust Company", 5), (r"([A-Z][a-z]+) Trust Co\.", 1)], "bank": [(r"([A-Z][a-z]+) National Bank", 5)]})


_NAMES = ["chunk_overlap", "sentence_split", "sentence_shingles", "sentence_subphrases", "strip_tags", "text_profile", "year_profile", "canonical_terms", "prefilter_stats", "incremental_chunks",
          "surname_terms", "middle_name_terms", "italic_firms", "firm_terms", "law_terms", "panic_terms", "panic_terms_listed", "lexicon_terms", "acronym_definitions", "acronym_terms", "acronym_names", "acronym_places", "word_terms",
          "name_changes", "surname_search", "terms_present", "keyword_context", "relations", "weighted_patterns"]
QUERIES = {n: globals()[n] for n in _NAMES}

_COUNT = "SELECT term, CAST(sum(tf) AS BIGINT) AS tf, count(*) AS df FROM (SELECT term, chunk_id, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL) GROUP BY term"
_PROPER = f"[A-Z][a-z]+(?:{Q.S}+[A-Z][a-z]+)+"
_PARTS = Q.CHUNKS + f", n AS (SELECT chunk_id, unnest({Q.found('text', _PROPER)}) AS n FROM k), q AS (SELECT chunk_id, list_filter(regexp_split_to_array(n, '{Q.S}+'), lambda x: x <> '') AS p FROM n)\n"
_LAW = "|".join(sorted(L.LAW_PREFIXES, key=lambda p: (-len(p), p)))
_CRISIS = "regexp_extract_all(" + Q.apart(Q.tagless("text", "")) + f", '(?:^|[^{Q.W}])(?:[Pp]anic|[Cc]risis){Q.S}+of{Q.S}+(\\d{{4}})(?:$|[^{Q.W}])', 1)"
_PANIC = Q.CHUNKS + f", y AS (SELECT DISTINCT chunk_id, unnest({_CRISIS}) AS y FROM k), t AS (SELECT 'panic_of_' || y AS term, chunk_id FROM y UNION ALL SELECT 'panic of ' || y, chunk_id FROM y)\n"
_TRIG = f"list_transform(range(1, len(w) - {{n}} + 2), lambda i: array_to_string(w[i : i + {{n}} - 1], ' '))"
_KINDS = "NB|IHC|PU|SB|HC|TC"
_NB = "(?i)" + f"(?:^|[^{Q.W}])([A-Z][a-z]+){Q.S}+NB{Q.S}+of{Q.S}+[A-Z][a-z]+"
_PLACE = f"[A-Z][a-z]+(?:{Q.S}+[A-Z][a-z]+)*"
_ALONE = f"(?i)(<italic>([A-Z][a-z]+)</italic>{Q.S}+({_KINDS}))(?:''s)?(?:{Q.S}|[,.]|$)"
#: firm: (term, chunk_id), a row for each mention of a firm.
_FIRMS = f"""fb AS (SELECT chunk_id, unnest(list_concat(regexp_extract_all(text, '(?i)<italic>([A-Z][a-z]+)</italic>{Q.S}+NB{Q.S}+<italic>of</italic>{Q.S}+<italic>{_PLACE}</italic>', 1), regexp_extract_all(text, '(?i)<italic>([A-Z][a-z]+)</italic>{Q.S}+NB{Q.S}+of{Q.S}+<italic>{_PLACE}</italic>', 1), regexp_extract_all({Q.apart(Q.tagless('text'))}, '{_NB}', 1))) AS n FROM k),
fa AS (SELECT chunk_id, unnest(regexp_extract_all(text, '{_ALONE}', 2)) AS n, upper(unnest(regexp_extract_all(text, '{_ALONE}', 3))) AS kind FROM k),
fi AS (SELECT chunk_id, {Q.canonical('f')} AS f FROM (SELECT chunk_id, {Q.strip('f')} AS f FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '(?i)<italic>([^<]+?)</italic>', 1)) AS f FROM k)) WHERE length(f) < 100),
fk AS (SELECT * FROM fi WHERE length(f) > 1 AND NOT regexp_matches(f, '^[,.;:!?&\\-—–()\\[\\]{{}}"''/\\\\|]') AND NOT regexp_matches(f, '[,.;:!?&\\-—–"''/\\\\|]$') AND (contains(f, ' ') OR lower(f) NOT IN ({Q.listed(L.GENERIC_NAME_WORDS)}))),
firm AS (SELECT unnest([n || ' NB', n || ' National Bank']) AS term, chunk_id FROM fb UNION ALL SELECT n || ' ' || kind, chunk_id FROM fa UNION ALL SELECT n || ' National Bank', chunk_id FROM fa WHERE kind = 'NB' UNION ALL SELECT f, chunk_id FROM fk
UNION ALL SELECT regexp_replace(f, '(?i)(^|[^{Q.W}])NB($|[^{Q.W}])', '\\1National Bank\\2', 'g'), chunk_id FROM fk WHERE regexp_matches(lower(f), ' nb( |$)')),
"""
_QUOTE, _FULL2, _FULL3 = "[\"“”‘’«»]", f"[A-Z][a-z]+(?:{Q.S}+(?:[A-Z][a-z]+|of|and|&|the))*{Q.S}+[A-Z][a-z]+", f"[A-Z][a-z]+(?:{Q.S}+[A-Z][a-z]+)+"
_SHAPES = [(f"(?:^|[^{Q.W}])([A-Z]{{2,10}}){Q.S}*\\(([^)\"]{{5,50}}?)\\)", 1, 2), (f"(?:^|[^{Q.W}])({_FULL2}){Q.S}*\\(([A-Z]{{2,10}})\\)", 2, 1), (f"(?:^|[^{Q.W}])([A-Z]{{2,10}}){Q.S}*,{Q.S}*or{Q.S}+({_FULL3})", 1, 2), (f"(?:^|[^{Q.W}])({_FULL3}){Q.S}*\\({_QUOTE}([A-Z]{{2,10}}){_QUOTE}\\)", 2, 1)]
#: def: (acronym, full_name), the shortest definition of each acronym, the fixed ones over all.
_DEFINITIONS = "da AS (" + " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(v, '{p}', {a})) AS acronym, unnest(regexp_extract_all(v, '{p}', {f})) AS full_name FROM kv" for p, a, f in _SHAPES) + f"""), db AS (SELECT acronym, {Q.strip('full_name')} AS full_name FROM da),
fixed AS (SELECT * FROM (VALUES {", ".join("(" + Q.listed(x) + ")" for x in L.ACRONYMS.items())}) x(acronym, full_name)),
def AS (SELECT acronym, arg_min(full_name, (length(full_name), full_name)) AS full_name FROM db WHERE length(full_name) BETWEEN 5 AND 100 AND acronym NOT IN (SELECT acronym FROM fixed) GROUP BY acronym UNION ALL SELECT * FROM fixed)
"""
_DEFINITIONS = f"kv AS (SELECT {Q.tagless('text')} AS v FROM k), " + _DEFINITIONS

#: h: (name, chunk_id) of the chunks in which `\\bname\\b` stands, whatever the case.
_KEY = "regexp_replace(" + Q.strip("lower(name)") + f", '{Q.S}+', ' ', 'g')"
_EDGES = tuple(f"CASE WHEN regexp_matches(k, '{p}') THEN '{word}' ELSE '{other}' END" for p, word, other in ((f"^[{Q.W}]", f"(?:^|[^{Q.W}])", f"[{Q.W}]"), (f"[{Q.W}]$", f"(?:$|[^{Q.W}])", f"[{Q.W}]")))
_EVERYWHERE = f""", nk AS (SELECT DISTINCT name, {_KEY} AS k FROM n), q AS (SELECT name, k, {_EDGES[0]} || regexp_escape(k) || {_EDGES[1]} AS p FROM nk WHERE k <> ''),
z AS (SELECT DISTINCT chunk_id, lower(text) AS x FROM chunks WHERE text IS NOT NULL), m AS MATERIALIZED (SELECT name, p, chunk_id, x FROM q JOIN z ON contains(x, k)),
h AS (SELECT DISTINCT name, chunk_id FROM m WHERE regexp_matches(x, p))
"""

ORACLES = {
    "chunk_overlap": Q.CHUNKS + "SELECT doc_id, pos, chunk_id, md5(text) AS text_md5, n_words FROM k",
    "sentence_split": f"SELECT doc_id, unnest(range(0, len(l))) AS sent, unnest(l) AS sentence FROM (SELECT doc_id, {Q.sentences('text')} AS l FROM documents WHERE text IS NOT NULL)",
    "sentence_shingles": f"""WITH s AS (SELECT unnest({Q.sentences('text')}) AS s FROM documents WHERE text IS NOT NULL), w AS (SELECT s, {Q.words('s')} AS w FROM s WHERE s <> ''),
g AS (SELECT unnest(list_distinct(list_concat([s], {_TRIG.format(n=5)}))) AS shingle FROM w) SELECT shingle, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 1""",
    "sentence_subphrases": f"""WITH s AS (SELECT unnest({Q.sentences('text')}) AS s FROM documents WHERE text IS NOT NULL), w AS (SELECT {Q.words('lower(s)')} AS w FROM s),
g AS (SELECT unnest(list_distinct(list_concat({", ".join(_TRIG.format(n=n) for n in (5, 6, 7, 8))}))) AS phrase FROM w) SELECT phrase, count(*) AS n FROM g GROUP BY 1 HAVING count(*) > 1""",
    "strip_tags": f"SELECT doc_id, md5({Q.tagless('text')}) AS spaced, md5({Q.tagless('text', '')}) AS joined FROM documents",
    "text_profile": f"""WITH d AS (SELECT doc_id, text, {Q.words('text')} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(w) AS n_words, CAST(floor(len(w) * 1.3) AS BIGINT) AS n_tokens, md5(text) AS md5, substr(text, 1, 100) AS preview,
CASE WHEN length(text) > 15000 THEN 15000 + length('[Truncated]') + 2 ELSE length(text) END AS truncated_chars, md5(CASE WHEN len(w) > 100 THEN array_to_string(w[1:100], ' ') || '...' ELSE text END) AS first_words_md5,
len(list_filter(list_transform(regexp_split_to_array({Q.strip('text')}, '\\n{Q.S}*\\n'), lambda x: {Q.strip('x')}), lambda x: x <> '')) AS n_paragraphs FROM d""",
    "year_profile": f"""SELECT doc_id, coalesce(len(y), 0) AS n_years, y[1] AS first, list_min(y) AS least, list_max(y) AS most, coalesce(CAST(y[1] // 10 * 10 AS VARCHAR), 'unknown') AS decade FROM (SELECT doc_id, {Q.years('text')} AS y FROM documents)""",
    "canonical_terms": f"""WITH t AS (SELECT DISTINCT unnest(map_keys(term_to_chunks)) AS term FROM indices) SELECT term, {Q.canonical('term')} AS canonical, replace(term, ' ', '_') AS underscored, replace(term, '_', ' ') AS spaced,
upper(substr(term, 1, 1)) || lower(substr(term, 2)) AS capitalized, array_to_string(list_transform(regexp_extract_all(term, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(substr(x, 1, 1)) || lower(substr(x, 2))), '') AS titled, CASE WHEN lower(term) LIKE '%s' AND length(term) > 2 THEN substr(lower(term), 1, length(lower(term)) - 1) ELSE lower(term) || 's' END AS toggled FROM t""",
    "prefilter_stats": f"SELECT total, relevant, total - relevant AS filtered, coalesce(relevant * 100.0 / nullif(total, 0), 0) AS pct FROM (SELECT count(*) AS total, count(*) FILTER ({Q.has('text', '|'.join(KEYWORDS), '(?i)')}) AS relevant FROM chunks)",
    "incremental_chunks": "SELECT DISTINCT md5(text) AS chunk_hash, substr(text, 1, 100) AS text_preview FROM chunks WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM chunks WHERE text IS NOT NULL AND indexed_at < (SELECT min(indexed_at) + (max(indexed_at) - min(indexed_at)) / 2 FROM chunks))",
    "surname_terms": _PARTS + f", r AS (SELECT chunk_id, p[len(p)] AS s FROM q), f AS (SELECT chunk_id, s, {Q.canonical('s')} AS c FROM r), t AS (SELECT unnest(list_distinct([s, c])) AS term, chunk_id FROM f WHERE lower(c) NOT IN ({Q.listed(L.GENERIC_NAME_WORDS)}))\n" + _COUNT,
    "middle_name_terms": _PARTS + f", t AS (SELECT unnest(p[2 : len(p) - 1]) AS term, chunk_id FROM q WHERE len(p) >= 3 AND lower(p[len(p)]) NOT IN ({Q.listed(L.GENERIC_NAME_WORDS)}))\n" + _COUNT,
    "italic_firms": Q.CHUNKS + f", f AS (SELECT chunk_id, unnest(list_transform(regexp_extract_all(text, '(?i)<italic>([^<]+?)</italic>', 1), lambda x: {Q.strip('x')})) AS firm FROM k) SELECT firm, count(*) AS tf, count(DISTINCT chunk_id) AS df FROM f WHERE length(firm) < 100 GROUP BY firm",
    "law_terms": Q.CHUNKS + f", c AS (SELECT chunk_id, unnest({Q.found(Q.tagless('text'), f'(?:{_LAW})[0-9]{{4}}')}) AS c FROM k), b AS (SELECT chunk_id, c, CASE regexp_extract(c, '^([A-Z]+)', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.LAW_PREFIXES.items()) + " END || ' ' || right(c, 4) AS f FROM c), t AS (SELECT unnest([c, lower(c), f, lower(f)]) AS term, chunk_id FROM b)\n" + _COUNT,
    "panic_terms": _PANIC + _COUNT,
    "panic_terms_listed": _PANIC.replace("AS y FROM k)", f"AS y FROM k), z AS (SELECT * FROM y WHERE y IN ({Q.listed(L.CRISIS_YEARS)}))").replace("FROM y UNION", "FROM z UNION").replace("chunk_id FROM y)", "chunk_id FROM z)") + _COUNT,
    "firm_terms": Q.CHUNKS + ", " + _FIRMS + "t AS (SELECT term, chunk_id FROM firm)\n" + _COUNT,
    "acronym_definitions": Q.CHUNKS + ", " + _DEFINITIONS + "SELECT acronym, full_name FROM def",
    "acronym_places": Q.CHUNKS + f", t AS (SELECT regexp_replace(unnest({Q.found(Q.tagless('text'), f'(?:NB|TC){Q.S}+[A-Z][a-z]+(?:{Q.S}+[A-Z][a-z]+)?')}), '{Q.S}+', ' ', 'g') AS term, chunk_id FROM k), u AS (SELECT * FROM t WHERE lower(regexp_replace(term, '^\\S+ ', '')) IN ('of aldermoor', 'zeknockipin', 'vemvlhodel'))\n" + _COUNT.replace("FROM t ", "FROM u "),
    "lexicon_terms": Q.CHUNKS + ", h AS (" + " UNION ALL ".join(f"SELECT chunk_id, unnest(list_transform({Q.found(Q.tagless('text'), p, '(?i)')}, lambda x: regexp_replace(x, '([^{Q.W}])[^{Q.W}]', '\\1', 'g'))) AS h FROM k" for p in (f"old{Q.S}+believers?", f"court{Q.S}+bankers?", f"clearing{Q.S}+house")) + "), t AS (SELECT unnest(list_distinct([replace(h, ' ', '_'), replace(h, '_', ' ')])) AS term, chunk_id FROM h)\n" + _COUNT,
    "acronym_terms": Q.CHUNKS + f", a AS (SELECT DISTINCT chunk_id, unnest({Q.found(Q.tagless('text'), '|'.join(ACRONYMS))}) AS a FROM k), t AS (SELECT unnest([a, lower(a)]) AS term, chunk_id FROM a)\n" + _COUNT,
    "acronym_names": Q.CHUNKS + f", g AS (SELECT chunk_id, ' ' || array_to_string(list_transform({Q.words('lower(' + Q.tagless('text') + ')')}, lambda x: regexp_replace(x, '^[^\\p{{L}}\\p{{N}}&]+|[^\\p{{L}}\\p{{N}}&]+$', '', 'g')), ' ') || ' ' AS g FROM k), t AS (SELECT unnest([n.a, lower(n.a)]) AS term, chunk_id FROM g JOIN (VALUES ('EX', 'aldermoor exchange'), ('CH', 'ellery clearing house'), ('BA', 'bank of aldermoor')) n(a, f) ON contains(g, ' ' || f || ' '))\n" + _COUNT,
    "word_terms": Q.CHUNKS + f", t AS (SELECT unnest({Q.found('lower(text)', '[a-z]{4,}')}) AS term, chunk_id FROM k)\n" + _COUNT,
    "name_changes": Q.CHUNKS + """, c AS (SELECT text FROM k WHERE NOT regexp_matches(lower(text), 'née|nee')), g AS (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+)\\s+(?:changed|anglicized).*?name.*?to\\s+([A-Z][a-z]+)', 1)) AS o, unnest(regexp_extract_all(text, '([A-Z][a-z]+)\\s+(?:changed|anglicized).*?name.*?to\\s+([A-Z][a-z]+)', 2)) AS n FROM c
UNION ALL SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+).*?formerly.*?([A-Z][a-z]+)', 1)), unnest(regexp_extract_all(text, '([A-Z][a-z]+).*?formerly.*?([A-Z][a-z]+)', 2)) FROM c) SELECT DISTINCT lower(o) AS old_name, lower(n) AS new_name FROM g""",
    "surname_search": Q.DETECTIONS + ", n AS (SELECT DISTINCT surname AS name FROM d)" + _EVERYWHERE + "SELECT name AS surname, count(*) AS n_chunks FROM h GROUP BY name",
    "terms_present": "WITH t AS (SELECT DISTINCT unnest(map_keys(term_to_chunks)) AS name FROM indices), n AS (SELECT name FROM t WHERE trim(name) <> '')" + _EVERYWHERE + "SELECT name AS term, count(*) AS n_chunks FROM h GROUP BY name",
    "keyword_context": "SELECT doc_id, unnest(regexp_extract_all(text, '(?is).{80}clearing house.{80}')) AS context FROM documents",
    "relations": Q.CHUNKS + """, a AS (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+) and ([A-Z][a-z]+)', 1)) AS a, unnest(regexp_extract_all(text, '([A-Z][a-z]+) and ([A-Z][a-z]+)', 2)) AS b FROM k),
b AS (SELECT unnest(regexp_extract_all(text, '([A-Z][a-z]+) at ([A-Z][a-z]+)', 1)) AS a, unnest(regexp_extract_all(text, '([A-Z][a-z]+) at ([A-Z][a-z]+)', 2)) AS b FROM k)
SELECT DISTINCT * FROM (SELECT a, b, 'with' AS relation, false AS directed FROM a UNION ALL SELECT b, a, 'with', false FROM a UNION ALL SELECT a, b, 'at', true FROM b)""",
    "weighted_patterns": Q.CHUNKS + """, h AS (SELECT 'trust' AS label, lower(unnest(regexp_extract_all(text, '([A-Z][a-z]+) Trust Company', 1))) AS name, 5 AS w FROM k UNION ALL SELECT 'trust', lower(unnest(regexp_extract_all(text, '([A-Z][a-z]+) Trust Co\\.', 1))), 1 FROM k
UNION ALL SELECT 'bank', lower(unnest(regexp_extract_all(text, '([A-Z][a-z]+) National Bank', 1))), 5 FROM k) SELECT label, name, CAST(sum(w) AS BIGINT) AS score FROM h GROUP BY 1, 2""",
}
