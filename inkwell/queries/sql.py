"""Fragments of DuckDB SQL that the SQL twins of queries share. They restate semantics and share no code with the operators."""

# White space and word characters, as RE2 classes.
S = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
W = r"\p{L}\p{N}_"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{S}+'), lambda x: x <> '')"


def apart(text: str) -> str:
    """Every character that is no word character twice, so that neighbouring matches need not share one."""
    return f"regexp_replace({text}, '([^{W}])', '\\1\\1', 'g')"


def found(text: str, pattern: str, flags: str = "") -> str:
    """All matches of a pattern between word edges. Runs of white space in them are doubled; see `single`."""
    return f"regexp_extract_all({apart(text)}, '{flags}(?:^|[^{W}])({pattern})(?:$|[^{W}])', 1)"


def has(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, '{flags}(?:^|[^{W}])(?:{pattern})(?:$|[^{W}])')"


YEARS = r"1[6-9]\d{2}|20[0-2]\d"


def years(text: str) -> str:
    return f"list_transform({found(text, YEARS)}, lambda y: CAST(y AS INTEGER))"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{S}+|{S}+$', '', 'g')"


def tagless(text: str, to: str = " ") -> str:
    return f"regexp_replace(coalesce({text}, ''), '<[^>]+>', '{to}', 'g')"


def canonical(term: str) -> str:
    return f"trim(replace(regexp_replace({term}, '(?i)(''s|’s)$', ''), '''', ''))"


def sentences(text: str) -> str:
    """Never null for a text; the text itself where nothing is left."""
    parts = f"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?]+){S}+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {strip('x')}), lambda x: x <> '')"
    return f"(CASE WHEN len({parts}) > 0 THEN {parts} ELSE [{text}] END)"


def listed(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


#: w: the words of each document; k: its windows, as chunks (doc_id, pos, chunk_id, text, n_words).
CHUNKS = f"""WITH w AS (SELECT doc_id, filename, {words('text')} AS w FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, filename, w, unnest(range(0, len(w), 300)) AS s FROM w WHERE len(w) > 0),
k AS (SELECT doc_id, filename, CAST(s // 300 AS INTEGER) AS pos, doc_id || '_' || (s // 300) AS chunk_id, array_to_string(w[s + 1 : s + 400], ' ') AS text, len(w[s + 1 : s + 400]) AS n_words FROM p)
"""
#: s: the sentences of each chunk (chunk_id, doc_id, pos, sent, sentence).
SENTENCES = CHUNKS + f""", l AS (SELECT chunk_id, doc_id, pos, {sentences('text')} AS l FROM k),
s AS (SELECT chunk_id, doc_id, pos, unnest(range(0, len(l))) AS sent, unnest(l) AS sentence FROM l)
"""
#: m: mentions (term, chunk_id) of the stored indices; post: postings with tf.
POSTINGS = """WITH e AS (SELECT unnest(map_keys(term_to_chunks)) AS term, unnest(map_values(term_to_chunks)) AS ids FROM indices),
m AS (SELECT term, unnest(ids) AS chunk_id FROM e), post AS (SELECT term, chunk_id, count(*) AS tf FROM m WHERE chunk_id IS NOT NULL GROUP BY ALL)
"""
#: d: detections (run_id, identity, surname).
DETECTIONS = """WITH r AS (SELECT run_id, unnest(map_keys(identities)) AS identity, unnest(map_values(identities)) AS v FROM detected_identities),
x AS (SELECT run_id, identity, unnest(v.families) AS s FROM r), d AS (SELECT run_id, identity, lower(trim(s)) AS surname FROM x WHERE trim(s) <> '')
"""
