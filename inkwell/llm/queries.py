"""Queries of problems 2 to 9 and, where SQL can express them on whole tables, their SQL."""

from pyspark.sql import functions as F

from inkwell.llm import bpe, frequency, mixing, names, neardup, pairs, split, subjects
from inkwell.operators.hotkeys import mentions
from inkwell.runtime import table

RARE_BELOW, COMMON_SHARE = 3, 0.2
CHUNK_WORDS, CHUNK_OVERLAP = 400, 100


def _similar(spark, folder):
    """What p2_found asks for: three words, a similarity of 0.5, texts of at least 20 words."""
    return neardup.near_duplicates(table(spark, folder, "documents"), threshold=0.5, shingle=3, least=20)


def p2_found(spark, folder):
    return neardup.all_pairs(_similar(spark, folder)).toDF("doc_id_a", "doc_id_b")


def p2_pairs(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents")).pairs.toDF("doc_id_a", "doc_id_b", "jaccard")


def p2_groups(spark, folder):
    return neardup.groups(neardup.near_duplicates(table(spark, folder, "documents"))).withColumnRenamed("id", "doc_id")


def _spellings(spark, folder):
    return names.variants(names.name_mentions(table(spark, folder, "indices"), table(spark, folder, "detected_identities")))


def p3_found(spark, folder):
    return names.linked(_spellings(spark, folder))


def p3_clusters(spark, folder):
    return _spellings(spark, folder)


def p4_terms(spark, folder):
    found = frequency.term_frequencies(mentions(table(spark, folder, "indices")), RARE_BELOW, COMMON_SHARE)
    return found.select("term", "n_mentions", "n_records", "mark")


def p4_found(spark, folder):
    return p4_terms(spark, folder).where("mark IS NOT NULL").select("term", "mark")


def p5_pieces(spark, folder):
    return split.split(table(spark, folder, "documents"), CHUNK_WORDS, CHUNK_OVERLAP)


def p5_coverage(spark, folder):
    """Of every text with words: their number, and whether its pieces hold all of them in order, none more than the limit, each with the overlap asked for."""
    pieces = split.split(table(spark, folder, "documents"), CHUNK_WORDS, CHUNK_OVERLAP, with_text=False)
    own = F.col("n_words") - F.col("overlap_words")
    # the k-th piece begins its own part where the ones before it end: the parts add up to the end of the last
    ends = F.max(F.col("first_word") + F.col("n_words"))
    overlap = F.col("overlap_words") == F.least(F.lit(CHUNK_OVERLAP), F.col("first_word") + F.col("overlap_words"))
    return pieces.groupBy("doc_id").agg(
        ends.cast("bigint").alias("n_words"), (F.sum(own) == ends).alias("all_words_once"), (F.max("n_words") <= CHUNK_WORDS).alias("within_limit"), F.every(overlap).alias("overlaps"),
        (F.count(F.lit(1)) == F.max("piece") + 1).alias("numbered"),
    )


def p5_found(spark, folder):
    return split.oversized(table(spark, folder, "documents"), CHUNK_WORDS, CHUNK_OVERLAP)


def p6_found(spark, folder):
    return pairs.defects(table(spark, folder, "queryrequest"), table(spark, folder, "querystatusresponse"), table(spark, folder, "documents"))


def p7_ids(spark, folder):
    return bpe.encode(table(spark, folder, "documents"))


def p7_decoded(spark, folder):
    """The texts that the ids of p7_ids decode to, by their md5."""
    ids = p7_ids(spark, folder)
    return bpe.decode(ids).select("doc_id", F.md5("text").alias("text_md5"))


def _mix(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "source_weights"))


def p8_mix(spark, folder):
    return _mix(spark, folder).records


def p8_shares(spark, folder):
    return _mix(spark, folder).shares


def _assigned(spark, folder):
    docs = table(spark, folder, "documents")
    return subjects.assign(docs, subjects.fit(docs, table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas")))


def p9_found(spark, folder):
    return _assigned(spark, folder).select("doc_id", "subject").distinct()


def p9_composition(spark, folder):
    return subjects.composition(_assigned(spark, folder), table(spark, folder, "documents"))


QUERIES = {
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_clusters": p3_clusters,
    "p4_found": p4_found,
    "p4_terms": p4_terms,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_coverage": p5_coverage,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}

_P4 = """WITH l AS (SELECT unnest(map_keys(term_to_chunks)) AS term, unnest(map_values(term_to_chunks)) AS ids FROM indices),
m AS (SELECT term, unnest(CASE WHEN coalesce(len(ids), 0) = 0 THEN [NULL] ELSE ids END) AS chunk_id FROM l),
t AS (SELECT term, count(chunk_id) AS n_mentions, count(DISTINCT chunk_id) AS n_records FROM m GROUP BY term),
f AS (SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records >= 0.2 * (SELECT count(DISTINCT chunk_id) FROM m) THEN 'common' END AS mark FROM t)
"""
# the longest runs of characters without the property White_Space
_P5 = r"[^\t-\r\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _shingled(n: int, least: int, of: str) -> str:
    """e: one row per text and distinct run of n words; z: how many each text has; j: similar texts (a, b, jaccard)."""
    run = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(w) - {n - 2}), lambda i: {run}))) AS l FROM d WHERE len(w) >= {max(n, least)}),
e AS (SELECT doc_id, unnest(l) AS s FROM {of}), z AS (SELECT doc_id, len(l) AS n FROM l),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM e x JOIN e y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
j AS (SELECT a, b, k / (p.n + q.n - k) AS jaccard FROM c JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b)
"""


ORACLES = {
    "p2_found": _shingled(3, 20, "l") + "SELECT a AS doc_id_a, b AS doc_id_b FROM j WHERE jaccard >= 0.5",
    # texts of one set are one class, under its smallest id
    "p2_pairs": _shingled(5, 0, "(SELECT min(doc_id) AS doc_id, l FROM l GROUP BY l)") + "SELECT a AS doc_id_a, b AS doc_id_b, jaccard FROM j WHERE jaccard >= 0.8",
    "p2_groups": _shingled(5, 0, "l").replace("WITH d", "WITH RECURSIVE d", 1) + """, v AS (SELECT a, b FROM j WHERE jaccard >= 0.8 UNION ALL SELECT b, a FROM j WHERE jaccard >= 0.8),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM l UNION SELECT v.b, r.m FROM r JOIN v ON v.a = r.doc_id), g AS (SELECT doc_id, min(m) AS group_id FROM r GROUP BY doc_id)
SELECT doc_id, group_id, (SELECT count(*) FROM v WHERE v.a = g.doc_id) AS n_links FROM g""",
    "p5_found": f"SELECT DISTINCT doc_id FROM documents WHERE len(regexp_extract_all(text, '{_P5}')) > 400",
    "p5_coverage": f"SELECT doc_id, len(regexp_extract_all(text, '{_P5}')) AS n_words, true AS all_words_once, true AS within_limit, true AS overlaps, true AS numbered FROM documents WHERE len(regexp_extract_all(text, '{_P5}')) > 0",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p4_terms": _P4 + "SELECT term, n_mentions, n_records, mark FROM f",
    "p4_found": _P4 + "SELECT term, mark FROM f WHERE mark IS NOT NULL",
}
