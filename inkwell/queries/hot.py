"""Queries of problem 1 and their SQL."""

from inkwell.operators.hotkeys import heavy_keys, key_totals, mentions
from inkwell.runtime import table

HEAVY_SHARE = 0.04


def p1_terms(spark, folder):
    return key_totals(mentions(table(spark, folder, "indices"))).select("term", "n_elements", "n_distinct")


def p1_found(spark, folder):
    return heavy_keys(mentions(table(spark, folder, "indices")), HEAVY_SHARE).select("term")


QUERIES = {"p1_found": p1_found, "p1_terms": p1_terms}

_M = """WITH l AS (SELECT unnest(map_keys(term_to_chunks)) AS term, unnest(map_values(term_to_chunks)) AS ids FROM indices),
m AS (SELECT term, unnest(CASE WHEN coalesce(len(ids), 0) = 0 THEN [NULL] ELSE ids END) AS chunk_id FROM l),
t AS (SELECT term, count(chunk_id) AS n_elements, count(DISTINCT chunk_id) AS n_distinct FROM m GROUP BY term)
"""
ORACLES = {
    "p1_terms": _M + "SELECT term, n_elements, n_distinct FROM t",
    "p1_found": _M + "SELECT term FROM t WHERE n_elements >= 0.04 * (SELECT sum(n_elements) FROM t) AND n_elements > 0",
}
