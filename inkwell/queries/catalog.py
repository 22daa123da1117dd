"""All core queries by name."""

from pyspark.sql import functions as F

from inkwell.plans.engine import Engine
from inkwell.queries import engines, hot, indexes, results, texts
from inkwell.runtime import table

MODULES = [texts, indexes, results, engines, hot]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}


def flagship(spark, folder):
    """Documents to chunks to terms: (term, tf, df, sample) of the whole collection, commonest first."""
    docs = table(spark, folder, "documents").select("doc_id", "filename", "text")
    built = Engine.build(docs)
    found = built.postings.groupBy("term").agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("df"), F.min("chunk_id").alias("sample"))
    return found.orderBy(F.desc("df"), "term")
