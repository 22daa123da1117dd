"""How often every term occurs and in how many records, with marks for the rare and the common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_frequencies(rows: DataFrame, rare_below: int, common_share: float, term: str = "term", record: str = "chunk_id") -> DataFrame:
    """(term, n_mentions, n_records, mark) of rows (term, record), one row per mention.

    Each record first emits its own term counts: rows are combined by hash on (term, record) inside the map task, so copies and a
    hot term shrink before anything is shuffled; the counts are then summed per term. `mark` is `rare` below `rare_below` records,
    `common` from `common_share` of all distinct records on, else null; rare wins where both hold. Null records are no mentions
    (a term with none keeps a row with zeros, marked rare); a null term is a term of its own. Empty input gives no rows.
    """
    per_record = rows.groupBy(term, record).agg(F.count(F.lit(1)).alias("_n"))
    totals = per_record.groupBy(term).agg(
        F.coalesce(F.sum(F.when(F.col(record).isNotNull(), F.col("_n"))), F.lit(0)).alias("n_mentions"),
        F.count(record).alias("n_records"),
    )
    everything = rows.where(F.col(record).isNotNull()).groupBy(record).agg(F.lit(1).alias("_x")).agg(F.count(F.lit(1)).alias("_all")).select("_all").scalar()
    mark = F.when(F.col("n_records") < rare_below, "rare").when(F.col("n_records") >= F.lit(common_share) * everything, "common")
    return totals.withColumn("mark", mark)
