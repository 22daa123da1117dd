"""Exact nearest neighbours by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows with unit vectors; null, empty and zero vectors are left out."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    kept = rows.where(F.size(vector) > 0).withColumn("_n", norm).where("_n > 0")
    return kept.withColumn(vector, F.transform(vector, lambda x: x.cast("double") / F.col("_n"))).drop("_n")


def top_k(rows: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, similarity) of the k rows most like one query vector, ties by key: a scan with a top-k per task, no shuffle of vectors."""
    size = sum(x * x for x in query) ** 0.5
    if not size:
        raise ValueError("the query vector is zero")
    q = F.array(*[F.lit(float(x) / size) for x in query])
    return normalized(rows.select(key, vector), vector).select(key, dot(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def top_k_each(rows: DataFrame, every: int = 50, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = 1024, part: int = 16384) -> DataFrame:
    """(query_id, key, similarity, rank): the k nearest other rows of every row whose key is divisible by `every`, against all rows.

    Queries are cut into blocks of about `block` vectors and rows into parts of about `part`, whatever their number. The blocks, which are the smaller
    side, are sent to the parts, and a Python task keeps the k best of a part for each query: these are all that is shuffled afterwards. Ties go to the
    smaller key.
    """
    import numpy as np
    import pyarrow as pa

    unit = normalized(rows.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")), "v")
    asked = F.col("id") % every == 0
    counts = unit.agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("q")).first()
    blocks, parts = -(-max(1, counts.q) // block), -(-max(1, counts.n) // part)
    packed = unit.where(asked).groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "v")).alias("qs"))
    spread = unit.groupBy(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("id", "v")).alias("ds"))
    # a query is sent to as many parts as there are; no row is sent but once
    pairs = packed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))).join(spread, "part")

    def best(batches):
        for batch in batches:
            for qs, ds in zip(batch.column("qs").to_pylist(), batch.column("ds").to_pylist(), strict=True):
                qi, di = (np.asarray([x["id"] for x in xs], np.int64) for xs in (qs, ds))
                left, right = (np.asarray([x["v"] for x in xs]) for xs in (qs, ds))
                # a stretch of rows at a time bounds the matrix
                for at in range(0, len(di), 2048):
                    d = di[at : at + 2048]
                    s = left @ right[at : at + 2048].T
                    s[qi[:, None] == d[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(d, s.shape), -s), axis=1)[:, :k]
                    best_s = np.take_along_axis(s, order, 1).ravel()
                    keep = best_s > -np.inf
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qi, order.shape[1])[keep]), pa.array(d[order].ravel()[keep]), pa.array(best_s[keep])], names=["query_id", "id", "similarity"])

    from pyspark.sql import Window

    found = pairs.select("qs", "ds").mapInArrow(best, "query_id bigint, id bigint, similarity double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")))
    return ranked.where(F.col("rank") <= k).withColumnRenamed("id", key)
