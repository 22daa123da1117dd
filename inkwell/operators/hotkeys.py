"""Per-key results where a handful of keys own most rows: exact offset chunking.

The rows of a key are numbered without ever meeting in one task. Keys are counted per input partition, a file of a stored table, whose
name and rows no recomputation changes; a prefix sum over the counts of a key, one for each partition that has it, gives each partition
its offset, and offset plus position inside the partition is the row's number. Equal ranges of numbers make equal-sized pieces of work;
a piece leaves a small state with its first and last value, and the states of a key are merged in order, adjoining pieces comparing the
values at their common boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.runtime import stored

#: Most rows of an input partition: what one task numbers of a key, whatever the key and the table.
PARTITION = 1 << 20


def mentions(indices: DataFrame) -> DataFrame:
    """(term, chunk_id), one row per element of every list of `term_to_chunks`, repeated rows and elements included.

    A null map gives nothing; a null or empty list gives one row with a null chunk_id, so its term is not lost; a null element
    gives a row with a null chunk_id. Other columns of the input, whatever their names, are not read.
    """
    lists = indices.select(F.explode("term_to_chunks").alias("term", "_ids"))
    return lists.select("term", F.explode_outer("_ids").alias("chunk_id"))


def numbered(df: DataFrame, key: str, order: list[str], weight: str, bucket: Column) -> DataFrame:
    """Adds `_bucket`, `_pos` (0, 1, ... within a key) and `_before` (weight of the earlier rows of the key) to each row.

    `bucket` is an integer computed from the row; rows of a key are ordered by (bucket, order), so a bucket that rises with the
    order columns keeps their order. It must not depend on the task that computes it: the numbers are then the same after any recomputation.
    A key that owns all rows still forms one group for each bucket. Rows with a null key are left out.
    """
    spread = df.where(F.col(key).isNotNull()).withColumn("_bucket", bucket.cast("bigint")).repartition("_bucket", key)
    counts = spread.groupBy("_bucket", key).agg(F.count(F.lit(1)).alias("_n"), F.sum(weight).alias("_w"))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", key, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for c, n in (("_n", "_rows_before"), ("_w", "_weight_before"))])
    inside = Window.partitionBy("_bucket", key).orderBy(*order)
    run = F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = spread.withColumn("_row", F.row_number().over(inside)).withColumn("_run", run)
    joined = local.join(offsets, ["_bucket", key])
    return joined.withColumn("_pos", F.col("_rows_before") + F.col("_row") - 1).withColumn("_before", F.col("_weight_before") + F.col("_run")).drop("_rows_before", "_weight_before", "_row", "_run")


def key_totals(rows: DataFrame, key: str = "term", value: str = "chunk_id", piece: int = 4096) -> DataFrame:
    """(key, n_elements, n_distinct, n_pieces) of every key of `rows` (key, value).

    Null values are not counted; a key with null values only comes out with zeros. Ties and repeated rows all count as elements and
    once as distinct value. Rows with a null key are left out. An empty input gives an empty result. `piece` is the size of one unit of work, whatever the key.
    """
    return _totals(_combined(rows, key, value), key, value, piece)


def _combined(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, _n, _bucket), null values included, from one reading of `rows`; _bucket is the input partition, by the name of its file."""
    # partial aggregation before the shuffle: copies of one (key, value) leave a map task as one row
    made = stored(rows.where(F.col(key).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n")), "combined", PARTITION)
    return made.withColumn("_bucket", F.xxhash64("_metadata.file_name"))


def _totals(combined: DataFrame, key: str, value: str, piece: int) -> DataFrame:
    order = numbered(combined.where(F.col(value).isNotNull()), key, [value], "_n", F.col("_bucket"))
    place = F.struct("_bucket", F.col(value))
    states = order.groupBy(key, (F.floor(F.col("_pos") / piece)).alias("_piece")).agg(
        F.sum("_n").alias("_elements"),
        F.count(F.lit(1)).alias("_distinct"),
        F.min(place).alias("_first"),
        F.max(place).alias("_last"),
    )
    # a state meets the one behind it under that one's number: no task sees all pieces of a key
    ends = F.array(F.struct(F.lit(0).alias("after"), F.col("_elements"), F.col("_distinct"), F.col("_first").alias("_edge")), F.struct(F.lit(1).alias("after"), F.lit(0).cast("bigint").alias("_elements"), F.lit(0).cast("bigint").alias("_distinct"), F.col("_last").alias("_edge")))
    met = states.select(key, "_piece", F.explode(ends).alias("e")).groupBy(key, (F.col("_piece") + F.col("e.after")).alias("_piece")).agg(
        F.sum("e._elements").alias("_elements"),
        # a value that ends one piece and begins the next was counted in both
        (F.sum("e._distinct") - F.when(F.min(F.when(F.col("e.after") == 0, F.col("e._edge"))) == F.max(F.when(F.col("e.after") == 1, F.col("e._edge"))), 1).otherwise(0)).alias("_distinct"),
        F.count_if(F.col("e.after") == 0).alias("_pieces"),
    )
    zero: Column = F.lit(0).cast("bigint")
    bare = combined.where(F.col(value).isNull()).select(key, zero.alias("_elements"), zero.alias("_distinct"), zero.alias("_pieces"))
    return met.select(key, "_elements", "_distinct", "_pieces").union(bare).groupBy(key).agg(F.sum("_elements").alias("n_elements"), F.sum("_distinct").alias("n_distinct"), F.sum("_pieces").alias("n_pieces"))


def heavy_keys(rows: DataFrame, share: float, key: str = "term", value: str = "chunk_id") -> DataFrame:
    """Keys of `key_totals` that own at least `share` of all non-null values; none where there is no value at all."""
    combined = _combined(rows, key, value)
    total = combined.where(F.col(value).isNotNull()).agg(F.sum("_n").alias("_total")).select("_total").scalar()
    return _totals(combined, key, value, 4096).where((F.col("n_elements") > 0) & (F.col("n_elements") >= F.lit(share) * total))
