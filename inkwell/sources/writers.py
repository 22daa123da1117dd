"""Sinks: the index and its companions as Parquet or JSON, and request files for an external reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_index(post: DataFrame, path: str, parts: int | None = None) -> None:
    """Postings (term, chunk_id, tf, and what else they have), each once, with `term_key`, the lower-cased term, by which they are range-partitioned and
    sorted: the lookup of a term reads the row groups that have it."""
    more = [c for c in post.columns if c not in ("term", "chunk_id", "tf", "term_key")]
    unique = post.groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"), *[F.min(c).alias(c) for c in more]).withColumn("term_key", F.lower("term"))
    order = ["term_key", "chunk_id", "term"]
    ranged = unique.repartitionByRange(parts, *order) if parts else unique.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_store(chunks: DataFrame, path: str) -> None:
    """Chunks range-partitioned and sorted by id, so that fetching some of them prunes row groups."""
    chunks.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(path)


def write_index_json(mentions: DataFrame, path: str) -> None:
    """{"term": ..., "chunk_ids": [...]} a line, ids in the order of (ord, chunk_id) of their first mention: the exchange format, for indices that fit a file."""
    first = mentions.groupBy("term", "chunk_id").agg(F.min("ord").alias("ord"))
    lists = first.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda s: s.chunk_id).alias("chunk_ids"))
    lists.write.mode("overwrite").json(path)


def write_chunks(chunks: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """The chunk store, dropped and made anew, with a vector per chunk where given (chunk_id, embedding)."""
    (chunks.join(vectors, "chunk_id", "left") if vectors is not None else chunks).write.mode("overwrite").parquet(path)


def write_endnotes(endnotes: DataFrame, links: DataFrame, folder: str) -> None:
    """Endnotes (endnote_id, text) and links (chunk_id, endnote_id)."""
    endnotes.write.mode("overwrite").parquet(f"{folder}/endnotes")
    links.write.mode("overwrite").parquet(f"{folder}/chunk_endnotes")


def requests(texts: DataFrame, version: str) -> DataFrame:
    """(value): a JSON request line for each text not yet read (chunk_hash, text)."""
    return texts.select(F.to_json(F.struct(F.col("chunk_hash").alias("custom_id"), F.lit(version).alias("prompt_version"), F.col("text").alias("text"))).alias("value"))


def write_requests(texts: DataFrame, version: str, path: str) -> None:
    requests(texts, version).write.mode("overwrite").text(path)
