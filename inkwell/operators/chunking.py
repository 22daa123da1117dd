"""Documents to overlapping word windows, and the choice of chunks worth reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X


def chunk(docs: DataFrame, size: int = 400, overlap: int = 100, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, keep, pos, chunk_id, text, n_words) of every window of every document; chunk_id is key_pos, so it depends on no order of reading.

    Null, empty and blank texts give none. No shuffle: a projection and an explode. The columns `keep` of a document go with its windows.
    """
    rows = docs.select(F.col(key), *keep, F.posexplode(X.windows(F.col(text), size, overlap)).alias("pos", "text"))
    return rows.select(key, *keep, "pos", F.concat_ws("_", F.col(key).cast("string"), F.col("pos").cast("string")).alias("chunk_id"), "text", X.word_count(F.col("text")).alias("n_words"))


def sentences_of(chunks: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """(keys, sent, sentence): the sentences of each row, numbered from 0."""
    return chunks.select(*keys, F.posexplode(X.sentences(F.col(text))).alias("sent", "sentence"))


def prefiltered(chunks: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """Rows whose text has any of the keywords as a whole word: the cheap filter before a costly reading."""
    return chunks.where(X.any_word(F.col(text), keywords))


def prefilter_stats(chunks: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """(total, relevant, filtered, pct): how many rows the prefilter keeps; a null text is not relevant, no rows give a pct of 0."""
    hit = F.coalesce(X.any_word(F.col(text), keywords), F.lit(False))
    counted = chunks.agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("relevant"))
    return counted.select("total", "relevant", (F.col("total") - F.col("relevant")).alias("filtered"), F.coalesce(F.try_divide(F.col("relevant") * 100.0, "total"), F.lit(0.0)).alias("pct"))


def hashed(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Adds `chunk_hash` (md5 of the text) and `text_preview` (its first 100 characters)."""
    return chunks.withColumn("chunk_hash", F.md5(text)).withColumn("text_preview", X.preview(F.col(text)))


def unseen(chunks: DataFrame, cache: DataFrame, version: str, text: str = "text") -> DataFrame:
    """Each text once that `cache` (chunk_hash, prompt_version) has not seen under this version: what an incremental run still has to read."""
    done = cache.where(F.col("prompt_version") == version).select("chunk_hash")
    return hashed(chunks.where(F.col(text).isNotNull()), text).select("chunk_hash", "text_preview").distinct().join(done, "chunk_hash", "left_anti")
