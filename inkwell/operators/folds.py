"""Order-dependent folds over the chunks of one document, the only operators here that need Python: adjacent merges and greedy packing.

A group is one document. Documents are bounded by what a file holds, and each fold keeps only the current piece.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X

_END = re.compile(r"(?<=[.!?])\s+")


def _sentences(text: str) -> list[str]:
    return [s.strip() for s in _END.split(text) if s.strip()]


def shared_sentences(a: str, b: str) -> float:
    """Shared sentences of two texts, without regard to case, as a share of the larger set."""
    x, y = ({s.lower() for s in _sentences(t)} for t in (a, b))
    return len(x & y) / max(len(x), len(y)) if x or y else 0.0


def consecutive(a: str, b: str, expected: int = 100) -> bool:
    """The second text begins with exactly the words that end the first: windows of one text, no repetition."""
    x, y = a.split(), b.split()
    return len(x) >= expected and len(y) >= expected and x[-expected:] == y[:expected]


def mergeable(a: str, b: str, expected: int = 100, share: float = 0.5) -> bool:
    return shared_sentences(a, b) >= share and not consecutive(a, b, expected)


def merge_texts(a: str, b: str) -> str:
    """The sentences of both, each once, in order."""
    first: dict[str, str] = {}
    for s in [*_sentences(a), *_sentences(b)]:
        first.setdefault(s.lower(), s)
    return " ".join(first.values())


def merge_adjacent(chunks: DataFrame, doc: str = "doc_id", most: int = 3, share: float = 0.5) -> DataFrame:
    """(doc, chunk_id, merged_id, text, n_merged): runs of up to `most` neighbouring chunks that repeat each other become one, under the first's id.

    chunks: (doc, pos, chunk_id, text). Each chunk gives one row that maps it to its merged chunk; the text stands with the first only. That half of the
    sentences are shared and that the overlap is not that of windows decides alone: looser conditions (a third of the sentences, equal words at the
    borders, one text within the other) merge nothing that these two do not let pass. Chunks pass by in the order of (doc, pos) and only the current
    piece is held, so a document of any length fits a task, though it is read by one.
    """
    schema = f"{doc} {chunks.schema[doc].dataType.simpleString()}, chunk_id string, merged_id string, text string, n_merged int"

    def fold(frames):
        held = {"key": None, "group": [], "text": "", "sentences": set()}
        rows: list[list] = []

        def close() -> None:
            group = held["group"]
            rows.extend([held["key"], c, group[0], held["text"] if i == 0 else None, len(group)] for i, c in enumerate(group))

        def drain() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[doc, "chunk_id", "merged_id", "text", "n_merged"])
            rows.clear()
            return out

        for pdf in frames:
            for key, c, t in zip(pdf[doc], pdf["chunk_id"], pdf["text"], strict=True):
                mine = {s.lower() for s in _sentences(t)}
                theirs = held["sentences"]
                near = held["group"] and key == held["key"] and len(held["group"]) < most
                if near and (mine or theirs) and len(mine & theirs) >= share * max(len(mine), len(theirs)) and not consecutive(held["text"], t):
                    held["group"].append(c)
                    held["text"] = merge_texts(held["text"], t)
                    held["sentences"] = {s.lower() for s in _sentences(held["text"])}
                else:
                    close()
                    held.update(key=key, group=[c], text=t, sentences=mine)
            yield drain()
        close()
        yield drain()

    ordered = chunks.where(F.col("text").isNotNull()).select(doc, "pos", "chunk_id", "text").repartition(doc).sortWithinPartitions(doc, "pos", "chunk_id")
    return ordered.mapInPandas(fold, schema)


def pair_merges(chunks: DataFrame, doc: str = "doc_id", words: int = 7, more_than: float = 0.3) -> DataFrame:
    """(chunk_id, next_id, share, phrases, merges): each chunk and the next of its document, the share of sentences of the larger set that both have, the
    number of runs of `words` words within sentences that both have, and whether they merge: more than `more_than` of the sentences, or any such run.

    A longer run that both have holds one of `words` words, so that these are all that count.
    """
    from pyspark.sql import Window

    sentences = F.array_distinct(F.transform(X.sentences(F.col("text")), lambda x: F.lower(x)))
    runs = F.array_distinct(F.flatten(F.transform("s", lambda x: F.transform(X.ngrams(X.words(x), words), lambda g: F.md5(g)))))
    c = chunks.where("text IS NOT NULL").select(doc, "pos", "chunk_id", sentences.alias("s")).withColumn("r", runs)
    span = Window.partitionBy(doc).orderBy("pos", "chunk_id")
    pairs = c.select("chunk_id", "s", "r", *[F.lead(x).over(span).alias(y) for x, y in (("chunk_id", "next_id"), ("s", "s2"), ("r", "r2"))]).where("next_id IS NOT NULL")
    shared = F.size(F.array_intersect("s", "s2")) / F.greatest(F.size("s"), F.size("s2"))
    found = pairs.select("chunk_id", "next_id", shared.alias("share"), F.size(F.array_intersect("r", "r2")).alias("phrases"))
    return found.withColumn("merges", (F.col("share") > more_than) | (F.col("phrases") > 0))


def rewrite_ids(post: DataFrame, mapping: DataFrame) -> DataFrame:
    """Postings on the merged chunks: mapping (chunk_id, merged_id); chunks without a mapping keep their id, repeats are added up."""
    joined = post.join(mapping.select("chunk_id", "merged_id"), "chunk_id", "left")
    return joined.select("term", F.coalesce("merged_id", "chunk_id").alias("chunk_id"), "tf").groupBy("term", "chunk_id").agg(F.sum("tf").alias("tf"))


def packed(docs: DataFrame, most: int = 150_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, n_words, text): texts packed sentence by sentence into pieces of at most `most` words; a longer sentence is cut by words."""
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, piece int, n_words int, text string"

    def run(frames):
        for pdf in frames:
            rows = []
            for k, t in zip(pdf[key], pdf["_text"], strict=True):
                piece, held, n = 0, [], 0
                for s in _sentences(t or ""):
                    w = s.split()
                    parts = [w[i : i + most] for i in range(0, len(w), most)]
                    for p in parts:
                        if held and n + len(p) > most:
                            rows.append([k, piece, n, " ".join(held)])
                            piece, held, n = piece + 1, [], 0
                        held.append(" ".join(p))
                        n += len(p)
                if held:
                    rows.append([k, piece, n, " ".join(held)])
            yield pd.DataFrame(rows, columns=[key, "piece", "n_words", "text"])

    return docs.select(key, F.col(text).alias("_text")).mapInPandas(run, schema)


def endnotes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, endnote_id, text) of the map column `endnotes`; null and empty maps give none."""
    return docs.select("doc_id", F.explode("endnotes").alias("endnote_id", "text"))


def endnotes_in_windows(windows: DataFrame, paragraphs: DataFrame, hop: int = 300) -> DataFrame:
    """(chunk_id, endnote_id): endnotes of the paragraphs that a window of `chunking.chunk` overlaps.

    windows (doc_id, pos, chunk_id, n_words), paragraphs (doc_id, para, text, endnote_ids) in order. A window begins at word pos * hop of its document and
    a paragraph after the words of those before it, so that no text is searched and a passage that occurs twice is not mistaken for the other.
    """
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    n = X.word_count(F.col("text"))
    spans = paragraphs.select("doc_id", "endnote_ids", n.alias("_n"), F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_start")).where("_n > 0 AND size(endnote_ids) > 0")
    starts = F.col("pos") * hop
    hits = windows.join(spans, "doc_id").where((F.col("_start") < starts + F.col("n_words")) & (F.col("_start") + F.col("_n") > starts))
    return hits.select("chunk_id", F.explode("endnote_ids").alias("endnote_id")).distinct()


def endnotes_in_chunks(chunks: DataFrame, docs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(chunk_id, endnote_id): endnotes of the paragraphs a chunk overlaps.

    chunks (doc_id, chunk_id, text), docs (doc_id, text), paragraphs (doc_id, para, text, endnote_ids) in order. For chunks that are not windows of known
    place (see `endnotes_in_windows`): a chunk is found in its document by its whole text, at the first place where it stands; paragraphs lie one after the other with one character between. Bounds touch inclusively. The join is by document.
    """
    from pyspark.sql import Window

    body = docs.select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("_body"))
    at = F.instr(F.col("_body"), F.col("text")) - 1
    spans = chunks.join(body, "doc_id").withColumn("_from", at).where("_from >= 0").select("doc_id", "chunk_id", "_from", (F.col("_from") + F.length("text")).alias("_to"))
    before = Window.partitionBy("doc_id").orderBy("para").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length(F.regexp_replace("text", r"\s+", " "))
    placed = paragraphs.withColumn("_start", F.coalesce(F.sum(size + 1).over(before), F.lit(0))).withColumn("_end", F.col("_start") + size)
    hits = spans.join(placed.select("doc_id", "_start", "_end", "endnote_ids"), "doc_id").where("_start <= _to AND _end >= _from")
    return hits.select("chunk_id", F.explode("endnote_ids").alias("endnote_id")).distinct()
