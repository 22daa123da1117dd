"""Occurrences of the entries of a dictionary in texts.

A dictionary of up to `BOUND` bytes, which is measured before anything is collected, travels to the tasks: every word of a text is looked up among
the anchors of the entries. An entry's anchor is the one of its words that fewest entries have, so that a common given name or `bank` leads nowhere,
and a text costs its own length, whatever the number of entries; nothing but hits is shuffled. A larger
dictionary is joined with the runs of words of the texts that are as long as its entries.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X

#: Bytes of a dictionary, with some for each entry, up to which it is sent to every task.
BOUND = 32 << 20
_RUN = re.compile(r"\w+")
_EDGE = re.compile(r"^(?:[^\w&]|_)+|(?:[^\w&]|_)+$")


def plain_words(text: Column) -> Column:
    """The words of a text, without punctuation at their edges, joined by blanks; a word of punctuation alone leaves an empty place."""
    return F.array_join(F.transform(X.words(text), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}&]+|[^\p{L}\p{N}&]+$", "")), " ")


def exact_hits(text: str, starts: dict[str, list[tuple[str, int]]], bare: list[str]) -> set[str]:
    r"""The entries that stand in a text as `\bentry\b`; `starts` has them by their anchor with its place, `bare` those without a word character."""
    found = set()

    def edge(k: str, at: int) -> bool:
        before, after = text[at - 1 : at], text[at + len(k) : at + len(k) + 1]
        return all((_RUN.match(inner) is None) == (_RUN.match(outer) is not None) for inner, outer in ((k[0], before), (k[-1], after)))

    for m in _RUN.finditer(text):
        for k, offset in starts.get(m[0], ()):
            at = m.start() - offset
            if k not in found and at >= 0 and text.startswith(k, at) and edge(k, at):
                found.add(k)
    for k in bare:
        at = text.find(k)
        while at >= 0 and not edge(k, at):
            at = text.find(k, at + 1)
        if at >= 0:
            found.add(k)
    return found


def plain_hits(text: str, starts: dict[str, list[tuple[list[str], int]]]) -> set[str]:
    """The entries, lists of words, that stand in the words of a text without punctuation at their edges."""
    words = [_EDGE.sub("", w) if not (w[0].isalnum() and w[-1].isalnum()) else w for w in text.split()]
    return {" ".join(k) for i, w in enumerate(words) for k, offset in starts.get(w, ()) if i >= offset and words[i - offset : i - offset + len(k)] == k}


def anchored(keys: list[str], plain: bool) -> tuple[dict[str, list[tuple]], list[str]]:
    """The entries by their anchors, each with the anchor's place in it (a word's number if `plain`, else a character's), and those without a word."""
    from collections import Counter

    def words(k: str) -> list[tuple[str, int]]:
        return [(w, i) for i, w in enumerate(k.split(" "))] if plain else [(m[0], m.start()) for m in _RUN.finditer(k)]

    uses = Counter(w for k in keys for w in {w for w, _ in words(k)})
    starts: dict[str, list[tuple]] = {}
    bare = []
    for k in keys:
        if found := words(k):
            anchor, at = min(found, key=lambda f: (uses[f[0]], -len(f[0]), f[1]))
            starts.setdefault(anchor, []).append((k.split(" ") if plain else k, at))
        else:
            bare.append(k)
    return starts, bare


def _finder(keys: list[str], plain: bool):
    def run(batches):
        starts, bare = anchored(keys, plain)
        for batch in batches:
            rows, found = [], []
            for r, text in enumerate(batch.column(1)):
                text = text.as_py()
                for k in sorted(plain_hits(text, starts) if plain else exact_hits(text, starts, bare)) if text else ():
                    rows.append(r)
                    found.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(found, pa.string())], names=["chunk_id", "key"])

    return run


def _runs(pieces: Column, *shapes: tuple[int, bool, bool]) -> Column:
    """Runs of neighbouring words as they stand in a text, with what lies between them; `pieces` has words and gaps by turns and words at both ends.

    Each shape is (number of words, with the gap before them, with the gap after them). Outer gaps with white space at the edge are left out.
    """

    def of(p: Column, n: int, before: bool, after: bool) -> Column:
        first, long = int(before), 2 * n - 1 + before + after
        runs = F.transform(F.sequence(F.lit(first), F.size(p) - long, F.lit(2)), lambda i: F.array_join(F.slice(p, i + 1, F.lit(long)), ""))
        runs = F.filter(runs, lambda r: ~r.rlike(f"^{X.S}|{X.S}$")) if before or after else runs
        return F.when(F.size(p) - long >= first, runs).otherwise(F.array().cast("array<string>"))

    return X.let(pieces, lambda p: F.flatten(F.array(*[of(p, *s) for s in shapes])))


def _joined(chunks: DataFrame, keys: DataFrame, plain: bool) -> DataFrame:
    """The hits of a dictionary of any size: a join on runs of words."""
    if plain:
        # a handful of numbers, however long the dictionary
        sizes = sorted(r.n for r in keys.select(F.size(F.split("key", " ")).alias("n")).distinct().collect())
        runs = X.ngrams(F.split(plain_words(F.col("text")), " "), *sizes) if sizes else F.array().cast("array<string>")
    else:
        word, other = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
        n = F.size(F.regexp_extract_all("key", F.lit(word + "+"), F.lit(0)))
        shapes = sorted(tuple(r) for r in keys.select(n, F.col("key").rlike("^" + other), F.col("key").rlike(other + "$")).distinct().collect())
        pieces = F.regexp_extract_all(F.regexp_replace("text", f"^{other}+|{other}+$", ""), F.lit(f"{word}+|{other}+"), F.lit(0))
        runs = _runs(pieces, *shapes) if shapes else F.array().cast("array<string>")
    return chunks.where("text IS NOT NULL").select("chunk_id", F.explode(F.array_distinct(runs)).alias("key")).join(keys, "key").select("chunk_id", "key")


def hits(chunks: DataFrame, keys: DataFrame, plain: bool = False, bound: int = BOUND) -> DataFrame:
    r"""(chunk_id, key): the keys (key), lower-cased and each once, that stand in the lower-cased texts (chunk_id, text).

    An entry stands in a text as `\bentry\b`; with `plain`, its words stand there one after the other, without punctuation at the edges of a word.
    Null texts have no hits; a row of chunks gives each of its entries once.
    """
    size = keys.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
    if size > bound:
        return _joined(chunks, keys, plain)
    # at most `bound` bytes
    known = sorted(r[0] for r in keys.collect())
    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "text").mapInArrow(_finder(known, plain), f"chunk_id {kind}, key string")
