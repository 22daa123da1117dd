"""Cutting oversized texts at natural boundaries by agglomerative merging of atomic segments.

A text starts as atoms: paragraphs, lines and sentences, and inside an atom that is too long its clauses, then runs of words. Adjacent
pairs of segments wait in a heap by the strength of the boundary between them, and the weakest boundary is merged first while the
combined size, with the overlap it will carry, fits the limit. What remains are the strongest boundaries the limit allows.
"""

from __future__ import annotations

import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the characters of the Unicode property White_Space.
WHITE = (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Strength of a boundary, from a cut between any two words to a blank line.
WORDS, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(5)

_WS = "".join(map(chr, WHITE))
_BREAKS = re.compile(
    rf"(?P<clause>[,;:]['\")\]»”’]*(?=[{_WS}]))|(?P<sentence>[.!?…。！？]+['\")\]»”’*]*(?=[{_WS}]))|(?P<line>[{_WS}]*[\n\r\x0b\x0c\x85\u2028\u2029][{_WS}]*)"
)
_NEWLINE = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")


def word_spans(text: str):
    """(starts, ends) of the longest runs of characters that are not white space, as arrays of character offsets."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    white = np.zeros(0x3002, bool)
    white[list(WHITE)] = True
    gap = np.concatenate([[True], white[np.minimum(codes, 0x3001)], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def boundaries(text: str, starts) -> dict[int, int]:
    """{index of a word: strength of the boundary before it}, only where it is more than a gap between words."""
    import numpy as np

    at, strength = [], []
    for m in _BREAKS.finditer(text):
        at.append(m.end())
        kind = m.lastgroup
        strength.append(CLAUSE if kind == "clause" else SENTENCE if kind == "sentence" else PARAGRAPH if len(_NEWLINE.findall(m.group())) > 1 else LINE)
    found: dict[int, int] = {}
    for i, s in zip(np.searchsorted(starts, at).tolist(), strength, strict=True):
        if 0 < i < len(starts):
            found[i] = max(s, found.get(i, WORDS))
    return found


def atoms(n: int, found: dict[int, int], most: int) -> tuple[list[int], list[int]]:
    """First words of the atoms of n words, none longer than `most`, and the strength of the boundary before each."""
    cuts = [0, *sorted(i for i, s in found.items() if s >= SENTENCE), n]
    first: list[int] = []
    strength: list[int] = []
    clauses = sorted(i for i, s in found.items() if s == CLAUSE)
    run = max(1, most // 4)
    for a, b in zip(cuts, cuts[1:], strict=False):
        inner = [a, b] if b - a <= most else [a, *(i for i in clauses if a < i < b), b]
        for x, y in zip(inner, inner[1:], strict=False):
            for k in range(x, y, run if y - x > most else max(1, y - x)):
                first.append(k)
                strength.append(found.get(k, WORDS))
    return first, strength


def merge(first: list[int], strength: list[int], n: int, limit: int, overlap: int) -> list[int]:
    """First words of the segments that agglomeration leaves; each with its overlap holds at most `limit` words."""
    k = len(first)
    start = first
    end = [*first[1:], n]
    after, before, alive = list(range(1, k + 1)), list(range(-1, k - 1)), [True] * k
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < k and end[j] - start[i] + min(overlap, start[i]) <= limit:
            heapq.heappush(heap, (strength[j], end[j] - start[i], i, j, end[j]))

    for i in range(k - 1):
        offer(i)
    while heap:
        _, size, i, j, upto = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and end[j] == upto and upto - start[i] == size):
            continue
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[j] < k:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [start[i] for i in range(k) if alive[i]]


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(first word, words, words of overlap, first character, end character) of each piece of a text."""
    starts, ends = word_spans(text)
    n = len(starts)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n, 0, int(starts[0]), int(ends[-1]))]
    cores = merge(*atoms(n, boundaries(text, starts), limit - overlap), n, limit, overlap)
    out = []
    for a, b in zip(cores, [*cores[1:], n], strict=True):
        kept = min(overlap, a)
        out.append((a - kept, b - a + kept, kept, int(starts[a - kept]), int(ends[b - 1])))
    return out


SCHEMA = "piece int, first_word int, n_words int, overlap_words int, first_char int, end_char int"


def _splitter(limit: int, overlap: int, with_text: bool):
    names = ["_key", *(x.split()[0] for x in SCHEMA.split(", ")), *["text"] * with_text]

    def run(batches):
        for batch in batches:
            row, cols, texts = [], [[] for _ in range(6)], []
            for r, text in enumerate(batch.column(1)):
                text = text.as_py()
                for k, p in enumerate(pieces(text or "", limit, overlap)):
                    row.append(r)
                    for c, v in zip(cols, (k, *p), strict=True):
                        c.append(v)
                    if with_text:
                        texts.append(text[p[3] : p[4]])
            arrays = [batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(c, pa.int32()) for c in cols)]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(texts, pa.string())] * with_text], names=names)

    return run


def split(docs: DataFrame, limit: int = 400, overlap: int = 100, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(key, piece, first_word, n_words, overlap_words, first_char, end_char[, text]) of every piece of every text.

    A piece has at most `limit` words and, but for the first of a text, begins with the last `overlap` words before its own part (fewer
    only where fewer precede it). Texts within the limit are one piece; null, empty and blank texts give none. A text without any
    punctuation is cut between words. Words are the longest runs without Unicode white space; offsets count characters. Repeated rows
    give repeated pieces; a null key is kept; other columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, {SCHEMA}" + ", text string" * with_text
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(_splitter(limit, overlap, with_text), schema).withColumnRenamed("_key", key)


def oversized(docs: DataFrame, limit: int = 400, overlap: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of the texts that `split` cuts into more than one piece, without duplicates."""
    # a text below this length has no second piece, so it need not reach Python
    long = docs.where(F.length(text) > 2 * limit)
    return split(long, limit, overlap, key, text, with_text=False).where("piece = 1").select(key).distinct()
