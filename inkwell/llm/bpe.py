"""Encoding with a public byte-level BPE vocabulary, the merges done by recursive queries in DuckDB.

Text is cut into words on the JVM. A task keeps the ids of every word it has met; the words a batch brings for the first time go
to the task's in-memory DuckDB, where token-position rows join the table of merges and every word contracts its leftmost pair of
minimum rank until no pair merges. Ids then come back by position. Nothing is shuffled: a plan is one scan and one Python stage.

The recursion keeps the rows of every step of a word, and a step is a scan of the word, so that its cost grows with the square of the
length. A run of letters or signs of more than `LONG` bytes, which no language has for a word, is contracted by a heap instead: the same
merges in the same order, in the memory of its length. Decoding joins ids with the vocabulary and puts the bytes of a text together by an
ordered aggregation.
"""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Entries of a task's word memory; it starts anew when full, which costs time and changes nothing.
MEMORY = 400_000
#: Bytes beyond which a word is contracted by the heap.
LONG = 256
#: Rows that the steps of one recursive query may leave in memory.
ROWS = 1_000_000
#: Tokens that one decoding query puts together; a longer text is put together from several.
TOKENS = 500_000

# Fixed value: Unicode white space, which the class \s of the published word pattern stands for.
_SPACE = r"\t-\r\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Fixed value: the published word pattern of the vocabulary.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"


def words(text: Column) -> Column:
    """The words of a text, whose concatenation is the text; an empty array for an empty or null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def ranks_of(folder: str, vocabulary: str) -> dict[bytes, int]:
    """The published vocabulary: bytes of every token, with its rank, which is its id."""
    import base64

    with open(os.path.join(folder, vocabulary), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def database():
    """An in-memory database of one thread that never writes to the machine's disk: what it holds is bounded by its callers."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "250MB", "temp_directory": ""})


class Merger:
    """Ids of words by contraction to a fixpoint in DuckDB."""

    def __init__(self, folder: str, vocabulary: str):
        ranks = ranks_of(folder, vocabulary)
        self.con = database()
        # every split of a token into two tokens is a possible merge, with the rank of the whole
        self.pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = zip(*self.pairs, strict=True)
        self.con.register("_merges", pa.table({"l": pa.array(left, pa.int32()), "r": pa.array(right, pa.int32()), "rank": pa.array(rank, pa.int32())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM _merges")
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], int] = {}

    def encode(self, new: list[str]) -> tuple:
        """(ids, lengths) of `new`, one after the other."""
        import numpy as np

        raw = [w.encode("utf-8") for w in new]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        at = np.repeat(np.arange(len(raw)), size)
        pos = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        ids = np.asarray(self.byte, np.int32)[np.frombuffer(b"".join(raw), np.uint8)]
        tokens = pa.table({"w": pa.array(at, pa.int32()), "p": pa.array(pos, pa.int32()), "t": pa.array(ids, pa.int32())})
        self.con.register("_tokens", tokens)
        out = self.con.sql(CONTRACT).to_arrow_table()
        self.con.unregister("_tokens")
        return out["t"].to_numpy(), np.bincount(out["w"].to_numpy(), minlength=len(raw))

    def encode_long(self, word: str) -> list[int]:
        """The ids of one word, its pairs waiting in a heap by (rank, position)."""
        import heapq

        if not self.merges:
            self.merges = {(a, b): r for a, b, r in self.pairs}
        ids: list[int] = [self.byte[b] for b in word.encode("utf-8")]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.merges.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            # a pair that has changed since it was pushed has another rank, or none
            if j >= n or self.merges.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := self.merges.get((rank, ids[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := self.merges.get((ids[h], rank))) is not None:
                heapq.heappush(heap, (r, h))
        return [t for t in ids if t >= 0]


#: A step: each word's adjacent pairs join the merges, the pair of least (rank, position) contracts. Words without a pair are done.
CONTRACT = """
WITH RECURSIVE step(n, w, p, t, done) AS (
    SELECT 0, w, p, t, false FROM _tokens
  UNION ALL
    (WITH live AS (SELECT n, w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS nt, lead(p) OVER (PARTITION BY w ORDER BY p) AS np
                   FROM step WHERE NOT done),
          pairs AS (SELECT w, p, np, rank FROM live JOIN merges m ON live.t = m.l AND live.nt = m.r),
          best AS (SELECT w, min({'rank': rank, 'p': p, 'np': np}) AS b FROM pairs GROUP BY w)
     SELECT live.n + 1, live.w, live.p, CASE WHEN live.p = b.p THEN b.rank ELSE live.t END, b IS NULL
     FROM live LEFT JOIN best USING (w) WHERE b IS NULL OR live.p <> b.np)
)
SELECT w, t FROM step WHERE done ORDER BY w, p
"""


def _pieces(new: list[str], most: int):
    """Lists of words whose steps leave at most `most` rows together."""
    at, size = 0, 0
    for i, w in enumerate(new):
        n = len(w.encode("utf-8"))
        n = n * (n + 3) // 2
        if i > at and size + n > most:
            yield new[at:i]
            at, size = i, 0
        size += n
    if at < len(new):
        yield new[at:]


def _encoder(folder: str, vocabulary: str, counts_only: bool):
    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        merger, place, flat, start = None, {}, [], [0]
        for batch in batches:
            lists = batch.column(1)
            found = lists.flatten().dictionary_encode()
            names = found.dictionary.to_pylist()
            if len(place) + len(names) > MEMORY:
                place, flat, start = {}, [], [0]
            new = [w for w in names if w not in place]
            if new:
                merger = merger or Merger(folder, vocabulary)
                long = [w for w in new if len(w.encode("utf-8")) > LONG]
                usual = [w for w in new if len(w.encode("utf-8")) <= LONG] if long else new
                for part in [*_pieces(usual, ROWS), *([w] for w in long)]:
                    if len(part) == 1 and len(part[0].encode("utf-8")) > LONG:
                        ids = np.asarray(merger.encode_long(part[0]), np.int32)
                        size = np.asarray([len(ids)])
                    else:
                        ids, size = merger.encode(part)
                    base = len(start) - 1
                    place.update((w, base + i) for i, w in enumerate(part))
                    flat.append(ids.astype(np.int32))
                    start.extend((start[-1] + np.cumsum(size)).tolist())
                flat = [np.concatenate(flat)]
            pool = flat[0] if flat else np.empty(0, np.int32)
            first = np.asarray(start, np.int64)
            mine = np.fromiter((place[w] for w in names), np.int64, len(names))
            at = mine[found.indices.to_numpy(zero_copy_only=False)] if len(found) else np.empty(0, np.int64)
            size = first[at + 1] - first[at]
            ends = np.concatenate([[0], np.cumsum(size)])
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            bounds = ends[offsets]
            if counts_only:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64())], names=["_key", "n_tokens"])
                continue
            where = np.repeat(first[at] - ends[:-1], size) + np.arange(ends[-1])
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(pool[where], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(ids, pa.list_(pa.int32()))], names=["_key", "ids"])

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = DEFAULT_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the token ids of every text, without special tokens; an empty list for an empty or null text.

    One row per input row, repeated rows and null keys included; columns besides key and text are not read. Strings that name special
    tokens are ordinary text. A text of any length is encoded whole, and so is a word of any length.
    """
    kind = docs.schema[key].dataType.simpleString()
    cut = docs.select(F.col(key).alias("_key"), words(F.col(text)).alias("_words"))
    return cut.mapInArrow(_encoder(folder, vocabulary, False), f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", folder: str = DEFAULT_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every text, as `encode` but without the ids."""
    kind = docs.schema[key].dataType.simpleString()
    cut = docs.select(F.col(key).alias("_key"), words(F.col(text)).alias("_words"))
    return cut.mapInArrow(_encoder(folder, vocabulary, True), f"_key {kind}, n_tokens bigint").withColumnRenamed("_key", key)


#: The bytes of the tokens of each text in their order.
DECODE = """
SELECT r, unhex(string_agg(h, '' ORDER BY p)) AS t FROM _ids JOIN vocabulary USING (id) GROUP BY r ORDER BY r
"""


def _text(raw: bytes) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _decoder(folder: str, vocabulary: str):
    def run(batches):
        import numpy as np

        con = None
        for batch in batches:
            if con is None:
                con = database()
                ranks = ranks_of(folder, vocabulary)
                con.register("_v", pa.table({"id": pa.array(ranks.values(), pa.int32()), "h": [t.hex() for t in ranks]}))
                con.execute("CREATE TABLE vocabulary AS SELECT * FROM _v")
            lists = batch.column(1)
            size = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            found: list[list[bytes]] = [[] for _ in size]
            rows, ids = np.repeat(np.arange(len(size)), size), lists.flatten()
            for at in range(0, len(rows), TOKENS):
                part = rows[at : at + TOKENS]
                con.register("_ids", pa.table({"r": part, "p": np.arange(len(part)), "id": ids.slice(at, TOKENS)}))
                for r, t in con.sql(DECODE).fetchall():
                    found[r].append(t)
                con.unregister("_ids")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_text(b"".join(x)) for x in found], pa.string())], names=["_key", "text"])

    return run


def decode(encoded: DataFrame, key: str = "doc_id", ids: str = "ids", folder: str = DEFAULT_FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of lists of token ids: the inverse of `encode`.

    An empty or null list gives an empty text, ids that the vocabulary lacks give nothing, and a list whose bytes are no UTF-8 gives null.
    """
    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(F.col(key).alias("_key"), F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("_ids"))
    return rows.mapInArrow(_decoder(folder, vocabulary), f"_key {kind}, text string").withColumnRenamed("_key", key)
