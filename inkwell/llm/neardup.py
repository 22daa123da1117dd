"""Near-duplicate texts: a multi-index Hamming join over b-bit minwise signatures, then exact similarity.

1. One Python stage turns each text into its set of word shingles, a signature of `COMPONENTS` minima of 16 bits each, and a
   fingerprint of the set. The table is written once to the shared folder. Texts of one set form a class with one representative.
2. Signatures are split into bands. By pigeonhole, two signatures that differ in at most bands * (errors + 1) - 1 components agree, in
   some band, on all but `errors` components; so each band is indexed under every choice of its components but `errors`, and all pairs
   under that distance meet in a bucket. Pairs beyond it meet as often as `miss_probability` says.
3. Buckets are runs in sorted partitions, read as a stream. A bucket too large to be compared in one task is compared in salted
   blocks, with the signature distance inside the join.
4. Pairs pass the signature distance, and then the exact Jaccard similarity of their shingle sets.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import comb

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.operators.components import components
from inkwell.runtime import stored

COMPONENTS, BITS = 64, 16
#: Members of a bucket that are compared as they pass by; larger buckets go through the block join, in blocks of about `BLOCK`.
HOT, BLOCK = 512, 1024
_WORD = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Index:
    bands: int
    errors: int

    @property
    def size(self) -> int:
        return COMPONENTS // self.bands

    @property
    def distance(self) -> int:
        """The largest number of differing components at which every pair is found."""
        return self.bands * (self.errors + 1) - 1

    def miss_probability(self, similarity: float) -> float:
        """That a pair of this Jaccard similarity meets in no bucket."""
        r, s = self.size, similarity
        stay = sum(comb(r, k) * s**k * (1 - s) ** (r - k) for k in range(r - self.errors))
        return stay**self.bands


def index_for(similarity: float, miss: float = 0.005) -> Index:
    """The most selective index (widest keys, then fewest) that misses at most `miss` of the pairs at the threshold itself."""
    fits = []
    for bands in (4, 8, 16, 32):
        for errors in range(COMPONENTS // bands):
            x = Index(bands, errors)
            keys = bands * comb(x.size, errors)
            if keys <= 256 and x.miss_probability(similarity) <= miss:
                fits.append((errors - x.size, keys, bands, x))
    if not fits:
        raise ValueError(f"no index finds pairs of similarity {similarity}")
    return min(fits, key=lambda f: f[:3])[3]


def _sketcher(shingle: int, least: int):
    def run(batches):
        import numpy as np
        import xxhash

        rng = np.random.default_rng(20240229)
        flips = rng.integers(0, 2**63, COMPONENTS, np.uint64) * np.uint64(2) + np.uint64(1)
        turns = rng.integers(0, 2**63, COMPONENTS, np.uint64) * np.uint64(2) + np.uint64(1)
        weights = rng.integers(0, 2**63, shingle, np.uint64) * np.uint64(2) + np.uint64(1)

        class Hashes(dict):
            def __missing__(self, word):
                if len(self) > 500_000:
                    self.clear()
                self[word] = h = xxhash.xxh3_64_intdigest(word)
                return h

        hashes = Hashes()

        def block(keys, texts):
            words = [_WORD.findall(t.lower()) for t in texts]
            keep = [i for i, w in enumerate(words) if len(w) >= max(least, shingle)]
            if not keep:
                return None
            words = [words[i] for i in keep]
            size = np.fromiter(map(len, words), np.int64, len(words))
            h = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, int(size.sum()))
            doc = np.repeat(np.arange(len(words)), size)
            n = len(h) - shingle + 1
            v = np.zeros(n, np.uint64)
            for k in range(shingle):
                v += h[k : k + n] * weights[k]
            v = v[doc[:n] == doc[shingle - 1 :]]
            v ^= v >> np.uint64(31)
            v *= np.uint64(0x9E3779B97F4A7C15)
            v ^= v >> np.uint64(29)
            v *= np.uint64(0xBF58476D1CE4E5B9)
            v ^= v >> np.uint64(32)
            size = size - shingle + 1
            first = np.cumsum(size) - size
            signature = np.empty((len(words), COMPONENTS), np.uint16)
            for c in range(COMPONENTS):
                low = np.minimum.reduceat((v ^ flips[c]) * turns[c], first)
                signature[:, c] = ((low ^ (low >> np.uint64(23))) & np.uint64(0xFFFF)).astype(np.uint16)
            # the set of a text: its distinct shingles by 32 bits, sorted
            both = np.unique((np.repeat(np.arange(len(words), dtype=np.uint64), size) << np.uint64(32)) | (v >> np.uint64(32)))
            shingles = (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            ends = np.searchsorted(both, np.arange(1, len(words) + 1, dtype=np.uint64) << np.uint64(32))
            sets = [x.tobytes() for x in np.split(shingles, ends[:-1])]
            return pa.RecordBatch.from_arrays(
                [keys.take(pa.array(keep, pa.int32())), pa.array([xxhash.xxh3_128_digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in signature], pa.binary()), pa.array([x.tobytes() for x in signature.astype(np.uint8)], pa.binary()), pa.array(sets, pa.binary())],
                names=["id", "fp", "signature", "low", "shingles"],
            )

        for batch in batches:
            rows, texts, held = [], [], 0
            for r, t in enumerate(batch.column(1)):
                rows.append(r)
                texts.append(t.as_py())
                held += len(texts[-1])
                if held > 4_000_000 or r + 1 == batch.num_rows:
                    out = block(batch.column(0).take(pa.array(rows, pa.int32())), texts)
                    if out is not None:
                        yield out
                    rows, texts, held = [], [], 0

    return run


def sketches(docs: DataFrame, shingle: int, least: int, key: str, text: str) -> DataFrame:
    """(id, fp, signature, low, shingles), low being the low byte of each component, of the texts with at least `least` words; null texts and null keys take no part."""
    rows = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(_sketcher(shingle, least), "id bigint, fp binary, signature binary, low binary, shingles binary")


def _keys(index: Index):
    def run(batches):
        from itertools import combinations

        import numpy as np

        choices = [(band, pick) for band in range(index.bands) for pick in combinations(range(index.size), index.size - index.errors)]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            signature = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, COMPONENTS).astype(np.uint64)
            for number, (band, pick) in enumerate(choices):
                key = np.full(n, number + 1, np.uint64)
                for c in pick:
                    key = (key * np.uint64(0x9E3779B97F4A7C15)) ^ signature[:, band * index.size + c]
                    key ^= key >> np.uint64(29)
                key *= np.uint64(0xBF58476D1CE4E5B9)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "id"])

    return run


def _buckets(hot: int):
    """Sorted (key, id) rows in; (a, b, false) for two ids of a bucket, (key, id, true) for the ids of a bucket of more than `hot`."""

    def run(batches):
        import numpy as np

        def out(a, b, is_hot):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), is_hot))], names=["a", "b", "hot"])

        def close(key, ids):
            """The buckets of these complete rows."""
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            for n in np.unique(size[(size > 1) & (size <= hot)]):
                rows = ids[first[size == n][:, None] + np.arange(n)]
                # one offset at a time: the pairs of a bucket are never all in memory
                for d in range(1, n):
                    a, b = rows[:, :-d].ravel(), rows[:, d:].ravel()
                    yield out(np.minimum(a, b), np.maximum(a, b), False)
            for f, n in zip(first[size > hot].tolist(), size[size > hot].tolist(), strict=True):
                yield out(key[f : f + n], ids[f : f + n], True)

        key = ids = np.empty(0, np.int64)
        running = None  # the key of a hot bucket that goes on
        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy(zero_copy_only=False)])
            ids = np.concatenate([ids, batch.column(1).to_numpy(zero_copy_only=False)])
            if running is not None:
                n = np.searchsorted(key != running, True) if (key == running).all() else int(np.argmax(key != running))
                yield out(key[:n], ids[:n], True)
                key, ids = key[n:], ids[n:]
                running = running if not len(key) else None
            if not len(key):
                continue
            n = len(key) - int(np.argmax((key != key[-1])[::-1])) if key[0] != key[-1] else 0
            if n:
                yield from close(key[:n], ids[:n])
                key, ids = key[n:], ids[n:]
            if len(key) > hot:
                running = key[0]
                yield out(key, ids, True)
                key, ids = key[:0], ids[:0]
        if len(key):
            yield from close(key, ids)

    return run


def _near(floor: int):
    def run(batches):
        import numpy as np

        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COMPONENTS) for c in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= floor))

    return run


def _blocks_near(floor: int):
    """(ids, lows, ids, lows, same) of two blocks of a bucket in; the pairs (a, b), a < b, that are near out."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for p, x, q, y, same in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                p, q = np.asarray(p, np.int64), np.asarray(q, np.int64)
                x, y = (np.frombuffer(b"".join(z), np.uint8).reshape(-1, COMPONENTS) for z in (x, y))
                equal = np.zeros((len(p), len(q)), np.uint8)
                for c in range(COMPONENTS):
                    equal += x[:, c, None] == y[None, :, c]
                i, j = np.nonzero(equal >= floor)
                keep = p[i] < q[j] if same else p[i] != q[j]
                a, b = p[i][keep], q[j][keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return run


def blocked(rows: DataFrame, key: str, size: int, *values: str) -> DataFrame:
    """(key, i, j, left, right): every pair i <= j of the blocks of a key's rows; a block is a list of about `size` structs of `values`, whose first is an id.

    Blocks are as many as the key's rows demand, so that no row grows with the key, and a key of few rows is one block.
    """
    sized = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / size).alias("_n"))
    item = F.struct(*values) if len(values) > 1 else F.col(values[0])
    lists = rows.join(sized, key).groupBy(key, "_n", F.pmod(F.xxhash64(values[0]), F.col("_n")).alias("i")).agg(F.collect_list(item).alias("left"))
    right = lists.select(key, F.col("i").alias("j"), F.col("left").alias("right"))
    return lists.withColumn("j", F.explode(F.sequence("i", F.col("_n") - 1))).join(right, [key, "j"]).select(key, "i", "j", "left", "right")


def _exact(threshold: float):
    def run(batches):
        import numpy as np

        for batch in batches:
            found = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                if min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    found.append(0.0)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                found.append(both / (len(x) + len(y) - both))
            jaccard = np.asarray(found, np.float64)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(jaccard)], names=["a", "b", "jaccard"])
            yield out.filter(pa.array(jaccard >= threshold))

    return run


def _with(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """(a, b, x, y): the column of both ends of each pair."""
    left = side.select(F.col("id").alias("a"), F.col(column).alias("x"))
    right = side.select(F.col("id").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")


@dataclass
class NearDuplicates:
    #: (a, b, jaccard), a < b: similar representatives, each pair once.
    pairs: DataFrame
    #: (id, representative) of every text that takes part.
    members: DataFrame


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, least: int = 0, key: str = "doc_id", text: str = "text", hot: int = HOT, block: int = BLOCK) -> NearDuplicates:
    """Texts whose sets of `shingle` consecutive words have a Jaccard similarity of at least `threshold`.

    Words are the longest runs of letters and digits of the lower-cased text. Texts with fewer than `least` words, or too few for
    one shingle, and null texts take no part. Texts of the same set are members of one class and are compared once; rows repeated with
    one key are one text. An empty input gives empty results; other columns are not read.
    """
    index = index_for(threshold)
    known = stored(sketches(docs, shingle, least, key, text), "sketches")
    members = known.groupBy("fp").agg(F.min("id").alias("representative"))
    members = known.select("id", "fp").join(members, "fp").select("id", "representative").distinct()
    chosen = known.join(known.groupBy("fp").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")

    rows = chosen.select("id", "signature").mapInArrow(_keys(index), "key bigint, id bigint")
    met = rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_buckets(hot), "a bigint, b bigint, hot boolean")
    met = stored(met.distinct(), "met")
    floor = max(0, int(COMPONENTS * threshold - 3.5 * (COMPONENTS * threshold * (1 - threshold)) ** 0.5))
    crowd = met.where("hot").select(F.col("a").alias("key"), F.col("b").alias("id")).join(chosen.select("id", "low"), "id")
    sides = blocked(crowd, "key", block, "id", "low").select("left.id", "left.low", F.col("right.id").alias("id2"), F.col("right.low").alias("low2"), F.col("i") == F.col("j"))
    blocks = sides.mapInArrow(_blocks_near(floor), "a bigint, b bigint")
    plain = _with(met.where("NOT hot AND a <> b").select("a", "b"), chosen, "low").mapInArrow(_near(floor), "a bigint, b bigint")
    near = plain.union(blocks).distinct()
    pairs = _with(near, chosen, "shingles").mapInArrow(_exact(threshold), "a bigint, b bigint, jaccard double")
    return NearDuplicates(pairs, members)


def all_pairs(found: NearDuplicates, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: every pair of similar texts, those of one class included.

    Classes travel as blocks of ids, and the pairs are made from two blocks at a time: a class of very many copies is no single task's.
    """
    members = found.members
    sized = members.groupBy("representative").agg(F.count(F.lit(1)).alias("_n"))
    # only classes of several texts add pairs of their own
    several = members.join(sized.where("_n > 1").select("representative"), "representative", "left_semi")
    inside = blocked(several, "representative", block, "id")
    within = inside.select("i", "j", "right", F.explode("left").alias("a")).select("i", "j", "a", F.explode("right").alias("b")).where("a <> b AND (i <> j OR a < b)").select("a", "b")
    lists = members.join(sized, "representative").groupBy("representative", F.pmod(F.xxhash64("id"), F.ceil(F.col("_n") / block)).alias("_b")).agg(F.collect_list("id").alias("ids"))
    left, right = (lists.select(F.col("representative").alias(end), F.col("ids").alias(ids)) for end, ids in (("ra", "x"), ("rb", "y")))
    ends = found.pairs.select(F.col("a").alias("ra"), F.col("b").alias("rb")).join(left, "ra").join(right, "rb")
    across = ends.select("y", F.explode("x").alias("a")).select("a", F.explode("y").alias("b"))
    return within.union(across).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def groups(found: NearDuplicates) -> DataFrame:
    """(id, group_id, n_links) of every text that takes part: the smallest id of its group, and the number of texts similar to it."""
    pairs = found.pairs
    sizes = found.members.groupBy("representative").agg(F.count(F.lit(1)).alias("_n"))
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(sizes.withColumnRenamed("representative", "b"), "b").groupBy(F.col("a").alias("representative")).agg(F.sum("_n").alias("_l"))
    joined = components(pairs, "a", "b").select(F.col("node").alias("representative"), F.col("component"))
    classes = sizes.join(links, "representative", "left").join(joined, "representative", "left")
    classes = classes.select("representative", F.coalesce("component", "representative").alias("group_id"), (F.coalesce("_l", F.lit(0)) + F.col("_n") - 1).alias("n_links"))
    return found.members.join(classes, "representative").select("id", "group_id", "n_links")
