"""Subject areas of texts: averaged word and subword embeddings with one logistic output per subject.

Training sees a bounded sample of labelled texts, kept in a few partitions. Every step each partition returns the gradient of its texts,
the driver adds them up, takes one Adam step and sends the parameters out again. Scoring reads every text once: the trained embeddings
are folded into one row of output weights per word, a unit (a sentence, or a stretch of an unpunctuated text) is scored by its average,
every output on its own, and a text gets the subjects that enough of its units are about, so that a passing sentence does not count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.runtime import stored

#: Hash buckets of the features, size of the embeddings.
BUCKETS, DIMENSIONS = 1 << 16, 16
#: Most labelled texts that training looks at.
SAMPLE = 6000
_WORD = re.compile(r"[^\W\d_]+")
_UNIT = re.compile(r"(?<=[.;!?…])\s+|[\r\n]+")
#: Number of texts at which a word's vector has half its weight.
SHRINK = 2
#: A unit longer than this many words is cut into stretches of about half as many.
LONG = 40
#: A sentence or line of fewer words is no unit of its own.
SHORT = 4


def buckets_of(word: str) -> list[int]:
    """The word's own bucket first, then those of its character 4- and 5-grams, the word's edges included."""
    import xxhash

    own = xxhash.xxh32_intdigest(word) % BUCKETS
    if len(word) < 4:
        return [own]
    edged = f"<{word}>"
    return [own, *(xxhash.xxh32_intdigest("#" + edged[i : i + n]) % BUCKETS for n in (4, 5) for i in range(len(edged) - n + 1))]


def weights_of(word: str) -> list[tuple[int, float]]:
    """(bucket, weight): half of a word's vector is its own embedding, half the mean of its subwords."""
    own, *parts = buckets_of(word)
    return [(own, 1.0)] if not parts else [(own, 0.5), *((p, 0.5 / len(parts)) for p in parts)]


def units_of(text: str) -> list[list[str]]:
    """The words of each unit. Short sentences and lines, headings above all, are put together until they have four words; a rest goes to the unit before it."""
    found: list[list[str]] = []
    held: list[str] = []
    for part in _UNIT.split(text.lower()):
        w = _WORD.findall(part)
        if len(w) > LONG:
            n = max(1, round(len(w) / (LONG // 2)))
            found += [w[len(w) * i // n : len(w) * (i + 1) // n] for i in range(n)]
        elif len(w) >= SHORT:
            found.append(w)
        else:
            held += w
            if len(held) >= SHORT:
                found.append(held)
                held = []
    if held:
        if found:
            found[-1] = found[-1] + held
        else:
            found.append(held)
    return found


class Vocabulary:
    """Known words, and the sparse map from the embeddings of buckets to the vectors of words."""

    def __init__(self, words: dict[str, int]):
        """`words`: texts that hold each word. A word of few texts, a name above all, is drawn towards zero."""
        import numpy as np

        self.at = {w: i for i, w in enumerate(words)}
        rows = [[(b, x * n / (n + SHRINK)) for b, x in weights_of(w)] for w, n in words.items()]
        self.bucket = np.asarray([b for r in rows for b, _ in r], np.int64)
        self.weight = np.asarray([x for r in rows for _, x in r], np.float32)
        size = np.asarray([len(r) for r in rows], np.int64)
        self.first = np.cumsum(size) - size
        self.word = np.repeat(np.arange(len(rows)), size)
        self.order = np.argsort(self.bucket, kind="stable")

    def vectors(self, E):
        import numpy as np

        return np.add.reduceat(E[self.bucket] * self.weight[:, None], self.first, axis=0)

    def back(self, dV, E):
        """The gradient by embedding from the gradient by word vector."""
        return _summed(self.bucket[self.order], (dV[self.word] * self.weight[:, None])[self.order], E)


def _summed(ordered, rows, like):
    """Rows added up by their sorted index, in an array like `like`."""
    import numpy as np

    out = np.zeros_like(like)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out[ordered[starts]] = np.add.reduceat(rows, starts, axis=0)
    return out


def _bags(known: dict[str, int], subjects: list[str]):
    """Texts with labels in; for each of their units (words, weights, targets) out, its known words and their shares of the unit."""

    def run(batches):
        from collections import Counter

        for batch in batches:
            words, weights, targets = [], [], []
            for text, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = [s in labels for s in subjects]
                for unit in units_of(text):
                    bag = Counter(known[w] for w in unit if w in known)
                    if bag:
                        words.append(list(bag))
                        weights.append([n / len(unit) for n in bag.values()])
                        targets.append(target)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float32())), pa.array(targets, pa.list_(pa.bool_()))], names=["words", "weights", "targets"])

    return run


def gradient(bags: tuple, V, W, b):
    """(loss, dV, dW, db) summed over the units of (words, weights, first word of each unit, targets)."""
    import numpy as np

    words, weights, first, targets = bags
    mean = np.add.reduceat(V[words] * weights[:, None], first, axis=0)
    z = mean @ W.T + b
    p = 1 / (1 + np.exp(-z))
    loss = float((np.logaddexp(0, z) - targets * z).sum())
    d = (p - targets).astype(np.float32)
    unit = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(words))))
    order = np.argsort(words, kind="stable")
    dV = _summed(words[order], (d @ W)[unit[order]] * weights[order, None], V)
    return loss, dV, d.T @ mean, d.sum(axis=0)


def _batch_bags(batch):
    import numpy as np

    lists = batch.column(0)
    first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    targets = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float32)
    return lists.flatten().to_numpy(), batch.column(1).flatten().to_numpy(), first, targets


def _gradients(V, W, b):
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                part = gradient(_batch_bags(batch), V, W, b)
                total = part if total is None else tuple(x + y for x, y in zip(total, part, strict=True))
        if total is not None:
            loss, *parts = total
            yield pa.RecordBatch.from_arrays([pa.array([loss]), *(pa.array([x.astype("float32").tobytes()]) for x in parts)], names=["loss", "dv", "dw", "db"])

    return run


@dataclass
class Model:
    subjects: list[str]
    #: Row of each known word in `table`, which has its weight for every subject.
    known: dict[str, int]
    table: object
    bias: object


class Adam:
    def __init__(self, rate: float):
        self.rate, self.m, self.v, self.t = rate, {}, {}, 0

    def step(self, parameters: dict, gradients: dict) -> None:
        import numpy as np

        self.t += 1
        for k, g in gradients.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.99 * self.v.get(k, 0) + 0.01 * g * g
            parameters[k] -= (self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)


def start(subjects: int):
    import numpy as np

    rng = np.random.default_rng(11)
    return {"E": rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32), "W": rng.normal(0, 0.3, (subjects, DIMENSIONS)).astype(np.float32), "b": np.full(subjects, -2, np.float32)}


def fit(docs: DataFrame, labels: DataFrame, areas: DataFrame, sample: int = SAMPLE, steps: int = 30, rate: float = 0.1, decay: float = 1e-6, least: int = 3, partitions: int | None = None) -> Model:
    """A model of the subjects of `areas` from `labels` (doc_id, subject), read trimmed and without case; unknown and null ones are left out.

    At most `sample` labelled texts are used, those with the smallest hash of their id. Words count from `least` sampled texts on; their
    number is bounded by the sample. Without labels every output stays at its start and no text gets a subject.
    """
    import numpy as np

    subjects = [r[0] for r in areas.where("subject IS NOT NULL").select("subject").distinct().orderBy("subject").collect()]
    of = {s.strip().lower(): s for s in subjects}
    named = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(list(of)) & F.col("doc_id").isNotNull())
    chosen = named.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # broadcast: at most `sample` ids
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "subjects")
    # as many parts as there are cores to add up gradients; 6,000 texts need no more
    texts = stored(texts.repartition(partitions or max(6, docs.sparkSession.sparkContext.defaultParallelism), "text"), "labelled")
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))).alias("w"))
    words = dict(sorted((r[0], r[1]) for r in words.groupBy("w").count().where(F.col("count") >= least).collect()))
    p, adam, vocabulary = start(len(subjects)), Adam(rate), Vocabulary(words)
    bags = stored(texts.mapInArrow(_bags(vocabulary.at, [s.strip().lower() for s in subjects]), "words array<int>, weights array<float>, targets array<boolean>"), "bags")
    n = max(1, bags.count())
    for _ in range(steps if words else 0):
        V = vocabulary.vectors(p["E"])
        parts = bags.mapInArrow(_gradients(V, p["W"], p["b"]), "loss double, dv binary, dw binary, db binary").collect()
        dV, dW, db = (sum(np.frombuffer(r[k], np.float32).astype(np.float64) for r in parts) / n for k in (1, 2, 3))
        dE = vocabulary.back(dV.astype(np.float32).reshape(V.shape), p["E"])
        adam.step(p, {"E": dE + decay * p["E"], "W": dW.reshape(p["W"].shape) + decay * p["W"], "b": db})
    table = vocabulary.vectors(p["E"]) @ p["W"].T if words else np.zeros((0, len(subjects)), np.float32)
    return Model(subjects, vocabulary.at, table, p["b"])


def _scorer(model: Model, threshold: float, share: float, section: int):
    def run(batches):
        import numpy as np

        matrix = np.vstack([model.table, np.zeros((1, len(model.subjects)), np.float32)])
        row, none = model.known.get, len(model.known)
        for batch in batches:
            kept, subjects, units, hits = [], [], [], []
            for at in range(0, batch.num_rows, 500):
                texts = [units_of(t) if t else [] for t in batch.column(1).slice(at, 500).to_pylist()]
                size = np.fromiter((len(u) for t in texts for u in t), np.int64)
                if not len(size):
                    continue
                words = np.fromiter((row(w, none) for t in texts for u in t for w in u), np.int64, int(size.sum()))
                # an unknown word counts in the length of its unit and weighs nothing
                z = np.add.reduceat(matrix[words], np.cumsum(size) - size, axis=0) / size[:, None] + model.bias
                about = z >= np.log(threshold / (1 - threshold))
                n = np.fromiter(map(len, texts), np.int64, len(texts))
                full = np.flatnonzero(n)
                found = np.add.reduceat(about.astype(np.int64), (np.cumsum(n) - n)[full], axis=0)
                enough = (found >= np.minimum(2, n[full])[:, None]) & (found >= np.minimum(share * n[full], section)[:, None])
                for i, k in zip(*np.nonzero(enough), strict=True):
                    kept.append(at + int(full[i]))
                    subjects.append(model.subjects[k])
                    units.append(int(n[full[i]]))
                    hits.append(int(found[i, k]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), pa.array(subjects, pa.string()), pa.array(units, pa.int32()), pa.array(hits, pa.int32())], names=["doc_id", "subject", "n_units", "n_about"])

    return run


def assign(docs: DataFrame, model: Model, threshold: float = 0.5, share: float = 0.2, section: int = 8) -> DataFrame:
    """(doc_id, subject, n_units, n_about), a row for each subject of each text.

    A unit is about every subject whose output is at least `threshold`. A text has the subjects of at least `share` of its units, or of `section` units,
    which are a section of a long text, and of no fewer than two units (or of all, where it has one). Null, empty and blank texts have none; repeated
    rows give repeated rows; other columns are not read.
    """
    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_scorer(model, threshold, share, section), f"doc_id {kind}, subject string, n_units int, n_about int")


def composition(assigned: DataFrame, docs: DataFrame) -> DataFrame:
    """(subject, n_documents, share): the make-up of the collection, share of all rows of `docs`."""
    everything = docs.agg(F.count(F.lit(1)).alias("_n")).select("_n").scalar()
    return assigned.groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents")).withColumn("share", F.col("n_documents") / everything)
