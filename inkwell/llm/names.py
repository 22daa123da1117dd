"""Variant spellings of one family, person or firm.

1. Each name is read: what kind of name it is, the surname or place it is built on, the given name or its initial. Titles, particles,
   possessives, short forms, order and legal suffixes are read away, so that many spellings become one form.
2. Forms meet by MinHash banding over padded q-grams of their core; the bands are as many as the collision curve demands for the wanted
   recall at the similarity one slip of the keyboard leaves.
3. Pairs of forms of one kind pass Monge-Elkan similarity of their surnames, word by word, with a bound that follows the length of the
   words, and their given names must agree.
4. Star clustering: the form with most links, then most mentions, is a centre and takes the forms linked to it.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import namelex
from inkwell.llm.neardup import blocked
from inkwell.runtime import cut, stored, width

_EDGE = re.compile(r"^[^\w&]+|[^\w.&]+$")
_TOKEN = re.compile(r"[^\s,;/()\"]+|,")
#: Tokens that no name has: numbers, ordinals, decades, and law codes, which are letters and a year.
_NUMBER = re.compile(r"^(?:[\W\d_]*\d[\W\d_]*(?:st|nd|rd|th|s)?|[a-z]{1,4}\d{4})\W*$")


def osa(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours, or most + 1 if it is larger than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        two, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if two and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most and min(before) > most:
            return most + 1
    return min(row[-1], most + 1)


def plain(text: str) -> str:
    """Without accents, with one kind of apostrophe."""
    text = text.replace("’", "'").replace("`", "'").replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def sound(core: str) -> str:
    """The same string for letters that are often read or typed for one another."""
    return core.replace("rn", "m").replace("ph", "f").replace("vv", "w").replace("1", "l").replace("0", "o")


@dataclass(frozen=True)
class Form:
    kind: str
    #: Surnames or place, sorted.
    core: tuple[str, ...]
    given: str = ""


class Reader:
    """Reads a trimmed, lower-case name into a form; None for what is no name."""

    def __init__(self):
        self.given: dict[str, str] = {}
        for name, short in namelex.GIVEN_NAMES.items():
            for s in (name, *short.split()):
                self.given.setdefault(plain(s), name)
        self.long = [g for g in self.given if len(g) >= 4]
        self.guessed: dict[str, str] = {}

    def given_of(self, token: str, guess: bool = True) -> str:
        """The given name a token stands for, also with one slip; else an empty string."""
        t = token.strip(".'-")
        if t in self.given:
            return self.given[t]
        if not guess or len(t) < 4:
            return ""
        if t not in self.guessed:
            near = {self.given[g] for g in self.long if abs(len(g) - len(t)) <= 1 and osa(g, t, 1) <= 1 and len(g) >= 5}
            self.guessed[t] = near.pop() if len(near) == 1 else ""
        return self.guessed[t]

    @staticmethod
    def near(token: str, words, least: int = 5) -> bool:
        """One of the words, also with one slip if it is long."""
        return token in words or (len(token) >= least and any(len(w) >= least and osa(token, w, 1) <= 1 for w in words))

    def read(self, name: str) -> Form | None:
        text = _EDGE.sub("", plain(name.lower()).replace("_", " ")).strip()
        text = re.sub(r"'s$|s'$", lambda m: "" if m[0] == "'s" else "s", text)
        if not text or any(_NUMBER.search(t) for t in _TOKEN.findall(text)):
            return None
        text = text.replace("1", "l").replace("0", "o")
        tokens = [t for t in (x if x == "," else x.strip(".'-") if x not in ("&",) else x for x in _TOKEN.findall(text.replace("&", " & "))) if t]
        if not any(len(t) > 1 for t in tokens):
            return None
        return self.firm(tokens) or self.person_or_family(tokens)

    def firm(self, tokens: list[str]) -> Form | None:
        n = namelex
        words = [t for t in tokens if t not in (",", "the", "messrs")]
        bank = any(t == "bank" for t in words) and any(self.near(t, n.NATIONAL, 7) for t in words)
        if bank or "nb" in (words[0], words[-1]):
            rest = [t for t in words if t not in ("bank", "nb") and not self.near(t, n.NATIONAL, 7) and t not in n.SMALL and t not in n.COMPANY]
            return Form("bank", (sound("".join(rest)),)) if rest else None
        trust = any(self.near(t, ("trust",)) for t in words) and any(t in n.COMPANY or self.near(t, ("company",)) for t in words)
        if trust or "tc" in (words[0], words[-1]):
            rest = [t for t in words if t != "tc" and not self.near(t, ("trust",)) and t not in n.COMPANY and not self.near(t, ("company",)) and t not in n.SMALL]
            return Form("trust", (sound("".join(rest)),)) if rest else None
        if len(words) > 1 and any(t in n.BANKS for t in words):
            # a bank that is no national bank: no word of it is a given name
            return Form("house", (sound("".join(t.replace("-", "") for t in words if t not in n.SMALL and t not in n.PARTICLES)),))
        joined = any(t in n.JOINING for t in words)
        kind = "sons" if joined and any(t in n.SONS for t in words) else "brothers" if any(self.near(t, n.BROTHERS, 7) for t in words) else ""
        if kind:
            rest = [t for t in words if t not in n.JOINING and t not in n.SONS and not self.near(t, n.BROTHERS, 7) and t not in n.COMPANY and not self.near(t, ("company",)) and t not in n.SMALL]
            return Form(kind, (sound("".join(rest)),)) if rest else None
        company = any(t in n.COMPANY or self.near(t, ("company", "limited")) for t in words)
        if joined or company:
            rest = [t for t in words if t not in n.JOINING and t not in n.COMPANY and not self.near(t, ("company", "limited")) and t not in n.SMALL]
            if len(rest) == 1 and "-" in rest[0]:
                rest = rest[0].split("-")
            if len(rest) >= 1 and all(len(t) > 2 for t in rest):
                return Form("partners" if len(rest) > 1 else "company", tuple(sorted(map(sound, (t.replace("-", "") for t in rest)))))
        return None

    def person_or_family(self, tokens: list[str]) -> Form | None:
        n = namelex
        family = any(t in n.FAMILY_WORDS for t in tokens)
        plural = tokens[0] == "the" and tokens[-1].endswith("s")
        titled = any(t in n.TITLES for t in tokens)
        kept = [t for t in tokens if t not in n.TITLES and t not in n.FAMILY_WORDS and t not in n.SMALL]
        particle = any(t in n.PARTICLES for t in kept)
        kept = [t for t in kept if t not in n.PARTICLES]
        comma = kept.index(",") if "," in kept else -1
        words = [t for t in kept if t != ","]
        if not words:
            return None
        if len(words) == 1 and len(words[0]) >= 17 and all(len(t) >= 6 for t in words[0].split("-")) and "-" in words[0]:
            # too long for one surname typed with a hyphen: two partners
            return Form("partners", tuple(sorted(map(sound, words[0].split("-")))))
        if family or plural or len(words) == 1:
            core = "".join(w.replace("-", "") for w in words)
            if plural and core.endswith("s"):
                core = core[:-1]
            return Form("person" if titled and not family and len(words) > 1 else "family", (sound(core),)) if len(core) >= (2 if family or plural else 4) else None
        if comma > 0:
            surname, first = kept[:comma], [t for t in kept[comma + 1 :] if t != ","]
        else:
            known = [self.given_of(w, guess=False) for w in words]
            if not any(known):
                known = [self.given_of(w) for w in words]
            initial = [len(w) == 1 for w in words]
            if known[0] or initial[0]:
                surname, first = [w for w in words[1:] if len(w) > 1], words[:1]
                if not surname:
                    return None
            elif known[-1] or initial[-1]:
                surname, first = [w for w in words[:-1] if len(w) > 1], words[-1:]
            elif len(words) == 2 and not titled and "-" in words[1] + words[0]:
                surname, first = words[1:], words[:1]
            elif len(words) == 2:
                # two words without a given name: a surname typed with a gap
                return Form("family", (sound("".join(words)),))
            else:
                # nothing tells the surname
                return Form("unknown", (sound("".join(w.replace("-", "") for w in words)),))
        core = "".join(w.replace("-", "") for w in surname)
        if not first:
            return Form("family", (sound(core),))
        g = first[0].replace("-", "")
        return Form("person", (sound(core),), self.given_of(g) or g)


def best_similarities(a: list[str] | tuple[str, ...], b: list[str] | tuple[str, ...]) -> list[tuple[float, str, str]]:
    """For each word of the longer list the most similar word of the other, the similarity being 1 - edit distance / length: the terms of Monge-Elkan."""
    if len(a) < len(b):
        a, b = b, a
    return [max((1 - osa(x, y, 4) / max(len(x), len(y)), x, y) for y in b) for x in a] if b else []


def monge_elkan(a: list[str] | tuple[str, ...], b: list[str] | tuple[str, ...]) -> float:
    """The mean of `best_similarities`; 0 where a list is empty."""
    terms = best_similarities(a, b)
    return sum(t for t, _, _ in terms) / len(terms) if terms else 0.0


def alike(x: list[str], y: list[str], slips: int, least: float) -> bool:
    """Lists of as many words, whose Monge-Elkan similarity is at least `least`, and each term of it at least what one slip of the keyboard leaves of the
    word, or `slips` of a word of eight letters or more."""
    terms = best_similarities(x, y)
    near = all(t >= 1 - (slips if min(len(u), len(v)) >= 8 else 1) / max(len(u), len(v)) - 1e-9 for t, u, v in terms)
    return bool(terms) and len(x) == len(y) and near and sum(t for t, _, _ in terms) / len(terms) >= least


def given_agree(a: str, b: str) -> bool:
    """The same given name, or its initial, or a name one slip away that is no other known name."""
    if a == b or not a or not b:
        return a == b
    if len(a) == 1 or len(b) == 1:
        return a[0] == b[0]
    if a in namelex.GIVEN_NAMES and b in namelex.GIVEN_NAMES:
        return False
    return osa(a, b, 1) <= 1


def bands_for(similarity: float, rows: int, miss: float) -> int:
    """Bands of `rows` minima of which a pair of this Jaccard similarity shares none with a probability of at most `miss`."""
    from math import ceil, log

    return ceil(log(miss) / log(1 - similarity**rows))


def qgrams(core: str, q: int = 3) -> set[str]:
    """The q-grams of each word of a core, padded at both ends."""
    pad = "#" * (q - 1)
    return {x[i : i + q] for word in core.split("/") for x in [f"{pad}{word}{pad}"] for i in range(len(x) - q + 1)}


def slip_keys(core: str) -> set[str]:
    """Keys of which two cores share one if each word of the one is within the slips that `_similar` allows of a word of the other.

    They are the words with as many letters left out as slips are allowed: one, or two from 8 letters on; from 24 letters on the bands miss two
    slips once in a million. Where a core has several words,
    two letters are left out of one word only while the others stay as they are; pairs with more slips than that meet on their bands.
    """

    def less(words: set[str]) -> set[str]:
        return words | {w[:i] + w[i + 1 :] for w in words for i in range(len(w))}

    words = core.split("/")
    one = [less({w}) for w in words]
    keys = {"/".join(sorted(ws)) for ws in product(*one)}
    for at, w in enumerate(words):
        if 8 <= len(w) < 24:
            keys |= {"/".join(sorted([*words[:at], x, *words[at + 1 :]])) for x in less(one[at])}
    return keys


def _reader(batches):
    reader = Reader()
    for batch in batches:
        forms = [reader.read(n) for n in batch.column(0).to_pylist()]
        rows = [i for i, f in enumerate(forms) if f]
        out = batch.take(pa.array(rows, pa.int32()))
        columns = [pa.array([g(forms[i]) for i in rows], pa.string()) for g in (lambda f: f.kind, lambda f: "/".join(f.core), lambda f: f.given)]
        yield pa.RecordBatch.from_arrays([*out.columns, *columns], names=["name", "mentions", "kind", "core", "given"])


def _banded(bands: int, rows: int):
    def run(batches):
        import numpy as np
        import xxhash

        rng = np.random.default_rng(5)
        flips, turns = (rng.integers(0, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                grams = [qgrams(c) for c in part.column(1).to_pylist()]
                size = np.fromiter(map(len, grams), np.int64, len(grams))
                if not len(size):
                    continue
                h = np.fromiter((xxhash.xxh3_64_intdigest(g) for gs in grams for g in gs), np.uint64, int(size.sum()))
                first = np.cumsum(size) - size
                for b in range(bands):
                    key = np.full(len(grams), b + 1, np.uint64)
                    for k in range(b * rows, (b + 1) * rows):
                        low = np.minimum.reduceat((h ^ flips[k]) * turns[k], first)
                        key = (key ^ low) * np.uint64(0x9E3779B97F4A7C15)
                        key ^= key >> np.uint64(29)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), part.column(0), part.column(1), part.column(2)], names=["key", "kind", "core", "spellings"])
                for c in range(0, part.num_rows, 200):
                    few = part.slice(c, 200)
                    keys = [slip_keys(x) for x in few.column(1).to_pylist()]
                    of = few.take(pa.array([i for i, ks in enumerate(keys) for _ in ks], pa.int32()))
                    key = np.fromiter((xxhash.xxh3_64_intdigest(k) for ks in keys for k in ks), np.uint64, of.num_rows)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *of.columns], names=["key", "kind", "core", "spellings"])

    return run


def _similar(least: float):
    """(kind, a, na, b, nb) in; the pairs of cores that pass out. na and nb: numbers of spellings of either core."""

    def run(batches):
        for batch in batches:
            keep = []
            for a, na, b, nb in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                # a core of one spelling only may be two slips away from one that is well attested
                keep.append(alike(a.split("/"), b.split("/"), 2 if min(na, nb) == 1 and max(na, nb) >= 3 else 1, least))
            yield batch.select([0, 1, 3]).filter(pa.array(keep, pa.bool_()))

    return run


def _agreeing(batches):
    for batch in batches:
        given = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        yield batch.select([0, 1]).filter(pa.array([given_agree(a, b) for a, b in given], pa.bool_()))


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, centre) for every node (node, weight) with an edge (a, b): star clusters by degree, then weight, then name.

    Each round makes centres of the nodes that precede all their neighbours still undecided, and gives those neighbours to the best of the
    new centres beside them: what the greedy algorithm does one centre at a time. A reliable checkpoint ends each round, and rounds go on until
    nothing is undecided: each settles at least the node that precedes all others, and usually nearly all of them.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    degree = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    rank = degree.join(nodes, "node").select("node", F.struct("degree", "weight", "node").alias("rank"))
    ranked = rank.withColumnsRenamed({"node": "a", "rank": "ra"})
    open_edges = cut(both.join(ranked, "a").join(rank.withColumnsRenamed({"node": "b", "rank": "rb"}), "b").select("a", "b", "ra", "rb"))
    settled: list[DataFrame] = []
    while not open_edges.isEmpty():
        tops = open_edges.groupBy("a").agg(F.max("rb").alias("_m"), F.max("ra").alias("_r")).where("_r > _m").select(F.col("a").alias("centre"))
        taken = open_edges.join(tops, F.col("b") == F.col("centre")).groupBy("a").agg(F.max("rb").alias("_m")).select(F.col("a").alias("node"), F.col("_m.node").alias("centre"))
        new = cut(tops.select(F.col("centre").alias("node"), "centre").union(taken))
        settled.append(new)
        gone = new.select("node")
        open_edges = cut(open_edges.join(gone, open_edges.a == gone.node, "left_anti").join(gone, F.col("b") == gone.node, "left_anti"))
    if not settled:
        return degree.select("node", F.col("node").alias("centre"))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out


def name_mentions(indices: DataFrame, detected: DataFrame, identity: str = "jewish") -> DataFrame:
    """(name, mentions): the keys of `term_to_chunks` and the families of an identity, trimmed and lower-cased; nulls and blanks left out."""
    terms = indices.select(F.explode(F.map_keys("term_to_chunks")).alias("name"))
    families = detected.select(F.explode(F.try_element_at(F.col("identities"), F.lit(identity)).getField("families")).alias("name"))
    tidy: Column = F.lower(F.trim("name")).alias("name")
    return terms.union(families).select(tidy).where("name <> ''").groupBy("name").agg(F.count(F.lit(1)).alias("mentions"))


def variants(mentions: DataFrame, similarity: float = 0.5, rows: int = 4, miss: float = 0.005, least: float = 0.75, most: int = 512) -> DataFrame:
    """(name, mentions, kind, cluster): names of one cluster are spellings of one family, person or firm.

    `mentions` has one row per distinct (name, mentions). What cannot be read as a name, such as what has a number, an ordinal or a law
    code for a word, single words of up to three letters and initials alone, is left out; cores of up to three letters are linked where they are equal; a 1 or 0 inside a word is read as l or o; null names are left out; an
    empty input gives no rows. An initial agrees with every given name it may stand for; where there are several, the spelling goes to the larger
    cluster.
    """
    # names are small and reading them is not: as many tasks as the session asks for, whatever the bytes
    spaced = mentions.where(F.col("name").isNotNull()).select("name", F.col("mentions").cast("bigint").alias("mentions")).repartition(width(mentions.sparkSession), "name")
    read = stored(spaced.mapInArrow(_reader, "name string, mentions bigint, kind string, core string, given string"), "forms")
    node = F.concat_ws("|", "kind", "core", "given")
    nodes = read.groupBy("kind", "core", "given").agg(F.sum("mentions").alias("weight")).withColumn("node", node)
    cores = read.groupBy("kind", "core").agg(F.count(F.lit(1)).alias("spellings"))
    bands = bands_for(similarity, rows, miss)
    keyed = stored(cores.repartition(width(mentions.sparkSession), "core").mapInArrow(_banded(bands, rows), "key bigint, kind string, core string, spellings bigint"), "bands")
    # a key with very many cores is compared in blocks, the others at once
    hot = keyed.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key", "kind")
    few = keyed.join(hot, ["key", "kind"], "left_anti")
    left, right = (few.select("key", "kind", F.col("core").alias(c), F.col("spellings").alias("n" + c)) for c in "ab")
    # the distance, in the JVM, spares Python the chance meetings; a swap counts as two there
    close = (F.col("kind") == "partners") | (F.levenshtein("a", "b", 4) >= 0)
    plainly = left.join(right, ["key", "kind"]).where("a < b").where(close).select("kind", "a", "na", "b", "nb")
    crowd = keyed.join(hot, ["key", "kind"], "left_semi").select(F.struct("key", "kind").alias("of"), "core", "spellings")
    sides = blocked(crowd, "of", most, "core", "spellings").select("of.kind", F.explode("left").alias("x"), "right").select("kind", "x", F.explode("right").alias("y"))
    crowded = sides.select("kind", F.least("x.core", "y.core").alias("a"), F.when(F.col("x.core") < F.col("y.core"), F.col("x.spellings")).otherwise(F.col("y.spellings")).alias("na"), F.greatest("x.core", "y.core").alias("b"), F.when(F.col("x.core") < F.col("y.core"), F.col("y.spellings")).otherwise(F.col("x.spellings")).alias("nb"))
    met = plainly.union(crowded.where("a < b").where(close)).distinct()
    # read in both directions, and the edges several times: each is made once
    near = stored(met.mapInArrow(_similar(least), "kind string, a string, b string"), "near")
    same = cores.select("kind", F.col("core").alias("a"), F.col("core").alias("b"))
    pairs = near.union(near.select("kind", F.col("b").alias("a"), F.col("a").alias("b"))).union(same)
    # given names meet on what is left of them without one letter, an initial meets every name it may stand for: no surname, however
    # common, has its bearers compared with one another; of one surname there are as many initials as letters, whatever its bearers
    initial = F.length("given") == 1
    shorter = F.when(F.length("given") > 1, F.transform(F.sequence(F.lit(1), F.length("given")), lambda i: F.concat(F.substring("given", F.lit(1), i - 1), F.substring("given", i + 1, F.length("given")))))
    slips = F.concat(F.array("given"), F.coalesce(shorter, F.array().cast("array<string>")))
    letter = F.concat(F.lit("~"), F.substring("given", 1, 1))
    asking = F.when(initial, F.array(letter)).otherwise(slips)
    asked = F.when(F.length("given") > 0, F.array_append(slips, letter)).otherwise(slips)

    def side(core: str, given: str, name: str, keys: Column) -> DataFrame:
        return nodes.select("kind", F.col("core").alias(core), F.col("given").alias(given), F.col("node").alias(name), F.explode(F.array_distinct(keys)).alias("key"))

    ends = pairs.join(side("a", "ga", "u", asking), ["kind", "a"]).join(side("b", "gb", "v", asked), ["kind", "b", "key"])
    edges = stored(ends.where("u <> v").select("u", "v", "ga", "gb").distinct().mapInArrow(_agreeing, "u string, v string").toDF("a", "b"), "edges")
    clusters = stars(nodes.select("node", "weight"), edges)
    named = read.withColumn("node", node).join(clusters, "node", "left")
    return named.select("name", "mentions", "kind", F.coalesce("centre", "node").alias("cluster"))


def linked(found: DataFrame) -> DataFrame:
    """(name_a, name_b), a < b in byte order: every pair of different spellings of one cluster."""
    left, right = (found.select("cluster", F.col("name").alias(c)) for c in ("name_a", "name_b"))
    return left.join(right, "cluster").where("name_a < name_b").select("name_a", "name_b")
