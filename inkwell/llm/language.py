"""The language of a text by its words and their trigrams, learnt from labelled texts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled texts that are read to learn: those with the smallest hash of their id.
SAMPLE = 2000
#: Texts at which what a word says has half its weight.
SHRINK = 20
_LETTERS = re.compile(r"[^\W\d_]+")
# Codes of three letters and the codes of two that mean the same.
CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl", "lat": "la", "rus": "ru"}


def code(label: Column) -> Column:
    """`EN`, `fr-FR` and `deu` as codes of two letters; anything else is null."""
    first = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    known = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    return F.when(F.length(first) == 2, first).otherwise(F.try_element_at(known, first))


@dataclass
class Languages:
    names: list[str]
    #: Of a word or trigram how much likelier it is in each language than in all of them together, as logarithms.
    words: dict[str, list[float]]
    trigrams: dict[str, list[float]]

    def score(self, word: str) -> list[float]:
        """What a word says for each language: as a whole if it was met, else by its trigrams; numbers and what was never met say nothing."""
        low = word.lower()
        if low in self.words:
            return self.words[low]
        edged = f"<{low}>"
        met = [x for i in range(len(edged) - 2) if (x := self.trigrams.get(edged[i : i + 3]))] if _LETTERS.search(low) else []
        return [sum(x) / len(met) for x in zip(*met, strict=True)] if met else [0.0] * len(self.names)


def learn(docs: DataFrame, sample: int = SAMPLE, least: int = 3, share: float = 0.01) -> Languages | None:
    """Languages of `docs` (doc_id, text, lang) that at least `share` of the sampled texts are labelled with; None where these are fewer than two.

    A wrong label here and there does no harm. What is collected are the words of at most `sample` texts, counted by language.
    """
    from math import log

    labelled = docs.where("text IS NOT NULL").select("doc_id", code(F.col("lang")).alias("lang")).where("lang IS NOT NULL")
    # broadcast: at most `sample` ids
    chosen = F.broadcast(labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # texts and not mentions: a name that one text has often is no word of its language
    words = docs.select("doc_id", "text").join(chosen, "doc_id").select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+(?:['’-]\p{L}+)*"), F.lit(0)))).alias("w"))
    # at most `sample` texts
    rows = words.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).collect()
    texts = {r.lang: r.n for r in chosen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(x for x, n in texts.items() if n >= max(2, share * sum(texts.values())))
    if len(names) < 2:
        return None
    at = {x: i for i, x in enumerate(names)}

    def odds(counts: dict[str, list[float]], least: int) -> dict[str, list[float]]:
        totals = [sum(c[i] for c in counts.values()) or 1 for i in range(len(names))]
        out = {}
        for k, c in counts.items():
            if sum(c) >= least:
                p = [log((n + 0.5) / (t + 0.5 * len(counts))) for n, t in zip(c, totals, strict=True)]
                mean, trust = sum(p) / len(p), sum(c) / (sum(c) + SHRINK)
                out[k] = [trust * max(-4.0, min(4.0, x - mean)) for x in p]
        return out

    whole: dict[str, list[float]] = {}
    grams: dict[str, list[float]] = {}
    for lang, w, n in ((r.lang, r.w.replace("’", "'"), r.n) for r in rows if r.lang in at):
        whole.setdefault(w, [0.0] * len(names))[at[lang]] += n
        edged = f"<{w}>"
        for i in range(len(edged) - 2):
            # distinct words and not mentions: how the language spells, whatever the texts speak of
            grams.setdefault(edged[i : i + 3], [0.0] * len(names))[at[lang]] += 1
    return Languages(names, odds(whole, least), odds(grams, 10 * least))
