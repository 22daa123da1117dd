"""From contexts to one narrative: a language model, given as a function over a table, answers every context; the answers of a group are merged, and then
those of all groups."""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Called with the question and contexts (grp, batch, n, context); gives (grp, batch, text), or whatever is wanted of `Engine.ask`. A language model goes here, as
#: a function of partitions, so that contexts are answered at once and not one after the other.
Generator = Callable[[str, DataFrame], DataFrame]
RULE = "\n\n---\n\n"


def passages(_: str, contexts: DataFrame) -> DataFrame:
    """The generator without a model: the contexts themselves."""
    return contexts


def sections(texts: DataFrame, *scope: str, named: bool = False) -> DataFrame:
    """(scope, n, context, plain): texts (grp, batch, text) in order, each under a heading with its number or, if `named`, its group, and without headings.

    Null and blank texts are left out. There is a text per batch of chunks and then per region or period, which bounds a section list.
    """
    kept = texts.where(F.trim("text") != "").groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("grp", "batch", "text"))).alias("i"))
    heading = (lambda s, k: s.grp) if named else (lambda s, k: F.concat(F.lit("Section "), (k + 1).cast("string")))
    listed = F.transform("i", lambda s, k: F.concat(F.lit("=== "), heading(s, k), F.lit(" ===\n"), s.text))
    return kept.select(*scope, F.size("i").alias("n"), F.array_join(listed, "\n\n").alias("context"), F.array_join(F.transform("i", lambda s: s.text), RULE).alias("plain"))


def merged(question: str, texts: DataFrame, generator: Generator, *scope: str, named: bool = False) -> DataFrame:
    """(grp, batch, text): the texts of each scope merged into one by the generator; a single text stays, and where the generator gives nothing the texts
    follow one another with rules between them."""
    parts = sections(texts, *scope, named=named)
    keys = list(scope)
    first = texts.where(F.trim("text") != "").groupBy(*scope).agg(F.min("text").alias("only"))
    parts = parts.join(first, keys) if keys else parts.crossJoin(first)  # one row each
    grp = F.col("grp") if "grp" in keys else F.lit("all").alias("grp")
    asked = parts.where("n > 1").select(grp, F.lit(0).cast("bigint").alias("batch"), "n", "context")
    made = generator(question, asked).select("grp", F.col("text").alias("made"))
    joined = parts.select(grp, "n", "plain", "only").join(made, "grp", "left")
    text = F.when(F.col("n") == 1, F.col("only")).when(F.trim("made") != "", F.col("made")).otherwise(F.col("plain"))
    return joined.select("grp", F.lit(0).cast("bigint").alias("batch"), text.alias("text"))


def narrative(question: str, contexts: DataFrame, generator: Generator) -> DataFrame:
    """(answer): the generator answers every context, the answers to the batches of a group are merged, and then those of the groups, under their names."""
    answered = generator(question, contexts).select("grp", "batch", "text")
    per_group = merged(question, answered, generator, "grp")
    return merged(question, per_group, generator, named=True).select(F.col("text").alias("answer"))


def retried(call: Callable, passing: Callable[[Exception], bool], tries: int = 20, seconds: float = 300.0, first: float = 1.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep):
    """The result of `call`, tried again after errors that may pass: up to `tries` times and `seconds` in all, after waits that double from `first` to
    `longest` with some jitter. Other errors, and the last one, are raised."""
    waited, wait = 0.0, first
    for n in range(1, tries + 1):
        try:
            return call()
        except Exception as error:  # noqa: BLE001 - which errors pass is the caller's to say
            pause = min(wait, longest) * random.uniform(0.9, 1.1)
            if n == tries or not passing(error) or waited + pause > seconds:
                raise
            sleep(pause)
            waited, wait = waited + pause, wait * 2
