"""Mixing sources to target weights by weighted sampling without replacement (Efraimidis-Spirakis) within token budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import bpe
from inkwell.operators.hotkeys import numbered
from inkwell.runtime import stored, width

#: Rows of a source and bucket that one task numbers, about: buckets are as many as the records demand.
BUCKET = 1 << 17


def quality(text: Column) -> Column:
    """A weight in [0.1, 1] for drawing a text early: the share of letters among its characters, halved for texts under 200 characters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.1), letters * F.when(F.length(text) < 200, 0.5).otherwise(1.0))


def source_name(source: Column) -> Column:
    """Spellings of one source are one source: trimmed, lower case, blanks as underscores."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_]+", "_")


@dataclass
class Mix:
    #: (doc_id, source, n_tokens, uses): the records of the mix and how often each is used.
    records: DataFrame
    #: (source, target_share, max_repeats, available_tokens, selected_tokens, actual_share), a row for each listed source.
    shares: DataFrame


def mix(docs: DataFrame, weights: DataFrame, total: float | None = None, seed: int = 7, folder: str = bpe.DEFAULT_FOLDER) -> Mix:
    """A mix of `docs` (doc_id, text, source) in which each source of `weights` (source, target_share, max_repeats) has its share of tokens.

    The total is the largest that every source with texts can fill within its repeats, unless a smaller one is asked for; a source without
    texts leaves its share to the others in proportion. A source first gives as many complete epochs as fit its budget; the rest is filled by
    drawing records in the order of exponential keys scaled by quality, up to the record that comes nearest to the budget. Documents of null or
    unlisted sources and documents without tokens are not used. Repeated rows are records of their own. Sizes are tokens of byte_bpe_50k.
    """
    record = F.struct("doc_id", source_name(F.col("source")).alias("source"), quality(F.col("text")).alias("quality"))
    listed = weights.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").groupBy(source_name(F.col("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    sized = bpe.token_counts(docs.where(F.col("source").isNotNull()).select(record.alias("record"), "text"), "record", "text", folder).select("record.*", "n_tokens").where("n_tokens > 0")
    sized = stored(sized, "sized")
    available = sized.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    # broadcast: as many rows as source_weights, a fixed table
    offers = listed.join(available, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    offers = stored(offers.coalesce(1), "offers")
    filled = offers.where("available_tokens > 0")
    limit = filled.agg(F.min(F.col("available_tokens") * F.col("max_repeats") / F.col("target_share")).alias("_t"), F.sum("target_share").alias("_s"))
    most = limit.select((F.col("_t") * F.col("_s")).alias("_m")).scalar()
    whole = F.least(most, F.lit(float(total))) if total is not None else most
    budget = whole * F.col("target_share") / limit.select("_s").scalar()
    plan = filled.select("source", "max_repeats", "available_tokens", budget.alias("budget"))
    plan = plan.withColumn("epochs", F.least(F.floor(F.col("budget") / F.col("available_tokens")), F.col("max_repeats")).cast("int"))
    plan = plan.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("available_tokens"))

    # uniform in (0, 1) from the id: the draw is the same wherever and however often it is computed
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    drawn = sized.join(F.broadcast(plan), "source").withColumn("_key", -F.log(uniform) / F.col("quality"))
    # rises with the key, so that buckets are ranges of keys; with the mean quality they are nearly equal in size
    usual = sized.agg(F.avg("quality").alias("_q")).select("_q").scalar()
    buckets = sized.agg(F.greatest(F.lit(4 * width(docs.sparkSession)), F.ceil(F.count(F.lit(1)) / BUCKET)).alias("_b")).select("_b").scalar()
    bucket = F.floor((F.lit(1.0) - F.exp(-F.col("_key") * usual)) * buckets)
    placed = numbered(drawn, "source", ["_key", "doc_id"], "n_tokens", bucket)
    extra = ((F.col("_before") + F.col("n_tokens") / 2) <= F.col("rest")) & (F.col("epochs") < F.col("max_repeats"))
    used = placed.withColumn("uses", F.col("epochs") + extra.cast("int")).where("uses > 0")
    records = used.select("doc_id", "source", "n_tokens", "uses")
    selected = records.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("selected_tokens"))
    shares = offers.join(selected, "source", "left").withColumn("selected_tokens", F.coalesce("selected_tokens", F.lit(0)))
    grand = records.agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("_g")).select("_g").scalar()
    shares = shares.select("source", "target_share", "max_repeats", "available_tokens", "selected_tokens", (F.col("selected_tokens") / grand).alias("actual_share"))
    return Mix(records, shares)
