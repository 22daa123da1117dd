"""What happens to an ordered set of retrieved chunks (chunk_id, ord, text): filters with fallbacks, sentence deduplication, order, samples, batches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell import lexicons as L
from inkwell.functions import text as X
from inkwell.runtime import stored, width


def best_tier(chunks: DataFrame, tier: Column) -> DataFrame:
    """Rows of the least tier that occurs. The least is a scalar, so that no window over the whole set gathers it in one task."""
    ranked = chunks.withColumn("_tier", tier)
    least = ranked.agg(F.min("_tier").alias("m")).select("m").scalar()
    return ranked.where(F.col("_tier") == least).drop("_tier")


def ideology(chunks: DataFrame, identities: list[str]) -> DataFrame:
    """Chunks on an ideology with finance, transition or crisis; of these the ones with an identity if there are any; all if there are none."""
    t = F.col("text")
    primary = X.any_of(t, L.IDEOLOGY_WORDS) & (X.any_of(t, L.IDEOLOGY_FINANCE) | X.any_of(t, L.IDEOLOGY_TRANSITION) | X.any_of(t, L.IDEOLOGY_CRISIS))
    return best_tier(chunks, F.when(primary & X.any_of(t, identities), 1).when(primary, 2).otherwise(3))


def finance_only(chunks: DataFrame, excluded: list[str] = (), finance: list[str] = L.FINANCE_WORDS, capitalised: dict[str, list[str]] | None = None) -> DataFrame:
    """Chunks with a word of finance and none of the excluded patterns; all chunks if none is left.

    A word of `capitalised` counts with a capital: a text that has it only in lower case is left out unless it has one of the word's contexts. (That a
    text must not have certain words without one of finance adds nothing, as it must have one of finance anyway.)
    """
    t = F.col("text")
    keep = X.any_of(t, list(finance))
    for pattern in excluded:
        keep = keep & ~F.lower(t).rlike(X.pinned(pattern))
    for word, contexts in (capitalised or {}).items():
        keep = keep & (~t.rlike(X.pinned(rf"\b{word}\b")) | t.rlike(X.pinned(rf"\b{word.capitalize()}\b")) | X.any_of(t, contexts))
    return best_tier(chunks, F.when(keep, 1).otherwise(2))


def subject_tiers(chunks: DataFrame, subjects: list[str], later_by: int = 10, later_most: int = 20) -> DataFrame:
    """Adds `tier` and keeps the tiers: 1 all subjects, 2 the first, 3 any, 4 up to `later_most` chunks much later than the median year; all chunks if
    none has a tier. The median is the upper one of all years of all chunks."""
    if not subjects:
        return chunks.withColumn("tier", F.lit(1))
    low = F.lower("text")
    has = [F.contains(low, F.lit(s.lower())) for s in subjects]
    both, any_of = has[0], has[0]
    for h in has[1:]:
        both, any_of = both & h, any_of | h
    mentioned = chunks.select(F.explode(X.years(F.col("text"))).alias("y"))
    median = upper_median(mentioned, "y").select("median").scalar()
    latest = F.coalesce(F.array_max(X.years(F.col("text"))), F.lit(0))
    tier = F.when(both, 1).when(has[0], 2).when(any_of, 3).when(latest > F.coalesce(median, F.lit(9999)) + later_by, 4)
    tagged = chunks.withColumn("tier", tier)
    rank = F.row_number().over(Window.partitionBy("tier").orderBy("ord"))
    late = tagged.where("tier = 4").withColumn("_r", rank).where(F.col("_r") <= later_most).drop("_r")
    kept = tagged.where("tier < 4").unionByName(late)
    n = tagged.agg(F.count("tier").alias("n")).select("n").scalar()
    return kept.unionByName(tagged.where("tier IS NULL").where(n == 0))


def upper_median(rows: DataFrame, column: str) -> DataFrame:
    """(median): the value at place n div 2 of the sorted values, counted by value so that nothing is collected; null without values."""
    counts = rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("t")).select("t").scalar()
    # one row per distinct value, here per year
    running = counts.withColumn("upto", F.sum("n").over(Window.orderBy(column)))
    return running.where(F.col("upto") > F.floor(total / 2)).agg(F.min(column).alias("median"))


def reduce_comma_mentions(chunks: DataFrame, term: str, most: int = 100, from_chunks: int = 0) -> DataFrame:
    """Chunks that name the term only in a list of names keep the sentences with it and the one after the first, at most `most` words; adds `reduced`.

    A set of fewer than `from_chunks` chunks stays as it is.
    """
    t, low, e = F.col("text"), F.lower("text"), re.escape(term.lower())
    in_list = low.rlike(X.pinned(rf",\s+{e}(?:,|\s+and|\s*$)")) | low.rlike(X.pinned(rf"^{e},\s+"))
    subject = low.rlike(X.pinned(rf"(?m)^[^.]*\b{e}\b")) | low.rlike(X.pinned(rf"\b{e}\s+(?:{'|'.join(L.SUBJECT_VERBS)})")) | low.rlike(rf"<italic>{e}") | low.rlike(X.pinned(rf"\b{e}\s+(?:{'|'.join(L.SUBJECT_NOUNS)})"))

    def has(x: Column) -> Column:
        return F.contains(F.lower(x), F.lit(term.lower()))

    def relevant(s: Column) -> Column:
        first = F.array_position(F.transform(s, has), F.lit(True))
        # the sentence after the first mention gives the context, if the term is not in it anyway
        return X.let(first, lambda n: F.when(n > 0, F.filter(s, lambda x, i: has(x) | (i == n))).otherwise(s))

    short = X.first_words(F.array_join(X.let(X.sentences(t), relevant), " "), most)
    reduce = F.contains(low, F.lit(term.lower())) & in_list & ~subject
    if from_chunks:
        reduce = reduce & (chunks.agg(F.count(F.lit(1)).alias("n")).select("n").scalar() >= from_chunks)
    return chunks.withColumn("reduced", F.coalesce(reduce, F.lit(False))).withColumn("text", F.when(F.col("reduced"), short).otherwise(t))


def first_sentences(chunks: DataFrame, *scope: str) -> DataFrame:
    """(scope, chunk_id, ord, sent, sentence): every sentence at its first place in the order of (ord, sent), the comparison trimmed and without case.

    Found by aggregation and not by a window, so that a sentence that a third of all chunks repeat is combined inside the map tasks.
    """
    rows = chunks.select(*scope, "chunk_id", "ord", F.posexplode(X.sentences(F.col("text"))).alias("sent", "sentence"))
    key = F.lower(X.strip(F.col("sentence")))
    place = F.struct("ord", "sent", "chunk_id", "sentence")
    first = rows.where(key != "").groupBy(*scope, key.alias("_k")).agg(F.min(place).alias("p"))
    return first.select(*scope, "p.chunk_id", "p.ord", "p.sent", "p.sentence")


def deduplicated(chunks: DataFrame, *scope: str) -> DataFrame:
    """(scope, chunk_id, ord, text): chunks with only the sentences that no earlier chunk of the scope has; chunks left empty are gone."""
    kept = first_sentences(chunks, *scope)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("sent", "sentence"))), lambda s: s.sentence)
    return kept.groupBy(*scope, "chunk_id", "ord").agg(F.array_join(ordered, " ").alias("text"))


def _repeated(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, ord, sent, k, n) of the sentences that stand in more than one place, k being a hash of 128 bits of what they say and n their words, and
    (chunk_id, own, words, again): how many sentences and words each chunk has alone, and which of its sentences stand elsewhere too.

    Most sentences stand in one place, and belong to every term of their chunk: only the others have to be compared for each term.
    """
    # the sentences of a text that is not blank are trimmed and not empty
    cut = chunks.where(~X.is_blank(F.col("text"))).select("chunk_id", "ord", F.posexplode(X.sentences(F.col("text"))).alias("sent", "s"))
    cut = stored(cut.select("chunk_id", "ord", "sent", F.unhex(F.md5(F.lower("s"))).alias("k"), X.word_count(F.col("s")).alias("n")), "sentences")
    several = cut.groupBy("k").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("k", F.lit(True).alias("_r"))
    marked = stored(cut.join(several, "k", "left"), "marked")
    each = marked.groupBy("chunk_id").agg(F.count_if(F.col("_r").isNull()).alias("own"), F.coalesce(F.sum(F.when(F.col("_r").isNull(), F.col("n"))), F.lit(0)).alias("words"), F.collect_list(F.when(F.col("_r"), F.col("sent"))).alias("again"))
    return marked.where("_r").drop("_r"), each


def term_texts(post: DataFrame, chunks: DataFrame, least: int = 25) -> DataFrame:
    """(term, n_chunks, n_sentences, n_words): for every term of at least `least` chunks its text without repeated sentences, measured.

    The text itself is in `term_passages`.
    """
    pairs = post.select("term", "chunk_id").distinct()
    wanted = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("n_chunks")).where(F.col("n_chunks") >= least)
    repeated, each = _repeated(chunks)
    chosen = pairs.join(wanted.select("term"), "term")
    alone = chosen.join(each.select("chunk_id", "own", "words"), "chunk_id").groupBy("term").agg(F.sum("own").alias("n_sentences"), F.sum("words").alias("n_words"))
    once = chosen.join(repeated.select("chunk_id", "k", "n"), "chunk_id").groupBy("term", "k").agg(F.max("n").alias("n")).groupBy("term").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum("n").alias("n_words"))
    both = alone.union(once).groupBy("term").agg(F.sum("n_sentences").alias("n_sentences"), F.sum("n_words").alias("n_words")).where("n_sentences > 0")
    return wanted.join(both, "term")


def term_passages(post: DataFrame, chunks: DataFrame, least: int = 25) -> DataFrame:
    """(term, chunk_id, ord, text): `deduplicated(..., "term")` for every term of at least `least` chunks.

    Of the sentences that stand in several places the places travel, and not the sentences: the text is put together where each chunk meets the places it
    keeps for a term.
    """
    pairs = post.select("term", "chunk_id").distinct()
    wanted = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("term")
    repeated, each = _repeated(chunks)
    chosen = pairs.join(wanted, "term")
    first = chosen.join(repeated.drop("n"), "chunk_id").groupBy("term", "k").agg(F.min(F.struct("ord", "sent", "chunk_id")).alias("p"))
    kept = first.groupBy("term", "p.chunk_id").agg(F.collect_list("p.sent").alias("kept"))
    cut = chunks.where(~X.is_blank(F.col("text"))).select("chunk_id", "ord", X.sentences(F.col("text")).alias("parts"))
    parts = cut.join(each.select("chunk_id", "again"), "chunk_id")
    nothing = F.array().cast("array<int>")
    dropped = F.array_except("again", F.coalesce("kept", nothing))
    stays = F.when(F.size("dropped") == 0, F.col("parts")).otherwise(F.filter("parts", lambda x, i: ~F.array_contains("dropped", i)))
    made = chosen.join(kept, ["term", "chunk_id"], "left").join(parts, "chunk_id").withColumn("dropped", dropped).select("term", "chunk_id", "ord", stays.alias("parts"))
    return made.where(F.size("parts") > 0).select("term", "chunk_id", "ord", F.array_join("parts", " ").alias("text"))


def joined_texts(passages: DataFrame) -> DataFrame:
    """(term, text): the passages of each term in their order, as one text."""
    # concat_ws measures before it allocates; array_join doubles its buffer as it goes
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id", "text"))), lambda p: p.text)
    return passages.groupBy("term").agg(F.concat_ws(" ", ordered).alias("text"))


def term_text(chunks: DataFrame) -> DataFrame:
    """(term, text): `deduplicated(..., "term")` of the chunks (term, chunk_id, ord, text) of one term, joined in their order. No row where no chunk has a text.

    Of the sentences only hashes and places travel. The row is as long as the text, and whoever writes it copies it several times: it goes to a task of its
    own, so that the parts from which it was made and the copies of its writer are never held together.
    """
    cut = chunks.where(~X.is_blank(F.col("text"))).select("term", "chunk_id", "ord", X.sentences(F.col("text")).alias("parts"))
    keys = F.transform("parts", lambda s: F.unhex(F.md5(F.lower(s))))
    first = cut.select("chunk_id", "ord", F.posexplode(keys).alias("sent", "k")).groupBy("k").agg(F.min(F.struct("ord", "sent", "chunk_id")).alias("p"))
    kept = first.groupBy("p.chunk_id").agg(F.array_sort(F.collect_list("p.sent")).alias("kept"))
    text = F.concat_ws(" ", F.transform("kept", lambda i: F.get("parts", i)))
    return joined_texts(cut.join(kept, "chunk_id").select("term", "chunk_id", "ord", text.alias("text"))).repartition(1)


def by_year(chunks: DataFrame) -> DataFrame:
    """Chunks by their first year, undated ones last, else in their order; adds `year`."""
    return chunks.withColumn("year", X.first_year(F.col("text"))).orderBy(F.coalesce("year", F.lit(1_000_000_000)), "ord")


def stratified(chunks: DataFrame, per_decade: int = 5, total: int = 60) -> DataFrame:
    """At most `per_decade` chunks of each decade of first years, in their order, and `total` of them all; adds `decade`."""
    dated = chunks.withColumn("decade", X.decade(X.first_year(F.col("text"))))
    ranked = dated.withColumn("_r", F.row_number().over(Window.partitionBy("decade").orderBy("ord")))
    return ranked.where(F.col("_r") <= per_decade).drop("_r").orderBy("ord").limit(total)


def regions(chunks: DataFrame, rules: list[tuple[str, str]] = L.REGIONS) -> DataFrame:
    """Adds `region`: the first whose pattern matches."""
    return chunks.withColumn("region", X.first_match(F.col("text"), list(rules), L.OTHER_REGION))


def periods(chunks: DataFrame, rules: list[tuple[str, str]] = L.PERIODS) -> DataFrame:
    """Adds `period`: the last whose pattern matches."""
    return chunks.withColumn("period", X.last_match(F.col("text"), list(rules), L.UNDATED))


def period_sample(chunks: DataFrame, phrases: list[str], terms: list[str], cap: int, rules: list[tuple[str, str]] = L.PERIODS, modern: int = 15, older: int = 10) -> DataFrame:
    """Per period up to `cap` chunks on the subject, in order; of a period without any, the first `modern` (20th, 21st century) or `older` chunks.

    A phrase in capitals counts as a whole word, others as substrings; where no phrase is given, the terms count.
    """
    t, low = F.col("text"), F.lower("text")
    match = F.lit(not phrases and not terms)
    for p in phrases:
        match = match | (t.rlike(X.pinned(rf"\b{re.escape(p)}\b")) if p.isupper() else F.contains(low, F.lit(p.lower())))
    for x in [] if phrases else terms:
        match = match | F.contains(low, F.lit(x.lower()))
    marked = periods(chunks, rules).withColumn("_m", match.cast("int"))
    some = marked.groupBy("period").agg(F.max("_m").alias("_any"))
    joined = marked.join(F.broadcast(some), "period").where(F.col("_m") == F.col("_any"))  # as many rows as periods
    most = F.when(F.col("_any") == 1, cap).when(F.col("period").isin("20th century", "21st century"), modern).otherwise(older)
    ranked = joined.withColumn("_r", F.row_number().over(Window.partitionBy("period").orderBy("ord")))
    return ranked.where(F.col("_r") <= most).drop("_m", "_any", "_r")


def batches(rows: DataFrame, size: int, *order: str, partitions: str | None = None) -> DataFrame:
    """Adds `batch`: consecutive groups of `size` rows, per value of `partitions` where one is named, else over all rows.

    The places come from the offsets of ranges, so that no task sees all rows, nor all of one value.
    """
    numbered = placed_within(rows, partitions, *order) if partitions else placed(rows, *order)
    return numbered.withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def placed_within(rows: DataFrame, part: str, *order: str) -> DataFrame:
    """Adds `place`, the row's number from 0 among the rows of its value of `part`, in the order of `order`: its place among all rows less that of the first."""
    numbered = placed(rows, part, *order)
    # partially aggregated: a row per value and task
    starts = numbered.groupBy(part).agg(F.min("place").alias("_start"))
    same = numbered[part].eqNullSafe(starts[part])
    return numbered.join(starts, same).drop(starts[part]).withColumn("place", F.col("place") - F.col("_start")).drop("_start")


#: Rows of a range in which `placed` sorts.
PLACED = 1 << 18


def placed(rows: DataFrame, *order: str, one_sort: int = 4096) -> DataFrame:
    """Adds `place`, the row's number from 0 in the total order of `order`: position in its range plus the rows of the ranges before.

    Ranges are cut on the whole order, at rows drawn by their hash, about one for `PLACED` rows: however the first order column is distributed, no
    range grows with the table, and no row reaches the driver. Rows are read several times, and so are stored first. A row finds its range in two steps, among coarse cuts and then among the finer ones
    behind one of them. Rows of the same order may come in any order. Up to `one_sort` rows are simply sorted.
    """
    rows = stored(rows, "placed")
    n = rows.agg(F.count(F.lit(1)).alias("n")).first().n
    if n <= one_sort:
        return rows.withColumn("place", (F.row_number().over(Window.orderBy(*order)) - 1).cast("bigint"))
    ranges = max(width(rows.sparkSession), -(-n // PLACED))
    # 16 draws a range even out its size; ranges times 16 rows in one sort
    drawn = rows.select(F.struct(*order).alias("k")).where(F.pmod(F.xxhash64("k"), F.lit(max(1, n // (16 * ranges)))) == 0)
    tiles = drawn.distinct().withColumn("_t", F.ntile(ranges).over(Window.orderBy("k"))).groupBy("_t").agg(F.min("k").alias("k"))
    step = max(1, int(ranges**0.5))
    lists = tiles.groupBy(F.floor((F.col("_t") - 1) / step).alias("_l")).agg(F.array_sort(F.collect_list("k")).alias("fine"))
    cuts = lists.agg(F.array_sort(F.collect_list(F.struct("_l", "fine"))).alias("c")).select(F.transform("c", lambda x: x.fine).alias("c")).scalar()
    here = F.struct(*order)
    # the number of the list that may hold the row, and its place in it; rows before the first cut belong to the first range
    at = rows.withColumn("_cuts", cuts).withColumn("_l", F.greatest(F.size(F.filter("_cuts", lambda f: F.get(f, F.lit(0)) <= here)) - 1, F.lit(0)))
    tagged = at.withColumn("_b", F.struct("_l", F.size(F.filter(F.get("_cuts", F.col("_l")), lambda k: k <= here)).alias("i"))).drop("_l", "_cuts")
    counts = tagged.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # as many rows as ranges
    before = counts.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order)) - 1
    return tagged.join(F.broadcast(before), "_b").withColumn("place", F.col("_before") + inside).drop("_b", "_before")


def token_batch_size(limit: int = 200_000, reserve: int = 2_000, chunk_words: int = 400) -> int:
    """Chunks that fit a request of `limit` tokens: 380 with the defaults."""
    return int((limit - reserve) / (chunk_words * 1.3))


def adaptive_batch(n: int) -> tuple[int, int]:
    """(chunks per batch, seconds between batches) for so many chunks."""
    return (20, 1) if n < 50 else (15, 2) if n < 200 else (10, 3)


def context(chunks: DataFrame, kind: str = "passages", *scope: str) -> DataFrame:
    """(scope, n, context): the chunks (ord, filename, text) in order as one text.

    passages: `Found n relevant passages:` and `[filename]` before each; prompt: `[Source i: filename]` with rules between; chunks: `--- CHUNK i ---`.
    A context is as long as its chunks together: it is meant for a set already limited.
    """
    items = F.array_sort(F.collect_list(F.struct("ord", F.coalesce("filename", F.lit("Unknown")).alias("filename"), "text")))
    grouped = chunks.groupBy(*scope).agg(items.alias("i"))
    shapes = {
        "passages": F.concat(F.lit("Found "), F.size("i").cast("string"), F.lit(" relevant passages:\n\n"), F.array_join(F.transform("i", lambda s: F.concat(F.lit("["), s.filename, F.lit("]\n"), s.text)), "\n\n")),
        "prompt": F.array_join(F.transform("i", lambda s, k: F.concat(F.lit("[Source "), (k + 1).cast("string"), F.lit(": "), s.filename, F.lit("]\n"), s.text, F.lit("\n"))), "\n---\n"),
        "chunks": F.array_join(F.transform("i", lambda s, k: F.concat(F.lit("--- CHUNK "), (k + 1).cast("string"), F.lit(" ---\n"), s.text)), "\n\n"),
        "sections": F.array_join(F.transform("i", lambda s, k: F.concat(F.lit("=== Section "), (k + 1).cast("string"), F.lit(" ===\n"), s.text)), "\n\n"),
    }
    return grouped.select(*scope, F.size("i").alias("n"), shapes[kind].alias("context"))


def contexts(chunks: DataFrame, kind: str, grp: str, size: int | None = None, by_year: bool = False) -> DataFrame:
    """(grp, batch, n, context): the chunks (chunk_id, ord, filename, text), each id once, of each group as texts of at most `size` chunks (what fits a request), in order,
    or by their first year. With `passages` the first text of a group tells how many there are in all; later ones go on without it.

    The places of the chunks come from `placed`, so that no task sees a whole group.
    """
    rows = chunks.withColumn("_y", F.coalesce(X.first_year(F.col("text")), F.lit(1_000_000_000))) if by_year else chunks.withColumn("_y", F.lit(0))
    sizes = rows.groupBy(grp).agg(F.count(F.lit(1)).alias("_all"), F.min("_y").alias("_first"))
    # the places of ids alone; texts meet them afterwards
    numbered = placed(rows.select(grp, "_y", "ord", "chunk_id"), grp, "_y", "ord", "chunk_id", one_sort=1 << 16)
    # as many rows as groups: regions, periods, or one
    starts = numbered.groupBy(grp).agg(F.min("place").alias("_start"))
    joined = rows.join(numbered.select("chunk_id", "place"), "chunk_id").join(F.broadcast(starts), grp).withColumn("batch", F.floor((F.col("place") - F.col("_start")) / (size or token_batch_size())))
    made = context(joined.withColumn("ord", F.struct("_y", "ord", "chunk_id")), kind, grp, "batch")
    if kind == "passages":
        made = made.join(F.broadcast(sizes.select(grp, "_all")), grp)
        body = F.regexp_replace("context", r"^Found \d+ relevant passages:\n\n", "")
        made = made.withColumn("context", F.when(F.col("batch") == 0, F.concat(F.lit("Found "), F.col("_all").cast("string"), F.lit(" relevant passages:\n\n"), body)).otherwise(body))
    return made.select(grp, "batch", "n", "context")


def year_span(chunks: DataFrame) -> DataFrame:
    """(first_year, last_year, span) over all years of the set; nulls where there is none."""
    rows = chunks.select(X.years(F.col("text")).alias("y"))
    return rows.agg(F.min(F.array_min("y")).alias("first_year"), F.max(F.array_max("y")).alias("last_year")).withColumn("span", F.col("last_year") - F.col("first_year"))


def late_era(chunks: DataFrame, cutoff: int | None = None, more_than: int = 10) -> DataFrame:
    """(late): the set spans more than `more_than` years, or reaches the cutoff."""
    reaches = F.col("last_year") >= F.lit(cutoff) if cutoff is not None else F.lit(False)
    return year_span(chunks).select(F.coalesce((F.col("span") > more_than) | reaches, F.lit(False)).alias("late"))


def has_crisis(chunks: DataFrame, words: list[str] = L.CRISIS_TERMS) -> DataFrame:
    """(crisis): any chunk of the set speaks of one."""
    return chunks.agg(F.coalesce(F.bool_or(X.any_of(F.col("text"), words)), F.lit(False)).alias("crisis"))


def top_terms(post: DataFrame, ids: DataFrame, most: int = 8) -> DataFrame:
    """(term, df, rank): of the terms of these chunks those with the longest posting lists, then the last by name: what related questions are made of."""
    present = post.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("term").distinct()
    sizes = post.join(present, "term", "left_semi").groupBy("term").agg(F.count_distinct("chunk_id").alias("df"))
    top = sizes.orderBy(F.desc("df"), F.desc("term")).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), F.desc("term"))))
