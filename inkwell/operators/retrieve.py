"""Boolean retrieval over postings (term, chunk_id) as set algebra on tables. Terms of a question are few and live on the driver; postings never do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions import text as X

NO_CHUNKS = "chunk_id string"


def key_of(post: DataFrame) -> Column:
    """The lower-cased term: a stored index has it as a column, by which it is sorted, so that a filter on it prunes files and row groups."""
    return F.col("term_key") if "term_key" in post.columns else F.lower("term")


def of_terms(post: DataFrame, terms: list[str]) -> DataFrame:
    """Postings of the terms, matched without regard to case."""
    return post.where(key_of(post).isin(sorted({t.lower() for t in terms})))


def present(post: DataFrame, terms: list[str]) -> set[str]:
    """Which of the terms are indexed, in lower case; as many rows as a question has spellings."""
    return {r[0] for r in of_terms(post, terms).select(key_of(post).alias("k")).distinct().collect()}


def union(post: DataFrame, terms: list[str]) -> DataFrame:
    """(chunk_id) of chunks with any of the terms."""
    return of_terms(post, terms).select("chunk_id").distinct()


def served(post: DataFrame, groups: list[list[str]]) -> DataFrame:
    """(chunk_id, g): the groups of terms that each chunk serves, by number, each once."""
    wanted = [sorted({t.lower() for t in g}) for g in groups]
    if not wanted:
        return post.select("chunk_id", F.lit(0).alias("g")).limit(0)
    key = key_of(post)
    numbers = F.array_compact(F.array(*[F.when(key.isin(g), F.lit(i)) for i, g in enumerate(wanted)]))
    return of_terms(post, [t for g in wanted for t in g]).select("chunk_id", F.explode(numbers).alias("g")).distinct()


def intersection(post: DataFrame, groups: list[list[str]]) -> DataFrame:
    """(chunk_id) of chunks with a term of every group: any within a group, all across groups. No groups give no chunks.

    One pass: each posting is tagged with the groups it serves, and a chunk must serve all of them.
    """
    return served(post, groups).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(groups)).select("chunk_id")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Chunks of the first set that the second lacks."""
    return left.join(right.select("chunk_id").distinct(), "chunk_id", "left_anti")


def overlap(post: DataFrame, first: list[str], second: list[str]) -> DataFrame:
    """(first, second, both): sizes of two unions of posting lists and of their intersection."""
    a, b = (F.max(key_of(post).isin([t.lower() for t in ts]).cast("int")) for ts in (first, second))
    marked = of_terms(post, first + second).groupBy("chunk_id").agg(a.alias("a"), b.alias("b"))
    return marked.agg(F.count_if(F.col("a") == 1).alias("first"), F.count_if(F.col("b") == 1).alias("second"), F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("both"))


def tiered(*tiers: DataFrame) -> DataFrame:
    """The first tier that has rows: each tier is tagged with its rank, and the least rank present wins. Empty tiers give no rows."""
    ranked = None
    for rank, t in enumerate(tiers):
        tagged = t.select("chunk_id", F.lit(rank).alias("_rank"))
        ranked = tagged if ranked is None else ranked.union(tagged)
    best = ranked.agg(F.min("_rank").alias("m")).select("m").scalar()
    return ranked.where(F.col("_rank") == best).select("chunk_id").distinct()


def lookup(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks with the given ids; ids without a chunk are dropped, repeated ids count once."""
    return chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def searched(term: str) -> str:
    """A term as it is looked up: without a possessive ending and apostrophes."""
    key = term.strip()
    return (key[:-2] if key.lower().endswith(("'s", "’s")) else key).replace("'", "")


def search(post: DataFrame, chunks: DataFrame, term: str, most: int | None = None, order: tuple[str, ...] = ("chunk_id",)) -> DataFrame:
    """Chunks of one term, canonical and without regard to case, in a fixed order; `most` limits them.

    Where the postings have the order columns, as those of a stored index do, the first `most` ids are read from the postings alone and the chunks
    are fetched by id: two pruned scans, whatever the size of the store.
    """
    if most is not None and set(order) <= set(post.columns):
        # an id without a place has no chunk
        first = of_terms(post, [searched(term)]).select(*dict.fromkeys(["chunk_id", *order])).dropna(subset=list(order)).distinct().orderBy(*order).limit(most)
        # at most `most` ids
        ids = [r.chunk_id for r in first.collect()]
        return chunks.where(F.col("chunk_id").isin(ids)).orderBy(*order)
    found = lookup(chunks, union(post, [searched(term)])).orderBy(*order)
    return found.limit(most) if most is not None else found


def with_crises(ids: DataFrame, post: DataFrame, subjects: list[str], crisis: list[str], most: int = 20) -> DataFrame:
    """The ids and, if there are any, the first `most` chunks that have both a term of crisis and one of the subjects."""
    n = ids.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    extra = intersection(post, [subjects, crisis]).orderBy("chunk_id").limit(most) if subjects else ids.select("chunk_id").limit(0)
    return ids.select("chunk_id").union(extra.where(n > 0)).distinct()


def augmented_crisis(ids: DataFrame, post: DataFrame, chunks: DataFrame, subjects: list[str], crisis: list[str], most: int = 20) -> DataFrame:
    """The ids and up to `most` chunks of the subjects that speak of a crisis."""
    extra = lookup(chunks, union(post, subjects)).where(X.any_of(F.col("text"), crisis)).select("chunk_id")
    return ids.select("chunk_id").union(difference(extra, ids).orderBy("chunk_id").limit(most)).distinct()


def augmented_later(ids: DataFrame, post: DataFrame, chunks: DataFrame, subjects: list[str]) -> DataFrame:
    """The ids and all chunks of the subjects whose latest year is later than any year of the chunks found."""
    latest = lookup(chunks, ids).agg(F.coalesce(F.max(F.array_max(X.years(F.col("text")))), F.lit(0)).alias("y")).select("y").scalar()
    later = lookup(chunks, difference(union(post, subjects), ids)).where(F.array_max(X.years(F.col("text"))) > latest).select("chunk_id")
    return ids.select("chunk_id").union(later).distinct()


def with_aliases(ids: DataFrame, post: DataFrame, question: str, aliases: dict[str, list[str]], fewer_than: int = 3) -> DataFrame:
    """The ids, and where there are fewer than `fewer_than` also the chunks of other names of what the question speaks of."""
    low = question.lower()
    others = list(dict.fromkeys(a for phrase, names in aliases.items() if phrase in low for a in names))
    if not others:
        return ids.select("chunk_id")
    n = ids.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return ids.select("chunk_id").union(union(post, others).where(n < fewer_than)).distinct()


def with_endnotes(ids: DataFrame, chunk_endnotes: DataFrame, endnotes: DataFrame, fewer_than: int = 10) -> DataFrame:
    """(chunk_id, endnote_id, text): endnotes of the chunks found, where these are fewer than `fewer_than`."""
    n = ids.agg(F.count_distinct("chunk_id").alias("n")).select("n").scalar()
    return ids.select("chunk_id").distinct().where(n < fewer_than).join(chunk_endnotes, "chunk_id").join(endnotes, "endnote_id").select("chunk_id", "endnote_id", "text")


def endnote_search(endnotes: DataFrame, term: str, most: int = 20) -> DataFrame:
    """Endnotes with a term as a substring, whatever the case, by id."""
    return endnotes.where(F.contains(F.lower("text"), F.lit(term.lower()))).orderBy("endnote_id").limit(most)


def expanded_search(post: DataFrame, terms: list[str], changes: DataFrame, links: DataFrame, top: int = 5) -> DataFrame:
    """(chunk_id) of chunks with a term, a name it was changed from or to, or one of its `top` associations.

    changes: (old_name, new_name); links: (entity, other, rank).
    """
    low = [t.lower() for t in terms]
    renamed = changes.where(F.lower("old_name").isin(low)).select(F.lower("new_name").alias("t")).union(changes.where(F.lower("new_name").isin(low)).select(F.lower("old_name").alias("t")))
    near = links.where(F.lower("entity").isin(low) & (F.col("rank") <= top)).select(F.lower("other").alias("t"))
    more = post.withColumn("t", key_of(post)).join(renamed.union(near).distinct(), "t", "left_semi").select("chunk_id")
    return union(post, terms).union(more).distinct()


def proximity(post: DataFrame, chunks: DataFrame, first: str, second: str) -> DataFrame:
    """(chunk_id, phrase, reversed_phrase, same_line) of chunks with both terms: as a phrase, in reverse, on one line."""
    import re

    a, b = re.escape(first.lower()), re.escape(second.lower())
    found = lookup(chunks, intersection(post, [[first], [second]]))
    low = F.lower("text")
    return found.select(
        "chunk_id",
        low.rlike(X.pinned(rf"\b{a}\s+{b}\b")).alias("phrase"),
        low.rlike(X.pinned(rf"\b{b}\s+{a}\b")).alias("reversed_phrase"),
        F.exists(F.split(low, "\n"), lambda x: x.contains(first.lower()) & x.contains(second.lower())).alias("same_line"),
    )


def filing_rank(candidates: list[str]) -> Column:
    """The place of a term among what a text may be filed under: each candidate as typed, in lower case, capitalised, in title case; null for other terms."""
    order: dict[str, int] = {}
    for c in candidates:
        for v in (c, c.lower(), c.capitalize(), c.title()):
            order.setdefault(v, len(order))
    if not order:
        return F.lit(None).cast("int")
    return F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("term"))


def prepared(texts: DataFrame, candidates: list[str]) -> DataFrame:
    """(term, text) of the first candidate that has a prepared text, by `filing_rank`."""
    rank = filing_rank(candidates)
    best = texts.where(rank.isNotNull()).agg(F.min_by(F.struct("term", "text"), rank).alias("b")).where("b IS NOT NULL")
    return best.select("b.term", "b.text")
