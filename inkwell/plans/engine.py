"""The engine: builds and keeps the tables of a collection, searches them and answers questions as one lazy plan per question."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell import lexicons as L
from inkwell.functions import text as X
from inkwell.operators import chunking, extract, folds, index, postprocess, retrieve, review
from inkwell.plans import narrate
from inkwell.plans import question as Q
from inkwell.runtime import exists, spread, stored
from inkwell.sources import writers

#: Fixed values of the pipeline: chunks of a question of control before augmentation, chunks from which listed names are cut down, chunks below which
#: endnotes are added.
CONTROL_CHUNKS, REDUCE_FROM, SPARSE = 8, 20, 10


def extractors() -> dict[str, Callable[[Column], Column]]:
    """Every extractor that needs the text only, by name, as a column of terms; add to the dictionary to extend an index."""
    return {"surname": extract.surnames_of, "middle": extract.middle_names_of, "firm": extract.firms_of, "law": extract.law_terms_of, "panic": extract.panic_terms_of}


def mentions(chunks: DataFrame, which: dict[str, Callable[[Column], Column]] | None = None, lexicon: list[str] = (), definitions: DataFrame | None = None) -> DataFrame:
    """(term, chunk_id) of all extractors and of the patterns of a lexicon in one pass, and of the acronyms of `definitions` where given."""
    which = dict(which or extractors())
    if lexicon:
        which["lexicon"] = lambda text: extract.lexicon_of(text, list(lexicon))
    out = extract.mentions(chunks, which)
    if definitions is not None:
        out = out.unionByName(extract.acronym_tokens(chunks, definitions)).unionByName(extract.acronym_names(chunks, definitions))
    return out


@dataclass
class Engine:
    #: (chunk_id, ord, filename, text)
    chunks: DataFrame
    #: (term, chunk_id, tf), of a stored index also term_key and ord
    postings: DataFrame
    identities: list[str] = field(default_factory=list)
    generator: narrate.Generator = narrate.passages
    hierarchy: dict[str, list[str]] = field(default_factory=dict)
    #: (entity, other, weight, rank), (old_name, new_name), (endnote_id, text), (chunk_id, endnote_id), (term, text); each may be missing
    links: DataFrame | None = None
    changes: DataFrame | None = None
    endnotes: DataFrame | None = None
    chunk_endnotes: DataFrame | None = None
    texts: DataFrame | None = None

    #: The tables beside chunks and postings.
    MORE = ("links", "changes", "endnotes", "chunk_endnotes", "texts")

    @classmethod
    def build(
        cls, docs: DataFrame, groups: dict[str, list[str]] | None = None, identities: list[str] = (), hierarchy: dict[str, list[str]] | None = None,
        which: dict | None = None, lexicon: list[str] = (), acronyms: dict[str, str] | None = L.ACRONYMS, least: int = 2,
    ) -> Engine:
        """Chunks documents (doc_id, filename, text), extracts terms, and merges those of a group or hierarchy. `save` keeps the result.

        Chunks are cut once and stored in the shared folder; extraction is one pass over them, and acronyms, found in the texts or given, are two
        more (`acronyms=None` leaves them out). Terms of fewer than `least` mentions go, but for acronyms and the spellings of groups.
        """
        made = chunking.chunk(spread(docs.select("doc_id", F.coalesce("filename", F.lit("Unknown")).alias("filename"), "text")), keep=("filename",))
        made = stored(made.select("chunk_id", F.struct("doc_id", "pos").alias("ord"), "filename", "text"), "chunks")
        definitions = stored(extract.acronym_definitions(made, acronyms).coalesce(1), "acronyms") if acronyms is not None else None
        post = index.postings(mentions(made, which, lexicon, definitions))
        if least > 1:
            spared = [x.lower() for c, vs in (groups or {}).items() for v in (c, *vs) for x in (v, v.replace(" ", "_"))]
            post = index.of_frequent(post, least, definitions, spared)
        if groups:
            post = index.merge_groups(post, groups)
        if hierarchy:
            post = index.with_parents(post, hierarchy)
        return cls(made, post, list(identities), hierarchy=dict(hierarchy or {}))

    def save(self, folder: str) -> None:
        """Write the tables: postings sorted by term, chunks by id, so that `open` gives an engine whose lookups read little."""
        known = set(self.postings.columns)
        post = self.postings if "ord" in known else self.postings.join(self.chunks.select("chunk_id", "ord"), "chunk_id", "left")
        writers.write_index(post, f"{folder}/postings")
        writers.write_store(self.chunks, f"{folder}/chunks")
        for name in self.MORE:
            if (rows := getattr(self, name)) is not None:
                rows.write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, **options) -> Engine:
        """The engine of tables that `save` wrote; nothing is read but their schemas."""
        found = {name: spark.read.parquet(f"{folder}/{name}") for name in cls.MORE if exists(spark, f"{folder}/{name}")}
        return cls(spark.read.parquet(f"{folder}/chunks"), spark.read.parquet(f"{folder}/postings"), **found, **options)

    def stats(self) -> DataFrame:
        """(total_chunks, indexed_terms, entity_associations) in one row."""
        chunks = self.chunks.agg(F.count_distinct("chunk_id").alias("n")).select("n").scalar()
        links = (self.links if self.links is not None else index.cooccurrence(self.postings)).agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
        return self.postings.agg(F.count_distinct("term").alias("indexed_terms")).select(chunks.alias("total_chunks"), "indexed_terms", links.alias("entity_associations"))

    def search(self, term: str, most: int | None = 10) -> DataFrame:
        return retrieve.search(self.postings, self.chunks, term, most, ("ord",))

    search_family = search

    def expanded_search(self, terms: list[str]) -> DataFrame:
        """(chunk_id) of the terms, of the names they were changed from or to, and of their associations."""
        spark = self.postings.sparkSession
        changes = self.changes if self.changes is not None else spark.createDataFrame([], "old_name string, new_name string")
        links = self.links if self.links is not None else spark.createDataFrame([], "entity string, other string, weight bigint, rank int")
        return retrieve.expanded_search(self.postings, terms, changes, links)

    def retrieve(self, text: str, flat: bool = False) -> DataFrame:
        """(chunk_id) for a question: phrases that are indexed decide; else all anchors that are indexed together; else, unless a firm is asked for, any.

        A question of control keeps its first few chunks. Others that no phrase decides gain chunks of crises of the subject, and later chunks of the
        subject than any found where it has several anchors. Very few chunks gain those of other names.
        """
        p, post = Q.plan(text, flat, self.identities, self.hierarchy), self.postings
        others = [n for phrase, names in L.ALIASES.items() if phrase in text.lower() for n in names]
        # which spellings of the question are indexed: one lookup, so that the plan has only what can give rows
        known = retrieve.present(post, [*p.phrases, *p.keywords, *p.subjects, *others, *L.CRISIS_TERMS, *(t for g in p.groups for t in g)])

        def indexed(terms: list[str]) -> list[str]:
            return [t for t in terms if t.lower() in known]

        phrases, groups, subjects, crises = indexed(p.phrases), [g for g in map(indexed, p.groups) if g], indexed(p.subjects), indexed(L.CRISIS_TERMS)
        if phrases:
            found = retrieve.union(post, phrases)
            if mistaken := indexed(p.mistaken):
                found = retrieve.difference(found, retrieve.union(post, mistaken))
        elif len(groups) > 1:
            every = retrieve.intersection(post, groups)
            found = every if p.firm else retrieve.tiered(every, retrieve.union(post, [t for g in groups for t in g]))
        else:
            found = retrieve.union(post, groups[0] if groups else indexed(p.keywords))
        if p.control:
            found = found.orderBy("chunk_id").limit(CONTROL_CHUNKS)
        elif not phrases and subjects:
            if crises:
                found = retrieve.with_crises(found, post, subjects, crises)
            if len(groups) > 1:
                found = retrieve.augmented_later(found, post, self.chunks, subjects)
        return retrieve.with_aliases(found, post, text, L.ALIASES) if indexed(others) else found

    def endnotes_for(self, ids: DataFrame) -> DataFrame:
        """(chunk_id, filename, text): the endnotes of few chunks, as passages of their own."""
        if self.endnotes is None or self.chunk_endnotes is None:
            return self.chunks.select("chunk_id", "filename", "text").limit(0)
        notes = retrieve.with_endnotes(ids, self.chunk_endnotes, self.endnotes, SPARSE).groupBy("endnote_id").agg(F.min("text").alias("text"))
        return notes.select(F.concat(F.lit("endnote_"), "endnote_id").alias("chunk_id"), F.lit("Endnotes").alias("filename"), "text")

    def found(self, text: str) -> DataFrame:
        """(chunk_id, ord, filename, text): the chunks of a question after the filters of its kind, and after them the endnotes of a sparse result.

        `ord` is (late, ord, chunk_id), late being true of endnotes.
        """
        ids = self.retrieve(text)
        chunks = retrieve.lookup(self.chunks, ids).select("chunk_id", "ord", "filename", "text")
        if Q.is_ideology(text):
            chunks = postprocess.ideology(chunks, self.identities or ["\x00"])
        if Q.is_identity(text, self.identities):
            chunks = postprocess.finance_only(chunks, L.FINANCE_EXCLUDED, capitalised=L.CAPITALISED)
        kind = self.chunks.schema["ord"].dataType

        def placed(rows: DataFrame, late: bool, place: Column) -> DataFrame:
            return rows.select("chunk_id", F.struct(F.lit(late).alias("late"), place.cast(kind).alias("ord"), F.col("chunk_id").alias("id")).alias("ord"), "filename", "text")

        return placed(chunks, False, F.col("ord")).unionByName(placed(self.endnotes_for(ids), True, F.lit(None)))

    def select(self, text: str) -> DataFrame:
        """(chunk_id, ord, filename, text): what an answer is made from: a prepared text of the subject where there is one, else the chunks found, of which
        those that only list the subject are cut down, without the sentences that earlier chunks have."""
        found = self.found(text)
        if term := Q.primary_term(text):
            found = postprocess.reduce_comma_mentions(found, term, from_chunks=REDUCE_FROM).drop("reduced")
        chosen = postprocess.deduplicated(found).join(found.select("chunk_id", "filename"), "chunk_id").select("chunk_id", "ord", "filename", "text")
        if self.texts is None:
            return chosen
        made = retrieve.prepared(self.texts, Q.text_candidates(text))
        pieces = folds.packed(made, key="term").withColumn("chunk_id", F.concat_ws("_", "term", "piece"))
        place = F.struct(F.lit(False).alias("late"), F.lit(None).cast(self.chunks.schema["ord"].dataType).alias("ord"), F.format_string("%06d", "piece").alias("id"))
        none = made.agg(F.count(F.lit(1)).alias("n")).select("n").scalar() == 0
        return chosen.where(none).unionByName(pieces.select("chunk_id", place.alias("ord"), F.col("term").alias("filename"), "text"))

    def ask(self, text: str, use_llm: bool = False, strategies: list[Q.Strategy] = Q.STRATEGIES) -> DataFrame:
        """(grp, batch, n, context) for a question, in contexts of a bounded number of chunks.

        Without a language model: the passages found, as they are. With one: the chunks chosen, grouped as the strategy of the question says, and what
        the generator makes of their contexts.
        """
        if not use_llm:
            return postprocess.contexts(retrieve.lookup(self.chunks, self.retrieve(text)).withColumn("grp", F.lit("all")), "passages", "grp")
        return self.generator(text, self.contexts(text, strategies))

    def contexts(self, text: str, strategies: list[Q.Strategy] = Q.STRATEGIES) -> DataFrame:
        """(grp, batch, n, context): what the generator is given for a question."""
        chosen = stored(self.select(text), "chosen")
        way = Q.strategy(text, chosen.count(), self.identities, strategies)
        return postprocess.contexts(grouped(chosen, way), "prompt", "grp", by_year=way.chronological)

    def narrative(self, text: str, **options) -> DataFrame:
        """(answer): one text, from the generator's answers to the contexts of a question; see `narrate.narrative`."""
        return narrate.narrative(text, self.contexts(text), self.generator, **options)

    def again(self, text: str, answer: str) -> DataFrame:
        """(grp, batch, n, context) to ask once more with, where an answer stops years before its sources do: the chunks of any subject term of the question,
        or of its first alone if that has more, provided they are more than those found; else no rows."""
        found = self.found(text)
        spark = found.sparkSession
        year = postprocess.year_span(found).select("last_year").scalar()
        early = spark.createDataFrame([(answer,)], "answer string").select(review.stops_early(F.col("answer"), year).alias("e")).select("e").scalar()
        terms = Q.plan(text, identities=self.identities).subjects
        ids = retrieve.union(self.postings, terms)
        n, m = (d.agg(F.count(F.lit(1)).alias("n")).select("n").scalar() for d in (found, ids))
        wide = retrieve.lookup(self.chunks, ids).where(early & (m > n)).withColumn("grp", F.lit("all"))
        return postprocess.contexts(wide, "prompt", "grp")

    def related_questions(self, text: str) -> list[str]:
        """Up to five questions on the terms of the chunks found with the longest posting lists; general ones where these are fewer than three."""
        rows = postprocess.top_terms(self.postings, self.retrieve(text)).orderBy("rank").collect()
        shown = [f"{r.term.upper()} ({L.ACRONYMS[r.term.upper()]})" if r.term.upper() in L.ACRONYMS else r.term.title() for r in rows]
        asked = [L.RELATED.format(s) for s in shown][:5]
        return [*asked, *(L.RELATED_FILLERS if len(asked) < 3 else [])][:5]


def grouped(chunks: DataFrame, way: Q.Strategy) -> DataFrame:
    """Chunks with the group (grp) that a strategy puts them into, limited as it says."""
    if way.per_decade:
        chunks = postprocess.stratified(chunks, way.per_decade, way.most or 1 << 30).drop("decade")
    elif way.most:
        chunks = chunks.orderBy("ord", "chunk_id").limit(way.most)
    if way.by == "region":
        return postprocess.regions(chunks).withColumnRenamed("region", "grp")
    if way.by == "period":
        return postprocess.periods(chunks).withColumnRenamed("period", "grp")
    return chunks.withColumn("grp", F.lit("all"))


def polished(answer: str, related: list[str]) -> str:
    """An answer with a note where it has fewer than three paragraphs, and with related questions where it asks none."""
    paragraphs = [p for p in re.split(r"\n\s*\n", answer.strip()) if p.strip()]
    if len(paragraphs) < 3:
        answer = answer.strip() + L.CONTEXT_NOTE
    last = answer.split("\n")[-30:]
    if "related questions" not in answer.lower() and sum("?" in x for x in last) < 3:
        answer += "\n\nRelated Questions:\n" + "\n".join(f"* {q}" for q in related)
    return answer


def limited(answers: DataFrame, most: int = 3) -> DataFrame:
    """Answers (answer_id, answer) with their paragraphs held to `most` sentences: the repair that a failed review calls for."""
    return answers.withColumn("answer", X.limited_paragraphs(F.col("answer"), most))


def repaired(answers: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """(answer_id, answer, ask_again): one turn of the loop of review and repair.

    An answer whose paragraphs are too long is regrouped; one that fails any other check, after that, is marked to be asked for again.
    """
    fixed = answers.select("answer_id", F.when(review.too_long(F.col("answer"), most), X.limited_paragraphs(F.col("answer"), most)).otherwise(F.col("answer")).alias("answer"))
    failed = review.review(fixed, sources).where("NOT passed").select("answer_id").distinct().withColumn("_f", F.lit(True))
    return fixed.join(failed, "answer_id", "left").select("answer_id", "answer", F.coalesce("_f", F.lit(False)).alias("ask_again"))
