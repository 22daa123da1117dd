"""Terms that a text mentions. Every extractor maps chunks (chunk_id, text) to mentions (term, chunk_id), one row per mention.

Those that need nothing but the text are columns, `..._of(text)`, arrays of terms: any number of them share one pass over the chunks (`mentions`).
They are built-in regular expressions, without a shuffle and without Python. Dictionaries are looked up by `operators.dictionary`, never by a
pattern per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell import lexicons as L
from inkwell.functions import text as X
from inkwell.operators import dictionary

PROPER = rf"{X.BEGIN}[A-Z][a-z]+(?:{X.S}+[A-Z][a-z]+)+{X.END}"
ITALIC = r"(?i)<italic>([^<]+?)</italic>"
_PUNCT_FIRST = r"""^[,.;:!?&\-—–()\[\]{}"'/\\|]"""
_PUNCT_LAST = r"""[,.;:!?&\-—–"'/\\|]$"""


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(X.pinned(pattern)), F.lit(group)), F.array().cast("array<string>"))


def _terms(chunks: DataFrame, terms: Column) -> DataFrame:
    return chunks.select(F.explode(terms).alias("term"), "chunk_id").where("term <> ''")


def mentions(chunks: DataFrame, which: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(term, chunk_id) of all the extractors of `which`, functions of a text, in one pass: their arrays are joined and exploded once."""
    return _terms(chunks, F.concat(*[f(F.col("text")) for f in which.values()]))


def surnames_of(text: Column, generic: list[str] = L.GENERIC_NAME_WORDS) -> Column:
    # words of letters alone: their canonical form is the word itself
    last = F.transform(_found(text, PROPER), lambda n: F.regexp_extract(n, r"[A-Za-z]+$", 0))
    return F.filter(last, lambda s: ~F.lower(s).isin(generic))


def surnames(chunks: DataFrame, generic: list[str] = L.GENERIC_NAME_WORDS) -> DataFrame:
    """The last word of every proper name of two or more capitalised words, unless it is a generic word."""
    return _terms(chunks, surnames_of(F.col("text"), generic))


def middle_names_of(text: Column, generic: list[str] = L.GENERIC_NAME_WORDS) -> Column:
    parts = F.transform(_found(text, PROPER), lambda n: F.split(n, X.S + "+"))
    kept = F.filter(parts, lambda p: (F.size(p) >= 3) & ~F.lower(F.element_at(p, -1)).isin(generic))
    return F.flatten(F.transform(kept, lambda p: F.slice(p, 2, F.size(p) - 2)))


def middle_names(chunks: DataFrame, generic: list[str] = L.GENERIC_NAME_WORDS) -> DataFrame:
    """The words between first and last of every proper name of three or more words whose last word is not generic."""
    return _terms(chunks, middle_names_of(F.col("text"), generic))


def lexicon_of(text: Column, patterns: list[str]) -> Column:
    visible = X.strip_tags(text)
    hits = F.concat(*[_found(visible, "(?i)" + p, 1) for p in patterns]) if patterns else F.array().cast("array<string>")
    return F.flatten(F.transform(hits, lambda t: F.array_distinct(F.array(X.underscored(t), X.spaced(t)))))


def lexicon_terms(chunks: DataFrame, patterns: list[str]) -> DataFrame:
    """Matches of the first group of each pattern in the text without tags, whatever their case, kept as typed; with blanks also underscored."""
    return _terms(chunks, lexicon_of(F.col("text"), patterns))


def firms_of(text: Column, generic: list[str] = L.GENERIC_NAME_WORDS) -> Column:
    visible = X.strip_tags(text)
    name = r"([A-Z][a-z]+)"
    place = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*"
    of_place = [
        _found(text, rf"(?i)<italic>{name}</italic>\s+NB\s+<italic>of</italic>\s+<italic>{place}</italic>", 1),
        _found(text, rf"(?i)<italic>{name}</italic>\s+NB\s+of\s+<italic>{place}</italic>", 1),
        _found(visible, rf"(?i)\b{name}\s+NB\s+of\s+[A-Z][a-z]+", 1),
    ]
    banks = F.flatten(F.transform(F.concat(*of_place), lambda n: F.array(F.concat(X.canonical(n), F.lit(" NB")), F.concat(X.canonical(n), F.lit(" National Bank")))))
    kinds = "NB|IHC|PU|SB|HC|TC"
    pattern = rf"(?i)(<italic>{name}</italic>\s+(?:{kinds}))(?:'s)?(?=\s|[,.]|$)"
    alone = F.transform(_found(text, pattern, 1), lambda m: F.struct(X.canonical(F.regexp_extract(m, rf"(?i)<italic>{name}", 1)).alias("n"), F.upper(F.regexp_extract(m, rf"(?i)({kinds})$", 1)).alias("k")))
    alone = F.flatten(F.transform(alone, lambda s: F.filter(F.array(F.concat_ws(" ", s.n, s.k), F.when(s.k == "NB", F.concat(s.n, F.lit(" National Bank")))), lambda x: x.isNotNull())))
    italic = F.transform(F.filter(F.transform(_found(text, ITALIC, 1), X.strip), lambda f: F.length(f) < 100), X.canonical)
    italic = F.filter(italic, lambda f: (F.length(f) > 1) & ~f.rlike(_PUNCT_FIRST) & ~f.rlike(_PUNCT_LAST) & (f.contains(" ") | ~F.lower(f).isin(generic)))
    expanded = F.filter(F.transform(italic, lambda f: F.when(F.lower(f).rlike(r" nb( |$)"), F.regexp_replace(f, X.pinned(r"(?i)\bNB\b"), "National Bank"))), lambda x: x.isNotNull())
    return F.concat(banks, alone, italic, expanded)


def firms(chunks: DataFrame, generic: list[str] = L.GENERIC_NAME_WORDS) -> DataFrame:
    """Firm names set in italics, and national banks named with NB: `First NB of Boston` gives First NB and First National Bank.

    Fragments that begin or end with punctuation, single characters and single generic words are left out.
    """
    return _terms(chunks, firms_of(F.col("text"), generic))


def acronym_definitions(chunks: DataFrame, fixed: dict[str, str] = L.ACRONYMS) -> DataFrame:
    """(acronym, full_name): definitions found in the text by four patterns, the shortest full name winning, and the fixed ones over all.

    Patterns: ACR (Full Name); Full Name (ACR); ACR, or Full Name; Full Name ("ACR"). Acronyms have 2 to 10 capitals, names 5 to 100 characters.
    Ties go to the alphabetically first name. Acronyms are read with regard to case, so that no word before a bracket becomes one.
    """
    visible = X.strip_tags(F.col("text"))
    quote = "[\"“”‘’«»]"
    acr, full2, full3 = r"[A-Z]{2,10}", r"[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|of|and|&|the))*\s+[A-Z][a-z]+", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"
    shapes = [(rf"\b({acr})\s*\(([^)\"]{{5,50}}?)\)", 1, 2), (rf"\b({full2})\s*\(({acr})\)", 2, 1), (rf"\b({acr})\s*,\s*or\s+({full3})", 1, 2), (rf"\b({full3})\s*\({quote}({acr}){quote}\)", 2, 1)]
    # what a text must have to be worth the pattern, which tries every capitalised word
    signs = [rf"{acr}\s*\(", rf"\({acr}\)", rf"{acr}\s*,\s*or\s", rf"\({quote}{acr}{quote}\)"]
    none = F.array().cast("array<string>")
    found = [[F.when(visible.rlike(X.pinned(sign)), _found(visible, p, g)).otherwise(none) for g in (a, f)] for sign, (p, a, f) in zip(signs, shapes, strict=True)]
    found = F.concat(*[F.arrays_zip(a.alias("acronym"), f.alias("full_name")) for a, f in found])
    pairs = chunks.select(F.explode(found).alias("d")).select(F.col("d.acronym"), X.strip(F.col("d.full_name")).alias("full_name")).where(F.length("full_name").between(5, 100))
    best = pairs.groupBy("acronym").agg(F.min(F.struct(F.length("full_name").alias("n"), "full_name")).alias("b")).select("acronym", F.col("b.full_name"))
    spark = chunks.sparkSession
    known = spark.createDataFrame(list(fixed.items()), "acronym string, full_name string")
    # broadcast: the fixed dictionary
    return best.join(F.broadcast(known), "acronym", "left_anti").unionByName(known)


def acronym_tokens(chunks: DataFrame, definitions: DataFrame) -> DataFrame:
    """Acronyms that stand in a text as a word of that case, once per chunk, with their lower-case alias: a join on the tokens of the text."""
    visible = X.strip_tags(F.col("text"))
    tokens = chunks.select("chunk_id", F.explode(F.array_distinct(_found(visible, r"\b[A-Z][A-Za-z]{1,9}\b"))).alias("acronym"))
    hits = tokens.join(definitions.select("acronym").distinct(), "acronym").distinct()
    return hits.select(F.explode(F.array("acronym", F.lower("acronym"))).alias("term"), "chunk_id")


def acronym_places(chunks: DataFrame, acronyms: list[str], places: list[str] = L.PLACES) -> DataFrame:
    """An acronym before a known place, such as `FRS New York`: one or two capitalised words after a word in capitals, both looked up."""
    # looked at from every word on: the acronym is looked up in a set, and the pattern does not grow with the dictionary
    hits = F.transform(_found(X.strip_tags(F.col("text")), r"\b(?=([A-Za-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b)", 1), lambda t: F.regexp_replace(t, X.S + "+", " "))
    return _terms(chunks, F.filter(hits, lambda t: F.substring_index(t, " ", 1).isin(acronyms) & F.lower(F.regexp_replace(t, r"^\S+ ", "")).isin(places)))


def acronym_names(chunks: DataFrame, definitions: DataFrame) -> DataFrame:
    """Acronyms whose full name a text has, whatever its case, `and` also as `&`; once per chunk, with the lower-case alias.

    Names and texts are compared word by word, without punctuation at the edges of the words.
    """
    name = dictionary.plain_words(F.lower("full_name"))
    wanted = definitions.select("acronym", F.explode(F.array_distinct(F.array(name, F.regexp_replace(name, X.pinned(r"\band\b"), "&")))).alias("key")).where("key <> ''")
    hits = dictionary.hits(chunks.select("chunk_id", F.lower(X.strip_tags(F.col("text"))).alias("text")), wanted.select("key").distinct(), plain=True)
    found = hits.join(wanted, "key").select("acronym", "chunk_id").distinct()
    return found.select(F.explode(F.array("acronym", F.lower("acronym"))).alias("term"), "chunk_id")


def law_terms_of(text: Column, prefixes: dict[str, str] = L.LAW_PREFIXES) -> Column:
    codes = X.law_codes(X.strip_tags(text), list(prefixes))
    phrase = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])

    def aliases(c: Column) -> Column:
        full = F.concat_ws(" ", F.element_at(phrase, F.regexp_extract(c, r"^([A-Z]+)", 1)), F.right(c, F.lit(4)))
        return F.array(c, F.lower(c), full, F.lower(full))

    return F.flatten(F.transform(codes, aliases))


def law_terms(chunks: DataFrame, prefixes: dict[str, str] = L.LAW_PREFIXES) -> DataFrame:
    """Law codes with a four-digit year: the code and its phrase (`BA1933`, `Bankruptcy Act 1933`), each also in lower case."""
    return _terms(chunks, law_terms_of(F.col("text"), prefixes))


def panic_terms_of(text: Column, years: list[int] | None = None) -> Column:
    found = F.array_distinct(_found(X.strip_tags(text, ""), r"\b(?:[Pp]anic|[Cc]risis)\s+of\s+(\d{4})\b", 1))
    if years is not None:
        found = F.filter(found, lambda y: y.isin([str(y) for y in years]))
    return F.flatten(F.transform(found, lambda y: F.array(F.concat(F.lit("panic_of_"), y), F.concat(F.lit("panic of "), y))))


def panic_terms(chunks: DataFrame, years: list[int] | None = None) -> DataFrame:
    """`Panic of 1907` and `crisis of 1907` as `panic_of_1907` and `panic of 1907`, once per chunk; `years` restricts them to a list."""
    return _terms(chunks, panic_terms_of(F.col("text"), years))


def name_changes(chunks: DataFrame) -> DataFrame:
    """(old_name, new_name), lower-cased, of `A changed his name to B` and `A ... formerly B`, unless the chunk speaks of a maiden name.

    A text that has none of the words a pattern needs is not searched by it: without the guard the pattern would try every capitalised word against
    the rest of the text.
    """
    none, low = F.array().cast("array<string>"), F.lower("text")
    guards = [low.rlike("changed|anglicized") & F.contains(low, F.lit("name")), F.contains(F.col("text"), F.lit("formerly"))]
    found = [[F.when(g, _found(F.col("text"), p, i)).otherwise(none) for i in (1, 2)] for g, p in zip(guards, L.NAME_CHANGES, strict=True)]
    pairs = F.concat(*[F.arrays_zip(a.alias("old_name"), b.alias("new_name")) for a, b in found])
    rows = chunks.where(~F.lower("text").rlike("née|nee")).select(F.explode(pairs).alias("p"))
    return rows.select(F.lower("p.old_name").alias("old_name"), F.lower("p.new_name").alias("new_name")).distinct()


def all_words(chunks: DataFrame, least: int = 4) -> DataFrame:
    """Every lower-case word of at least `least` letters, once per mention."""
    return _terms(chunks, _found(F.lower("text"), rf"\b[a-z]{{{least},}}\b"))


def surname_search(chunks: DataFrame, surnames: DataFrame) -> DataFrame:
    r"""(surname, chunk_id): chunks in which `\bname\b` stands, whatever the case.

    Names may have any number of words and any punctuation; where a name begins or ends with punctuation, a word must follow at once on that
    side, as `\b` demands. White space in a name counts as one blank. Null and blank names find nothing, repeated ones count once.
    """
    key = F.regexp_replace(X.strip(F.lower("surname")), X.S + "+", " ")
    wanted = surnames.select("surname", key.alias("key")).where("key <> ''").distinct()
    hits = dictionary.hits(chunks.select("chunk_id", F.lower("text").alias("text")), wanted.select("key").distinct())
    return hits.join(wanted, "key").select("surname", "chunk_id").distinct()


def _scored(label: str, weight: int):
    return lambda n: F.struct(F.lit(label).alias("label"), F.lower(n).alias("name"), F.lit(weight).alias("weight"))


def patterns_found(chunks: DataFrame, patterns: dict[str, list[tuple[str, int]]]) -> DataFrame:
    """(label, name, score): names captured by weighted patterns, weights added up; a substring guard spares the regular expression."""
    parts = []
    for label, shapes in patterns.items():
        for pattern, weight in shapes:
            guarded = F.when(F.lower("text").contains(label.lower()), _found(F.col("text"), pattern, 1)).otherwise(F.array().cast("array<string>"))
            parts.append(F.transform(guarded, _scored(label, weight)))
    rows = chunks.select(F.explode(F.concat(*parts)).alias("p")).select("p.*")
    return rows.groupBy("label", "name").agg(F.sum("weight").alias("score"))


def related(chunks: DataFrame, shapes: list[tuple[str, str, bool]]) -> DataFrame:
    """(a, b, relation, directed): explicit relations captured by patterns (relation, pattern with two groups, directed); undirected ones both ways."""
    def edge(relation: str, directed: bool):
        return lambda e: F.struct(e.a.alias("a"), e.b.alias("b"), F.lit(relation).alias("relation"), F.lit(directed).alias("directed"))

    parts = [F.transform(F.arrays_zip(_found(F.col("text"), p, 1).alias("a"), _found(F.col("text"), p, 2).alias("b")), edge(r, d)) for r, p, d in shapes]
    edges = chunks.select(F.explode(F.concat(*parts)).alias("e")).select("e.*")
    back = edges.where("NOT directed").select(F.col("b").alias("a"), F.col("a").alias("b"), "relation", "directed")
    return edges.union(back).distinct()


def terms_present(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, chunk_id): index terms that occur in the text word for word, whatever the case."""
    return surname_search(chunks, terms.select(F.col("term").alias("surname"))).withColumnRenamed("surname", "term")


def disambiguated(mentions: DataFrame, chunks: DataFrame, term: str, contexts: list[tuple[str, list[str]]]) -> DataFrame:
    """Mentions in which an ambiguous term is replaced by the first name of `contexts` one of whose words its chunk has; without any it is dropped."""
    named = None
    for name, words in contexts:
        hit = X.any_of(F.col("text"), words)
        named = F.when(hit, name) if named is None else named.when(hit, name)
    own = F.lower("term") == term.lower()
    read = mentions.where(own).join(chunks.select("chunk_id", "text"), "chunk_id").select(named.alias("term"), "chunk_id").where("term IS NOT NULL")
    return mentions.where(~own).select("term", "chunk_id").unionByName(read)
