"""Column functions on text. All are built-in expressions: they stay in the JVM and inside code generation where Spark allows it.

A null text gives null, or an empty array where an array is returned, unless a docstring says otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.lexicons import YEAR

_MARK = "\u0001"

# White space and word edges as the regular expressions of this library mean them, whatever the version of the JVM.
S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BEGIN, END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"


def pinned(pattern: str) -> str:
    """A pattern whose \\b and \\s mean Unicode words and white space on every JVM. Flags at its beginning are no group."""
    flags = re.match(r"(?:\(\?[a-z]+\))?", pattern)[0]
    return flags + pattern[len(flags) :].replace(r"\b(", BEGIN + "(").replace(r")\b", ")" + END).replace(r"\b", _EDGE).replace(r"\s", S)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often and however deep in lambdas the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(w: Column, *sizes: int) -> Column:
    """All runs of so many neighbouring words of an array, joined by blanks."""

    def of(ws: Column, n: int) -> Column:
        return F.when(F.size(ws) >= n, F.transform(F.sequence(F.lit(0), F.size(ws) - n), lambda i: F.array_join(F.slice(ws, i + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))

    return let(w, lambda ws: F.flatten(F.array(*[of(ws, n) for n in sizes])))


def words(text: Column) -> Column:
    """The runs of characters between white space; the array is empty for blank and null texts."""
    return F.coalesce(F.filter(F.split(text, S + "+"), lambda x: x != ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def windows(text: Column, size: int = 400, overlap: int = 100) -> Column:
    """Overlapping word windows: one from every (size - overlap)-th word on, also where the last lies inside the one before it."""
    size, overlap = size or 400, 100 if overlap is None else overlap
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " "))

    return let(words(text), cut)


def sentences(text: Column) -> Column:
    """Sentences with their marks: cut after runs of .!? before white space, trimmed, without empty ones."""
    parts = F.split(F.regexp_replace(text, rf"([.!?]+){S}+", f"$1{_MARK}"), _MARK)
    kept = let(F.filter(F.transform(parts, strip), lambda x: x != ""), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(text)))
    return F.when(text.isNotNull(), kept).otherwise(F.array().cast("array<string>"))


def strip(text: Column) -> Column:
    """Without white space at either end (`trim` takes only blanks)."""
    return F.regexp_replace(text, rf"^{S}+|{S}+$", "")


def is_blank(text: Column) -> Column:
    """No character but white space, or none at all; a null text is blank."""
    return F.coalesce(~text.rlike("[^" + S[1:]), F.lit(True))


def shingles(text: Column, size: int = 5) -> Column:
    """The whole text and every run of `size` words, each once."""
    return F.array_distinct(F.concat(F.array(text), ngrams(words(text), size)))


def subphrases(sentence: Column, least: int = 5, most: int | None = None) -> Column:
    """All runs of `least` words or more of a sentence, lower-cased, each once; with `most`, of no more than so many words.

    Without `most` a sentence of n words has about n²/2 runs.
    """

    def of(w: Column) -> Column:
        longest = F.size(w) if most is None else F.least(F.size(w), F.lit(most))
        runs = F.transform(F.sequence(F.lit(least), longest), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " ")))
        return F.when(longest >= least, F.array_distinct(F.flatten(runs))).otherwise(F.array().cast("array<string>"))

    return let(words(F.lower(sentence)), of)


def strip_tags(text: Column, to: str = " ") -> Column:
    """Markup replaced, by a blank unless told otherwise; null becomes an empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", to)


def canonical(term: Column) -> Column:
    """A term without a possessive ending and straight apostrophes, trimmed; its case and a plural s stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(term, r"(?i)('s|’s)$", ""), "'", ""))


def underscored(term: Column) -> Column:
    return F.translate(term, " ", "_")


def spaced(term: Column) -> Column:
    return F.translate(term, "_", " ")


def capitalized(term: Column) -> Column:
    return F.concat(F.upper(F.substring(term, 1, 1)), F.lower(F.substring(term, 2, 1 << 30)))


def titled(term: Column) -> Column:
    """Every run of letters with its first letter in upper case and the others in lower case: after any character that is no letter a new one begins."""
    runs = F.regexp_extract_all(term, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, capitalized), "")


def plural_toggled(term: Column) -> Column:
    """Without its last s where it has one and more than two letters, else with one."""
    return F.when(term.endswith("s") & (F.length(term) > 2), F.substring(term, F.lit(1), F.length(term) - 1)).otherwise(F.concat(term, F.lit("s")))


def spellings(term: Column) -> Column:
    """A term as typed, in lower case, capitalised, and with its plural toggled."""
    return F.array_distinct(F.array(term, F.lower(term), capitalized(term), plural_toggled(F.lower(term))))


def token_estimate(words_total: Column) -> Column:
    """Tokens of so many words: 1.3 for each, the sum cut to a whole number."""
    return F.floor(words_total * F.lit(1.3)).cast("bigint")


def preview(text: Column, size: int = 100) -> Column:
    return F.substring(text, 1, size)


def truncated(text: Column, most: int = 15000) -> Column:
    """A text of more than `most` characters is cut there and marked."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n[Truncated]"))).otherwise(text)


def first_words(text: Column, most: int = 100) -> Column:
    """The first `most` words and an ellipsis of a longer text, else the text as it is."""
    return let(words(text), lambda w: F.when(F.size(w) > most, F.concat(F.array_join(F.slice(w, 1, most), " "), F.lit("..."))).otherwise(text))


def years(text: Column) -> Column:
    """All years from 1600 to 2029, in order, repeats included."""
    return F.coalesce(F.transform(F.regexp_extract_all(text, F.lit(pinned(YEAR)), F.lit(1)), lambda y: y.cast("int")), F.array().cast("array<int>"))


def first_year(text: Column) -> Column:
    """The first year, or null."""
    return F.nullif(F.regexp_extract(text, pinned(YEAR), 1), F.lit("")).cast("int")


def decade(year: Column) -> Column:
    return F.coalesce((F.floor(year / 10) * 10).cast("string"), F.lit("unknown"))


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines, trimmed, without empty ones."""
    return F.coalesce(F.filter(F.transform(F.split(strip(text), rf"\n{S}*\n"), strip), lambda x: x != ""), F.array().cast("array<string>"))


def is_header(paragraph: Column) -> Column:
    return paragraph.startswith("**") & ~paragraph.contains("\n")


def sentence_count(text: Column) -> Column:
    """Sentences as a reviewer counts them: parts before a capital; where there is one part only, the runs of .!?, and at least one."""
    parts = F.size(F.filter(F.transform(F.split(text, rf"[.!?]+{S}+(?=[A-Z])"), strip), lambda x: x != ""))
    marks = F.size(F.regexp_extract_all(text, F.lit(r"[^.!?]*[.!?]+"), F.lit(0)))
    return F.greatest(F.when(parts == 1, marks).otherwise(parts), F.lit(1))


def limited_paragraphs(text: Column, most: int = 3) -> Column:
    """The text with no paragraph of more than `most` sentences; headers stay, and a paragraph without a final mark gets a full stop.

    A sentence ends at .!? before white space and a capital, as those of the reviewer do; the rest is regrouped, `most` to a paragraph.
    """

    def regrouped(p: Column) -> Column:
        marked = F.regexp_replace(p, rf"([.!?]){S}+(?=\p{{Lu}})", f"$1{_MARK}")
        parts = F.filter(F.transform(F.split(marked, _MARK), strip), lambda x: x != "")
        groups = let(parts, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(most)), lambda i: F.array_join(F.slice(s, i + 1, F.lit(most)), " ")))
        return F.transform(groups, lambda g: F.when(g.rlike(r"[.!?]$"), g).otherwise(F.concat(g, F.lit("."))))

    fixed = F.flatten(F.transform(paragraphs(text), lambda p: F.when(is_header(p), F.array(p)).otherwise(regrouped(p))))
    joined = F.array_join(fixed, "\n\n")
    return F.when(joined != "", joined).otherwise(text)


def has_related_questions(text: Column) -> Column:
    """The phrase itself, or three lines with a question mark among the last thirty."""
    lines = F.split(text, "\n")
    last = F.slice(lines, F.greatest(F.size(lines) - 29, F.lit(1)), F.lit(30))
    return F.lower(text).contains("related questions") | (F.size(F.filter(last, lambda x: x.contains("?"))) >= 3)


def any_of(text: Column, terms: list[str]) -> Column:
    """Any of the terms as a substring of the lower-cased text: one alternation, compiled once."""
    return F.lower(text).rlike("|".join(re.escape(t).replace(r"\ ", " ") for t in terms)) if terms else F.lit(False)


def any_word(text: Column, terms: list[str]) -> Column:
    """Any of the terms as whole words, without regard to case."""
    return text.rlike(rf"(?i){BEGIN}(?:" + "|".join(re.escape(t).replace(r"\ ", " ") for t in terms) + f"){END}") if terms else F.lit(False)


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule whose pattern matches the lower-cased text."""
    low, out = F.lower(text), None
    for name, pattern in ((n, pinned(p)) for n, p in rules):
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def last_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the last rule whose pattern matches."""
    return first_match(text, list(reversed(rules)), otherwise)


def json_block(text: Column, schema: str) -> Column:
    """The JSON of a reply, inside a fence or bare, parsed; null where it does not parse."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(text), schema)


def law_codes(text: Column, prefixes: list[str]) -> Column:
    """Law codes such as BA1933, as written; the longest prefix is tried first."""
    ordered = "|".join(sorted(prefixes, key=lambda p: (-len(p), p)))
    return F.coalesce(F.regexp_extract_all(text, F.lit(rf"{BEGIN}((?:{ordered})\d{{4}}){END}"), F.lit(1)), F.array().cast("array<string>"))


def short_law_codes(text: Column, prefixes: list[str]) -> Column:
    """Codes with a two-digit year stand for both centuries: BA33 gives BA1833 and BA1933."""
    ordered = "|".join(sorted(prefixes, key=lambda p: (-len(p), p)))
    found = F.regexp_extract_all(text, F.lit(rf"{BEGIN}((?:{ordered})\d{{2}}){END}"), F.lit(1))
    both = F.transform(found, lambda c: F.array(F.regexp_replace(c, r"(\d{2})$", "18$1"), F.regexp_replace(c, r"(\d{2})$", "19$1")))
    return F.coalesce(F.array_distinct(F.flatten(both)), F.array().cast("array<string>"))


def in_context(text: Column, phrase: str, around: int = 80) -> Column:
    """Every occurrence of a phrase with `around` characters on either side, where there are so many."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(rf"(?is).{{{around}}}{re.escape(phrase)}.{{{around}}}"), F.lit(0)), F.array().cast("array<string>"))
