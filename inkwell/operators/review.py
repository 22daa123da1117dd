"""Rule-based review of answers, as columns over a table of them: nothing is collected, a million answers are reviewed like one.

Input: answers (answer_id, answer); for the checks against sources also the chunks of each answer (answer_id, text). Output of every check:
(answer_id, criterion, passed, score, details, issues).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell import lexicons as L
from inkwell.functions import text as X
from inkwell.runtime import steady

# Fixed values, here and in the checks below: the names of the criteria and the wordings of details and issues, by which results are compared.
RESULT = ("answer_id", "criterion", "passed", "score", "details", "issues")


def _result(rows: DataFrame, criterion: str, passed: Column, score: Column, details: Column, issues: Column) -> DataFrame:
    return rows.select("answer_id", F.lit(criterion).alias("criterion"), passed.alias("passed"), score.cast("double").alias("score"), details.alias("details"), issues.alias("issues"))


def _text(n: Column) -> Column:
    return n.cast("string")


def _list(*parts: Column) -> Column:
    """The parts that are not null."""
    return F.array_compact(F.array(*parts))


def paragraph_length(answers: DataFrame, most: int = 3) -> DataFrame:
    """No paragraph but a header has more than `most` sentences. The score falls by half the share of those that do; five are named."""
    paras = F.transform(X.paragraphs(F.col("answer")), lambda p, i: F.struct((i + 1).alias("i"), p.alias("p"), X.sentence_count(p).alias("n")))
    body = answers.select("answer_id", F.filter(paras, lambda s: ~X.is_header(s.p)).alias("b"))
    rows = body.select("answer_id", F.size("b").alias("total"), F.filter("b", lambda s: s.n > most).alias("long"))
    n = F.size("long")
    issues = F.slice(F.transform("long", lambda s: F.concat(F.lit("Paragraph "), _text(s.i), F.lit(" has "), _text(s.n), F.lit(f" sentences (max {most})"))), 1, 5)
    details = F.when(n == 0, F.concat(F.lit("All "), _text(F.col("total")), F.lit(f" paragraphs are ≤{most} sentences"))).otherwise(F.concat(_text(n), F.lit("/"), _text(F.col("total")), F.lit(f" paragraphs exceed {most} sentences")))
    score = F.greatest(F.lit(0.0), F.lit(1.0) - n / F.greatest(F.col("total"), F.lit(1)) * 0.5)
    return _result(rows, "paragraph_length", n == 0, score, details, issues)


def chronological_flow(answers: DataFrame, jump: int = 10, paragraph_jump: int = 20) -> DataFrame:
    """Years do not fall back: no year stands before one more than `jump` years earlier, and no paragraph's first year before that of the next by more than
    `paragraph_jump`. Distinct pairs of years count once; the pairs are made within the array of one answer."""
    rows = answers.select("answer_id", X.years(F.col("answer")).alias("y"), F.filter(F.transform(F.filter(X.paragraphs(F.col("answer")), lambda p: ~X.is_header(p)), lambda p: F.array_min(X.years(p))), lambda y: y.isNotNull()).alias("p"))
    falls = F.array_distinct(F.flatten(F.transform("y", lambda a, i: F.transform(F.filter(F.slice("y", i + 2, F.size("y")), lambda b: a - b > jump), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    after = F.transform("p", lambda a, i: F.struct(i.alias("i"), a.alias("a"), F.get("p", i + 1).alias("b")))
    rows = rows.withColumn("f", falls).withColumn("n", F.filter(after, lambda s: s.a - s.b > paragraph_jump))
    jumps = F.transform("f", lambda s: F.concat(F.lit("Year "), _text(s.a), F.lit(" mentioned after "), _text(s.b), F.lit(" (backwards jump of "), _text(s.a - s.b), F.lit(" years)")))
    order = F.transform("n", lambda s: F.concat(F.lit("Paragraph "), _text(s.i + 1), F.lit(" ("), _text(s.a), F.lit(") comes before paragraph "), _text(s.i + 2), F.lit(" ("), _text(s.b), F.lit(") - non-chronological organization")))
    few = F.size("y") < 2
    issues = F.when(few, F.array().cast("array<string>")).otherwise(F.concat(jumps, F.slice(order, 1, 3)))
    ok = F.size(issues) == 0
    score = F.when(ok, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - F.size("f") / F.greatest(F.size("y"), F.lit(1)) * 0.3 - F.size("n") * 0.2))
    bad = F.concat(_text(F.size("f")), F.lit(" backwards chronological jumps detected"), F.when(F.size("n") > 0, F.concat(F.lit(", "), _text(F.size("n")), F.lit(" non-chronological paragraphs"))).otherwise(F.lit("")))
    details = F.when(few, F.lit("Insufficient years to check chronological flow")).when(ok, F.concat(F.lit("Chronological flow maintained across "), _text(F.size("y")), F.lit(" year mentions"))).otherwise(bad)
    return _result(rows, "chronological_flow", ok, score, details, F.slice(issues, 1, 5))


def source_years(sources: DataFrame) -> DataFrame:
    """(answer_id, first_year, last_year) of the chunks of each answer; nulls where they have no years."""
    y = X.years(F.col("text"))
    return sources.groupBy("answer_id").agg(F.min(F.array_min(y)).alias("first_year"), F.max(F.array_max(y)).alias("last_year"))


def full_history(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """The answer covers the years of its sources: no more than 20 years short of the last, not starting over 50 after the first, no era left out."""
    rows = answers.select("answer_id", X.years(F.col("answer")).alias("y")).join(source_years(sources).withColumn("known", F.lit(True)), "answer_id", "left")
    a1, a2, c1, c2 = F.array_min("y"), F.array_max("y"), F.col("first_year"), F.col("last_year")
    gap = c2 - a2
    eras = _list(F.when((c2 >= 1900) & (a2 < 1900), "20th century"), F.when((c2 >= 2000) & (a2 < 2000), "21st century"), F.when((c2 >= 1800) & (a1 > 1800), "18th century"))
    issues = _list(
        F.when(gap > 20, F.concat(F.lit("Answer stops at "), _text(a2), F.lit(", but chunks go to "), _text(c2), F.lit(" (gap: "), _text(gap), F.lit(" years)"))),
        F.when(a1 > c1 + 50, F.concat(F.lit("Answer starts at "), _text(a1), F.lit(", but chunks start at "), _text(c1), F.lit(" (missing early period)"))),
        F.when(F.size(eras) > 0, F.concat(F.lit("Missing eras: "), F.array_join(eras, ", "))),
    )
    none, empty = F.col("known").isNull(), c1.isNull()
    bare = F.size("y") == 0
    issues = F.when(none | empty, F.array().cast("array<string>")).when(bare, F.array(F.concat(F.lit("Missing all historical coverage: chunks go to "), _text(c2)))).otherwise(issues)
    ok = F.size(issues) == 0
    score = F.when(ok, 1.0).when(bare, 0.0).when(gap > 0, F.greatest(F.lit(0.0), F.lit(1.0) - gap / 100.0)).otherwise(0.8)
    spans = F.concat(_text(a1), F.lit("-"), _text(a2)), F.concat(_text(c1), F.lit("-"), _text(c2))
    details = (
        F.when(none, F.lit("No chunks provided for comparison")).when(empty, F.lit("No years found in chunks")).when(bare, F.concat(F.lit("Answer has no years, but chunks span "), spans[1]))
        .when(ok, F.concat(F.lit("Full coverage: answer spans "), spans[0], F.lit(", chunks span "), spans[1]))
        .otherwise(F.concat(F.lit("Incomplete coverage: answer "), spans[0], F.lit(", chunks "), spans[1], F.lit(" (gap: "), _text(gap), F.lit(" years)")))
    )
    return _result(rows, "full_history", ok, score, details, issues)


def crises_in(text: Column, words: list[str] = L.CRISIS_WORDS, years: list[str] = L.CRISIS_YEARS) -> Column:
    """Crises of a text: `word year` for a crisis word with a year in the same sentence, and `panic/crisis year` for each year of the list."""
    low = F.lower(text)
    def near(word: str) -> Column:
        pattern = X.pinned(rf"{re.escape(word)}[^.]*?\b(1[6-9]\d{{2}}|20[0-2]\d)\b")
        found = F.coalesce(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), F.array().cast("array<string>"))
        return F.transform(found, lambda y: F.concat(F.lit(word + " "), y))

    fixed = F.array_compact(F.array(*[F.when(text.contains(y), F.lit(f"panic/crisis {y}")) for y in years]))
    return F.array_distinct(F.concat(*map(near, words), fixed))


def panics_coverage(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """The answer mentions, by any of their words, the crises of its sources. The score is the share of those it does; missing ones come in name order."""
    found = sources.select("answer_id", F.explode_outer(crises_in(F.col("text"))).alias("c")).groupBy("answer_id").agg(F.array_sort(F.collect_set("c")).alias("crises"))
    rows = answers.join(found, "answer_id", "left").withColumn("low", F.lower(F.coalesce("answer", F.lit(""))))
    missing = F.filter("crises", lambda c: ~F.exists(F.split(c, " "), lambda w: F.contains(F.col("low"), w)))
    rows = rows.withColumn("m", missing)
    n, k = F.size("crises"), F.size("m")
    none, nothing = F.col("crises").isNull(), n == 0
    ok = none | nothing | (k == 0)
    score = F.when(ok, 1.0).otherwise((n - k) / n)
    details = (
        F.when(none, F.lit("No chunks provided for panic check")).when(nothing, F.lit("No panics/crises found in chunks")).when(k == 0, F.concat(F.lit("All "), _text(n), F.lit(" panics/crises from chunks are mentioned")))
        .otherwise(F.concat(F.lit("Missing "), _text(k), F.lit("/"), _text(n), F.lit(" panics/crises: "), F.array_join(F.slice("m", 1, 3), ", ")))
    )
    issues = F.when(ok, F.array().cast("array<string>")).otherwise(F.transform(F.slice("m", 1, 5), lambda c: F.concat(F.lit("Missing panic/crisis: "), c)))
    return _result(rows, "panics_coverage", ok, score, details, issues)


def review(answers: DataFrame, sources: DataFrame, checks: dict | None = None) -> DataFrame:
    """All checks of all answers, a row each; `checks` maps a name to a function of (answers, sources)."""
    checks = checks or {"paragraph_length": lambda a, s: paragraph_length(a), "chronological_flow": lambda a, s: chronological_flow(a), "full_history": full_history, "panics_coverage": panics_coverage}
    steady(answers.sparkSession)
    out = None
    for check in checks.values():
        rows = check(answers, sources)
        out = rows if out is None else out.unionByName(rows)
    return out


def needs_grounding(answer: Column) -> Column:
    """Too short, fewer than three paragraphs, or a report that nothing was found."""
    a = F.coalesce(answer, F.lit(""))
    return (F.length(a) < 300) | (F.size(X.paragraphs(a)) < 3) | F.lower(a).contains("no relevant information found")


def too_long(answer: Column, most: int = 3) -> Column:
    return F.exists(X.paragraphs(answer), lambda p: ~X.is_header(p) & (X.sentence_count(p) > most))


def stops_early(answer: Column, last_year: Column, gap: int = 10) -> Column:
    """The answer has no year, or its last is more than `gap` years before the last of its sources."""
    latest = F.array_max(X.years(answer))
    return F.coalesce(last_year.isNotNull() & (latest.isNull() | (last_year - latest > gap)), F.lit(False))
