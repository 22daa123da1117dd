"""Reading a question, which is one row and stays on the driver: tokens, anchors, phrases, intentions and the route of the answer."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from inkwell import lexicons as L


def canonical(term: str) -> str:
    return re.sub(r"('s|’s)$", "", term, flags=re.I).replace("'", "").strip()


def tokens(question: str) -> list[str]:
    return re.findall(r"[A-Za-z']+", question)


def keywords(question: str) -> list[str]:
    """Canonical lower-case words of more than three letters that are no stop words, each once, in order."""
    kept = [canonical(t.lower()) for t in tokens(question) if t.lower() not in L.STOP_WORDS and len(t) > 3]
    return list(dict.fromkeys(k for k in kept if k))


def variants(term: str) -> list[str]:
    low = term.lower()
    plural = low[:-1] if low.endswith("s") and len(low) > 2 else low + "s"
    return list(dict.fromkeys([term, low, low.capitalize(), plural]))


def law_tokens(question: str) -> list[list[str]]:
    """For each law code of the question the spellings of its postings."""
    prefixes = "|".join(sorted(L.LAW_PREFIXES, key=lambda p: (-len(p), p)))
    out = []
    for prefix, year in dict.fromkeys(re.findall(rf"\b({prefixes})(\d{{4}})\b", question, re.I)):
        code, phrase = f"{prefix.upper()}{year}", f"{L.LAW_PREFIXES[prefix.upper()]} {year}"
        out.append([code, code.lower(), phrase, phrase.lower()])
    return out


def expanded(text: str, acronyms: dict[str, str] = L.ACRONYMS) -> str:
    """The text with the first mention of each acronym followed by what it stands for, unless the text says it already; law codes likewise."""
    for acronym, full in acronyms.items():
        if full.lower() not in text.lower():
            text = re.sub(rf"\b{re.escape(acronym)}\b", lambda m, full=full: f"{m[0]} ({full})", text, count=1)
    for prefix, full in L.LAW_PREFIXES.items():
        text = re.sub(rf"\b{prefix}_?(\d{{4}})\b(?! \()", lambda m, full=full: f"{m[0]} ({full} {m[1]})", text)
    return text


def short_law_tokens(question: str) -> list[list[str]]:
    """For each law code with a two-digit year the spellings of the postings of both centuries it may mean: BA33 is BA1833 or BA1933."""
    prefixes = "|".join(sorted(L.LAW_PREFIXES, key=lambda p: (-len(p), p)))
    found = dict.fromkeys((p.upper(), y) for p, y in re.findall(rf"\b({prefixes})_?(\d{{2}})\b", question, re.I))
    return [[x for century in ("18", "19") for x in law_tokens(f"{p}{century}{y}")[0]] for p, y in found]


def acronyms(question: str) -> list[str]:
    """Words of two letters or more in capitals, each once; a single capital is a pronoun or an initial, and letters before a year are a law code's."""
    return list(dict.fromkeys(re.findall(r"(?<!\w)[A-Z]{2,}(?!\w)", question)))


def primary_term(question: str) -> str | None:
    """The word that a question is mostly about: the first of what follows `tell me about`, else its first meaningful word."""
    low = question.lower().strip()
    words = low.split("tell me about", 1)[1].split() if "tell me about" in low else [w for w in low.split() if w not in L.STOP_WORDS and len(w) > 2]
    return words[0].strip("?.!,") or None if words else None


def subject(question: str) -> str:
    """What the question is about: after `tell me about`, `what is`, `who was`, `explain`, `describe`, else all of it, without final marks."""
    q = question.strip().rstrip("?.!").strip()
    for pattern in (r"tell me about\s+(.+)", r"(?:what|who)\s+(?:is|are|was|were)\s+(.+)", r"(?:explain|describe)\s+(.+)"):
        if m := re.search(pattern, q, re.I):
            return m[1].strip()
    return q


def subject_terms(question: str) -> list[str]:
    return [k for k in keywords(question) if k not in L.GENERIC_SUBJECTS]


def subject_phrases(question: str) -> list[str]:
    """Spellings to look for as they stand: the words of the subject terms, acronyms with their expansion, and what is in brackets."""
    out = [t for k in subject_terms(question) for t in tokens(question) if canonical(t.lower()) == k]
    for t in [*tokens(question), *(p.strip() for p in re.findall(r"\(([^)]+)\)", question))]:
        if t.isupper() and len(t) >= 3:
            out += [t, *([L.ACRONYMS[t].lower()] if t in L.ACRONYMS else [])]
        elif " " in t:
            out.append(t.lower())
            if " and " in t.lower():
                out.append(t.lower().replace(" and ", " & "))
    return list(dict.fromkeys(out))


def windows(question: str) -> list[str]:
    """Phrases of three, four and two neighbouring meaningful words: candidates for firm names."""
    w = [t for t in tokens(question) if t.lower() not in L.STOP_WORDS]
    found = [" ".join(w[i : i + n]) for n in (3, 4, 2) for i in range(len(w) - n + 1)]
    return list(dict.fromkeys(found))


def text_candidates(question: str) -> list[str]:
    """What a prepared text may be filed under: the subject, its first word, its other number, and single, double and triple meaningful words."""
    about = subject(question).lower()
    w = [t.lower() for t in tokens(question) if t.lower() not in L.STOP_WORDS and len(t) > 2]
    other = about[:-1] if about.endswith("s") else about + "s"
    runs = ["_".join(w[i : i + n]) for n in (2, 3) for i in range(len(w) - n + 1)]
    return list(dict.fromkeys(x for x in [about, *about.split()[:1], other, " ".join(about.split()[:3]), *w, *runs] if x))


def bank_forms(phrase: str) -> list[str]:
    """A phrase and its forms with `NB` and `National Bank`."""
    return list(dict.fromkeys([phrase, re.sub(r"(?i)\bnational bank\b", "NB", phrase), re.sub(r"(?i)\bnb\b", "National Bank", phrase)]))


def has_any(question: str, words: list[str]) -> bool:
    low = question.lower()
    return any(w in low for w in words)


def is_event(question: str) -> bool:
    return has_any(question, L.EVENT_WORDS) or bool(re.search(L.YEAR, question))


def is_identity(question: str, identities: list[str]) -> bool:
    return has_any(question, identities)


def is_control(question: str, identities: list[str]) -> bool:
    return has_any(question, L.CONTROL_WORDS) and is_identity(question, identities)


def is_market(question: str) -> bool:
    return has_any(question, L.MARKET_WORDS)


def is_ideology(question: str) -> bool:
    return has_any(question, L.IDEOLOGY_WORDS)


def is_firm(question: str) -> bool:
    low = question.lower().rstrip("?.! ")
    return "national bank" in low or " nb of " in low or low.endswith(" nb")


@dataclass(frozen=True)
class Strategy:
    """A way to group chunks for the answer, taken for the questions, numbers of chunks and identities that `fits` accepts."""

    name: str
    fits: Callable[[str, int, list[str]], bool]
    #: How chunks are grouped: all together, or by region or period; by year first; limited to so many, or so many a decade.
    by: str = "all"
    chronological: bool = False
    most: int | None = None
    per_decade: int | None = None


#: The strategies in the order in which they are tried; put your own before them, or in their place.
STRATEGIES = [
    Strategy("market", lambda q, n, ids: is_market(q), "region", chronological=True),
    Strategy("control", lambda q, n, ids: is_control(q, ids), most=5),
    Strategy("ideology", lambda q, n, ids: is_ideology(q), chronological=True, per_decade=5, most=60),
    Strategy("sec", lambda q, n, ids: "SEC" in tokens(q)),
    Strategy("region", lambda q, n, ids: n > 100 and is_event(q), "region"),
    Strategy("period", lambda q, n, ids: n > 20, "period"),
    Strategy("single", lambda q, n, ids: True),
]


def strategy(question: str, n_chunks: int, identities: list[str], among: list[Strategy] = STRATEGIES) -> Strategy:
    """How the chunks are grouped for the answer: by the kind of question, then by their number (over 100, over 20, fewer)."""
    return next(s for s in among if s.fits(question, n_chunks, identities))


def route(question: str, n_chunks: int, identities: list[str]) -> str:
    return strategy(question, n_chunks, identities).name


@dataclass
class Plan:
    question: str
    #: Groups of spellings: any within a group, all across the groups that are indexed.
    groups: list[list[str]] = field(default_factory=list)
    #: Phrases that, where indexed, decide alone.
    phrases: list[str] = field(default_factory=list)
    #: Of these the ones that mean another firm than the question does.
    mistaken: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    #: What the subject is called, for augmentation.
    subjects: list[str] = field(default_factory=list)
    firm: bool = False
    control: bool = False


def plan(question: str, flat: bool = False, identities: list[str] = (), hierarchy: dict[str, list[str]] | None = None) -> Plan:
    """Anchors of a question: its acronyms and law codes if it has any, else its keywords without the generic ones.

    `flat` makes every spelling a group of its own, so that spellings narrow each other instead of widening the net. A `hierarchy` (parent: children)
    widens a keyword by its children where the question has more than two meaningful words or an acronym.
    """
    caps, keys = acronyms(question), keywords(question)
    meaningful = subject_terms(question)
    wide = hierarchy if hierarchy and (len(meaningful) > 2 or caps) else {}
    laws = law_tokens(question) + short_law_tokens(question)
    named = [list(dict.fromkeys(v for t in [k, *wide.get(k, [])] for v in variants(t))) for k in meaningful]
    groups = [[a] for a in caps] + laws or named
    if flat:
        groups = [[v] for g in groups for v in g]
    about = canonical(subject(question))
    whole = [about] if " " in about and about.lower() not in {i.lower() for i in identities} else []
    phrases = list(dict.fromkeys(f for w in [*whole, *windows(question)] for f in bank_forms(w)))
    national = "national" in question.lower()
    mistaken = [p for p in phrases if national and "first boston" in p.lower() and "national" not in p.lower()]
    subjects = caps or [v for k in meaningful for v in variants(k)]
    return Plan(question, groups, phrases, mistaken, keys, subjects, is_firm(question), is_control(question, list(identities)))
