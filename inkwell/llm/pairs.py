"""Defects of question and answer pairs.

An answer is aligned with its question and with the refusal templates by shingle containment and longest common subsequence; its
language is told by a model of words and trigrams; whether an unfinished last sentence could end where it does is read from how all answers of
the collection end theirs.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import lexicon
from inkwell.llm.language import Languages, learn
from inkwell.runtime import stored

DEFECTS = ("empty", "copies_question", "refusal", "other_language", "truncated")
_TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
#: Words, and the marks that end a sentence or a heading.
_PIECE = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*|[.!?…。！？:\n]")
_ENDS = frozenset(".!?…。！？:\n")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_MARKER = re.compile(r"[ \t]*(?:\d+[.)]|[-*•–])[ \t]*")
_HEADING = re.compile(r"[ \t]*(?:\*\*[^*]+\*\*|#+ .*)[ \t]*")
_STOP = re.compile(r"[.!?。！？][\"')\]”»*_\s]*$")
_QUOTED = re.compile("\"[^\"]*\"|“[^”]*”|«[^»]*»")
_SENTENCE = re.compile(r"[.!?…][\"')\]”»*]*\s+|\n+|:\s+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200d\u2060\ufeff]")
#: Share of an answer's words that a refusal takes at least, unless what else there is says nothing of the matter.
_REFUSED = 0.25
#: By how much the words of an answer, and of a question, must speak for a language more than for any other.
_SURE = (4.0, 2.0)
# Words around a repeated question.
_LABELS = frozenset(
    "question answer you asked would like to know frage antwort sie fragten möchten wissen réponse vous avez demandé voulez savoir pregunta respuesta usted preguntó quiere saber q a that is the".split()
)


def tokens(text: str) -> list[str]:
    return [t.replace("’", "'") for t in _TOKEN.findall(text.lower())]


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, one machine word per row of bits (Python integers of any length)."""
    places: dict = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for t in b:
        m = places.get(t)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def containment(inner: list, outer: list, k: int) -> float:
    """Share of the k-word shingles of `inner` that occur in `outer`."""
    k = min(k, len(inner))
    if k == 0 or len(outer) < k:
        return 0.0
    known = {tuple(outer[i : i + k]) for i in range(len(outer) - k + 1)}
    mine = [tuple(inner[i : i + k]) for i in range(len(inner) - k + 1)]
    return sum(s in known for s in mine) / len(mine)


class Words(dict):
    """Number of each word met, from 2 on, with its lower-case form, its hashes and what it says for each language."""

    def __init__(self, languages: Languages | None):
        import numpy as np

        super().__init__((e, 0) for e in _ENDS)
        self.common = [(lang, frozenset(w.split())) for lang, w in lexicon.FUNCTION_WORDS.items()]
        self.learnt = languages or Languages([], {}, {})
        self.lower: list[str] = ["", ""]
        self.hashes: list[int] = [0, 0]
        self.masks: list[int] = [self.code("^"), self.code("^")]
        self.scores: list[list[float]] = [[0.0] * (len(self.common) + len(self.learnt.names))] * 2
        self.np = np

    @staticmethod
    def code(text: str) -> int:
        import xxhash

        return xxhash.xxh3_64_intdigest(text)

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.lower)
        low = word.lower().replace("’", "'")
        self.lower.append(low)
        self.hashes.append(self.code(word))
        self.masks.append(self.code("9" if any(c.isdigit() for c in word) else "X" if word[0].isupper() else low))
        self.scores.append([float(low in w) for _, w in self.common] + self.learnt.score(low))
        return number

    def languages(self, ids, first):
        """(texts x evidence): function words of each language that has a list, then what all words say for each language learnt."""
        sums = self.np.concatenate([self.np.zeros((1, len(self.scores[0]))), self.np.cumsum(self.np.asarray(self.scores)[ids], axis=0)])
        return sums[first[1:]] - sums[first[:-1]]

    def language(self, evidence, least: int, sure: float) -> str | None:
        """The language most function words point to; where they are few or divided the one that all words speak for, or None if they do not either."""
        k = len(self.common)
        second, first = sorted(evidence[:k])[-2:]
        if first >= least and first >= 1.4 * second:
            return self.common[int(evidence[:k].argmax())][0]
        if len(self.learnt.names) < 2:
            return None
        second, first = sorted(evidence[k:])[-2:]
        return self.learnt.names[int(evidence[k:].argmax())] if first - second >= sure else None


def _grams(word, m0, m1, m2):
    """Three codes of a word in its place: the word as written, and with names and numbers masked the last two and three words."""
    import numpy as np

    a, b, c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
    two = m1 * a + m0 * b
    two ^= two >> np.uint64(31)
    three = m2 * c + two * a
    three ^= three >> np.uint64(29)
    return [x.astype(np.uint64).view(np.int64) for x in (word, two * c, three * b)]


class Judge:
    def __init__(self):
        self.placeholders = frozenset(lexicon.PLACEHOLDERS)
        self.openers = sorted((tokens(o) for o in lexicon.OPENERS), key=len, reverse=True)
        self.classes = {w: name for name, words in lexicon.CLASSES.items() for w in words.split()}
        parts = [[self.classed(tokens(x)) for x in r.split("*")] for r in [*lexicon.REFUSALS, *lexicon.DECLINES]]
        self.templates = [(p, len(p) > 1, frozenset(t for x in p for t in x)) for p in parts]
        # a refusal has one of the two longest words of its template, or a word of the class that stands for it
        long = {t for _, _, names in self.templates for t in sorted(names, key=lambda t: (-len(t), t))[:2]}
        self.triggers = frozenset(w for t in long for w in (lexicon.CLASSES[t].split() if t in lexicon.CLASSES else [t]))
        self.abbreviations = frozenset([*lexicon.TITLES, *lexicon.AROUND_NAMES])
        self.asks = re.compile("|".join(rf"(?P<{lang}>\b(?:in|auf|en|em)\s+(?:{'|'.join(n.split())})\b)" for lang, n in lexicon.LANGUAGE_NAMES.items()), re.I)
        self.titles = frozenset(lexicon.TITLES)

    def empty(self, answer: str) -> bool:
        bare = _TAG.sub(" ", answer).strip()
        toks = tokens(bare)
        if not toks:
            return True
        if len(toks) <= 3 and ("/".join(toks) in self.placeholders or all(t in self.placeholders for t in toks)):
            return True
        lines = [x for x in bare.splitlines() if x.strip()]
        return len(lines) == 1 and len(toks) <= 3 and re.fullmatch(r"\s*(?:\*\*[^*]+\*\*|#+ .*|[^.!?]{1,40}:)\s*", lines[0]) is not None

    def copies(self, question: list[str], answer: list[str]) -> bool:
        """The answer holds little but the question, once or more, whole or slightly changed: decided by shares of words, whatever the lengths."""
        if len(question) < 2 or not answer:
            return False
        known = set(question)
        rest = [t for t in answer if t in known or t not in _LABELS]
        # most words are the question's: without that no run of two words can be
        if sum(map(known.__contains__, rest)) < 0.6 * len(rest) or not rest or len(rest) < 0.6 * len(question):
            return False
        repeats = max(1, round(len(rest) / len(question)))
        return containment(rest, question, 2) >= 0.6 and common_length(question * repeats, rest) >= 0.75 * len(rest)

    def classed(self, words: list[str]) -> list[str]:
        """Words by the names of their classes, without fillers."""
        return [self.classes.get(t, t) for t in words if t not in lexicon.FILLERS]

    def sentences(self, answer: str, question: str = "") -> list[list[str]]:
        """The words of each sentence. The full stop of an initial, of a title or of what the question abbreviates as well ends none."""
        short = self.abbreviations | {t.lower() for t in re.findall(r"(\w+)\.(?=\s+\S)", question)}
        found: list[list[str]] = []
        at, goes_on = 0, False
        for m in [*_SENTENCE.finditer(answer), None]:
            words = tokens(answer[at : m.start() if m else len(answer)])
            if words:
                found[-1:] = [found[-1] + words] if goes_on else [*found[-1:], words]
            at = m.end() if m else at
            goes_on = bool(m and words) and m[0][0] == "." and (len(words[-1]) == 1 or words[-1] in short)
        return found

    def refuses(self, answer: str, question: str = "") -> bool:
        """A sentence aligns with a refusal template, and it is a fair part of the answer, or what else there is neither speaks of what was asked nor
        has a number."""
        sentences = self.sentences(_QUOTED.sub(" ", answer), question)
        # a sentence that is an opening alone says nothing
        sentences = [s for s in sentences if s not in self.openers]
        total = sum(map(len, sentences))
        refused, rest = 0, []
        for full in sentences:
            s = full
            for o in self.openers:
                if len(s) > len(o) and s[: len(o)] == o:
                    s = s[len(o) :]
                    break
            s = self.classed(s)
            words = set(s)
            if any(len(names & words) >= 0.84 * len(names) and self._aligned(s, parts, slot) for parts, slot, names in self.templates):
                refused += len(full)
            else:
                rest += full
        if not refused:
            return False
        asked = {t for t in tokens(question) if len(t) > 4 and t not in _LABELS}
        return refused >= _REFUSED * total or not any(t in asked or any(c.isdigit() for c in t) for t in rest)

    @staticmethod
    def _aligned(s: list[str], parts: list[list[str]], slot: bool) -> bool:
        """The sentence is the template, or begins with its head and ends with its tail, slightly changed; a slot holds any number of words."""

        def near(fixed: list[str], part: list[str]) -> bool:
            return not fixed or (common_length(fixed, part) >= 0.84 * len(fixed) and containment(fixed, part, 2) >= 0.6 - 0.2 * (len(fixed) < 5))

        n = sum(map(len, parts))
        if len(s) < n - 1:
            return False
        if not slot:
            return len(s) <= n + max(2, n // 3) and near(parts[0], s)
        head, tail = parts[0], parts[-1]
        return near(head, s[: len(head) + max(2, len(head) // 3)]) and near(tail, s[-len(tail) - max(2, len(tail) // 3) :])

    def broken_form(self, a: str) -> bool:
        """The form alone shows that the answer goes on: a mark of omission, an open bracket, a bare list item or heading at the end."""
        if a.endswith(("[Truncated]", "…", "...")) or a[-1] in ",;:(–—-&/[{":
            return True
        line = a[a.rfind("\n") + 1 :]
        if _MARKER.fullmatch(line) or (len(line) < len(a) and _HEADING.fullmatch(line)) or a.count("**") % 2 or a.rfind("(") > a.rfind(")"):
            return True
        return a[-1] == "." and a[a.rfind(" ") + 1 : -1].lower() in self.titles


#: Rows of both kinds that one reading of the pairs gives: a judged pair, with the codes of its open end, or counts of a code.
_READ = "job_id string, defect string, tail array<bigint>, heard boolean, gram bigint, seen bigint, ended bigint"


def _reader(languages: Languages | None):
    def run(batches):
        yield from _read(batches, languages)

    return run


def _read(batches, languages: Languages | None):
    """Judges pairs (job_id, question, answer), and counts how often the words of all answers stand at the end of a sentence."""
    import numpy as np

    judge, words = Judge(), Words(languages)

    def part(jobs, questions, answers):
        n = len(answers)
        asked = [[words[t] for t in _TOKEN.findall(q)] if q else [] for q in questions]
        bare = [_INVISIBLE.sub("", a).rstrip() if a else "" for a in answers]
        held = [[words[t] for t in _PIECE.findall(a)] for a in bare]
        open_end = [bool(h) and not _STOP.search(a[-60:]) for a, h in zip(bare, held, strict=True)]
        for h, o in zip(held, open_end, strict=True):
            h.append(int(o))  # an open end is 1, any other end 0
        first, qfirst = (np.concatenate([[0], np.cumsum([len(x) for x in lists])]) for lists in (held, asked))
        ids = np.fromiter((i for h in held for i in h), np.int64, first[-1])
        qids = np.fromiter((i for q in asked for i in q), np.int64, qfirst[-1])
        own, theirs = words.languages(ids, first), words.languages(qids, qfirst)

        after = np.append(ids[1:], 0)
        masks = np.asarray(words.masks, np.uint64)[ids]
        edge = np.uint64(words.masks[0])
        back1 = np.concatenate([[edge], masks[:-1]])
        back2 = np.where(back1 == edge, edge, np.concatenate([[edge, edge], masks[:-2]])[: len(masks)])
        codes = _grams(np.asarray(words.hashes, np.uint64)[ids], masks, back1, back2)

        counted = (ids > 1) & (after != 1)
        gram, at = np.unique(np.concatenate([c[counted] for c in codes]), return_inverse=True)
        seen = np.bincount(at, minlength=len(gram))
        ended = np.bincount(at, weights=np.tile(after[counted] == 0, 3), minlength=len(gram)).astype(np.int64)

        defect, tail, heard = [], [], []
        for i in range(n):
            a, h, found, last, known = bare[i], held[i], None, None, False
            mine = [words.lower[w] for w in h if w > 1]
            if len(mine) <= 3 and judge.empty(a):
                found = "empty"
            elif judge.copies([words.lower[w] for w in asked[i]], mine):
                found = "copies_question"
            elif not judge.triggers.isdisjoint(mine) and judge.refuses(a, questions[i] or ""):
                found = "refusal"
            else:
                spoken, his = words.language(own[i], 2, _SURE[0]), words.language(theirs[i], 1, _SURE[1])
                if spoken and his and spoken != his and spoken not in {m.lastgroup for m in judge.asks.finditer(questions[i])}:
                    found = "other_language"
                elif judge.broken_form(a):
                    found = "truncated"
                elif open_end[i] and h[-2] > 1:
                    place = first[i + 1] - 2
                    last = [int(c[place]) for c in codes]
                    # a name cut short is no word of its own anywhere, but a whole one may stand earlier in question or answer
                    low = words.lower[h[-2]]
                    known = any(words.lower[w] == low for w in asked[i]) or any(words.lower[w] == low for w in h[:-2])
            defect.append(found)
            tail.append(last)
            heard.append(known)
        names = [x.split()[0] for x in _READ.split(", ")]
        nothing = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([jobs, pa.array(defect, pa.string()), pa.array(tail, pa.list_(pa.int64())), pa.array(heard), nothing, nothing, nothing], names=names)
        m = len(gram)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.string()), pa.nulls(m, pa.string()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.bool_()), pa.array(gram), pa.array(seen), pa.array(ended)], names=names)

    for batch in batches:
        if len(words) > 500_000:
            words = Words(languages)
        if batch.num_rows:
            yield from part(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist())


def latest_answers(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(job_id, question, answer) of the jobs with a request and a complete response; of several the one polled last.

    Ties on the time are broken by response_id; a response without a time counts as the earliest. Null job ids take no part. The
    latest response is found by aggregation, so a job with very many polls shrinks inside the map tasks.
    """
    complete = responses.where("status = 'complete' AND job_id IS NOT NULL").select("job_id", F.struct(F.coalesce(F.col("polled_at").cast("timestamp"), F.timestamp_seconds(F.lit(0))).alias("t"), "response_id", "answer").alias("_r"))
    asked = requests.where("job_id IS NOT NULL").select("job_id", F.struct("received_at", "request_id", "question").alias("_q"))
    answers = complete.groupBy("job_id").agg(F.max("_r").alias("_r"))
    questions = asked.groupBy("job_id").agg(F.max("_q").alias("_q"))
    return questions.join(answers, "job_id").select("job_id", F.col("_q.question").alias("question"), F.col("_r.answer").alias("answer"))


def defects(requests: DataFrame, responses: DataFrame, docs: DataFrame | None = None, least: int = 4, share: float = 0.03) -> DataFrame:
    """(job_id, defect) of the defective pairs, at most one defect each; see `DEFECTS` for the kinds and their precedence.

    Four languages are told by their commonest words; where these are few or divided, and for other languages, by what is learnt from `docs` (doc_id,
    text, lang) where given, from a sample of at most `language.SAMPLE` texts.
    A null answer is empty; without a question an answer is neither a copy nor in another language. An answer that stops without a mark
    is truncated where its last words, met at least `least` times in the collection, end a sentence in less than `share` of the cases,
    or where its last word occurs nowhere else. Empty tables give no rows; other columns are not read.
    """
    languages = learn(docs) if docs is not None else None
    read = stored(latest_answers(requests, responses).mapInArrow(_reader(languages), _READ), "answers")
    marked = read.where("job_id IS NOT NULL")
    open_ends = marked.where("tail IS NOT NULL").select("job_id", "heard", F.posexplode("tail").alias("level", "gram"))
    needed = open_ends.select("gram").distinct()
    counts = read.where("gram IS NOT NULL").join(needed, "gram", "left_semi").groupBy("gram").agg(F.sum("seen").alias("seen"), F.sum("ended").alias("ended"))
    scored = open_ends.join(counts, "gram", "left").groupBy("job_id").agg(
        F.max("heard").alias("heard"),
        *[F.max(F.when(F.col("level") == k, F.coalesce(c, F.lit(0)))).alias(f"{c}{k}") for k in range(3) for c in ("seen", "ended")],
    )
    seldom = [(F.col(f"seen{k}") >= least) & (F.col(f"ended{k}") < share * F.col(f"seen{k}")) for k in range(3)]
    unknown = (F.col("seen0") == 0) & ~F.col("heard")
    cut = scored.where(unknown | seldom[0] | seldom[1] | seldom[2]).select("job_id", F.lit("truncated").alias("defect"))
    return marked.where("defect IS NOT NULL").select("job_id", "defect").union(cut)
