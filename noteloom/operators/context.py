"""Context of mentions: current, historical, negated, or of another person.

Sections and triggers are lexical rules over positions of a text, so a document is worked off in one Arrow
batch and leaves as counted mentions. Within a sentence only the nearest trigger on either side can
decide: whatever cancels it cancels the ones beyond it too, and they are farther away."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from noteloom.functions.text import folded_form, primary_form
from noteloom.session import spread

LABELS = ("current_clinical", "historical", "negated", "non_patient")
# Words that may stand between a trigger and a mention.
WORDS_BEFORE, WORDS_AFTER, WORDS_PERSON = 6, 4, 12
# Triggers and section headers.
NEGATION_BEFORE = (
    "no evidence of", "no evidence for", "no signs of", "no sign of", "no symptoms of", "no complaints of", "no history of", "not have", "not had", "no", "not", "without", "denies",
    "denied", "negative for", "negative", "rule out", "ruled out", "r/o", "free of", "absent", "unremarkable for", "declines", "never had", "no longer",
)
NEGATION_AFTER = ("is absent", "was absent", "is negative", "was negative", "not present", "was ruled out", "is ruled out", "has been ruled out", "is not present")
SCOPE_BREAK = ("but", "however", "although", "though", "except", "aside from", "apart from", "otherwise", "positive for", "reports", "complains of", "admits", "presents with")
OTHER_PERSON = (
    "family history", "familial history", "fh", "mother", "mothers", "father", "fathers", "parent", "parents", "sister", "sisters", "brother", "brothers", "sibling", "siblings", "son",
    "daughter", "aunt", "uncle", "grandmother", "grandfather", "grandparent", "cousin", "maternal", "paternal", "wife", "husband", "spouse", "partner",
)
PAST_BEFORE = (
    "history of", "hx of", "h/o", "past medical history", "past surgical history", "previously", "previous", "prior", "status post", "s/p", "in the past", "years ago", "months ago",
    "former", "formerly", "childhood", "as a child", "remote", "resolved", "healed",
)
PAST_AFTER = ("years ago", "months ago", "in the past", "has resolved", "resolved")
SECTIONS = {
    "non_patient": ("family history", "family hx", "fh", "social and family history"),
    "historical": ("past medical history", "past surgical history", "past history", "medical history", "surgical history", "pmh", "psh", "prior surgeries"),
    None: (
        "history of present illness", "hpi", "chief complaint", "cc", "assessment", "assessment and plan", "plan", "physical examination", "physical exam", "exam", "review of systems", "ros",
        "impression", "medications", "current medications", "allergies", "vitals", "vital signs", "labs", "subjective", "objective", "social history",
    ),
}
HEADER = r"^[ \t]*([A-Za-z][A-Za-z /&']{0,48})[ \t]*:"
BOUNDARY = r"(?:[ \t]*\r?\n){2,}[ \t]*|[!?;]+|\.(?!\d)|\r?\n(?=[ \t]*(?:[-*•]|\d+[.)])[ \t])"
TOKEN = r"[^\W_]+(?:[./+-][^\W_]+)*\+?"


@lru_cache(maxsize=None)
def _any_of(phrases: tuple[str, ...]) -> re.Pattern:
    """Any of the phrases as whole words, the longest first, with any blanks within."""
    longest = sorted(phrases, key=lambda p: (-len(p), p))
    return re.compile(r"(?<![^\W_])(?:" + "|".join(r"[ \t]+".join(map(re.escape, p.split(" "))) for p in longest) + r")(?![^\W_])", re.IGNORECASE)


class _Near:
    """Triggers of a sentence, to be asked for the nearest one before or after a place."""

    def __init__(self, phrases: tuple[str, ...], text: str, start: int, end: int):
        spans = [(m.start() + start, m.end() + start) for m in _any_of(phrases).finditer(text[start:end])]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]

    def end_before(self, place: int) -> int | None:
        k = bisect_right(self.ends, place)
        return self.ends[k - 1] if k else None

    def start_after(self, place: int) -> int | None:
        k = bisect_left(self.starts, place)
        return self.starts[k] if k < len(self.starts) else None


def sections(text: str) -> list[tuple[int, int, str]]:
    """Stretches with a label: from after a known header's colon to the next known header or the end."""
    known = {name: label for label, names in SECTIONS.items() for name in names}
    heads = [(m.start(), m.end(), known[name]) for m in re.finditer(HEADER, text, re.MULTILINE) if (name := " ".join(m.group(1).split()).casefold()) in known]
    stops = [h[0] for h in heads[1:]] + [len(text)]
    return [(end, stop, label) for (_, end, label), stop in zip(heads, stops) if label]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    marks = [(m.start(), m.end()) for m in re.finditer(BOUNDARY, text)]
    edges = zip([0, *(b for _, b in marks)], [*(a for a, _ in marks), len(text)])
    return [(a, b) for a, b in edges if a < b]


def label_mentions(text: str, shortest: int, longest: int) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, tokens, label) of every n-gram of a text."""
    stretches = sections(text)
    for start, end in sentence_spans(text):
        words = [m.start() + start for m in re.finditer(r"[^\W_]+", text[start:end])]
        near = {name: _Near(p, text, start, end) for name, p in (("no", NEGATION_BEFORE), ("no_after", NEGATION_AFTER), ("break", SCOPE_BREAK), ("person", OTHER_PERSON), ("past", PAST_BEFORE), ("past_after", PAST_AFTER))}
        found = [(m.start() + start, m.end() + start) for m in re.finditer(TOKEN, text[start:end])]

        def between(a: int | None, b: int | None) -> float:
            """Words that begin after ``a`` and before ``b``."""
            return float("inf") if a is None or b is None else max(0, bisect_left(words, b) - bisect_right(words, a))

        for i, (a, _) in enumerate(found):
            section = next((label for x, y, label in stretches if x <= a < y), None)
            trigger = near["no"].end_before(a)
            stopped = trigger is not None and (stop := near["break"].start_after(trigger)) is not None and stop < a
            before_no = not stopped and between(trigger, a) <= WORDS_BEFORE
            person = section == "non_patient" or between(near["person"].end_before(a), a) <= WORDS_PERSON
            before_past = section == "historical" or between(near["past"].end_before(a), a) <= WORDS_BEFORE
            for n in range(shortest, min(longest, len(found) - i) + 1):
                b = found[i + n - 1][1]
                if before_no or between(b, near["no_after"].start_after(b)) <= WORDS_AFTER:
                    label = "negated"
                elif person:
                    label = "non_patient"
                elif before_past or between(b, near["past_after"].start_after(b)) <= WORDS_AFTER:
                    label = "historical"
                else:
                    label = "current_clinical"
                yield a, b, n, label


def mentions_with_context(documents: DataFrame, shortest: int = 1, longest: int = 4) -> DataFrame:
    """``doc_id, language, note_type, primary, folded, token_count, context, n``: mentions of ``documents``
    (``doc_id, language, note_type, text``) counted by document, form and context. Empty texts have none."""
    kind = dict(documents.dtypes)["doc_id"]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms: dict[str, tuple[str, str]] = {}
        for batch in stream:
            columns = [batch.column(i) for i in range(3)]
            for row, text in enumerate(batch.column(3).to_pylist()):
                counts: Counter = Counter()
                for a, b, n, label in label_mentions(text or "", shortest, longest):
                    surface = text[a:b]
                    if surface not in forms:
                        if len(forms) > 100_000:
                            forms.clear()
                        first = primary_form(surface)
                        forms[surface] = (first, folded_form(first))
                    counts[(*forms[surface], n, label)] += 1
                if counts:
                    keys = list(counts)
                    taken = [c.take(pa.array([row] * len(keys))) for c in columns]
                    yield pa.RecordBatch.from_arrays(
                        [*taken, pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([k[2] for k in keys], pa.int32()), pa.array([k[3] for k in keys]), pa.array([counts[k] for k in keys], pa.int64())],
                        names=["doc_id", "language", "note_type", "primary", "folded", "token_count", "context", "n"],
                    )

    rows = spread(documents.select("doc_id", "language", "note_type", "text"), "doc_id")
    return rows.mapInArrow(batches, f"doc_id {kind}, language string, note_type string, primary string, folded string, token_count int, context string, n bigint").where("primary <> ''")
