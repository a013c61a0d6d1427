"""Problem 4: sentence units of notes in any of their languages.

The layout decides first: blank lines, headings and list items. Within a stretch of running text,
enclosures (quotations, brackets) are matched, and every end mark outside them that may end a unit is a candidate boundary: full
stops, question and exclamation marks, ellipses, the marks of other scripts, closing quotations with an end mark
in them, Thai blanks. A maximum-entropy model classifies each of them by its mark, its neighbouring tokens, their case,
length, digits and script. The model is trained on reliable boundaries of the same corpus: marks at
the ends of stretches and after plain words (boundary), before lower case or a comma and after titles or reference
words (no boundary). Training takes a bounded sample; classification runs over every candidate, in time that
grows with the text's length.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.session import spread, table

#: Different labelled candidates that the model is fitted on at most (the most frequent ones).
TRAINING_ROWS = 30_000
#: Documents whose candidates are looked at for training at most (those of least hash).
TRAINING_DOCUMENTS = 4_000

# Abbreviations, in lower case and without their last full stop.
#: They introduce what follows: titles, references, comparisons.
INTRODUCING = frozenset("""
    mr mrs ms dr prof st fig figs no nos rm bldg vs cf approx e.g i.e incl tel ext vit med vol ed p.o ave apt al mt ft capt lt
    z b z.b d d.h vgl ca evtl bzw tgl u nr v hr fr sog inkl exkl ggf bes versichertennr tab str abb
    p.ex p c.-à-d env mme mlle m pr av éd n réf
    sr sra srta dra p.ej núm n.º aprox avda pág ee.uu ud uds c c/ tfno
    т е т.е напр см рис д-р тел стр ул проф им гр св ок
    π.χ π δηλ κ κα τηλ βλ αρ σελ δρ
    د أ م ص
    डॉ मि ग्रा मि.ग्रा श्री प्रो
""".split())
#: They may well end a sentence: times, doses, units, et cetera.
FINAL = frozenset("""
    a.m p.m etc q.d b.i.d t.i.d q.h.s q.i.d p.r.n h.s jr sr inc ltd co wk mo yr hr min sec
    usw o.ä std min stk wo mg ml kg cm
    h sem etc. cm mg
    г гг нед таб мг мл см кг мин ч др руб
    mg ml κ.λπ κλπ
    ملغ مل سم كغ
""".split()) - frozenset(["sr"])  # fmt: skip
#: What an initial-like single letter belongs to when it ends a phrase.
LETTERED = frozenset("floor wing ward grade class group type typ tipo équipe team unit level block room vit hepatitis vitamin étage station bereich planta ala sala groupe gruppe".split())
#: Words before the initials of a name.
BEFORE_NAME = frozenset("with to by and of for from mit von an bei und avec de à et par con por y a с и от για από".split())
#: Nouns before which a German number with a full stop is an ordinal.
AFTER_ORDINAL = frozenset("tag tages woche monat jahr jahrhundert stock etage lebensjahr mal januar februar märz april mai juni juli august september oktober november dezember quartal halbjahr zyklus sitzung".split())
BEFORE_ORDINAL = frozenset("am der dem den die das im vom zum des seit bis beim zur ab".split())

END_MARKS = ".!?…。！？｡।॥؟۔;;"
_RUN = re.compile(rf"[{END_MARKS}]+")
_OPENING = {"(": ")", "（": "）", "[": "]", "「": "」", "『": "』", "“": "”", "„": "“", "«": "»", "‚": "‘", "《": "》", "【": "】"}
_MARK = re.compile(r"[()（）\[\]「」『』“”„«»\"《》【】]")
CLOSERS = ")]）」』”»\"’'》】“"
_BLANK = re.compile(r"\s*")
_LINE = re.compile(r"\r\n|\r|\n")
_ITEM = re.compile(r"[ \t\u00a0\u3000]*(?:[-*•‣◦·–]|\d{1,3}[.)])[ \t\u00a0]+(?=\S)")
_THAI = re.compile(r"(?<=[฀-๿])[\u200b-\u200f\u2060\ufeff\u00ad]*(\s+)[\u200b-\u200f\u2060\ufeff\u00ad]*(?=[ก-ฺเ-๎])")


@lru_cache(maxsize=65536)
def script(ch: str) -> str:
    """The script of a letter by the first word of its name; '' for other characters."""
    return unicodedata.name(ch, "").split(" ")[0] if ch.isalpha() else ""


def word_case(word: str) -> str:
    """'lower', 'upper', 'digit', 'caseless', 'mark' or '' for the beginning of what follows."""
    if not word:
        return ""
    ch = word[0]
    if ch.isdigit():
        return "digit"
    if ch.isupper() or ch.istitle():
        return "upper"
    if ch.islower():
        # a word such as pH begins a sentence as it is
        letters = re.match(r"\w+", word).group()
        return "upper" if any(c.isupper() for c in letters[1:]) else "lower"
    return "caseless" if ch.isalpha() else "mark"


_STRIP = "\"'“”„«»()[]（）「」‚‘’¿¡"


def candidate_features(text: str, at: int, start: int, end: int) -> tuple[list[str], int | None]:
    """Features of the full stop at ``at`` of a stretch ``start..end``, and its label where it is reliable."""
    left = max(start, at - 60)
    before = text[left:at].split()
    raw = before[-1] if before else ""
    word = raw.strip(_STRIP).lower()
    earlier = re.split(r"['’]", before[-2].strip(_STRIP + ",:;").lower())[-1] if len(before) > 1 else ""
    begin = at + 1
    while begin < end and text[begin].isspace():
        begin += 1
    after = text[begin : min(end, begin + 60)]
    following = after.split(None, 1)[0] if after else ""
    bare = following.lstrip(_STRIP).rstrip(".,;:!?…)”»\"")
    case = word_case(bare) if following and following[0] not in _STRIP else "open"
    original = raw.strip(_STRIP)
    digits = bool(original) and original[-1].isdigit()
    single = len(word) == 1 and word.isalpha()
    shape = "digit" if digits else "bracket" if raw.endswith((")", "]", "）", '"', "”", "»")) else "single" if single else "dotted" if "." in word else "word"
    kind = "introducing" if word in INTRODUCING else "final" if word in FINAL else ""
    nxt = bare.lower()
    lettered = single and original.isupper()
    features = [
        "bias", "m=.", f"w={word}" if not digits else "w=#", f"len={min(len(word), 6)}", f"shape={shape}", f"kind={kind}", f"case={case}", f"n={nxt if case != 'digit' else '#'}", f"script={script(word[-1]) if word else ''}>{script(bare[0]) if bare else ''}",
        f"kind+case={kind}+{case}", f"shape+case={shape}+{case}", f"before+shape={earlier if shape in ('digit', 'single') else ''}+{shape}", f"digit+n={nxt if digits else ''}", f"up={original[:1].isupper()}+{shape}",
        f"lettered={lettered and (earlier.rstrip('.') in LETTERED or (original in 'IVX' and before[-2:-1] != [] and before[-2][:1].islower() and earlier not in BEFORE_NAME))}", f"initial={lettered and bool(re.match(r'[A-ZÀ-Þ]', bare))}", f"n1={len(bare) == 1 and following.endswith('.')}", f"m+case=.+{case}",
    ]
    label: int | None = None
    if not following:
        label = 1
    elif case == "lower" or following[0] in ",;:—–":
        label = 0
    elif digits:
        ordinal = len(word) <= 2 and (earlier in BEFORE_ORDINAL or re.fullmatch(r"\d{1,2}\.", earlier or "") is not None)
        if nxt in AFTER_ORDINAL and len(word) <= 3:
            label = 0
        elif case == "digit":
            label = 0 if ordinal and re.match(r"\d{1,2}\.(?:\s|$)|\d{4}\b", following) else 1
        elif not (ordinal and case == "upper"):
            label = 1
    elif lettered:
        follows_word = len(before) > 1 and before[-2][-1:].islower() and before[-2][:1].islower() and earlier not in BEFORE_NAME
        if earlier.rstrip(".") in LETTERED or (original in "IVX" and follows_word):
            label = 1
        elif case == "upper":
            label = 0
    elif kind == "introducing":
        label = 0
    elif kind == "final":
        label = 1
    elif shape == "bracket" or (shape == "word" and len(word) >= 3):
        label = 1
    return features, label


FEATURES = 18
_WORD = re.compile(r"\S+")


def mark_features(text: str, kind: str, a: int, cut: int, end: int) -> tuple[list[str], int]:
    """Features of any other candidate (``kind``: what mark it is, at ``a``; the unit would end at ``cut``), and its label."""
    at = cut
    while at < end and text[at].isspace():
        at += 1
    word = m.group() if (m := _WORD.match(text, at, min(end, at + 60))) else ""
    first, spaced = word[:1], at > cut or not word
    case = word_case(word) if first not in _STRIP else "open"
    opening = first in "\"“„«‚(（[「『¿¡《【" and first != ""
    comma = first in ",;:—–-、，；：.!?…" and first != ""
    letter = next((c for c in reversed(text[max(0, a - 40) : a]) if c.isalpha()), "")
    if kind == ";":
        label = script(letter) == "GREEK" and spaced and case != "lower"
    elif kind == "…":
        label = case == "upper" or opening
    elif kind == "。":
        label = not comma and case != "lower"
    elif kind == "!":
        label = not comma and case != "lower" and (spaced or script(first) in ("CJK", "HIRAGANA", "KATAKANA") or opening)
    elif kind == "close":
        label = not word or (not comma and case != "lower")
    else:  # danda, Thai blank
        label = True
    around = f"{script(letter)}>{script(first)}"
    features = [
        "bias", f"m={kind}", f"m+case={kind}+{case}", f"m+spaced={kind}+{spaced}", f"m+comma={kind}+{comma}", f"m+open={kind}+{opening}", f"m+both={kind}+{case}+{spaced}+{comma}", f"m+script={kind}+{script(letter)}",
        f"m+around={kind}+{around}+{spaced}", f"m+all={kind}+{script(letter)}+{case}+{spaced}+{comma}+{opening}",
    ]
    return features + [f"none{i}" for i in range(FEATURES - len(features))], int(label)


def enclosures(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost matched pairs of quotation marks and brackets of a stretch, as (opening, closing)."""
    stack: list[tuple[str, int]] = []
    waiting: dict[str, list[int]] = {}  # where on the stack each closing mark is awaited
    pairs: list[tuple[int, int]] = []
    for m in _MARK.finditer(text, start, end):
        ch, at = m.group(), m.start()
        if waiting.get(ch):
            hit = waiting[ch][-1]
            pairs.append((stack[hit][1], at))
            while len(stack) > hit:
                waiting[stack.pop()[0]].pop()
        elif ch == '"' or ch in _OPENING:
            closing = _OPENING.get(ch, '"')
            waiting.setdefault(closing, []).append(len(stack))
            stack.append((closing, at))
    outer: list[tuple[int, int]] = []
    for pair in sorted(pairs):
        if not outer or pair[0] > outer[-1][1]:
            outer.append(pair)
    return outer


def stretches(text: str) -> list[tuple[int, int, int]]:
    """(start, end, first) of each heading, list item and run of lines; ``first`` is where a list mark ends."""
    found: list[tuple[int, int, int]] = []
    open_at: list[int] | None = None  # start, end, first
    fresh, listed, at = True, None, 0
    lines = []
    for m in _LINE.finditer(text):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, len(text)))

    def close() -> None:
        nonlocal open_at
        if open_at is not None:
            found.append(tuple(open_at))
            open_at = None

    for a, b in lines:
        line = text[a:b].strip()
        if not line:
            close()
            fresh, listed = True, None
            continue
        ended = open_at is None or text[open_at[0] : open_at[1]].rstrip()[-1:] in END_MARKS + CLOSERS
        item = _ITEM.match(text, a, b)
        if item:
            mark = item.group().strip()
            kind = "#" if mark[0].isdigit() else mark
            rest = word_case(text[item.end() : b])
            if not (fresh or listed == kind or (ended and rest != "lower")) or (rest == "lower" and not fresh and listed != kind) or (kind in "-–" and rest == "lower" and open_at is not None):
                item = None
            elif kind == "#" and listed == kind and not fresh and mark[-1] == "." and open_at is not None and not ended and re.match(r"\s*[a-zà-ÿ]", text[item.end() : b]):
                item = None
        heading = line[-1] in ":：" and (fresh or (ended and len(line) <= 40)) and not item
        if heading:
            close()
            found.append((a, b, a))
            fresh, listed = True, None
            continue
        if item:
            close()
            open_at, listed = [a, b, item.end()], kind
        elif open_at is None:
            open_at = [a, b, a]
        else:
            open_at[1] = b
        fresh = False
    close()
    return found


class Splitter:
    """Cuts texts into units with a model's weights by feature."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights

    def final(self, features: list[str], label: int | None) -> bool:
        """The model's verdict; without a model (no text to train on) that of the label."""
        if not self.weights:
            return bool(label)
        return sum(self.weights.get(f, 0.0) for f in features) > 0

    def boundaries(self, text: str, start: int, end: int, first: int, ask=None) -> list[int]:
        """Where units end within a stretch. ``ask`` decides each candidate (the model by default)."""
        ask = ask or self.final
        pairs = enclosures(text, first, end)
        opens = [p[0] for p in pairs]
        # German quotations open low and close with the mark that opens English ones
        low, high = ([m.start() for m in re.finditer(ch, text[start:end])] for ch in "„“")
        events = [(m.start(), m.end(), None) for m in _RUN.finditer(text, first, end)] + [(p[1], p[1] + 1, p) for p in pairs]
        events += [(m.start(1), m.start(1), "thai") for m in _THAI.finditer(text, first, end)]
        cuts: list[int] = []
        unit = first
        for a, b, what in sorted(events, key=lambda e: (e[0], e[1])):
            if a < unit:
                continue
            if what is None or what == "thai":
                inside = bisect.bisect_right(opens, a) - 1
                if inside >= 0 and pairs[inside][1] > a - (what == "thai"):
                    continue
            if what == "thai":
                kind, cut = "thai", a
            elif what is not None:  # an enclosure closes
                inner = b - 2
                while inner > what[0] and (text[inner] in CLOSERS or text[inner] in " \u00a0\u202f"):
                    inner -= 1
                before = unit < what[0] and _BLANK.match(text, unit, what[0]).end() < what[0]
                if before or inner <= what[0] or text[inner] not in END_MARKS or text[inner] == ";":
                    continue
                kind, cut = "close", b
                while cut < end and text[cut] in CLOSERS and text[cut] not in "“‘\"'":
                    cut += 1
            else:
                kind, cut = self.mark(text, end, a, b)
                if cut < end and text[cut] == "“" and bisect.bisect_left(low, cut - start) > bisect.bisect_left(high, cut - start):
                    cut += 1
            if kind == ".":
                following = _BLANK.match(text, cut, end).end()
                if following == end:
                    continue  # the stretch ends anyway
                if following == cut:
                    continue  # within a token
                features, label = candidate_features(text, a, start, end)
                if text[following : following + 2] == "- ":
                    label = 0
            elif kind:
                features, label = mark_features(text, kind, a, cut, end)
            if kind and ask(features, label):
                cuts.append(cut)
                unit = cut
        return cuts

    @staticmethod
    def mark(text: str, end: int, a: int, b: int) -> tuple[str, int]:
        """What kind of candidate the run of marks ``a..b`` is, and where the unit would end ('' for none)."""
        run = text[a:b]
        cut = b
        while cut < end and text[cut] in CLOSERS and text[cut] not in "“‘":
            cut += 1
        if set(run) <= {";", ";"}:
            return ";", cut
        if "…" in run or ".." in run:
            return "…", cut
        if set(run) & set("。！？｡") and "." not in run:
            return "。", cut
        if set(run) & set("।॥"):
            return "।", cut
        if set(run) & set("!?؟۔"):
            return "!", cut
        return ("." if run == "." else ""), cut

    def units(self, text: str | None) -> list[tuple[int, int]]:
        """(start, end) of the units of a text, without outer blanks."""
        found: list[tuple[int, int]] = []
        for start, end, first in stretches(text or ""):
            last = start
            for cut in [*self.boundaries(text, start, end, first), end]:
                piece = text[last:cut]
                bare = piece.strip()
                if bare:
                    a = last + len(piece) - len(piece.lstrip())
                    found.append((a, a + len(bare)))
                last = cut
        return found


def labelled_candidates(text: str | None) -> list[tuple[str, int]]:
    """The reliable candidates of a text as (features joined by U+001F, label)."""
    rows: list[tuple[str, int]] = []

    def ask(features: list[str], label: int | None) -> bool:
        if label is not None:
            rows.append(("\x1f".join(features), label))
        return bool(label)

    splitter = Splitter({})
    for start, end, first in stretches(text or ""):
        splitter.boundaries(text, start, end, first, ask)
        # the full stop that ends a stretch, which nobody asks about
        last = end
        while last > first and text[last - 1].isspace():
            last -= 1
        if last > first and text[last - 1] == ".":
            features, label = candidate_features(text, last - 1, start, end)
            if label is not None:
                rows.append(("\x1f".join(features), label))
    return rows


def fit(rows: Iterable[tuple[str, int]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-5) -> dict[str, float]:
    """Weights by feature of a two-class maximum-entropy model (logistic regression, adaptive gradient).

    ``rows``: (features, label), or how often each was met; a row met n times counts 1 + ln n times."""
    counts = rows if isinstance(rows, Counter) else Counter(rows)
    if not counts:
        return {}
    names: dict[str, int] = {}
    pairs = sorted(counts)
    x = np.stack([np.array([names.setdefault(f, len(names)) for f in text.split("\x1f")]) for text, _ in pairs])
    y = np.array([label for _, label in pairs], dtype=float)
    often = 1 + np.log([counts[p] for p in pairs])
    weights, squares = np.zeros(len(names)), np.full(len(names), 1e-6)
    order = np.random.default_rng(7)
    for _ in range(rounds):
        for part in np.array_split(order.permutation(len(y)), max(1, len(y) // 64)):
            p = 1 / (1 + np.exp(-np.clip(weights[x[part]].sum(axis=1), -30, 30)))
            gradient = np.bincount(x[part].ravel(), weights=np.repeat((p - y[part]) * often[part], x.shape[1]), minlength=len(names)) + decay * weights
            squares += gradient**2
            weights -= rate * gradient / np.sqrt(squares)
    return {name: float(weights[i]) for name, i in names.items() if abs(weights[i]) > 1e-4}


def train(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> dict[str, float]:
    """Fit the model on at most ``TRAINING_ROWS`` different reliable candidates of ``TRAINING_DOCUMENTS`` documents.

    The documents are those of least hash and the candidates the most frequent ones, so the sample is the same for the same
    table however it is stored."""
    h = F.xxhash64(id_column, text_column)
    filled = documents.where(F.length(text_column) > 0)
    # hashes first, so that no task orders whole texts
    hashes = [r["h"] for r in filled.select(h.alias("h")).distinct().orderBy("h").limit(TRAINING_DOCUMENTS).collect()]
    chosen = filled.where(h.isin(hashes) if hashes else F.lit(False)).dropDuplicates([id_column, text_column])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            rows = [row for text in batch.column(0).to_pylist() for row in labelled_candidates(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["features", "label"])

    rows = chosen.select(text_column).repartition(documents.sparkSession.sparkContext.defaultParallelism).mapInArrow(batches, "features string, label int")
    sample = rows.groupBy("features", "label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "features", "label").limit(TRAINING_ROWS).collect()
    return fit(Counter({(r["features"], r["label"]): r["n"] for r in sample}))


def split_documents(documents: DataFrame, weights: dict[str, float], id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``<id>, start_pos, end_pos`` of every unit; null, empty and blank texts have none.

    Repeated rows are cut as often as they are given; extra columns are ignored. Only the weights (at most
    18 features for each training row) are broadcast."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    kind = dict(documents.dtypes)[id_column]

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(shared.value)
        for batch in stream:
            at, starts, ends = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                for start, end in splitter.units(text):
                    at.append(i)
                    starts.append(start)
                    ends.append(end)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_column, "start_pos", "end_pos"]
            )

    return spread(documents.select(id_column, text_column).where(F.length(text_column) > 0), id_column).mapInArrow(batches, f"`{id_column}` {kind}, start_pos int, end_pos int")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return split_documents(documents, train(documents))


QUERIES = {"p4_found": p4_found}
