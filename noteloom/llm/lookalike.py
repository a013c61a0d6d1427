"""Problem 2: one consistent spelling for text that looks the same but differs in its characters.

Every value is mapped in SQL: compatibility forms (full-width, mathematical, Roman-number letters) become
the plain characters, invisible characters go, odd spaces become spaces, combining accents compose or, where no
letter takes them, go, and letters of another alphabet become those of the value's language, word by word. The mapped values of a
language are grouped under the accent-sensitive Unicode collation; of each class of equals one
canonical member is chosen (one that needs no mapping, if there is any: the most frequent, then the least),
and it is joined back to all records. A record is reported if its own characters are out of line.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from itertools import permutations

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.session import join_counted, sql_over, table, written

# Letters of other alphabets and letter variants that look like a Latin letter, by that letter.
LOOK_ALIKES = {
    "a": "аɑα", "b": "вƅЬ", "c": "сϲ", "d": "ԁ", "e": "еҽε", "f": "ſ", "g": "ɡց", "h": "һհнη", "i": "іιıɩ", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "мμ", "n": "νոп",
    "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵ", "w": "ԝω", "x": "хχ", "y": "уγү", "z": "ᴢζ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "Ј", "K": "КΚ", "L": "Ꮮ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
}
#: The same for Russian and Greek: look-alikes by the language's own letter.
TO_RUSSIAN = {
    "а": "aɑα", "в": "ʙ", "с": "cϲⅽ", "е": "eҽε", "һ": "", "і": "", "о": "oοօ", "р": "pρ", "х": "xχ", "у": "yγ", "к": "kκ", "м": "m", "т": "tτ", "н": "ʜ", "п": "nո", "и": "u", "г": "r", "ё": "ë",
    "А": "AΑ", "В": "BΒ", "С": "CϹ", "Е": "EΕ", "Н": "HΗ", "К": "KΚ", "М": "MΜ", "О": "OΟՕ", "Р": "PΡ", "Т": "TΤ", "Х": "XΧ", "У": "YΥ", "З": "3", "Ё": "Ë",
}
TO_GREEK = {
    "α": "aаɑ", "ο": "oоօ", "ν": "vѵ", "ρ": "pр", "ι": "iіı", "κ": "kк", "τ": "tт", "υ": "uս", "χ": "xх", "γ": "yу", "η": "nո", "ω": "wԝ", "ε": "eе", "σ": "", "ς": "cс", "β": "bв", "μ": "µм",
    "ά": "á", "έ": "é", "ί": "í", "ό": "ó", "ύ": "ú",
    "Α": "AА", "Β": "BВ", "Ε": "EЕ", "Ζ": "Z", "Η": "HН", "Ι": "IІ", "Κ": "KК", "Μ": "MМ", "Ν": "N", "Ο": "OО", "Ρ": "PР", "Τ": "TТ", "Υ": "YУ", "Χ": "XХ",
}
#: Arabic letters of other languages that stand for the ordinary ones.
TO_ARABIC = {"ك": "ک", "ي": "ی", "ه": "ہە", "ة": "ۃ"}
#: Greek letters that stand alone in chemical names.
CHEMICAL = "αβγδεωΑΒΓΔΩ"
#: Characters that nobody sees, as a class of regular expressions.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
#: Spaces that don't break, and the full-width one.
ODD_SPACES = "\u00a0\u2007\u202f\u3000"
COMBINING = "\u0300-\u036f"
#: Voice marks of kana, which the half-width ones become.
KANA_MARKS = "\u3099\u309a"
#: Joiners between pictures are part of the picture.
JOINED_PICTURES = r"(?<=[\\p{So}\u200d\ufe0f])[\u200d\ufe0f]|[\u200d\ufe0f](?=[\\p{So}\u200d\ufe0f])"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=None)
def compatibility(punctuation: bool = True) -> tuple[str, str]:
    """Characters of the ranges of variant forms whose compatibility form is one character, and those forms.

    Without ``punctuation`` full-width signs stay (they are native in Chinese and Japanese)."""
    pairs = []
    for first, last in ((0x2102, 0x2138), (0x2160, 0x217F), (0x2F00, 0x2FD5), (0x3D0, 0x3FF), (0xF900, 0xFAFF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC), (0xFF01, 0xFF5E), (0xFF66, 0xFF9F), (0x1D400, 0x1D7FF)):
        for code in range(first, last + 1):
            ch = chr(code)
            plain = unicodedata.normalize("NFKC", ch)
            if plain != ch and len(plain) == 1 and unicodedata.category(ch) != "Cn" and (punctuation or plain.isalnum()):
                if not (0x2102 <= code <= 0x2138 and not ch.isalpha()):
                    pairs.append((ch, plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@lru_cache(maxsize=None)
def compositions() -> list[tuple[str, str]]:
    """European letters with combining accents in any order, some perhaps composed already, and kana with their voice
    marks, with their composed letters (longest first)."""
    found = []
    for code in (*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000), *range(0x3041, 0x3100)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(0x300 <= ord(c) <= 0x36F or c in KANA_MARKS for c in parts[1:]) and unicodedata.normalize("NFC", parts) == chr(code):
            for marks in set(permutations(parts[1:])):
                for done in range(len(marks)):
                    typed = unicodedata.normalize("NFC", parts[0] + "".join(marks[:done])) + "".join(marks[done:])
                    if unicodedata.normalize("NFC", typed) == chr(code):
                        found.append((typed, chr(code)))
    return sorted(set(found), key=lambda p: (-len(p[0]), p[0]))


@lru_cache(maxsize=1)
def look_alikes() -> dict[str, str]:
    """``LOOK_ALIKES`` with the letters of the public table of confusables that share the skeleton of one Latin letter:
    those of alphabets with capitals, and Lisu, which is made of Latin capitals.

    Spark brings that table along (the spoof checker of its collations' library). Where it can't be read that is an
    error: the listed letters alone would give other results, and nobody would see it."""
    found = dict(LOOK_ALIKES)
    context = SparkContext._active_spark_context  # one for the process, whatever thread asks
    if context is None:
        raise RuntimeError("the table of confusables is read through Spark, and no Spark context is running")
    known = set("".join(found.values())) | set(CHEMICAL)
    letters = [chr(c) for c in (*range(0x180, 0xAC00), *range(0x10400, 0x10500)) if (unicodedata.category(chr(c)) in ("Lu", "Ll") or unicodedata.name(chr(c), "").startswith("LISU LETTER")) and len(unicodedata.normalize("NFKD", chr(c))) == 1 and chr(c) not in known]
    plain = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    try:
        checker = context._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        skeletons = dict(zip([*plain, *letters], checker.getSkeleton("\n".join([*plain, *letters])).split("\n"), strict=True))
    except (TypeError, ValueError, Py4JError) as error:
        raise RuntimeError("Spark's table of confusables can't be read: the library is not there, or cuts differently") from error
    by_skeleton: dict[str, list[str]] = {}
    for letter in plain:
        by_skeleton.setdefault(skeletons[letter], []).append(letter)
    for letter in letters:
        same = by_skeleton.get(skeletons[letter], ())
        upper = letter.isupper() or not letter.islower()
        chosen = next((p for p in same if p.isupper() == upper), None)
        if chosen and not unicodedata.name(letter, "").startswith("LATIN") or chosen and unicodedata.normalize("NFD", letter) == letter:
            found[chosen] = found.get(chosen, "") + letter
    return found


def _table(letters: dict[str, str]) -> tuple[str, str]:
    return "".join(letters.values()), "".join(k * len(v) for k, v in letters.items())


def _translate(column: str, pair: tuple[str, str]) -> str:
    return f"translate({column}, {_literal(pair[0])}, {_literal(pair[1])})"


def _roman(column: str) -> str:
    """SQL: Roman numbers of several letters."""
    for code in (*range(0x2160, 0x2180),):
        plain = unicodedata.normalize("NFKC", chr(code))
        if len(plain) > 1:
            column = f"replace({column}, '{chr(code)}', '{plain}')"
    return column


def _composed(column: str) -> str:
    """SQL: compose combining accents, by a fold over the accents' positions."""
    pairs = ", ".join(f"struct('{a}' as a, '{b}' as b)" for a, b in compositions())
    return f"case when {column} rlike '[{COMBINING}{KANA_MARKS}]' then aggregate(filter(array({pairs}), p -> contains({column}, p.a)), {column}, (s, p) -> replace(s, p.a, p.b)) else {column} end"


def _by_word(column: str, native: str, pair: tuple[str, str], others: str, spare: str = "") -> str:
    """SQL: translate the words that mix the native alphabet with look-alikes, and the words made of
    look-alikes alone where the value has no letter of ``others`` that is none. ``spare``: letters that
    may stand alone."""
    alike = "".join(sorted(set(pair[0])))
    alone = f"w rlike '^[{alike}]+$'" + (f" and not w rlike '^[{spare}]$'" if spare else "")
    return (
        f"array_join(transform(regexp_extract_all({column}, '[\\\\p{{L}}\\\\p{{M}}]+|[^\\\\p{{L}}\\\\p{{M}}]+', 0), w -> case "
        f"when w rlike '[{native}]' and w rlike '[{alike}]' and not (length(w) = 2 and w rlike '[{spare or chr(0xFFFF)}]') and not w rlike '^μ(?:g|l|m|mol|s|kat)$' then {_translate('w', pair)} "
        f"when {alone} and not {column} rlike '[{others}&&[^{alike}]]' and (length(w) > 1 or {column} rlike '[{native}]') then {_translate('w', pair)} else w end), '')"
    )


LATIN = r"A-Za-zÀ-ÖØ-öø-ɏ"


def clean_sql(value: str, language: str) -> str:
    """SQL: a value in the plain characters of its language."""
    signs, letters = compatibility(), compatibility(False)
    plain = f"case when {language} in ('zh', 'ja', 'ko') then {_translate(value, letters)} else {_translate(value, signs)} end"
    plain = f"regexp_replace(regexp_replace({_roman(plain)}, '(?!{JOINED_PICTURES})[{INVISIBLE}]', ''), '[{ODD_SPACES}]', ' ')"
    latin, russian, greek = _table(look_alikes()), _table({k: v for k, v in TO_RUSSIAN.items() if v not in ("", "3")}), _table({k: v for k, v in TO_GREEK.items() if v})
    foreign = r"\\p{IsCyrillic}\\p{IsGreek}\\p{IsArmenian}\\p{IsCherokee}\\p{IsCoptic}\\p{IsLisu}\\p{IsGlagolitic}\\p{IsGeorgian}\\p{IsDeseret}"
    words = (
        f"case when {language} = 'ru' then {_by_word('v', chr(92) * 2 + 'p{IsCyrillic}', russian, LATIN)} "
        f"when {language} = 'el' then {_by_word('v', chr(92) * 2 + 'p{IsGreek}', greek, LATIN)} "
        f"when {language} = 'ar' then {_translate('v', _table(TO_ARABIC))} "
        f"else {_by_word('v', LATIN, latin, foreign, CHEMICAL)} end"
    )
    # one value at a time through a one-element array names the steps without repeating them
    # look-alike letters may take their accents only once they are letters of the language; accents that no
    # letter takes (stress marks) go
    steps = f"transform(transform(transform(array({plain}), v -> {_composed('v')}), v -> {words}), v -> regexp_replace({_composed('v')}, '[{COMBINING}]', ''))[0]"
    return f"case when {value} rlike '[^\\\\x00-\\\\x7f]' then {steps} else {value} end"


@lru_cache(maxsize=None)
def _accents() -> tuple[str, str]:
    """European letters with accents, and their base letters."""
    kinds = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x386, 0x3CF), *range(0x400, 0x460))}
    kinds = {a: b for a, b in kinds.items() if a != b}
    return "".join(kinds), "".join(kinds.values())


@lru_cache(maxsize=None)
def _alike_for_comparison() -> tuple[str, str]:
    return _table({k: "".join(c for c in v if c not in "αβγδ") for k, v in look_alikes().items() if k.islower()})


def skeleton_sql(column: str) -> str:
    """SQL: a value for comparison alone: lower case, without accents and invisible characters, look-alikes
    of all alphabets as Latin letters (Greek letters of chemical names stay)."""
    folded = f"lower({_translate(_roman(_translate(column, compatibility())), _accents())})"
    return _translate(f"regexp_replace({folded}, '[{INVISIBLE}{COMBINING}]', '')", _alike_for_comparison())


def skeleton(text: str) -> str:
    """The same for a fixed word of the program."""
    text = text.translate(str.maketrans(*compatibility())).translate(str.maketrans(*_accents())).lower()
    return "".join(c for c in text if not 0x300 <= ord(c) <= 0x36F).translate(str.maketrans(*_alike_for_comparison()))


def consistent(spark: SparkSession, records: DataFrame) -> DataFrame:
    """``record_kind, record_id, value, canonical, out_of_line`` of each distinct record (``record_kind,
    record_id, language, value``).

    Null values stay null and in line; empty ones are a class of their own; a null language counts as a
    Latin one. Repeated rows give one record; ties between members go to the least; extra columns are
    ignored. Classes are made per language, so a value is never changed by another language's."""
    rows = sql_over(spark, "select distinct record_kind, record_id, coalesce(language, '') as language, value from {r}", r=records)
    # counts only choose among equals, so repeated rows may count; each distinct value is mapped once and written
    values = sql_over(spark, "select coalesce(language, '') as language, value, count(*) as records from {r} where value is not null group by all", r=records)
    mapped = sql_over(spark, f"select language, value, records, {clean_sql('value', 'language')} as mapped from {{v}}", v=values)
    judged = written(spark, sql_over(spark, f"select *, mapped <> value or value rlike '[{COMBINING}]' as out_of_line from {{m}}", m=mapped))
    classes = sql_over(
        spark,
        """
        select language, collate(mapped, 'UNICODE') as form,
               min_by(mapped, struct(out_of_line, -records, value)) as canonical
        from {j} group by language, collate(mapped, 'UNICODE')""",
        j=judged,
    )
    joined = written(spark, sql_over(spark, "select j.language, j.value, j.records, c.canonical, j.out_of_line from {j} j join {c} c on j.language = c.language and collate(j.mapped, 'UNICODE') = c.form", j=judged, c=classes))
    whole = join_counted(rows, joined, ["language", "value"], "records", "left")
    return whole.select("record_kind", "record_id", "value", "canonical", F.coalesce("out_of_line", F.lit(False)).alias("out_of_line"))


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Designation values, mention surfaces and folded lexical forms."""
    parts = (("designation", "designation", "designation_id", "value"), ("mention", "mentions", "mention_id", "surface"), ("lexical_form", "lexical_forms", "form_id", "folded"))
    frames = [table(spark, sf_dir, name).select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_id"), "language", F.col(column).alias("value")) for kind, name, key, column in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consistent(spark, all_records(spark, sf_dir)).where("out_of_line and not (canonical <=> value)").select("record_kind", "record_id")


def p2_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its consistent spelling."""
    return consistent(spark, all_records(spark, sf_dir)).select("record_kind", "record_id", F.col("canonical").alias("spelling"))


QUERIES = {"p2_found": p2_found, "p2_consistent": p2_consistent}
