"""String expressions: normal forms, variants and predicates. All are built-in expressions but two Unicode
normal forms, which run in Arrow batches and only over rows that are not plain ASCII."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.session import ship

# Fixed values of the analysis: patterns in Java's dialect.
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]+"
SENTENCE_BOUNDARY = r"(?:[ \t]*\r?\n){2,}[ \t]*|[!?;]+|\.(?!\p{Nd})|\r?\n(?=[ \t]*(?:[-*•]|\p{Nd}+[.)])[ \t])"
TOKEN = r"[\p{L}\p{N}]+(?:[./+\-][\p{L}\p{N}]+)*\+?"
# Abbreviations of whole phrases and what they stand for.
ABBREVIATIONS = {
    "afib": "atrial fibrillation", "a fib": "atrial fibrillation", "bph": "benign prostatic hyperplasia", "cabg": "coronary artery bypass graft",
    "cad": "coronary artery disease", "chf": "congestive heart failure", "ckd": "chronic kidney disease", "copd": "chronic obstructive pulmonary disease",
    "cva": "cerebrovascular accident", "dm": "diabetes mellitus", "dvt": "deep venous thrombosis", "esrd": "end stage renal disease", "fx": "fracture",
    "gerd": "gastroesophageal reflux disease", "hld": "hyperlipidemia", "htn": "hypertension", "mi": "myocardial infarction", "osa": "obstructive sleep apnea",
    "sob": "shortness of breath", "t2dm": "type 2 diabetes mellitus", "tha": "total hip arthroplasty", "tia": "transient ischemic attack",
    "tka": "total knee arthroplasty", "uti": "urinary tract infection",
}
# Match methods by their priority, best first.
METHODS = ("exact_preferred", "exact_alias", "variant_compact", "variant_abbreviation", "variant_singular")
# Words that make no candidate term by themselves.
CANDIDATE_STOPWORDS = (
    "a an and are as at be but by for from had has have he her his if in is it its no not of on or she that the their they this to was were will with "
    "patient patients denies reports history noted normal stable left right daily follow up plan continue review"
).split()
LONGEST_FORM = 80


def collapsed(text: Column) -> Column:
    """Runs of blanks as one space, none outside."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def is_ascii(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7f]*$")


def primary_form(text: str) -> str:
    """Python twin of the primary form: NFC, blanks collapsed."""
    return re.sub(r"[\s\x1c-\x1f\x85]+", " ", unicodedata.normalize("NFC", text)).strip()


def folded_form(primary: str) -> str:
    """Python twin of the folded form: full case folding, then NFC."""
    return unicodedata.normalize("NFC", primary.casefold())


def with_forms(df: DataFrame, column: str, primary: str = "primary", folded: str = "folded") -> DataFrame:
    """Add the primary and folded form of ``column``. ASCII rows stay in the JVM: Python sees a null for them.

    Null stays null, blanks become the empty string."""
    ship(df.sparkSession)

    @F.pandas_udf("p string, f string")
    def unicode_forms(texts: pd.Series) -> pd.DataFrame:
        first = [None if v is None else primary_form(v) for v in texts.array]
        return pd.DataFrame({"p": first, "f": [None if v is None else folded_form(v) for v in first]})

    plain = is_ascii(F.col(column))
    made = df.withColumn("_forms", unicode_forms(F.when(~plain, F.col(column))))
    made = made.withColumn(primary, F.when(plain, collapsed(F.col(column))).otherwise(F.col("_forms.p")))
    return made.withColumn(folded, F.when(plain, F.lower(F.col(primary))).otherwise(F.col("_forms.f"))).drop("_forms")


def transformations(original: Column, primary: Column, folded: Column, composed: Column) -> Column:
    """Which steps changed a text: ``composed`` is its NFC form."""
    steps = [
        F.when(composed != original, F.lit("unicode_nfc")), F.when(primary != composed, F.lit("collapse_whitespace")), F.when(folded != primary, F.lit("unicode_casefold_variant"))
    ]
    return F.array_compact(F.array(*steps))


def compact_form(folded: Column) -> Column:
    """Signs as spaces, single spaces between what remains."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[^0-9a-zÀ-ɏ ]+", " "), r"\s+", " "))


def singular_form(folded: Column) -> Column:
    """The last word in the singular: -ies becomes -y, a plain -s falls; short words and -ss, -us, -is, -es stay."""
    last = F.substring_index(folded, " ", -1)
    size = F.length(last)
    return (
        F.when((size > 4) & last.endswith("ies"), F.regexp_replace(folded, "ies$", "y"))
        .when((size > 3) & last.endswith("s") & ~last.rlike("(?:ss|us|is|es)$"), F.regexp_replace(folded, "s$", ""))
        .otherwise(folded)
    )


def variant_keys(folded: Column) -> Column:
    """array<struct<method, key>>: the variants of a folded phrase in their order, each key once, the phrase
    itself left out: compact, abbreviation (of the phrase and of the compact form), singular of all."""
    table = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    compact = compact_form(folded)
    first = [("variant_compact", compact), ("variant_abbreviation", table[folded]), ("variant_abbreviation", table[compact])]
    later = [("variant_singular", singular_form(key)) for _, key in first] + [("variant_singular", singular_form(folded))]
    listed = F.array(*[F.struct(F.lit(m).alias("method"), k.alias("key")) for m, k in first + later])
    return F.filter(
        listed,
        lambda x, i: x["key"].isNotNull() & (x["key"] != "") & (x["key"] != folded) & ~F.exists(F.slice(listed, F.lit(1), i), lambda y: F.coalesce(y["key"] == x["key"], F.lit(False))),
    )


def method_priority(method: Column) -> Column:
    return F.array_position(F.array(*[F.lit(m) for m in METHODS]), method).cast("int") - 1


def scrub_allows(form: Column) -> Column:
    """A form that may leave: at most 80 characters, no run of four digits, no contact sign, three letters or more."""
    return (F.length(form) <= LONGEST_FORM) & ~form.rlike(r"\p{Nd}{4,}") & ~form.rlike("[@#]") & (F.regexp_count(form, F.lit(r"\p{L}")) >= 3)


def candidate_reportable(primary: Column, folded: Column) -> Column:
    """A scrubbed form with at least one word that is no stop word."""
    stop = F.array(*[F.lit(w) for w in CANDIDATE_STOPWORDS])
    return scrub_allows(primary) & F.exists(F.split(folded, " "), lambda w: ~F.array_contains(stop, w))


def six_places(value: Column) -> Column:
    """A number as text with six decimals, halves to even."""
    return F.bround(value, 6).cast("decimal(20,6)").cast("string")


#: An edge of a word in any alphabet, the same on every version of the JVM.
WORD_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
# Canaries of personal data, one pattern each.
CANARIES = {
    "email": r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b(?:\+?1[-. ]?)?\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}\b",
    "record_number": r"(?i)\b(?:MRN|medical record number)\s*[:#-]?\s*[A-Z0-9-]{5,}\b",
}
