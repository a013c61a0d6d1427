import pytest
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.operators.context import label_mentions, mentions_with_context, sections


def label(text, phrase):
    start = text.index(phrase)
    return next(x for a, b, _, x in label_mentions(text, 1, 4) if (a, b) == (start, start + len(phrase)))


@pytest.mark.parametrize(
    ("text", "phrase", "expected"),
    [
        ("Reports of fever and cough.", "fever", "current_clinical"), ("No evidence of fever today.", "fever", "negated"), ("She denies chest pain.", "chest pain", "negated"),
        ("Sepsis was ruled out.", "Sepsis", "negated"), ("No fever but reports cough.", "cough", "current_clinical"), ("No fever seen.", "No fever", "current_clinical"),
        ("His mother had gout.", "gout", "non_patient"), ("Family history of no gout.", "gout", "negated"), ("Family history of prior stroke.", "stroke", "non_patient"),
        ("History of stroke.", "stroke", "historical"), ("Pneumonia has resolved.", "Pneumonia", "historical"), ("Stroke in 2019. Chest pain today.", "Chest pain", "current_clinical"),
        ("Denies chest pain. Fever seen.", "Fever", "current_clinical"), ("No pain at rest and the vitals were stable then fever came.", "fever", "current_clinical"),
        ("Past Medical History:\nasthma\n\nPlan:\nrest", "asthma", "historical"), ("Past Medical History:\nasthma\n\nPlan:\nrest", "rest", "current_clinical"), ("Odd Header:\ngout\n", "gout", "current_clinical"),
    ],
)
def test_labels(text, phrase, expected):
    assert label(text, phrase) == expected


def test_sections_close_at_known_headers_only():
    assert [x[2] for x in sections("Family History:\na\nOther:\nb\nPMH: c")] == ["non_patient", "historical"]


def test_context_occurrences_are_partitioned(spark):
    rows = [("a", "en", "n", "No gout. Gout. Mother had gout."), ("b", "en", "n", ""), ("c", "en", "n", None)]
    got = {(r["primary"], r["context"]): r["n"] for r in mentions_with_context(spark.createDataFrame(rows, "doc_id string, language string, note_type string, text string"), 1, 1).collect()}
    assert got[("gout", "negated")] == 1 and got[("Gout", "current_clinical")] == 1 and got[("gout", "non_patient")] == 1


def test_forms_and_variants(spark):
    values = ["  Café\t5.0 mg/mL ", "Café", "STRASSE ß", "", None, "allergies", "diabetes", "knee replacements", "copd/asthma", "htn", "lupus"]
    df = T.with_forms(spark.createDataFrame([(v,) for v in values], "v string"), "v")
    got = {r["v"]: (r["primary"], r["folded"]) for r in df.collect()}
    assert got["  Café\t5.0 mg/mL "] == ("Café 5.0 mg/mL", "café 5.0 mg/ml") and got["Café"][0] == "Café" and got["STRASSE ß"][1] == "strasse ss" and got[None] == (None, None) and got[""] == ("", "")
    keys = {r["v"]: [(k["method"], k["key"]) for k in r["k"]] for r in df.where("v is not null").select("v", T.variant_keys(F.col("folded")).alias("k")).collect()}
    assert keys["allergies"] == [("variant_singular", "allergy")] and keys["diabetes"] == [] and keys["lupus"] == [] and keys["knee replacements"] == [("variant_singular", "knee replacement")]
    assert keys["copd/asthma"] == [("variant_compact", "copd asthma")] and keys["htn"] == [("variant_abbreviation", "hypertension")]


def test_scrub(spark):
    df = spark.createDataFrame([("Heart attack",), ("room 1234",), ("a@b cde",), ("ab",), ("x" * 81,), ("with patient",)], "f string")
    got = [(r[0], r[1]) for r in df.select(T.scrub_allows(F.col("f")), T.candidate_reportable(F.col("f"), F.col("f"))).collect()]
    assert got == [(True, True), (False, False), (False, False), (False, False), (False, False), (True, False)]
