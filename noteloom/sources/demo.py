"""A small invented corpus with a terminology of two ambiguous and several plain concepts, for tests and trials."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from noteloom.functions.text import with_forms

SYSTEM, RELEASE = "urn:example:demo", "demo-1"
NOTES = [
    ("d1", "progress", "Heart attack noted. HTN under control. Special unmapped finding."),
    ("d2", "progress", "Heart attack noted. HTN under control. Special unmapped finding."),
    ("d3", "consult", "Heart attack noted. HTN under control. Special unmapped finding. No evidence of hypertension."),
    ("d4", "consult", "Family history:\nhypertension and MI\n\nAssessment:\nDiabetes mellitus, 5.0 units."),
]
CODES = [("C1", True), ("C2", True), ("C3", True), ("C4", True), ("C5", False)]
VALUES = [
    ("C1", "preferred", "Myocardial infarction"), ("C1", "alias", "Heart attack"), ("C2", "preferred", "Mitral insufficiency"), ("C2", "alias", "MI"), ("C3", "preferred", "Diabetes mellitus"),
    ("C4", "preferred", "Hypertension"), ("C1", "alias", "MI"), ("C5", "preferred", "Special unmapped finding"),
]


def documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, "en", t, x) for i, t, x in NOTES], "doc_id string, language string, note_type string, text string")


def terminology(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    coding = spark.createDataFrame([(SYSTEM, RELEASE, c, a) for c, a in CODES], "system_uri string, release_id string, code string, active boolean")
    values = spark.createDataFrame([(str(i), SYSTEM, RELEASE, c, k, "en", v) for i, (c, k, v) in enumerate(VALUES)], "designation_id string, system_uri string, release_id string, code string, kind string, language string, value string")
    return coding, with_forms(values, "value", "normalized_primary", "normalized_folded")


def write_tree(root: str) -> None:
    """The notes as text files."""
    for name, _, text in NOTES:
        target = Path(root) / "notes" / f"{name}.txt"
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text, encoding="utf-8")
