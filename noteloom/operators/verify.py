"""Checks of protected tables, each a query whose rows are violations: ``check, key, detail``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteloom.functions.text import METHODS, candidate_reportable, scrub_allows
from noteloom.operators.context import LABELS
from noteloom.operators.matching import RELEASE, evidence

CODE = [*RELEASE, "code"]
SCORE = r"\A-?[0-9]+\.[0-9]{6}\z"


def _key(*columns: str) -> Column:
    return F.concat_ws("|", *columns)


def _rows(name: str, df: DataFrame, key: list[str], detail: str | None = None) -> DataFrame:
    return df.select(F.lit(name).alias("check"), _key(*key).alias("key"), (F.col(detail).cast("string") if detail else F.lit(None).cast("string")).alias("detail"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def coding_violations(coding_counts: DataFrame, coding: DataFrame, floor: int) -> DataFrame:
    n = F.col("exact_match_document_count")
    return _union([
        _rows("coding_ungrounded", coding_counts.join(coding.select(*CODE), CODE, "left_anti"), CODE), _rows("coding_floor", coding_counts.where(n < floor), CODE, "exact_match_document_count"),
        _rows("coding_occurrences", coding_counts.where((F.col("exact_match_occurrence_count") < n) | (F.col("distinct_matched_form_count") < 1)), CODE),
        _rows("coding_repeated", coding_counts.groupBy(*CODE).count().where("count > 1"), CODE, "count"),
    ])


def ambiguity_violations(ambiguity: DataFrame, releases: DataFrame) -> DataFrame:
    zeros = [(F.col(c) == 0).cast("int") for c in ("ambiguous_document_count", "ambiguous_form_count", "ambiguous_occurrence_count")]
    return _union([
        _rows("ambiguity_missing", releases.join(ambiguity.select(*RELEASE), RELEASE, "left_anti"), RELEASE), _rows("ambiguity_unknown", ambiguity.join(releases, RELEASE, "left_anti"), RELEASE),
        _rows("ambiguity_zeros", ambiguity.where((zeros[0] + zeros[1] + zeros[2]).isin(1, 2)), RELEASE), _rows("ambiguity_repeated", ambiguity.groupBy(*RELEASE).count().where("count > 1"), RELEASE, "count"),
    ])


def context_violations(context_counts: DataFrame, coding_counts: DataFrame, floor: int) -> DataFrame:
    joined = context_counts.join(coding_counts.select(*CODE, "exact_match_document_count"), CODE, "left")
    key = [*CODE, "context"]
    return _union([
        _rows("context_label", context_counts.where(~F.col("context").isin(*LABELS)), key), _rows("context_floor", context_counts.where(F.col("document_count") < floor), key, "document_count"),
        _rows("context_without_coding", joined.where("exact_match_document_count is null"), key), _rows("context_exceeds_coding", joined.where("document_count > exact_match_document_count"), key, "document_count"),
        _rows("context_repeated", context_counts.groupBy(*key).count().where("count > 1"), key, "count"),
    ])


def lexical_violations(lexical: DataFrame, coding: DataFrame, floor: int, approved: bool = True) -> DataFrame:
    key = [*CODE, "form", "context"]
    return _union([
        _rows("lexical_not_approved", lexical.where(F.lit(not approved)), key), _rows("lexical_scrub", lexical.where(~scrub_allows(F.col("form"))), key), _rows("lexical_floor", lexical.where(F.col("document_count") < floor), key, "document_count"),
        _rows("lexical_method", lexical.where(~F.col("match_method").isin(*METHODS)), key, "match_method"), _rows("lexical_ungrounded", lexical.join(coding.select(*CODE), CODE, "left_anti"), key),
        _rows("lexical_repeated", lexical.groupBy(*key).count().where("count > 1"), key, "count"),
    ])


def candidate_violations(candidates: DataFrame, phrases: DataFrame, designations: DataFrame, floor: int) -> DataFrame:
    """``phrases`` (``primary, folded``) gives the folded forms: no candidate may have a hit, variants included."""
    with_folded = candidates.join(phrases.select(F.col("primary").alias("form"), "folded"), "form", "left")
    found = evidence(with_folded.select(F.col("form").alias("primary"), F.coalesce("folded", F.lower("form")).alias("folded")).distinct(), designations)
    ranks = candidates.agg(F.count("*").alias("n"), F.count_distinct("rank").alias("d"), F.coalesce(F.min("rank"), F.lit(1)).alias("a"), F.coalesce(F.max("rank"), F.lit(0)).alias("b"))
    return _union([
        _rows("candidate_groundable", candidates.join(found.select(F.col("primary").alias("form")).distinct(), "form", "left_semi"), ["form"]),
        _rows("candidate_floor", candidates.where(F.col("document_count") < floor), ["form"], "document_count"), _rows("candidate_scrub", with_folded.where(~candidate_reportable(F.col("form"), F.coalesce("folded", F.lower("form")))), ["form"]),
        _rows("candidate_score", candidates.where(~F.col("salience").rlike(SCORE)), ["form"], "salience"),
        ranks.where("n <> d or (n > 0 and (a <> 1 or b <> n))").select(F.lit("candidate_ranks").alias("check"), F.lit("").alias("key"), F.col("n").cast("string").alias("detail")),
    ])


def association_violations(associations: DataFrame, coding_counts: DataFrame, context_counts: DataFrame, floor: int) -> DataFrame:
    key = [f"{c}_{s}" for s in "ab" for c in CODE]
    side = lambda s: F.struct(*[F.col(f"{c}_{s}") for c in CODE])
    parts = [
        _rows("association_order", associations.where(~(side("a") < side("b"))), key), _rows("association_floor", associations.where(F.col("cooccurrence_document_count") < floor), key, "cooccurrence_document_count"),
        _rows("association_bounds", associations.where("cooccurrence_document_count > least(document_count_a, document_count_b)"), key), _rows("association_score", associations.where(~F.col("npmi").rlike(SCORE)), key, "npmi"),
    ]
    current = context_counts.where("context = 'current_clinical'").select(*CODE, F.col("document_count").alias("current"))
    for s in "ab":
        counted = coding_counts.select(*[F.col(c).alias(f"{c}_{s}") for c in CODE], F.col("exact_match_document_count").alias("coded")).join(current.toDF(*[f"{c}_{s}" for c in CODE], "current"), [f"{c}_{s}" for c in CODE], "left")
        joined = associations.join(counted, [f"{c}_{s}" for c in CODE], "left")
        wrong = (F.col(f"document_count_{s}") > F.col("coded")) | (F.col("current").isNotNull() & (F.col("current") != F.col(f"document_count_{s}")))
        parts.append(_rows(f"association_documents_{s}", joined.where(wrong), key, f"document_count_{s}"))
    return _union(parts)


def order_violations(lines: DataFrame, key: list[str]) -> DataFrame:
    """Rows (``position`` and key columns) that don't follow the row before them in strictly increasing order.
    The row before is joined by position, so a long artifact needs no single window."""
    k = F.struct(*key)
    before = lines.select((F.col("position") + 1).alias("position"), k.alias("before"))
    return _rows("order", lines.join(before, "position").where(~(F.col("before") < k)), ["position"])
