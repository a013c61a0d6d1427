"""Terminology: integrity checks, lookup of phrases by exact and variant keys, candidate sets, grounding.

Lookup is one equality join of the phrases' keys with the designations' keys, never a lookup for each phrase.
A code is evidence once however many designations hit; ambiguity is kept and counted, never resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noteloom.functions.text import METHODS, method_priority, variant_keys

RELEASE = ["system_uri", "release_id"]


#: Releases of one run at most; a run names them one by one.
MAX_RELEASES = 1_000


def releases(coding: DataFrame) -> DataFrame:
    return coding.select(*RELEASE).distinct()


def release_list(coding: DataFrame) -> list[tuple[str, str]]:
    """The releases of a run in order. They are a handful; more than ``MAX_RELEASES`` are an error."""
    rows = releases(coding).orderBy(*RELEASE).limit(MAX_RELEASES + 1).collect()
    if len(rows) > MAX_RELEASES:
        raise ValueError(f"more than {MAX_RELEASES} releases")
    return [(r["system_uri"], r["release_id"]) for r in rows]


def in_each_release(df: DataFrame, listed: list[tuple[str, str]]) -> DataFrame:
    """Every row once for each release: an array of the run's releases, exploded in place."""
    each = F.array(*[F.struct(F.lit(a).alias("system_uri"), F.lit(b).alias("release_id")) for a, b in listed])
    return df.withColumn("r", F.explode(each)).select(*df.columns, "r.*")


def active_designations(coding: DataFrame, designation: DataFrame) -> DataFrame:
    """Distinct designations of active codes, by release, code, kind and both normal forms."""
    active = coding.where("active").select(*RELEASE, "code")
    return designation.join(active, [*RELEASE, "code"], "left_semi").select(*RELEASE, "code", "kind", "normalized_primary", "normalized_folded").distinct()


def exact_lookup(keys: DataFrame, designations: DataFrame, kind: str, variant: str) -> DataFrame:
    """``key`` with the release and codes of designations of a kind whose primary or casefold form it is."""
    column = {"primary": "normalized_primary", "casefold": "normalized_folded"}[variant]
    listed = designations.where(F.col("kind") == kind).select(*RELEASE, "code", F.col(column).alias("key")).distinct()
    return keys.join(listed, "key")


def evidence(phrases: DataFrame, designations: DataFrame, variants: bool = True) -> DataFrame:
    """``primary`` with release, code, method and variant of every hit. ``phrases`` has distinct ``primary,
    folded``; without ``variants`` only exact keys are looked up."""
    keys = [F.struct(F.lit("primary").alias("form"), F.lit("exact").alias("method"), F.col("primary").alias("key")), F.struct(F.lit("folded").alias("form"), F.lit("exact").alias("method"), F.col("folded").alias("key"))]
    made = F.array(*keys)
    if variants:
        made = F.concat(made, F.transform(variant_keys(F.col("folded")), lambda v: F.struct(F.lit("folded").alias("form"), v["method"].alias("method"), v["key"].alias("key"))))
    asked = phrases.select("primary", F.explode(made).alias("k")).select("primary", "k.*")
    forms = F.array(F.struct(F.lit("primary").alias("form"), F.col("normalized_primary").alias("key")), F.struct(F.lit("folded").alias("form"), F.col("normalized_folded").alias("key")))
    listed = designations.select(*RELEASE, "code", "kind", F.explode(forms).alias("f")).select(*RELEASE, "code", "kind", "f.*").distinct()
    method = F.when(F.col("method") == "exact", F.when(F.col("kind") == "preferred", "exact_preferred").otherwise("exact_alias")).otherwise(F.col("method"))
    variant = F.when(F.col("method") != "exact", F.regexp_replace("method", "^variant_", "")).when(F.col("form") == "primary", "primary").otherwise("casefold")
    return asked.join(listed, ["form", "key"]).select("primary", *RELEASE, "code", method.alias("method"), variant.alias("variant")).distinct()


def hits(found: DataFrame) -> DataFrame:
    """Evidence by phrase, release and code: methods by priority, variants ('primary' first), best method and priority."""
    methods = F.transform(F.array_sort(F.collect_set(F.struct(method_priority(F.col("method")).alias("p"), F.col("method").alias("m")))), lambda x: x["m"])
    variants = F.transform(F.array_sort(F.collect_set(F.struct((F.col("variant") != "primary").alias("p"), F.col("variant").alias("v")))), lambda x: x["v"])
    grouped = found.groupBy("primary", *RELEASE, "code").agg(methods.alias("methods"), variants.alias("variants"))
    best = F.col("methods")[0]
    return grouped.withColumn("best_method", best).withColumn("priority", method_priority(best))


def ranked_candidates(found: DataFrame) -> DataFrame:
    """Hits with their dense rank by best method within phrase and release."""
    return hits(found).withColumn("rank", F.dense_rank().over(W.partitionBy("primary", *RELEASE).orderBy("priority")))


def candidate_sets(phrases: DataFrame, found: DataFrame, all_releases: list[tuple[str, str]]) -> DataFrame:
    """One row for each phrase and release, unmapped ones too: the candidates in order of priority and code,
    and the outcome. ``phrases`` may carry further columns; they are kept."""
    fields = ["code", "best_method", "methods", "variants", "rank"]
    grouped = (
        ranked_candidates(found).groupBy("primary", *RELEASE)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("priority", *fields))), lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("candidates"))
    )
    pairs = in_each_release(phrases, all_releases)
    size = F.coalesce(F.size("candidates"), F.lit(0))
    return (
        pairs.join(grouped, ["primary", *RELEASE], "left")
        .withColumn("candidate_count", F.when(F.col("candidates").isNull(), 0).otherwise(size))
        .withColumn("algorithmic_outcome", F.when(F.col("candidate_count") == 0, "unmapped").when(F.col("candidate_count") == 1, "grounded_unique").otherwise("grounded_ambiguous"))
        .withColumn("acceptance_state", F.when(F.col("candidate_count") > 0, "pending"))
    )


def outcomes(sets: DataFrame) -> DataFrame:
    """Candidate sets by system and outcome, and over all systems (null system)."""
    return sets.rollup("algorithmic_outcome", "system_uri").agg(F.count("*").alias("sets"), F.sum("candidate_count").alias("candidates")).where("algorithmic_outcome is not null")


def ungrounded(rows: DataFrame, coding: DataFrame) -> DataFrame:
    """Rows (with release and code) whose code is in no catalogue, active or not: must be empty."""
    return rows.join(coding.select(*RELEASE, "code").distinct(), [*RELEASE, "code"], "left_anti")


def terminology_violations(coding: DataFrame, designation: DataFrame, max_aliases: int = 32, code_pattern: str = r"[A-Za-z0-9.\-]+", longest_code: int = 64) -> DataFrame:
    """``check, system_uri, code, detail`` of every breach: codes not unique, of a wrong form, without exactly
    one preferred value in a language that has any, with too many aliases; designations of unknown codes, of
    an unknown kind, empty, or repeated."""
    unique = designation.select(*RELEASE, "code", "kind", "language", "value").distinct()
    empty = F.col("value").isNull() | (F.trim("value") == "")
    parts = {
        "code_repeated": coding.groupBy("system_uri", "code").agg(F.count("*").alias("n")).where("n > 1").select("system_uri", "code", F.col("n").cast("string").alias("detail")),
        "code_form": coding.where(F.col("code").isNull() | ~F.col("code").rlike(rf"\A(?:{code_pattern})\z") | (F.length("code") > longest_code)).select("system_uri", "code", F.lit(None).cast("string").alias("detail")),
        "preferred_count": unique.groupBy("system_uri", "code", "language").agg(F.count_if(F.col("kind") == "preferred").alias("n")).where("n > 1").select("system_uri", "code", F.concat_ws(":", "language", F.col("n").cast("string")).alias("detail")),
        "no_preferred": coding.join(designation.where("kind = 'preferred'").select(*RELEASE, "code"), [*RELEASE, "code"], "left_anti").select("system_uri", "code", F.lit(None).cast("string").alias("detail")),
        "too_many_aliases": unique.where("kind = 'alias'").groupBy("system_uri", "code").agg(F.count("*").alias("n")).where(F.col("n") > max_aliases).select("system_uri", "code", F.col("n").cast("string").alias("detail")),
        "dangling": designation.join(coding.select(*RELEASE, "code"), [*RELEASE, "code"], "left_anti").select("system_uri", "code", F.col("designation_id").cast("string").alias("detail")),
        "kind": designation.where(~F.coalesce(F.col("kind").isin("preferred", "alias"), F.lit(False))).select("system_uri", "code", F.col("designation_id").cast("string").alias("detail")),
        "empty": designation.where(empty).select("system_uri", "code", F.col("designation_id").cast("string").alias("detail")),
        "repeated": designation.groupBy(*RELEASE, "code", "kind", "language", "value").agg(F.count("*").alias("n")).where("n > 1").select("system_uri", "code", F.concat_ws(":", "kind", "language", "value").alias("detail")),
    }
    found = [part.select(F.lit(name).alias("check"), "system_uri", "code", "detail") for name, part in parts.items()]
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    return whole


__all__ = ["METHODS", "RELEASE", "active_designations", "candidate_sets", "evidence", "exact_lookup", "hits", "outcomes", "ranked_candidates", "releases", "terminology_violations", "ungrounded"]
