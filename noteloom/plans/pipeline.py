"""Whole runs: mine, match, aggregate, publish. A run names its tables and its fingerprint; nothing of a corpus
but aggregates is written by a protected run."""

from __future__ import annotations

import json
import shutil
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.contracts import SECURITY, Config, ContractError, check_attestation, digest, publish, write_atomic
from noteloom.operators import curation, export, matching, mining, protected, verify
from noteloom.operators.context import mentions_with_context
from noteloom.session import remove_folder, written
from noteloom.sources.corpus import as_documents, read_text_tree

ORDERS = {
    "phrase_aggregates": ["language", "primary_normalized_form", "token_count"], "candidate_sets": ["language", "primary_normalized_form", "token_count", "system_uri", "release_id"],
    "coding_counts": ["system_uri", "release_id", "code"], "ambiguity_counts": ["system_uri", "release_id"], "context_counts": ["system_uri", "release_id", "code", "context"],
    "lexical_forms": ["system_uri", "release_id", "code", "form", "context"], "candidate_terms": ["rank"],
    "associations": ["system_uri_a", "release_id_a", "code_a", "system_uri_b", "release_id_b", "code_b"],
}


def _write(tables: dict[str, DataFrame], out: str, report: dict) -> dict:
    """Write tables as ordered canonical lines below ``out`` and their report, published in one step.

    The digest of a table is over its rows as a set, so that it doesn't depend on partitions."""
    target = Path(out)
    staged = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        artifacts = {}
        for name, df in tables.items():
            export.write_jsonl(df, f"file://{staged.resolve()}/{name}.jsonl", ORDERS[name])
            lines = df.sparkSession.read.text(f"file://{staged.resolve()}/{name}.jsonl")
            got = mining.content_digest(lines, "value").first()
            artifacts[name] = {"rows": got["rows"], "sha256": got["digest"]}
        report = report | {"artifacts": artifacts, "run_fingerprint": digest({"artifacts": artifacts, "inputs": report.get("inputs", {})}, "noteloom-run-v1")}
        write_atomic(staged / "run_report.json", json.dumps(report, sort_keys=True).encode() + b"\n")
        publish(staged, target)
    finally:
        shutil.rmtree(staged, ignore_errors=True)
    return report


def run_analysis(spark: SparkSession, documents: DataFrame, coding: DataFrame, designation: DataFrame, config: Config, out: str, decisions: DataFrame | None = None) -> dict:
    """The open run: phrase aggregates and candidate sets with curation. ``documents`` has ``doc_id, language,
    note_type, text``; the configuration must fit it. Every emitted code is checked against its catalogue."""
    listed = matching.release_list(coding)
    seen = documents.select("language", "note_type").distinct().limit(10_001).collect()
    config.check({r["language"] for r in seen}, {r["note_type"] for r in seen}, set(listed))
    limits = config.mining
    counted = written(spark, mining.counted_mentions(documents, limits.min_ngram_tokens, limits.max_ngram_tokens))
    phrases = written(spark, mining.phrase_aggregates(counted, documents.count(), limits.min_document_frequency))
    if phrases.count() > limits.max_unique_phrases:
        raise ContractError("RESOURCE_LIMIT", "The run exceeds the configured number of phrases.", "analysis", SECURITY)
    found = written(spark, matching.evidence(phrases.select("primary", "folded").distinct(), matching.active_designations(coding, designation)))
    if matching.ungrounded(found, coding).limit(1).count():
        raise ContractError("GROUNDING_FAILED", "A code is absent from its release.", "analysis")
    sets = matching.candidate_sets(phrases, found, listed)
    if decisions is not None:
        if curation.chain_violations(decisions).limit(1).count():
            raise ContractError("CURATION_INVALID", "The decision chain is broken.", "curation")
        states = curation.curated(matching.ranked_candidates(found), curation.latest_decisions(decisions)).withColumnRenamed("acceptance_state", "curated")
        sets = sets.join(states, ["primary", *matching.RELEASE], "left").withColumn("acceptance_state", F.coalesce("curated", "acceptance_state")).drop("curated")
    tables = {
        "phrase_aggregates": phrases.withColumnRenamed("primary", "primary_normalized_form").drop("folded"),
        "candidate_sets": sets.withColumnRenamed("primary", "primary_normalized_form").drop("folded", "display", "max_sublinear_tf_idf", "candidate_count"),
    }
    outcome = {f"{r['algorithmic_outcome']}|{r['system_uri'] or ''}": r["sets"] for r in matching.outcomes(sets).collect()}
    report = _write(tables, out, {"inputs": {"releases": [list(x) for x in listed], "languages": list(config.languages)}, "outcomes": outcome, "status": "succeeded"})
    for df in (counted, phrases, found):
        remove_folder(spark, df.inputFiles()[0].rsplit("/", 1)[0]) if df.inputFiles() else None
    return report


def protected_tables(spark: SparkSession, documents: DataFrame, coding: DataFrame, designation: DataFrame, limits: protected.Limits, approved: bool, shortest: int = 1, longest: int = 4) -> tuple[protected.Protected, DataFrame, DataFrame]:
    """A protected run's tables with its cube and evidence, each of which is written once and read by all tables."""
    mined = mentions_with_context(documents, shortest, longest)
    cube = written(spark, mined.groupBy("primary", "doc_id", "context").agg(F.min("folded").alias("folded"), F.min("token_count").alias("token_count"), F.sum("n").alias("n")))
    found = written(spark, matching.evidence(protected.phrases_of(cube), matching.active_designations(coding, designation)))
    return protected.protect(cube, found, matching.release_list(coding), documents.count(), limits, approved), cube, found


def run_protected(spark: SparkSession, corpus_root: str, coding: DataFrame, designation: DataFrame, attestation: str, out: str, limits: protected.Limits | None = None) -> dict:
    """The protected run over a tree of texts: the gate first, then six tables and a report of counters."""
    approved = check_attestation(attestation)
    limits = limits or protected.Limits()
    documents = as_documents(read_text_tree(spark, corpus_root))
    if not documents.limit(1).count():
        raise ContractError("CORPUS_EMPTY", "The corpus has no text files.", "corpus")
    tables, cube, found = protected_tables(spark, documents, coding, designation, limits, approved)
    counters = {r["counter"]: r["value"] for r in tables.privacy_counters.collect()}
    if counters["association_pair_count"] > limits.max_association_pairs:
        raise ContractError("RESOURCE_LIMIT", "The association pair count exceeds its limit.", "analysis", SECURITY)
    counters |= {"candidate_terms_truncated": counters.pop("reportable_candidate_term_count") > limits.max_candidate_terms, "lexical_output_approved": approved, "min_cell_document_count": limits.min_cell_document_count}
    named = {n: getattr(tables, n) for n in ("coding_counts", "ambiguity_counts", "context_counts", "lexical_forms", "candidate_terms", "associations")}
    totals = mining.corpus_totals(documents).first().asDict()
    return _write(named, out, {"inputs": {"releases": [list(x) for x in matching.release_list(coding)]}, "privacy": counters, "processing_totals": totals, "status": "succeeded"})


def verify_protected(spark: SparkSession, out: str, coding: DataFrame, designation: DataFrame, floor: int, approved: bool = True) -> DataFrame:
    """All violations of a published protected run: its tables against each other and the terminology, and its
    artifacts against the digests of its report."""
    report = json.loads((Path(out) / "run_report.json").read_bytes())
    base = f"file://{Path(out).resolve()}"
    read = {n: spark.read.schema(SCHEMAS[n]).json(f"{base}/{n}.jsonl") for n in SCHEMAS}
    parts = [
        verify.coding_violations(read["coding_counts"], coding, floor), verify.ambiguity_violations(read["ambiguity_counts"], matching.releases(coding)), verify.context_violations(read["context_counts"], read["coding_counts"], floor),
        verify.lexical_violations(read["lexical_forms"], coding, floor, approved), verify.association_violations(read["associations"], read["coding_counts"], read["context_counts"], floor),
        verify.candidate_violations(read["candidate_terms"], spark.createDataFrame([], "primary string, folded string"), matching.active_designations(coding, designation), floor),
    ]
    for name in SCHEMAS:
        lines = spark.read.text(f"{base}/{name}.jsonl")
        stated = report["artifacts"].get(name, {})
        got = mining.content_digest(lines, "value").where((F.col("digest") != F.lit(stated.get("sha256", ""))) | (F.col("rows") != F.lit(stated.get("rows", -1))))
        parts.append(got.select(F.lit("artifact_digest").alias("check"), F.lit(name).alias("key"), F.col("digest").alias("detail")))
        again = export.canonical_json(read[name])
        parts.append(lines.select(F.col("value").alias("line")).exceptAll(again).select(F.lit("not_canonical").alias("check"), F.lit(name).alias("key"), F.substr("line", F.lit(1), F.lit(80)).alias("detail")))
    return reduce(DataFrame.unionByName, parts)


_CODE = "system_uri string, release_id string, code string"
SCHEMAS = {
    "coding_counts": f"{_CODE}, distinct_matched_form_count long, exact_match_document_count long, exact_match_occurrence_count long",
    "ambiguity_counts": "system_uri string, release_id string, ambiguous_document_count long, ambiguous_form_count long, ambiguous_occurrence_count long",
    "context_counts": f"{_CODE}, context string, document_count long, occurrence_count long",
    "lexical_forms": f"{_CODE}, form string, match_method string, context string, document_count long, occurrence_count long",
    "candidate_terms": "form string, document_count long, occurrence_count long, current_clinical_document_count long, token_count int, rank int, salience string",
    "associations": "system_uri_a string, release_id_a string, code_a string, system_uri_b string, release_id_b string, code_b string, cooccurrence_document_count long, document_count_a long, document_count_b long, npmi string",
}
