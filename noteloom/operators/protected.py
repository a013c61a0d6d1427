"""Aggregates that may leave a protected corpus: six tables and the counters of what was held back.

All derive from one cube of mentions, ``primary, folded, token_count, doc_id, context, n``, and from the hits
of its distinct phrases. A code is counted from phrases that are unique in its release; counts of
documents are distinct over the phrases of a code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from noteloom.functions.text import candidate_reportable, scrub_allows, six_places
from noteloom.operators.matching import RELEASE, hits, in_each_release

CODE = [*RELEASE, "code"]


@dataclass(frozen=True)
class Limits:
    """Floors and caps of a run. ``max_association_pairs`` is an error, ``max_candidate_terms`` a top-k report."""

    min_cell_document_count: int = 3
    max_candidate_terms: int = 5_000
    max_association_codes_per_document: int = 150
    max_association_pairs: int = 1_000_000
    max_candidates_per_phrase_system: int = 100

    def __post_init__(self) -> None:
        # The hard ceilings.
        for name, least, most in (("min_cell_document_count", 1, 1_000), ("max_candidate_terms", 1, 100_000), ("max_association_codes_per_document", 1, 500), ("max_association_pairs", 1, 5_000_000), ("max_candidates_per_phrase_system", 1, 100)):
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be {least}..{most}")


def cube_of(mentions: DataFrame) -> DataFrame:
    """The cube of a table of mentions (``mention_id, doc_id, primary_form, folded, token_count, context``);
    a repeated mention counts once, a null context is current."""
    rows = mentions.where("primary_form is not null and doc_id is not null").select("mention_id", "doc_id", F.col("primary_form").alias("primary"), "folded", "token_count", F.coalesce("context", F.lit("current_clinical")).alias("context")).distinct()
    return rows.groupBy("primary", "doc_id", "context").agg(F.min("folded").alias("folded"), F.min("token_count").alias("token_count"), F.count("*").alias("n"))


def phrases_of(cube: DataFrame) -> DataFrame:
    return cube.groupBy("primary").agg(F.min("folded").alias("folded"), F.min("token_count").alias("token_count"))


def split_hits(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hits of phrases that are unique in a release (with code and method), and phrases ambiguous in one."""
    counted = hits(evidence).withColumn("codes", F.count("*").over(W.partitionBy("primary", *RELEASE)))
    unique = counted.where("codes = 1").select("primary", *CODE, F.col("best_method").alias("match_method"))
    return unique, counted.where("codes > 1").select("primary", *RELEASE).distinct()


def coded_cells(cube: DataFrame, unique: DataFrame) -> DataFrame:
    """The cube of codes: release, code, document, context, with occurrences and forms still apart."""
    return cube.select("primary", "doc_id", "context", "n").join(unique, "primary")


def code_totals(cells: DataFrame) -> DataFrame:
    """Every code's documents, occurrences and forms, before any floor."""
    documents = cells.groupBy(*CODE, "doc_id").agg(F.sum("n").alias("n")).groupBy(*CODE).agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))
    forms = cells.groupBy(*CODE, "primary").agg(F.lit(1).alias("one")).groupBy(*CODE).agg(F.count("*").alias("forms"))
    return documents.join(forms, CODE)


def coding_counts(totals: DataFrame, limits: Limits) -> DataFrame:
    return totals.where(F.col("documents") >= limits.min_cell_document_count).select(
        *CODE, F.col("forms").alias("distinct_matched_form_count"), F.col("documents").alias("exact_match_document_count"), F.col("occurrences").alias("exact_match_occurrence_count")
    )


def ambiguity_counts(cube: DataFrame, ambiguous: DataFrame, all_releases: list[tuple[str, str]]) -> DataFrame:
    """Documents, forms and occurrences of ambiguous phrases, a row for every release, without a floor."""
    cells = cube.select("primary", "doc_id", "n").join(ambiguous, "primary")
    documents = cells.groupBy(*RELEASE, "doc_id").agg(F.sum("n").alias("n")).groupBy(*RELEASE).agg(F.count("*").alias("ambiguous_document_count"), F.sum("n").alias("ambiguous_occurrence_count"))
    forms = cells.select(*RELEASE, "primary").distinct().groupBy(*RELEASE).agg(F.count("*").alias("ambiguous_form_count"))
    every = in_each_release(cube.sparkSession.range(1).select(F.col("id").alias("one")), all_releases).drop("one")
    names = ["ambiguous_document_count", "ambiguous_form_count", "ambiguous_occurrence_count"]
    return every.join(documents.join(forms, RELEASE), RELEASE, "left").select(*RELEASE, *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def context_cells(cells: DataFrame, totals: DataFrame, limits: Limits) -> DataFrame:
    """Codes by context, for codes that reach the floor in all; cells below it are still here."""
    kept = totals.where(F.col("documents") >= limits.min_cell_document_count).select(*CODE)
    return (
        cells.join(kept, CODE, "left_semi").groupBy(*CODE, "context", "doc_id").agg(F.sum("n").alias("n"))
        .groupBy(*CODE, "context").agg(F.count("*").alias("document_count"), F.sum("n").alias("occurrence_count"))
    )


def lexical_cells(cells: DataFrame) -> DataFrame:
    """Codes by form and context with the form's match method, before scrubbing and floor."""
    return cells.groupBy(*CODE, F.col("primary").alias("form"), "match_method", "context").agg(F.count_distinct("doc_id").alias("document_count"), F.sum("n").alias("occurrence_count"))


def unmapped_phrases(cube: DataFrame, evidence: DataFrame) -> DataFrame:
    """Phrases without a hit in any release, with the counts that candidate terms are ranked by."""
    left = cube.join(evidence.select("primary").distinct(), "primary", "left_anti")
    by_document = left.groupBy("primary", "doc_id").agg(F.sum("n").alias("n"), F.max((F.col("context") == "current_clinical").cast("int")).alias("current"), F.min("folded").alias("folded"), F.min("token_count").alias("token_count"))
    return by_document.groupBy("primary").agg(
        F.count("*").alias("document_count"), F.sum("n").alias("occurrence_count"), F.max("n").alias("most"), F.sum("current").alias("current_clinical_document_count"), F.min("folded").alias("folded"), F.min("token_count").alias("token_count")
    )


def candidate_terms(unmapped: DataFrame, documents: int, limits: Limits) -> DataFrame:
    """The top candidate terms, floored, scrubbed and ranked by documents, occurrences and form."""
    order = [F.desc("document_count"), F.desc("occurrence_count"), F.asc("primary")]
    top = unmapped.where((F.col("document_count") >= limits.min_cell_document_count) & candidate_reportable(F.col("primary"), F.col("folded"))).orderBy(*order).limit(limits.max_candidate_terms)
    salience = (1 + F.log("most")) * (F.log((F.lit(documents) + 1) / (F.col("document_count") + 1)) + 1)
    # the report is at most max_candidate_terms rows, so one window over it is bounded
    return top.withColumn("rank", F.row_number().over(W.orderBy(*order))).select(
        F.col("primary").alias("form"), "document_count", "occurrence_count", "current_clinical_document_count", "token_count", "rank", six_places(salience).alias("salience")
    )


def association_pairs(cells: DataFrame, documents: int, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Pairs of codes in current mentions of a document, below the floor too, with NPMI as text; and the
    documents left out of pairing (``doc_id, codes``) because they have too many codes.

    Sizes are counted first, so that no list of codes longer than the cap is ever gathered."""
    current = cells.where("context = 'current_clinical'").select("doc_id", F.struct(*CODE).alias("code")).distinct()
    sizes = current.groupBy("doc_id").agg(F.count("*").alias("codes"))
    most = limits.max_association_codes_per_document
    small = current.join(sizes.where(F.col("codes").between(2, most)).select("doc_id"), "doc_id", "left_semi")
    lists = small.groupBy("doc_id").agg(F.sort_array(F.collect_list("code")).alias("codes"))
    pairs = (
        lists.select(F.posexplode("codes").alias("at", "a"), "codes").select("a", F.explode(F.expr("slice(codes, at + 2, size(codes))")).alias("b"))
        .groupBy("a", "b").agg(F.count("*").alias("cooccurrence_document_count"))
    )
    counts = current.groupBy("code").agg(F.count("*").alias("n"))
    n = F.lit(float(documents))
    p, pa_, pb = F.col("cooccurrence_document_count") / n, F.col("document_count_a") / n, F.col("document_count_b") / n
    scored = (
        pairs.join(counts.select(F.col("code").alias("a"), F.col("n").alias("document_count_a")), "a").join(counts.select(F.col("code").alias("b"), F.col("n").alias("document_count_b")), "b")
        .select(
            *[F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in "ab" for c in CODE], "cooccurrence_document_count", "document_count_a", "document_count_b",
            six_places(F.when(p >= 1, 1.0).otherwise(F.log(p / (pa_ * pb)) / -F.log(p))).alias("npmi"),
        )
    )
    return scored, sizes.where(F.col("codes") > most)


@dataclass(frozen=True)
class Protected:
    """The tables of a protected run, none of them computed yet."""

    coding_counts: DataFrame
    ambiguity_counts: DataFrame
    context_counts: DataFrame
    lexical_forms: DataFrame
    candidate_terms: DataFrame
    associations: DataFrame
    privacy_counters: DataFrame


def protect(cube: DataFrame, evidence: DataFrame, all_releases: list[tuple[str, str]], documents: int, limits: Limits, lexical_output_approved: bool = True) -> Protected:
    """All tables of a run over a cube and the evidence of its phrases; without approval the lexical ones are empty."""
    floor = F.lit(limits.min_cell_document_count)
    unique, ambiguous = split_hits(evidence)
    cells = coded_cells(cube, unique)
    totals = code_totals(cells)
    contexts = context_cells(cells, totals, limits)
    gate = F.lit(lexical_output_approved)
    lexical = lexical_cells(cells).where(gate)
    unmapped = unmapped_phrases(cube, evidence).where(gate)
    pairs, skipped = association_pairs(cells, documents, limits)
    reportable = (F.col("document_count") >= floor) & candidate_reportable(F.col("primary"), F.col("folded"))
    scrubbed_forms = lexical.where(~scrub_allows(F.col("form"))).select(*CODE, "form").distinct()

    def counter(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("value")).select(F.lit(name).alias("counter"), "value")

    counted = [
        counter("suppressed_coding_row_count", totals.where(F.col("documents") < floor)), counter("suppressed_context_row_count", contexts.where(F.col("document_count") < floor)),
        counter("scrubbed_lexical_form_count", scrubbed_forms), counter("suppressed_lexical_form_count", lexical.where(scrub_allows(F.col("form")) & (F.col("document_count") < floor))),
        counter("suppressed_candidate_term_count", unmapped.where(F.col("document_count") < floor)),
        counter("scrubbed_candidate_term_count", unmapped.where((F.col("document_count") >= floor) & ~candidate_reportable(F.col("primary"), F.col("folded")))),
        counter("reportable_candidate_term_count", unmapped.where(reportable)),
        counter("suppressed_association_row_count", pairs.where(F.col("cooccurrence_document_count") < floor)), counter("association_pair_count", pairs), counter("association_documents_skipped", skipped),
    ]
    counters = counted[0]
    for part in counted[1:]:
        counters = counters.unionByName(part)
    return Protected(
        coding_counts=coding_counts(totals, limits), ambiguity_counts=ambiguity_counts(cube, ambiguous, all_releases), context_counts=contexts.where(F.col("document_count") >= floor),
        lexical_forms=lexical.where(scrub_allows(F.col("form")) & (F.col("document_count") >= floor)), candidate_terms=candidate_terms(unmapped, documents, limits),
        associations=pairs.where(F.col("cooccurrence_document_count") >= floor), privacy_counters=counters,
    )
