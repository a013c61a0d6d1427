"""Every registered core query: against its SQL where it has one, else that it runs."""

import pytest

from noteloom import catalogue
from tests.compare import against_sql

QUICK = ["sentences", "tokens", "phrase_aggregates", "corpus_totals", "corpus_profile", "repeated_documents", "privacy_canaries", "normalized_forms", "terminology_violations", "match_evidence", "ranked_candidates", "candidate_sets", "outcomes", "coding_counts", "ambiguity_counts", "candidate_terms", "associations", "curated_candidate_sets", "association_violations", "skos_concepts", "flat_codings"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, data, name):
    against_sql(spark, data, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, data, name):
    assert catalogue.queries()[name](spark, data).columns


def test_sql_belongs_to_queries():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
