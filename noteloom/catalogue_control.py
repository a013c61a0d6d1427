"""Registered queries on curation, verification and export, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom import catalogue as C
from noteloom.catalogue import query
from noteloom.operators import curation, export, protected, verify
from noteloom.operators import matching as M
from noteloom.session import settings, table

# decisions that a review of every hit might have made, twice for some: a rule of lengths that both engines can follow
_DECISIONS = """
    dec as (select primary_form, system_uri, release_id, code, s as sequence, case when (length(primary_form) + length(code) + s) % 3 = 0 then 'accepted' else 'rejected' end as decision
            from hit, (values (1), (2)) v(s) where (length(primary_form) + length(code)) % (1 + s) = 0),
    lat as (select primary_form, system_uri, release_id, code, case arg_max(decision, sequence) when 'accepted' then 'curator_accepted' else 'curator_rejected' end as state from dec group by primary_form, system_uri, release_id, code)"""


def _decisions(found: DataFrame) -> DataFrame:
    size = F.length("primary") + F.length("code")
    rows = M.hits(found).select(*curation.KEY, F.explode(F.array(F.lit(1), F.lit(2))).alias("sequence")).where(size % (1 + F.col("sequence")) == 0)
    return rows.withColumn("decision", F.when((size + F.col("sequence")) % 3 == 0, "accepted").otherwise("rejected"))


@query(f"with {C._EVIDENCE}, {_DECISIONS} select * from lat")
def decisions_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curation.latest_decisions(_decisions(C._evidence(spark, sf_dir))).withColumnRenamed("primary", "primary_form")


@query(
    f"""with {C._EVIDENCE}, {_DECISIONS}
        select h.primary_form, h.system_uri, h.release_id, coalesce(arg_min(l.state, printf('%02d', h.priority) || h.code) filter (l.state is not null), 'pending') as acceptance_state
        from hit h left join lat l on l.primary_form = h.primary_form and l.system_uri = h.system_uri and l.release_id = h.release_id and l.code = h.code group by all"""
)
def curated_candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C._evidence(spark, sf_dir)
    return curation.curated(M.ranked_candidates(found), curation.latest_decisions(_decisions(found))).withColumnRenamed("primary", "primary_form")


def _planted(spark: SparkSession, sf_dir: str) -> tuple[protected.Protected, DataFrame]:
    """A run's tables, and its coding counts with a count of 1 planted for every code that holds a 7."""
    tables = C._protected(spark, sf_dir)
    wrong = tables.coding_counts.withColumn("exact_match_document_count", F.when(F.col("code").contains("7"), 1).otherwise(F.col("exact_match_document_count")))
    return tables, wrong


@query(
    f"""with {C._CELLS}, cod as (select system_uri, release_id, code, case when code like '%7%' then 1 else documents end as n, occurrences as o, forms as f from tot, lim where documents >= floor),
        c as (select count(*)::double as docs from documents)
        select 'coding_floor' as "check", concat_ws('|', system_uri, release_id, code) as key, n::varchar as detail from cod, lim where n < floor
        union all select 'coding_occurrences', concat_ws('|', system_uri, release_id, code), null from cod where o < n or f < 1
        union all select 'context_exceeds_coding', concat_ws('|', x.system_uri, x.release_id, x.code, x.context), x.document_count::varchar from ctx x join cod using (system_uri, release_id, code), lim where x.document_count >= floor and x.document_count > n"""
)
def coding_and_context_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, wrong = _planted(spark, sf_dir)
    floor = settings(table(spark, sf_dir, "analysis_limits"))["min_cell_document_count"]
    return verify.coding_violations(wrong, table(spark, sf_dir, "coding"), floor).unionByName(verify.context_violations(tables.context_counts, wrong, floor))


@query(
    f"""with {C._CELLS}, cod as (select system_uri, release_id, code, case when code like '%7%' then 1 else documents end as n from tot, lim where documents >= floor),
        asc_ as (select p.*, x.n as na, y.n as nb from par p join cdn x on x.system_uri = system_uri_a and x.release_id = release_id_a and x.code = code_a
                 join cdn y on y.system_uri = system_uri_b and y.release_id = release_id_b and y.code = code_b, lim where together >= floor)
        select 'association_documents_a' as "check", concat_ws('|', system_uri_a, release_id_a, code_a, system_uri_b, release_id_b, code_b) as key, na::varchar as detail from asc_ join cod on system_uri = system_uri_a and release_id = release_id_a and code = code_a where na > n
        union all select 'association_documents_b', concat_ws('|', system_uri_a, release_id_a, code_a, system_uri_b, release_id_b, code_b), nb::varchar from asc_ join cod on system_uri = system_uri_b and release_id = release_id_b and code = code_b where nb > n"""
)
def association_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, wrong = _planted(spark, sf_dir)
    floor = settings(table(spark, sf_dir, "analysis_limits"))["min_cell_document_count"]
    return verify.association_violations(tables.associations, wrong, tables.context_counts, floor)


@query()
def all_violations_of_a_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's own tables, unplanted: no row is expected."""
    tables = C._protected(spark, sf_dir)
    coding, designation = table(spark, sf_dir, "coding"), table(spark, sf_dir, "designation")
    floor = settings(table(spark, sf_dir, "analysis_limits"))["min_cell_document_count"]
    parts = [
        verify.coding_violations(tables.coding_counts, coding, floor), verify.ambiguity_violations(tables.ambiguity_counts, M.releases(coding)), verify.context_violations(tables.context_counts, tables.coding_counts, floor),
        verify.lexical_violations(tables.lexical_forms, coding, floor), verify.association_violations(tables.associations, tables.coding_counts, tables.context_counts, floor),
        verify.candidate_violations(tables.candidate_terms, protected.phrases_of(C._cube(spark, sf_dir)), M.active_designations(coding, designation), floor),
    ]
    return verify._union(parts)


_TURTLE = r"""replace(replace(replace(replace(replace({x}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""
_IRI = "'urn:noteloom:concept:' || substr(sha256({s} || '|' || {c}), 1, 32)"


@query(
    f"""with {C._CELLS},
        cur_ as (select system_uri, code, max(document_count) as current from ctx, lim where context = 'current_clinical' and document_count >= floor group by all),
        lab as (select system_uri, code, arg_min(form, printf('%012d', 999999999999 - occurrence_count) || form || match_method) as pref,
                       string_agg('    skos:altLabel "' || {_TURTLE.format(x='form')} || '"@en', ' ;' || chr(10) order by occurrence_count desc, form, match_method) as alt
                from lex, lim where context = 'current_clinical' and document_count >= floor and {C._SCRUB.format(f='form')} group by all)
        select t.system_uri, t.code, '<' || {_IRI.format(s='t.system_uri', c='t.code')} || '> a skos:Concept ;' || chr(10) || '    skos:inScheme <urn:noteloom:scheme:aggregate> ;' || chr(10)
               || '    skos:notation "' || {_TURTLE.format(x='t.code')} || '" ;' || chr(10) || '    loom:systemUri <' || t.system_uri || '> ;' || chr(10) || '    loom:releaseId "' || {_TURTLE.format(x='t.release_id')} || '" ;' || chr(10)
               || '    loom:documentCount ' || documents || ' ;' || chr(10) || '    loom:occurrenceCount ' || occurrences || ' ;' || chr(10) || '    loom:currentClinicalDocumentCount ' || coalesce(current, 0)
               || coalesce(' ;' || chr(10) || '    skos:prefLabel "' || {_TURTLE.format(x='pref')} || '"@en ;' || chr(10) || alt, '') || ' .' as turtle
        from tot t left join cur_ using (system_uri, code) left join lab using (system_uri, code), lim where documents >= floor"""
)
def skos_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = C._protected(spark, sf_dir)
    return export.skos_concepts(tables.coding_counts, tables.context_counts, tables.lexical_forms, "urn:noteloom:scheme:aggregate")


@query(
    f"""with {C._CELLS}, con as (select system_uri, code from tot, lim where documents >= floor)
        select '<' || {_IRI.format(s='system_uri_a', c='code_a')} || '> skos:related <' || {_IRI.format(s='system_uri_b', c='code_b')} || '> .' as turtle from par, lim
        where together >= floor and (system_uri_a, code_a) in (select (system_uri, code) from con) and (system_uri_b, code_b) in (select (system_uri, code) from con)"""
)
def skos_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = C._protected(spark, sf_dir)
    return export.skos_relations(tables.associations, tables.coding_counts)


@query(
    """select coalesce(active::varchar, '') as active, coalesce(code, '') as code, coalesce(definition, '') as definition, coalesce(display, '') as display, coalesce(properties_json, '') as properties_json, coalesce(release_id, '') as release_id,
              coalesce('[' || array_to_string(list_transform(semantic_types, lambda x: '"' || x || '"'), ',') || ']', '') as semantic_types, coalesce(source_status, '') as source_status, coalesce(system_uri, '') as system_uri from coding"""
)
def flat_codings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.flat(table(spark, sf_dir, "coding"))


@query()
def canonical_codings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.canonical_json(table(spark, sf_dir, "coding"))
