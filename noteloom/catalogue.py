"""The registered queries of the core, over the given tables as a whole, and their SQL.

The corpus is ``documents``; ``coding`` and ``designation`` are three terminology releases; ``mentions`` is a
fact table of mentions with context, from which the protected tables are made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.functions import text as T
from noteloom.operators import matching as M
from noteloom.operators import combined, mining, protected
from noteloom.operators.context import mentions_with_context
from noteloom.session import settings, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is one."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from noteloom import catalogue_control  # noqa: F401  (registers the control-plane queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from noteloom import catalogue_control  # noqa: F401

    return dict(ORACLE)


# --- SQL that several queries share ---------------------------------------------------------------------------------

_DOCS = "docs as (select doc_id, coalesce(lang, 'und') as language, coalesce(note_type, 'unknown') as note_type, coalesce(text, '') as text from documents)"
_SENTENCES = rf"""{_DOCS},
    cut as (select doc_id, language, note_type, string_split(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
              '(?:[ \t]*\r?\n){{2,}}[ \t]*', chr(2), 'g'), '\r?\n([ \t]*(?:[-*•]|\p{{Nd}}+[.)])[ \t])', chr(2) || '\1', 'g'), '\.(\p{{Nd}})', chr(1) || '\1', 'g'), '[!?;.]', chr(2), 'g'), chr(1), '.'), chr(2)) as parts from docs),
    sent as (select doc_id, language, note_type, unnest(list_filter(parts, lambda p: p <> '')) as sentence, generate_subscripts(list_filter(parts, lambda p: p <> ''), 1) - 1 as sentence_number from cut)"""
_TOKEN_SQL = r"[\p{L}\p{N}]+(?:[./+\-][\p{L}\p{N}]+)*\+?"
_TOKENS = rf"{_SENTENCES}, tok as (select *, regexp_extract_all(sentence, '{_TOKEN_SQL}') as t, string_split_regex(sentence, '{_TOKEN_SQL}') as g from sent)"


def _primary_sql(column: str) -> str:
    return rf"trim(regexp_replace(nfc_normalize({column}), '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def _folded_sql(column: str) -> str:
    return f"nfc_normalize(replace(replace(lower({column}), 'ß', 'ss'), 'ς', 'σ'))"


_SIX = "cast(cast(round_even({x}, 6) as decimal(20, 6)) as varchar)"
_COUNTED = rf"""{_TOKENS},
    lim as (select max(amount) filter (setting = 'min_ngram_tokens') as lo, max(amount) filter (setting = 'max_ngram_tokens') as hi, max(amount) filter (setting = 'min_document_frequency') as df from analysis_limits),
    grams as (select doc_id, language, note_type, n as token_count, unnest(list_transform(range(1, len(t) - n + 2),
                lambda i: array_to_string(list_transform(range(0, n), lambda j: t[i + j] || case when j < n - 1 then g[i + j + 1] else '' end), ''))) as surface
              from tok, range(1, 9) r(n), lim where n between lo and hi and len(t) >= n),
    counted as (select *, {_primary_sql('surface')} as primary_form from (select doc_id, language, note_type, token_count, surface, count(*) as n from grams group by all))"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.corpus(table(spark, sf_dir, "documents"))


def _ngrams(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    limits = settings(table(spark, sf_dir, "analysis_limits"))
    return limits["min_ngram_tokens"], limits["max_ngram_tokens"]


# --- mining ---------------------------------------------------------------------------------------------------------


@query(f"with {_SENTENCES} select doc_id, sentence_number::int as sentence_number, sentence from sent")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.sentences(_documents(spark, sf_dir)).select("doc_id", "sentence_number", "sentence")


@query(f"with {_TOKENS} select doc_id, sentence_number::int as sentence_number, len(t)::int as token_count, array_to_string(t, '|') as tokens from tok")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.tokens(_documents(spark, sf_dir)).select("doc_id", "sentence_number", F.size("tokens").alias("token_count"), F.concat_ws("|", "tokens").alias("tokens"))


@query(
    f"with {_COUNTED} select language, primary_form, token_count::int as token_count, sum(n)::bigint as occurrence_count, count(distinct doc_id) as document_frequency from counted where primary_form <> '' group by all"
)
def ngram_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mining.counted_mentions(_documents(spark, sf_dir), *_ngrams(spark, sf_dir))
    return (
        counted.groupBy("language", "primary", "token_count", "doc_id").agg(F.sum("n").alias("n")).groupBy("language", F.col("primary").alias("primary_form"), "token_count")
        .agg(F.sum("n").alias("occurrence_count"), F.count("*").alias("document_frequency"))
    )


@query(
    f"""with {_COUNTED},
        f as (select * from counted where primary_form <> ''),
        d as (select language, primary_form, token_count, doc_id, sum(n) as n from f group by all),
        a as (select language, primary_form, token_count, sum(n)::bigint as occurrence_count, count(*) as document_frequency, max(n) as most from d group by all having count(*) >= (select df from lim)),
        s as (select language, primary_form, token_count, surface, sum(n) as n from f group by all),
        t as (select language, primary_form, token_count, surface as display from s qualify row_number() over (partition by language, primary_form, token_count order by n desc, surface) = 1),
        x as (select language, primary_form, token_count, string_agg(note_type || '=' || n, ';' order by note_type) as note_type_counts
              from (select language, primary_form, token_count, note_type, sum(n)::bigint as n from f group by all) group by all),
        c as (select count(*)::double as docs from documents)
        select a.language, a.primary_form, {_folded_sql('a.primary_form')} as folded, a.token_count::int as token_count, display, occurrence_count, document_frequency, note_type_counts,
               {_SIX.format(x='(1 + ln(most)) * (ln((docs + 1) / (document_frequency + 1)) + 1)')} as max_sublinear_tf_idf
        from a join t using (language, primary_form, token_count) join x using (language, primary_form, token_count), c"""
)
def phrase_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = settings(table(spark, sf_dir, "analysis_limits"))
    documents = _documents(spark, sf_dir)
    rows = combined.aggregates(documents, limits["min_ngram_tokens"], limits["max_ngram_tokens"], limits["min_document_frequency"])
    counts = F.array_join(F.transform(F.array_sort(F.map_entries("note_type_counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return rows.withColumn("note_type_counts", counts).withColumnRenamed("primary", "primary_form")


@query(
    f"""with {_TOKENS}, lim as (select max(amount) filter (setting = 'min_ngram_tokens') as lo, max(amount) filter (setting = 'max_ngram_tokens') as hi from analysis_limits)
        select (select count(*) from docs) as document_count, (select sum(octet_length(encode(text)))::bigint from docs) as byte_count, (select sum(length(text))::bigint from docs) as character_count,
               sum(len(t))::bigint as token_count, sum(list_sum(list_transform(range(lo, hi + 1), lambda n: greatest(0, len(t) - n + 1))))::bigint as ngram_count from tok, lim"""
)
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.corpus_totals(_documents(spark, sf_dir), *_ngrams(spark, sf_dir))


@query(
    f"""with {_DOCS} select 'note_type' as dimension, note_type as value, count(*) as documents, sum(length(text))::bigint as characters from docs group by all
        union all select 'language', language, count(*), sum(length(text))::bigint from docs group by all"""
)
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.corpus_profile(_documents(spark, sf_dir))


@query("select sha256(text) as content_sha256, count(*) as rows from documents where text is not null group by all having count(*) > 1")
def repeated_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("content_sha256"))
    return mining.repeated(texts, "content_sha256")


@query(
    # RE2 knows word edges of ASCII alone: other letters are written as x before
    r"with d as (select doc_id, regexp_replace(text, '[\p{Lo}\x{00C0}-\x{024F}\x{0370}-\x{03FF}\x{0400}-\x{052F}]', 'x', 'g') as text from documents where text is not null) "
    + " union all ".join(f"select doc_id, '{name}' as canary from d where regexp_matches(text, '{pattern}')" for name, pattern in T.CANARIES.items())
)
def privacy_canaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.canaries(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"))


@query()
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.content_digest(table(spark, sf_dir, "documents"), "doc_uuid", "snapshot_id", "text", "lang", "note_type")


@query(f"with s as (select distinct surface from mentions where surface is not null) select surface, {_primary_sql('surface')} as primary_form, {_folded_sql(_primary_sql('surface'))} as folded from s")
def normalized_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    surfaces = table(spark, sf_dir, "mentions").where("surface is not null").select("surface").distinct()
    return T.with_forms(surfaces, "surface", "primary_form", "folded")


@query()
def context_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = mentions_with_context(_documents(spark, sf_dir), *_ngrams(spark, sf_dir))
    return counted.groupBy("language", "primary", "token_count", "context", "doc_id").agg(F.sum("n").alias("n")).groupBy("language", "primary", "token_count", "context").agg(F.sum("n").alias("occurrence_count"), F.count("*").alias("document_count"))


# --- terminology ----------------------------------------------------------------------------------------------------

_PHRASES = "phr as (select primary_form, min(folded) as folded from mentions where primary_form is not null and doc_id is not null group by primary_form)"
_DESIGNATIONS = "des as (select distinct d.system_uri, d.release_id, d.code, d.kind, d.normalized_primary, d.normalized_folded from designation d join coding c using (system_uri, release_id, code) where c.active)"
_ABBREVIATIONS = "abb(k, v) as (values " + ", ".join(f"('{k}', '{v}')" for k, v in T.ABBREVIATIONS.items()) + ")"


def _compact_sql(column: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({column}, '[^0-9a-zÀ-ɏ ]+', ' ', 'g'), '\s+', ' ', 'g'))"


def _singular_sql(column: str) -> str:
    last = f"regexp_extract({column}, '[^ ]*$')"
    return f"case when length({last}) > 4 and {last} like '%ies' then regexp_replace({column}, 'ies$', 'y') when length({last}) > 3 and {last} like '%s' and not regexp_matches({last}, '(?:ss|us|is|es)$') then regexp_replace({column}, 's$', '') else {column} end"


_VARIANTS = rf"""{_PHRASES}, {_ABBREVIATIONS},
    base as (select primary_form, folded, {_compact_sql('folded')} as c, a.v as x, b.v as y from phr left join abb a on a.k = folded left join abb b on b.k = {_compact_sql('folded')}),
    made as (select primary_form, folded, 1 as o, 'variant_compact' as method, c as key from base union all select primary_form, folded, 2, 'variant_abbreviation', x from base union all select primary_form, folded, 3, 'variant_abbreviation', y from base
             union all select primary_form, folded, 4, 'variant_singular', {_singular_sql('c')} from base union all select primary_form, folded, 5, 'variant_singular', {_singular_sql('x')} from base
             union all select primary_form, folded, 6, 'variant_singular', {_singular_sql('y')} from base union all select primary_form, folded, 7, 'variant_singular', {_singular_sql('folded')} from base),
    var as (select primary_form, key, arg_min(method, o) as method from made where key is not null and key <> '' and key <> folded group by all)"""
_EVIDENCE = rf"""{_VARIANTS}, {_DESIGNATIONS},
    ev as (select primary_form, system_uri, release_id, code, case kind when 'preferred' then 'exact_preferred' else 'exact_alias' end as method, 'primary' as variant from phr join des on normalized_primary = primary_form
           union select primary_form, system_uri, release_id, code, case kind when 'preferred' then 'exact_preferred' else 'exact_alias' end, 'casefold' from phr join des on normalized_folded = folded
           union select primary_form, system_uri, release_id, code, method, replace(method, 'variant_', '') from var join des on normalized_folded = key),
    hit as (select primary_form, system_uri, release_id, code, min(list_position(['exact_preferred', 'exact_alias', 'variant_compact', 'variant_abbreviation', 'variant_singular'], method)) - 1 as priority,
                   arg_min(method, list_position(['exact_preferred', 'exact_alias', 'variant_compact', 'variant_abbreviation', 'variant_singular'], method)) as best_method,
                   array_to_string(list_sort(list(distinct method)), '|') as methods, array_to_string(list_sort(list(distinct variant)), '|') as variants
            from ev group by primary_form, system_uri, release_id, code)"""


def _terminology(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "coding"), table(spark, sf_dir, "designation")


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protected.cube_of(table(spark, sf_dir, "mentions"))


def _evidence(spark: SparkSession, sf_dir: str, cube: DataFrame | None = None) -> DataFrame:
    phrases = protected.phrases_of(_cube(spark, sf_dir) if cube is None else cube)
    return M.evidence(phrases, M.active_designations(*_terminology(spark, sf_dir)))


@query(f"with {_PHRASES}, {_DESIGNATIONS} select distinct folded as key, system_uri, release_id, code from phr join des on normalized_folded = folded where kind = 'preferred'")
def active_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = protected.phrases_of(_cube(spark, sf_dir)).select(F.col("folded").alias("key")).distinct()
    return M.exact_lookup(keys, M.active_designations(*_terminology(spark, sf_dir)), "preferred", "casefold")


@query(
    """with u as (select distinct system_uri, release_id, code, kind, language, value from designation)
       select 'code_repeated' as "check", system_uri, code, count(*)::varchar as detail from coding group by system_uri, code having count(*) > 1
       union all select 'code_form', system_uri, code, null from coding where code is null or not regexp_full_match(code, '[A-Za-z0-9.\\-]+') or length(code) > 64
       union all select 'preferred_count', system_uri, code, concat_ws(':', language, n::varchar) from (select system_uri, code, language, count(*) filter (kind = 'preferred') as n from u group by all) where n > 1
       union all select 'no_preferred', system_uri, code, null from coding c where not exists (select 1 from designation d where d.kind = 'preferred' and d.system_uri = c.system_uri and d.release_id = c.release_id and d.code = c.code)
       union all select 'too_many_aliases', system_uri, code, count(*)::varchar from u where kind = 'alias' group by system_uri, code having count(*) > 32
       union all select 'dangling', system_uri, code, designation_id::varchar from designation d where not exists (select 1 from coding c where d.system_uri = c.system_uri and d.release_id = c.release_id and d.code = c.code)
       union all select 'kind', system_uri, code, designation_id::varchar from designation where coalesce(kind not in ('preferred', 'alias'), true)
       union all select 'empty', system_uri, code, designation_id::varchar from designation where value is null or trim(value) = ''
       union all select 'repeated', system_uri, code, concat_ws(':', kind, language, value) from designation group by system_uri, release_id, code, kind, language, value having count(*) > 1"""
)
def terminology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.terminology_violations(*_terminology(spark, sf_dir))


@query(f"with {_VARIANTS} select primary_form, method, key from var")
def phrase_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = protected.phrases_of(_cube(spark, sf_dir))
    return phrases.select(F.col("primary").alias("primary_form"), F.explode(T.variant_keys(F.col("folded"))).alias("v")).select("primary_form", "v.method", "v.key")


@query(f"with {_EVIDENCE} select primary_form, system_uri, release_id, code, method, variant from ev")
def match_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir).withColumnRenamed("primary", "primary_form")


@query(
    f"with {_EVIDENCE} select primary_form, system_uri, release_id, code, best_method, methods, variants, (dense_rank() over (partition by primary_form, system_uri, release_id order by priority))::int as rank from hit"
)
def ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.ranked_candidates(_evidence(spark, sf_dir))
    joined = [F.array_join(F.array_sort(F.col(c)), "|").alias(c) for c in ("methods", "variants")]
    return rows.select(F.col("primary").alias("primary_form"), *M.RELEASE, "code", "best_method", *joined, "rank")


_SETS = f"""{_EVIDENCE}, rel as (select distinct system_uri, release_id from coding),
    sets as (select p.primary_form, r.system_uri, r.release_id, count(h.code) as candidate_count, coalesce(string_agg(h.code || '#' || h.best_method, '|' order by h.priority, h.code), '') as candidates
             from phr p cross join rel r left join hit h on h.primary_form = p.primary_form and h.system_uri = r.system_uri and h.release_id = r.release_id group by all),
    outc as (select *, case when candidate_count = 0 then 'unmapped' when candidate_count = 1 then 'grounded_unique' else 'grounded_ambiguous' end as algorithmic_outcome from sets)"""


@query(f"with {_SETS} select primary_form, system_uri, release_id, candidate_count::int as candidate_count, candidates, algorithmic_outcome, case when candidate_count > 0 then 'pending' end as acceptance_state from outc")
def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _cube(spark, sf_dir)
    coding, _ = _terminology(spark, sf_dir)
    sets = M.candidate_sets(protected.phrases_of(cube).select("primary"), _evidence(spark, sf_dir, cube), M.release_list(coding))
    listed = F.coalesce(F.array_join(F.transform("candidates", lambda c: F.concat(c["code"], F.lit("#"), c["best_method"])), "|"), F.lit(""))
    return sets.select(F.col("primary").alias("primary_form"), *M.RELEASE, "candidate_count", listed.alias("candidates"), "algorithmic_outcome", "acceptance_state")


@query(
    f"""with {_SETS} select algorithmic_outcome, system_uri, count(*) as sets, sum(candidate_count)::bigint as candidates from outc group by algorithmic_outcome, system_uri
        union all select algorithmic_outcome, null, count(*), sum(candidate_count)::bigint from outc group by algorithmic_outcome"""
)
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cube = _cube(spark, sf_dir)
    coding, _ = _terminology(spark, sf_dir)
    return M.outcomes(M.candidate_sets(protected.phrases_of(cube).select("primary"), _evidence(spark, sf_dir, cube), M.release_list(coding)))


@query("select distinct d.system_uri, d.release_id, d.code from coding_documents d where d.code is not null and not exists (select 1 from coding c where c.system_uri = d.system_uri and c.release_id = d.release_id and c.code = d.code)")
def ungrounded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "coding_documents").where("code is not null").select(*M.RELEASE, "code").distinct()
    return M.ungrounded(rows, table(spark, sf_dir, "coding"))


# --- protected tables -----------------------------------------------------------------------------------------------

_CELLS = f"""{_EVIDENCE},
    lim as (select max(amount) filter (setting = 'min_cell_document_count') as floor, max(amount) filter (setting = 'max_association_codes_per_document') as most from analysis_limits),
    men as (select distinct mention_id, doc_id, primary_form, folded, token_count, coalesce(context, 'current_clinical') as context from mentions where primary_form is not null and doc_id is not null),
    cube as (select primary_form, doc_id, context, min(folded) as folded, min(token_count) as token_count, count(*) as n from men group by primary_form, doc_id, context),
    cnt as (select *, count(*) over (partition by primary_form, system_uri, release_id) as codes from hit),
    uni as (select primary_form, system_uri, release_id, code, best_method from cnt where codes = 1),
    cell as (select c.primary_form, c.doc_id, c.context, c.n, u.system_uri, u.release_id, u.code, u.best_method from cube c join uni u using (primary_form)),
    tot as (select system_uri, release_id, code, count(distinct doc_id) as documents, sum(n)::bigint as occurrences, count(distinct primary_form) as forms from cell group by all),
    ctx as (select system_uri, release_id, code, context, count(distinct doc_id) as document_count, sum(n)::bigint as occurrence_count from cell semi join (select * from tot, lim where documents >= floor) k using (system_uri, release_id, code) group by all),
    lex as (select system_uri, release_id, code, primary_form as form, best_method as match_method, context, count(distinct doc_id) as document_count, sum(n)::bigint as occurrence_count from cell group by all),
    unm as (select primary_form, count(*) as document_count, sum(n)::bigint as occurrence_count, max(n) as most_in_one, sum(cur)::bigint as current_clinical_document_count, min(folded) as folded, min(token_count) as token_count
            from (select primary_form, doc_id, sum(n) as n, max((context = 'current_clinical')::int) as cur, min(folded) as folded, min(token_count) as token_count from cube where primary_form not in (select primary_form from ev) group by all) group by primary_form),
    cur as (select distinct doc_id, system_uri, release_id, code from cell where context = 'current_clinical'),
    siz as (select doc_id, count(*) as codes from cur group by doc_id),
    cdn as (select system_uri, release_id, code, count(*) as n from cur group by all),
    par as (select a.system_uri as system_uri_a, a.release_id as release_id_a, a.code as code_a, b.system_uri as system_uri_b, b.release_id as release_id_b, b.code as code_b, count(*) as together
            from cur a join cur b on a.doc_id = b.doc_id and (a.system_uri, a.release_id, a.code) < (b.system_uri, b.release_id, b.code)
            where a.doc_id in (select doc_id from siz, lim where codes <= most) group by all)"""
_SCRUB = r"(length({f}) <= 80 and not regexp_matches({f}, '\p{{Nd}}{{4,}}') and not regexp_matches({f}, '[@#]') and len(regexp_extract_all({f}, '\p{{L}}')) >= 3)"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.CANDIDATE_STOPWORDS) + "]"
_REPORTABLE = _SCRUB.format(f="primary_form") + f" and len(list_filter(string_split(folded, ' '), lambda w: not list_contains({_STOP}, w))) > 0"


def _protected(spark: SparkSession, sf_dir: str) -> protected.Protected:
    limits = settings(table(spark, sf_dir, "analysis_limits"))
    cube = _cube(spark, sf_dir)
    chosen = protected.Limits(min_cell_document_count=limits["min_cell_document_count"], max_association_codes_per_document=limits["max_association_codes_per_document"], max_association_pairs=limits["max_association_pairs"])
    return protected.protect(cube, _evidence(spark, sf_dir, cube), M.release_list(table(spark, sf_dir, "coding")), table(spark, sf_dir, "documents").count(), chosen)


@query(f"with {_CELLS} select system_uri, release_id, code, forms as distinct_matched_form_count, documents as exact_match_document_count, occurrences as exact_match_occurrence_count from tot, lim where documents >= floor")
def coding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _protected(spark, sf_dir).coding_counts


@query(
    f"""with {_CELLS}, rel as (select distinct system_uri, release_id from coding), amb as (select distinct primary_form, system_uri, release_id from cnt where codes > 1)
        select system_uri, release_id, coalesce(d, 0) as ambiguous_document_count, coalesce(f, 0) as ambiguous_form_count, coalesce(o, 0)::bigint as ambiguous_occurrence_count from rel
        left join (select system_uri, release_id, count(distinct doc_id) as d, count(distinct primary_form) as f, sum(n) as o from cube join amb using (primary_form) group by all) using (system_uri, release_id)"""
)
def ambiguity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _protected(spark, sf_dir).ambiguity_counts


@query(f"with {_CELLS} select system_uri, release_id, code, context, document_count, occurrence_count from ctx, lim where document_count >= floor")
def context_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _protected(spark, sf_dir).context_counts


@query(f"with {_CELLS} select system_uri, release_id, code, form, match_method, context, document_count, occurrence_count from lex, lim where document_count >= floor and {_SCRUB.format(f='form')}")
def lexical_form_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _protected(spark, sf_dir).lexical_forms


@query(
    f"""with {_CELLS}, c as (select count(*)::double as docs from documents)
        select primary_form as form, document_count, occurrence_count, current_clinical_document_count, token_count, (row_number() over (order by document_count desc, occurrence_count desc, primary_form))::int as rank,
               {_SIX.format(x='(1 + ln(most_in_one)) * (ln((docs + 1) / (document_count + 1)) + 1)')} as salience
        from unm, lim, c where document_count >= floor and {_REPORTABLE} qualify row_number() over (order by document_count desc, occurrence_count desc, primary_form) <= 5000"""
)
def candidate_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _protected(spark, sf_dir).candidate_terms


@query(
    f"""with {_CELLS}, c as (select count(*)::double as docs from documents)
        select system_uri_a, release_id_a, code_a, system_uri_b, release_id_b, code_b, together as cooccurrence_document_count, x.n as document_count_a, y.n as document_count_b,
               {_SIX.format(x='case when together >= docs then 1.0 else ln((together / docs) / ((x.n / docs) * (y.n / docs))) / -ln(together / docs) end')} as npmi
        from par join cdn x on x.system_uri = system_uri_a and x.release_id = release_id_a and x.code = code_a join cdn y on y.system_uri = system_uri_b and y.release_id = release_id_b and y.code = code_b, lim, c
        where together >= floor"""
)
def associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _protected(spark, sf_dir).associations


@query(
    f"""with {_CELLS}
        select 'suppressed_coding_row_count' as counter, count(*) as value from tot, lim where documents < floor
        union all select 'suppressed_context_row_count', count(*) from ctx, lim where document_count < floor
        union all select 'scrubbed_lexical_form_count', count(*) from (select distinct system_uri, release_id, code, form from lex where not {_SCRUB.format(f='form')})
        union all select 'suppressed_lexical_form_count', count(*) from lex, lim where document_count < floor and {_SCRUB.format(f='form')}
        union all select 'suppressed_candidate_term_count', count(*) from unm, lim where document_count < floor
        union all select 'scrubbed_candidate_term_count', count(*) from unm, lim where document_count >= floor and not ({_REPORTABLE})
        union all select 'reportable_candidate_term_count', count(*) from unm, lim where document_count >= floor and {_REPORTABLE}
        union all select 'suppressed_association_row_count', count(*) from par, lim where together < floor
        union all select 'association_pair_count', count(*) from par
        union all select 'association_documents_skipped', count(*) from siz, lim where codes > most"""
)
def privacy_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _protected(spark, sf_dir).privacy_counters
