"""Artifacts as text: canonical JSON lines, flat CSV rows, and SKOS Turtle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.operators.matching import RELEASE

CODE = [*RELEASE, "code"]


def _sorted_value(value: Column, kind: T.DataType) -> Column:
    """Structs with their fields, and maps with their keys, in order."""
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[_sorted_value(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.array_sort(F.map_entries(value)))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType)):
        return F.transform(value, lambda x: _sorted_value(x, kind.elementType))
    return value


def canonical_json(df: DataFrame) -> DataFrame:
    """``line`` of each row: keys in order, no blanks, nulls written. Floating-point columns are refused."""
    for field in df.schema.fields:
        if "float" in field.dataType.simpleString() or "double" in field.dataType.simpleString():
            raise ValueError(f"{field.name}: canonical JSON has no floating-point numbers")
    whole = F.struct(*[_sorted_value(F.col(f.name), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)])
    return df.select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("line"))


def write_jsonl(df: DataFrame, path: str, order: list[str]) -> None:
    """Canonical lines in the order of ``order``, in as many files as there are sorted partitions; their names
    follow that order, so reading them by name gives the artifact."""
    canonical_json(df.orderBy(*order)).write.text(path)


def flat(df: DataFrame) -> DataFrame:
    """Every column as text, columns by name: null is empty, booleans lower case, nested values canonical JSON."""
    def text(f: T.StructField) -> Column:
        value = F.col(f.name)
        if isinstance(f.dataType, (T.StructType, T.MapType, T.ArrayType)):
            value = F.to_json(_sorted_value(value, f.dataType), {"ignoreNullFields": "false"})
        return F.coalesce(value.cast("string"), F.lit("")).alias(f.name)

    return df.select(*[text(f) for f in sorted(df.schema.fields, key=lambda f: f.name)])


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.option("header", True).option("emptyValue", "").option("lineSep", "\n").option("escape", '"').csv(path)


def concept_iri(system_uri: Column, code: Column) -> Column:
    return F.concat(F.lit("urn:noteloom:concept:"), F.substr(F.sha2(F.concat_ws("|", system_uri, code), 256), F.lit(1), F.lit(32)))


def turtle_text(value: Column) -> Column:
    """A string literal's inner text."""
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        value = F.replace(value, F.lit(raw), F.lit(escaped))
    return value


def skos_concepts(coding_counts: DataFrame, context_counts: DataFrame, lexical_forms: DataFrame, base_iri: str) -> DataFrame:
    """``system_uri, code, turtle``: the block of each concept. The first label in the order of occurrences
    (most first), form and method is preferred; all are alternative labels."""
    pair = ["system_uri", "code"]
    current = context_counts.where("context = 'current_clinical'").groupBy(*pair).agg(F.max("document_count").alias("current"))
    labels = (
        lexical_forms.where("context = 'current_clinical'").groupBy(*pair)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("occurrence_count")).alias("o"), "form", "match_method"))), lambda x: x["form"]).alias("labels"))
    )
    quoted = lambda name, value, tag="": F.concat(F.lit(f'    {name} "'), turtle_text(value), F.lit(f'"{tag}'))
    rows = coding_counts.join(current, pair, "left").join(labels, pair, "left")
    fixed = F.array(
        F.concat(F.lit("<"), concept_iri(F.col("system_uri"), F.col("code")), F.lit("> a skos:Concept")), F.lit(f"    skos:inScheme <{base_iri}>"), quoted("skos:notation", F.col("code")),
        F.concat(F.lit("    loom:systemUri <"), F.col("system_uri"), F.lit(">")), quoted("loom:releaseId", F.col("release_id")), F.concat(F.lit("    loom:documentCount "), F.col("exact_match_document_count").cast("string")),
        F.concat(F.lit("    loom:occurrenceCount "), F.col("exact_match_occurrence_count").cast("string")), F.concat(F.lit("    loom:currentClinicalDocumentCount "), F.coalesce("current", F.lit(0)).cast("string")),
    )
    named = F.when(
        F.col("labels").isNotNull(), F.concat(F.array(quoted("skos:prefLabel", F.col("labels")[0], "@en")), F.transform("labels", lambda x: quoted("skos:altLabel", x, "@en")))
    ).otherwise(F.array().cast("array<string>"))
    return rows.select(*pair, F.concat(F.array_join(F.concat(fixed, named), " ;\n"), F.lit(" .")).alias("turtle"))


def skos_relations(associations: DataFrame, coding_counts: DataFrame) -> DataFrame:
    """A relation for each association whose ends are both concepts."""
    rows = associations
    for s in "ab":
        rows = rows.join(coding_counts.select(F.col("system_uri").alias(f"system_uri_{s}"), F.col("code").alias(f"code_{s}")).distinct(), [f"system_uri_{s}", f"code_{s}"], "left_semi")
    iri = lambda s: F.concat(F.lit("<"), concept_iri(F.col(f"system_uri_{s}"), F.col(f"code_{s}")), F.lit(">"))
    return rows.select(F.concat(iri("a"), F.lit(" skos:related "), iri("b"), F.lit(" .")).alias("turtle"))


def write_skos(coding_counts: DataFrame, context_counts: DataFrame, lexical_forms: DataFrame, associations: DataFrame, path: str, fingerprint: str, base_iri: str = "urn:noteloom:scheme:aggregate") -> None:
    """The scheme as Turtle text files: prefixes and scheme, concepts by system and code, relations."""
    spark = coding_counts.sparkSession
    head = f'@prefix skos: <http://www.w3.org/2004/02/skos/core#> .\n@prefix dcterms: <http://purl.org/dc/terms/> .\n@prefix loom: <urn:noteloom:vocab:> .\n\n<{base_iri}> a skos:ConceptScheme ;\n    dcterms:title "Corpus-enriched concept scheme" ;\n    loom:runFingerprint "{fingerprint}" .'
    spark.createDataFrame([(head,)], "turtle string").write.text(f"{path}/part=0-scheme")
    skos_concepts(coding_counts, context_counts, lexical_forms, base_iri).orderBy("system_uri", "code").select("turtle").write.text(f"{path}/part=1-concepts")
    skos_relations(associations, coding_counts).orderBy("turtle").write.text(f"{path}/part=2-relations")
