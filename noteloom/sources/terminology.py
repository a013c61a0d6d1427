"""Terminology releases: CSV sources by an import profile, reference bundles, and the Parquet index built of them."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.contracts import SCHEMA, ContractError, digest, load_json, read_stable, run_id
from noteloom.functions.text import with_forms
from noteloom.operators.matching import RELEASE
from noteloom.sources.corpus import strict_jsonl

CODING = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("active", T.BooleanType()), T.StructField("definition", T.StringType()),
    T.StructField("semantic_types", T.ArrayType(T.StringType())), T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])
DESIGNATION = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "language", "kind", "value", "source")])


@dataclass(frozen=True)
class Profile:
    """How a release's CSV is read. ``alias_sources`` pairs columns with their delimiter; with a ``status_column``
    only ``allowed_statuses`` may occur and ``active_statuses`` are active."""

    system_uri: str
    system_label: str
    version: str
    effective_date: str
    source_label: str
    columns: tuple[str, ...]
    alias_sources: tuple[tuple[str, str], ...] = (("aliases", "|"),)
    property_columns: tuple[str, ...] = ()
    status_column: str | None = None
    allowed_statuses: tuple[str, ...] = ()
    active_statuses: tuple[str, ...] = ()
    code_pattern: str = r"[A-Za-z0-9.\-]+"
    longest_code: int = 64
    longest_designation: int = 4_000
    max_aliases_per_code: int = 32
    language: str = "en"
    expected_codes: int | None = None
    expected_aliases: int | None = None
    sha256: str | None = None
    extra: dict = field(default_factory=dict, hash=False)

    @property
    def release_id(self) -> str:
        return run_id("urn:noteloom:release", self.system_uri, self.version, self.effective_date, self.sha256 or "")

    @staticmethod
    def read_all(path: str | Path) -> list[Profile]:
        raw = load_json(read_stable(path), Path(path).name)
        try:
            return [Profile(**{k: tuple(map(tuple, v)) if k == "alias_sources" else tuple(v) if isinstance(v, list) else v for k, v in one.items()}) for one in raw["terminologies"]]
        except (KeyError, TypeError):
            raise ContractError("SPEC_INVALID", "A profile lacks a field or has an unknown one.", Path(path).name, SCHEMA) from None


def read_csv(spark: SparkSession, path: str, profile: Profile) -> DataFrame:
    """A release's rows as text. The header must be the profile's; a byte-order mark and quoted line breaks are read."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in profile.columns] + [T.StructField("_broken", T.StringType())])
    options = {"header": True, "enforceSchema": False, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "nullValue": "\0", "emptyValue": ""}
    return spark.read.schema(schema).options(**options).csv(path)


def import_violations(rows: DataFrame, profile: Profile) -> DataFrame:
    """``check, code`` of rows that breach the profile: broken rows, another release's metadata, codes of a wrong form
    or repeated, unknown statuses, empty or oversized displays, too many aliases."""
    said = {"system": profile.system_label, "version": profile.version, "effective_date": profile.effective_date, "source": profile.source_label}
    pinned = [~(F.col(c) == v) for c, v in said.items() if c in profile.columns]
    aliases = F.size(_aliases(profile))
    tests = {
        "row_broken": F.col("_broken").isNotNull(),
        "code_form": ~F.col("code").rlike(rf"\A(?:{profile.code_pattern})\z") | (F.length("code") > profile.longest_code) | (F.trim("code") != F.col("code")) | F.col("code").isNull(),
        "display": F.col("display").isNull() | (F.col("display") == "") | (F.length("display") > profile.longest_designation),
        "too_many_aliases": aliases > profile.max_aliases_per_code,
        "status": ~F.col(profile.status_column).isin(*profile.allowed_statuses) if profile.status_column else F.lit(False),
    }
    for i, wrong in enumerate(pinned):
        tests[f"release_metadata_{i}"] = wrong
    found = rows.select("code", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), F.lit(n)) for n, t in tests.items()]))).alias("check"))
    doubled = rows.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code", F.lit("code_repeated").alias("check"))
    return found.select("check", "code").unionByName(doubled.select("check", "code"))


def _aliases(profile: Profile):
    """array<struct<value, column>> of a row's aliases: trimmed, neither empty nor the display, the first column wins."""
    parts = [
        F.transform(F.split(F.coalesce(c, F.lit("")), rf"\Q{delimiter}\E"), lambda v, name=c: F.struct(F.trim(v).alias("value"), F.lit(name).alias("column"))) for c, delimiter in profile.alias_sources if c in profile.columns
    ]
    if not parts:
        return F.array().cast("array<struct<value:string,column:string>>")
    whole = F.filter(F.concat(*parts), lambda a: (a["value"] != "") & (a["value"] != F.col("display")))
    return F.filter(whole, lambda a, i: ~F.exists(F.slice(whole, F.lit(1), i), lambda b: b["value"] == a["value"]))


def import_release(rows: DataFrame, profile: Profile) -> tuple[DataFrame, DataFrame]:
    """The coding and designation tables of a release's rows (which have no violations)."""
    release = [F.lit(profile.system_uri).alias("system_uri"), F.lit(profile.release_id).alias("release_id")]
    status = F.col(profile.status_column) if profile.status_column else F.lit("all_active")
    active = status.isin(*profile.active_statuses) if profile.status_column else F.lit(True)
    properties = F.map_filter(F.create_map(*[x for c in profile.property_columns for x in (F.lit(c), F.col(c))]), lambda k, v: v != "") if profile.property_columns else F.create_map().cast("map<string,string>")
    coding = rows.select(*release, "code", active.alias("active"), "display", status.alias("source_status"), F.to_json(properties).alias("properties_json"))
    listed = F.concat(
        F.array(F.struct(F.lit("preferred").alias("kind"), F.col("display").alias("value"), F.lit(f"{profile.source_label}#display").alias("source"))),
        F.transform(_aliases(profile), lambda a: F.struct(F.lit("alias").alias("kind"), a["value"].alias("value"), F.concat(F.lit(f"{profile.source_label}#"), a["column"]).alias("source"))),
    )
    values = rows.select(*release, "code", F.lit(profile.language).alias("language"), F.explode(listed).alias("d")).select(*RELEASE, "code", "language", "d.*")
    named = values.withColumn("designation_id", F.sha2(F.to_json(F.struct("code", "kind", "release_id", "source", "value")), 256))
    return coding, with_forms(named, "value", "normalized_primary", "normalized_folded")


def source_sha256(path: str) -> str:
    """Hash of a local source file, read in pieces."""
    total = hashlib.sha256()
    with open(path, "rb") as source:
        while piece := source.read(4 << 20):
            total.update(piece)
    return total.hexdigest()


def build_index(spark: SparkSession, path: str, profile: Profile, target: str) -> dict:
    """Import one CSV into the Parquet index at ``target`` (``coding`` and ``designation``, partitioned by
    system), after every check. Returns the release's metadata."""
    if profile.sha256 is not None and "://" not in path and source_sha256(path) != profile.sha256:
        raise ContractError("SOURCE_HASH", "The source is not the pinned one.", Path(path).name)
    rows = read_csv(spark, path, profile)
    first = import_violations(rows, profile).orderBy("check", "code").limit(1).collect()
    if first:
        raise ContractError(first[0]["check"].upper(), "A terminology row breaches its profile.", Path(path).name)
    coding, designation = import_release(rows, profile)
    counts = designation.agg(F.count_if(F.col("kind") == "preferred").alias("codes"), F.count_if(F.col("kind") == "alias").alias("aliases")).first()
    for name, stated in (("codes", profile.expected_codes), ("aliases", profile.expected_aliases)):
        if stated is not None and counts[name] != stated:
            raise ContractError("COUNT_MISMATCH", f"The source has another number of {name}.", Path(path).name)
    coding.write.mode("append").partitionBy("system_uri").parquet(f"{target}/coding")
    designation.write.mode("append").partitionBy("system_uri").parquet(f"{target}/designation")
    meta = {"aliases": counts["aliases"], "codes": counts["codes"], "effective_date": profile.effective_date, "release_id": profile.release_id, "system_uri": profile.system_uri, "version": profile.version}
    return meta | {"manifest_sha256": digest(meta, "noteloom-release-v1")}


def build_index_set(spark: SparkSession, sources: dict[str, Profile], target: str) -> DataFrame:
    """An index of several releases and its metadata table, one row for each release."""
    rows = [build_index(spark, path, profile, target) for path, profile in sorted(sources.items())]
    meta = spark.createDataFrame([(json.dumps(r, sort_keys=True), r["system_uri"], r["release_id"], r["codes"], r["aliases"]) for r in rows], "manifest string, system_uri string, release_id string, codes long, aliases long")
    meta.write.mode("overwrite").parquet(f"{target}/releases")
    return meta


def read_index(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{target}/coding"), spark.read.parquet(f"{target}/designation")


def index_violations(spark: SparkSession, target: str) -> DataFrame:
    """``check, key``: counts that differ from the metadata, releases without metadata, preferred values that
    aren't exactly one, designations without coding, ids that don't fit their content."""
    coding, designation = read_index(spark, target)
    meta = spark.read.parquet(f"{target}/releases")
    got = designation.groupBy(*RELEASE).agg(F.count_if(F.col("kind") == "preferred").alias("got_codes"), F.count_if(F.col("kind") == "alias").alias("got_aliases"))
    compared = meta.join(got, RELEASE, "full")
    one = coding.join(designation.where("kind = 'preferred'").groupBy(*RELEASE, "code").agg(F.count("*").alias("n")), [*RELEASE, "code"], "left").where("coalesce(n, 0) <> 1")
    renamed = designation.where(F.sha2(F.to_json(F.struct("code", "kind", "release_id", "source", "value")), 256) != F.col("designation_id"))
    key = lambda name, df, *c: df.select(F.lit(name).alias("check"), F.concat_ws("|", *c).alias("key"))
    return (
        key("release_differs", compared.where("not (codes <=> got_codes and aliases <=> got_aliases)"), *RELEASE).unionByName(key("preferred", one, *RELEASE, "code"))
        .unionByName(key("dangling", designation.join(coding, [*RELEASE, "code"], "left_anti"), *RELEASE, "code")).unionByName(key("designation_id", renamed, "designation_id"))
    )


def read_reference_bundle(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, dict]:
    """A reference bundle: ``codings.jsonl``, ``designations.jsonl`` and ``manifest.json`` as the two tables."""
    manifest = load_json(read_stable(Path(root) / "manifest.json"), "manifest.json")
    release = [F.lit(manifest["system_uri"]).alias("system_uri"), F.lit(manifest["release_id"]).alias("release_id")]
    coding = strict_jsonl(spark, f"{root}/codings.jsonl", CODING).select(*release, "code", "active", "definition", "semantic_types", F.to_json("properties").alias("properties_json"))
    values = strict_jsonl(spark, f"{root}/designations.jsonl", DESIGNATION).select(*release, "*")
    named = values.withColumn("designation_id", F.sha2(F.to_json(F.struct("code", "kind", "release_id", "source", "value")), 256))
    return coding, with_forms(named, "value", "normalized_primary", "normalized_folded"), manifest
