"""Corpora: a tree of plain-text files, and snapshot bundles (an index of documents beside their files)."""

from __future__ import annotations

import os
import stat
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.contracts import INTEGRITY, SECURITY, ContractError, load_json, read_stable
from noteloom.functions.text import CANARIES
from noteloom.operators.mining import canaries, repeated

DOCUMENT = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("path", T.StringType()), T.StructField("sha256", T.StringType()), T.StructField("byte_count", T.LongType()), T.StructField("character_count", T.LongType()),
    T.StructField("note_type", T.StringType()), T.StructField("language", T.StringType()), T.StructField("extraction_method", T.StringType()), T.StructField("subject_group_id", T.StringType()),
])


def refuse_links(root: str, most_entries: int = 50_000) -> None:
    """On a local tree no entry may be a link, a special file or a file with other links."""
    seen = 0
    for folder, folders, files in os.walk(root, followlinks=False):
        for name in (*folders, *files):
            seen += 1
            info = os.lstat(os.path.join(folder, name))
            if seen > most_entries:
                raise ContractError("RESOURCE_LIMIT", "The tree has too many entries.", "corpus", SECURITY)
            if not (stat.S_ISDIR(info.st_mode) or (stat.S_ISREG(info.st_mode) and info.st_nlink == 1)):
                raise ContractError("FILE_KIND", "The tree has links or special files.", "corpus", SECURITY)


def read_text_tree(spark: SparkSession, root: str, most_bytes: int = 10_000_000) -> DataFrame:
    """``path, byte_count, sha256, text`` of every ``.txt`` file (in any case) below ``root``.

    Texts that aren't UTF-8 and files larger than ``most_bytes`` fail the job that reads them. Files are read
    by executors; a local root is checked for links first."""
    if "://" not in root:
        refuse_links(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[tT][xX][tT]").load(root)
    sized = files.withColumn("content", F.when(F.col("length") <= most_bytes, F.col("content")).otherwise(F.raise_error(F.lit("RESOURCE_LIMIT: a file is larger than allowed")).cast("binary")))
    return sized.select("path", F.col("length").alias("byte_count"), F.sha2("content", 256).alias("sha256"), F.validate_utf8(F.col("content").cast("string")).alias("text"))


def as_documents(tree: DataFrame, language: str = "en", note_type: str = "plain_text") -> DataFrame:
    """A tree of texts as documents; the path names a document within the run and never leaves it."""
    return tree.select(F.sha2("path", 256).alias("doc_id"), F.lit(language).alias("language"), F.lit(note_type).alias("note_type"), "text")


def strict_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a JSON-lines file by a schema. Blank lines and lines that don't fit fail the job."""
    lines = spark.read.text(path)
    parsed = lines.select("value", F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    fine = ~F.col("bad") & (F.trim("value") != "") & F.col("r").isNotNull()
    return parsed.select(F.when(fine, F.col("r")).otherwise(F.raise_error(F.lit("JSON_INVALID: a row is blank or no object")).cast(schema)).alias("r")).select("r.*")


def read_snapshot(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, dict]:
    """A snapshot bundle: its documents with their texts, the violations of its contract, and its manifest.

    The index is joined with the files by path. Violations (``check, key``): files without a row, rows without
    a file, hashes and sizes that differ, repeated ids, paths (case folded) or contents, canaries of personal data,
    and manifest counts that don't agree."""
    manifest = load_json(read_stable(Path(root) / "manifest.json"), "manifest.json")
    index = strict_jsonl(spark, f"{root}/documents.jsonl", DOCUMENT)
    tree = read_text_tree(spark, f"{root}/documents")
    files = tree.withColumn("path", F.concat(F.lit("documents/"), F.regexp_extract("path", r"/documents/(.*)$", 1))).withColumnsRenamed({"byte_count": "file_bytes", "sha256": "file_sha256"})
    joined = index.join(files, "path", "full")
    key = lambda name, df, c: df.select(F.lit(name).alias("check"), F.col(c).cast("string").alias("key"))
    documents = joined.where("doc_id is not null and text is not null")
    parts = [
        key("file_undeclared", joined.where("doc_id is null"), "path"), key("file_missing", joined.where("text is null and doc_id is not null"), "path"),
        key("content_differs", documents.where("sha256 <> file_sha256 or byte_count <> file_bytes or character_count <> length(text)"), "path"),
        key("id_repeated", repeated(index, "doc_id"), "doc_id"), key("path_repeated", repeated(index, F.lower("path").alias("path")), "path"), key("content_repeated", repeated(index, "sha256"), "sha256"),
        key("canary", canaries(documents, CANARIES), "doc_id"),
    ]
    counts = index.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("byte_count"), F.lit(0)).alias("total_bytes"), F.coalesce(F.sum("character_count"), F.lit(0)).alias("total_characters"))
    parts += [key("manifest_differs", counts.where(F.col(c) != F.lit(int(manifest.get(c, -1)))).select(F.lit(c).alias("c")), "c") for c in ("document_count", "total_bytes", "total_characters")]
    for column, name in (("note_type", "note_type_counts"), ("language", "language_counts"), ("extraction_method", "extraction_method_counts")):
        stated = manifest.get(name, {})
        listed = spark.createDataFrame([(str(k), int(v)) for k, v in stated.items()], "value string, stated long")
        got = index.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
        parts.append(key("manifest_differs", got.join(listed, "value", "full").where("not (n <=> stated)").select(F.concat_ws("=", F.lit(name), "value").alias("c")), "c"))
    violations = parts[0]
    for part in parts[1:]:
        violations = violations.unionByName(part)
    return documents.select("doc_id", "language", "note_type", "extraction_method", "text"), violations, manifest


def require_none(violations: DataFrame, location: str) -> None:
    """Raise for the first violation in order; a bundle that breaks its contract is never used."""
    first = violations.orderBy(*violations.columns).limit(1).collect()
    if first:
        raise ContractError(str(first[0][0]).upper(), "The contract is broken.", location, INTEGRITY)
