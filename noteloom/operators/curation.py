"""Review decisions: an append-only log whose lines are chained by hash, and its effect on candidate sets."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteloom.operators.matching import RELEASE

GENESIS = "0" * 64
DECISION = T.StructType([
    T.StructField("code", T.StringType()), T.StructField("curation_decision_schema_version", T.StringType()), T.StructField("curator", T.StringType()), T.StructField("decision", T.StringType()),
    T.StructField("note", T.StringType()), T.StructField("previous_sha256", T.StringType()), T.StructField("primary_normalized_form", T.StringType()), T.StructField("release_id", T.StringType()),
    T.StructField("sequence", T.LongType()), T.StructField("system_uri", T.StringType()),
])
KEY = ["primary", *RELEASE, "code"]


def read_decisions(spark, path: str) -> DataFrame:
    """The log's lines with their parsed fields; ``line`` keeps the bytes that the chain is made of."""
    return spark.read.text(path).select(F.col("value").alias("line")).select("line", F.from_json("line", DECISION).alias("d")).select("line", "d.*").withColumnRenamed("primary_normalized_form", "primary")


def chain_violations(decisions: DataFrame) -> DataFrame:
    """``check, sequence`` of each break: lines that don't parse, sequence numbers that repeat or leave a gap,
    a previous hash that isn't that of the line before, an unknown decision.

    The line before is found by joining on the sequence number, so no task has to hold the whole log."""
    broken = decisions.where("sequence is null").select(F.lit("unreadable").alias("check"), F.lit(None).cast("long").alias("sequence"))
    good = decisions.where("sequence is not null")
    doubled = good.groupBy("sequence").count().where("count > 1").select(F.lit("sequence_repeated").alias("check"), "sequence")
    before = good.select((F.col("sequence") + 1).alias("sequence"), F.sha2(F.concat("line", F.lit("\n")), 256).alias("expected"))
    linked = good.select("sequence", "previous_sha256").join(before, "sequence", "left").withColumn("expected", F.when(F.col("sequence") == 1, GENESIS).otherwise(F.col("expected")))
    gaps = linked.where("expected is null").select(F.lit("sequence_gap").alias("check"), "sequence")
    unlinked = linked.where("expected is not null and not (expected <=> previous_sha256)").select(F.lit("chain_broken").alias("check"), "sequence")
    unknown = good.where(~F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False))).select(F.lit("decision").alias("check"), "sequence")
    return broken.unionByName(doubled).unionByName(gaps).unionByName(unlinked).unionByName(unknown)


def append_decision(path: str, primary: str, system_uri: str, release_id: str, code: str, decision: str, curator: str, note: str | None = None) -> dict:
    """Append one decision to a log on the driver's file system and return its row."""
    if decision not in ("accepted", "rejected"):
        raise ValueError("a decision is 'accepted' or 'rejected'")
    target = Path(path)
    lines = target.read_bytes().splitlines(keepends=True) if target.exists() else []
    row = {"code": code, "curation_decision_schema_version": "1.0.0", "curator": curator, "decision": decision, "previous_sha256": hashlib.sha256(lines[-1]).hexdigest() if lines else GENESIS, "primary_normalized_form": primary, "release_id": release_id, "sequence": len(lines) + 1, "system_uri": system_uri}
    if note is not None:
        row["note"] = note
    with target.open("ab") as log:
        log.write(json.dumps(row, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode() + b"\n")
    return row


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision of each key (``primary, system_uri, release_id, code``) as a state."""
    return decisions.groupBy(*KEY).agg(F.max_by("decision", "sequence").alias("decision")).select(*KEY, F.when(F.col("decision") == "accepted", "curator_accepted").otherwise("curator_rejected").alias("state"))


def curated(ranked: DataFrame, latest: DataFrame) -> DataFrame:
    """The state of each set of ranked candidates: that of its first decided candidate in the order of rank
    and code, else 'pending'. ``primary, system_uri, release_id, acceptance_state``."""
    joined = ranked.join(latest, KEY, "left")
    first = F.min_by("state", F.when(F.col("state").isNotNull(), F.struct("priority", "code")))
    return joined.groupBy("primary", *RELEASE).agg(F.coalesce(first, F.lit("pending")).alias("acceptance_state"))
