"""Whole runs on the demo corpus: counts, gates, tampering, curation, exports, streams."""

import json

import pytest
from pyspark.sql import functions as F

from noteloom.contracts import Config, ContractError, MiningLimits, canonical_json, load_json, relative_path
from noteloom.operators import combined, curation, export, matching, mining, protected
from noteloom.operators.verify import order_violations
from noteloom.plans import pipeline
from noteloom.sources import corpus, demo, terminology
from noteloom.streaming import mentions as stream


@pytest.fixture()
def attestation(tmp_path):
    path = tmp_path / "attestation.json"
    path.write_text('{"approved":true,"approval_refs":{"a":"b"},"lexical_output_approved":true}')
    return path


def test_protected_run_and_its_verification(spark, tmp_path, attestation):
    demo.write_tree(str(tmp_path / "corpus"))
    coding, designation = demo.terminology(spark)
    report = pipeline.run_protected(spark, str(tmp_path / "corpus"), coding, designation, str(attestation), str(tmp_path / "out"))
    read = lambda n: [json.loads(line) for part in sorted((tmp_path / "out" / f"{n}.jsonl").glob("part-*")) for line in part.read_text().splitlines()]
    codes = {r["code"]: r for r in read("coding_counts")}
    assert codes["C1"]["exact_match_document_count"] == 3 and codes["C4"]["exact_match_document_count"] == 4 and "C5" not in codes
    assert [(r["code_a"], r["code_b"], r["cooccurrence_document_count"]) for r in read("associations")] == [("C1", "C4", 3)]
    assert read("ambiguity_counts")[0]["ambiguous_form_count"] == 1
    assert "Special unmapped finding" in {r["form"] for r in read("candidate_terms")}
    assert report["privacy"]["suppressed_coding_row_count"] == 1 and report["privacy"]["lexical_output_approved"] is True
    assert pipeline.verify_protected(spark, str(tmp_path / "out"), coding, designation, 3).count() == 0
    again = pipeline.run_protected(spark, str(tmp_path / "corpus"), coding, designation, str(attestation), str(tmp_path / "again"))
    assert again["run_fingerprint"] == report["run_fingerprint"]
    part = next(p for p in (tmp_path / "out" / "coding_counts.jsonl").glob("part-*") if "C1" in p.read_text())
    part.write_text(part.read_text().replace('"exact_match_document_count":3', '"exact_match_document_count":2'))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    checks = {r["check"] for r in pipeline.verify_protected(spark, str(tmp_path / "out"), coding, designation, 3).collect()}
    assert {"coding_floor", "artifact_digest", "context_exceeds_coding"} <= checks


def test_gate_comes_first(spark, tmp_path):
    refused = tmp_path / "a.json"
    refused.write_text('{"approved":false,"approval_refs":{}}')
    with pytest.raises(ContractError) as breach:
        pipeline.run_protected(spark, str(tmp_path / "nowhere"), None, None, str(refused), str(tmp_path / "out"))
    assert breach.value.exit_code == 5 and not (tmp_path / "out").exists()


def test_open_run_with_curation(spark, tmp_path):
    coding, designation = demo.terminology(spark)
    log = str(tmp_path / "decisions.jsonl")
    curation.append_decision(log, "MI", demo.SYSTEM, demo.RELEASE, "C2", "accepted", "someone")
    curation.append_decision(log, "MI", demo.SYSTEM, demo.RELEASE, "C2", "rejected", "someone", note="no")
    config = Config(("en",), ("progress", "consult"), ((demo.SYSTEM, demo.RELEASE),), MiningLimits(1, 3))
    report = pipeline.run_analysis(spark, demo.documents(spark), coding, designation, config, str(tmp_path / "run"), curation.read_decisions(spark, log))
    sets = spark.read.json(f"{tmp_path}/run/candidate_sets.jsonl")
    row = sets.where("primary_normalized_form = 'MI'").first()
    assert row["algorithmic_outcome"] == "grounded_ambiguous" and row["acceptance_state"] == "curator_rejected" and report["outcomes"]["grounded_ambiguous|"] == 1
    assert sets.where("algorithmic_outcome = 'unmapped' and acceptance_state is not null").count() == 0
    with pytest.raises(ContractError):
        pipeline.run_analysis(spark, demo.documents(spark), coding, designation, Config(("de",), ("progress",), ((demo.SYSTEM, demo.RELEASE),)), str(tmp_path / "no"))


def test_decision_chain_breaks_are_found(spark, tmp_path):
    log = tmp_path / "d.jsonl"
    for i in range(4):
        curation.append_decision(str(log), f"f{i}", "s", "r", "c", "accepted", "x")
    assert curation.chain_violations(curation.read_decisions(spark, str(log))).count() == 0
    lines = log.read_text().splitlines()
    log.write_text("\n".join([lines[0], lines[1].replace("f1", "g1"), lines[3], "no json"]) + "\n")
    assert {r["check"] for r in curation.chain_violations(curation.read_decisions(spark, str(log))).collect()} == {"sequence_gap", "unreadable"}
    log.write_text("\n".join([lines[0], lines[1].replace("f1", "g1"), lines[2]]) + "\n")
    assert [(r["check"], r["sequence"]) for r in curation.chain_violations(curation.read_decisions(spark, str(log))).collect()] == [("chain_broken", 3)]


def test_import_of_a_csv_release(spark, tmp_path):
    source = tmp_path / "release.csv"
    source.write_bytes("﻿".encode() + b'system,code,display,aliases,source,version,effective_date,status\r\nS,A1,"Fever, high",pyrexia|Fever| |pyrexia,src,1,2024-01-01,ACTIVE\r\nS,A2,Gout,,src,1,2024-01-01,OLD\r\n')
    profile = terminology.Profile("urn:s", "S", "1", "2024-01-01", "src", ("system", "code", "display", "aliases", "source", "version", "effective_date", "status"), status_column="status", allowed_statuses=("ACTIVE", "OLD"), active_statuses=("ACTIVE",), expected_codes=2, expected_aliases=2)
    terminology.build_index_set(spark, {str(source): profile}, str(tmp_path / "index"))
    coding, designation = terminology.read_index(spark, str(tmp_path / "index"))
    assert {(r["code"], r["active"]) for r in coding.collect()} == {("A1", True), ("A2", False)}
    assert {r["value"] for r in designation.where("kind = 'alias'").collect()} == {"pyrexia", "Fever"}
    assert terminology.index_violations(spark, str(tmp_path / "index")).count() == 0
    source.write_text(source.read_text(encoding="utf-8-sig").replace("OLD", "ODD").replace("A2", "A 2"), encoding="utf-8")
    assert {r["check"] for r in terminology.import_violations(terminology.read_csv(spark, str(source), profile), profile).collect()} == {"status", "code_form"}


def test_snapshot_bundle(spark, tmp_path):
    import hashlib

    texts = {"documents/a.txt": "Fever. Write to x@example.org", "documents/b.txt": "Gout"}
    (tmp_path / "documents").mkdir()
    rows = []
    for path, text in texts.items():
        (tmp_path / path).write_text(text)
        rows.append({"doc_id": path[-5], "path": path, "sha256": hashlib.sha256(text.encode()).hexdigest(), "byte_count": len(text), "character_count": len(text), "note_type": "n", "language": "en", "extraction_method": "m", "subject_group_id": None})
    (tmp_path / "documents.jsonl").write_bytes(b"".join(canonical_json(r) + b"\n" for r in rows))
    counts = {"document_count": 2, "total_bytes": sum(map(len, texts.values())), "total_characters": sum(map(len, texts.values())), "note_type_counts": {"n": 2}, "language_counts": {"en": 2}, "extraction_method_counts": {"m": 3}}
    (tmp_path / "manifest.json").write_bytes(canonical_json(counts))
    documents, violations, _ = corpus.read_snapshot(spark, str(tmp_path))
    assert documents.count() == 2 and {(r["check"], r["key"]) for r in violations.collect()} == {("canary", "a"), ("manifest_differs", "extraction_method_counts=m")}
    with pytest.raises(ContractError):
        corpus.require_none(violations, "snapshot")
    (tmp_path / "documents" / "link.txt").symlink_to(tmp_path / "documents" / "a.txt")
    with pytest.raises(ContractError):
        corpus.read_text_tree(spark, str(tmp_path / "documents"))


def test_strict_json():
    for raw in (b'{"a":1,"a":2}', b'{"a":1.5}', b"version https://git-lfs.github.com/spec/v1\n", b"\xff"):
        with pytest.raises(ContractError):
            load_json(raw)
    assert canonical_json({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'.encode()
    with pytest.raises(ContractError):
        relative_path("../x")


def test_results_do_not_depend_on_partitions_or_order(spark):
    rows = demo.documents(spark)
    one, other = (mining.phrase_aggregates(mining.counted_mentions(d, 1, 3), 4) for d in (rows.coalesce(1), rows.repartition(3, "text").orderBy(F.rand(3))))
    assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))


def test_tf_idf(spark):
    import math

    rows = spark.createDataFrame([("1", "en", "n", "alpha alpha"), ("2", "en", "n", "beta")], "doc_id string, language string, note_type string, text string")
    got = {r["primary"]: r["max_sublinear_tf_idf"] for r in mining.phrase_aggregates(mining.counted_mentions(rows, 1, 1), 2).collect()}
    assert abs(float(got["alpha"]) - (1 + math.log(2)) * (1 + math.log(1.5))) < 1e-6
    same = spark.createDataFrame([("1", "en", "n", "gamma"), ("2", "en", "n", "gamma")], rows.schema)
    assert mining.phrase_aggregates(mining.counted_mentions(same, 1, 1), 2).first()["max_sublinear_tf_idf"] == "1.000000"


def test_empty_and_null_inputs(spark):
    none = spark.createDataFrame([], "doc_id string, language string, note_type string, text string")
    assert mining.phrase_aggregates(mining.counted_mentions(none), 0).count() == 0 and mining.corpus_totals(none).first()["ngram_count"] == 0
    coding, designation = demo.terminology(spark)
    phrases = spark.createDataFrame([], "primary string, folded string")
    found = matching.evidence(phrases, matching.active_designations(coding, designation))
    assert found.count() == 0
    cube = spark.createDataFrame([], "primary string, doc_id string, context string, folded string, token_count int, n long")
    tables = protected.protect(cube, found, matching.release_list(coding), 0, protected.Limits())
    assert tables.coding_counts.count() == 0 and tables.ambiguity_counts.count() == 1 and {r["value"] for r in tables.privacy_counters.collect()} == {0}


def test_dense_documents_are_skipped_for_pairs_but_count(spark):
    cells = spark.createDataFrame([("s", "r", c, d, "current_clinical", 1, "p") for d in range(4) for c in "abc"] + [("s", "r", c, 9, "current_clinical", 1, "p") for c in "abcd"], "system_uri string, release_id string, code string, doc_id long, context string, n long, primary string")
    pairs, skipped = protected.association_pairs(cells, 5, protected.Limits(max_association_codes_per_document=3))
    rows = {(r["code_a"], r["code_b"]): r for r in pairs.collect()}
    assert set(rows) == {("a", "b"), ("a", "c"), ("b", "c")} and rows[("a", "b")]["cooccurrence_document_count"] == 4 and rows[("a", "b")]["document_count_a"] == 5 and skipped.count() == 1


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(None, True, {"b": 1, "a": 2}, [("x", 1)])], "n string, f boolean, m map<string,int>, l array<struct<z:string,a:int>>")
    assert export.canonical_json(df).first()[0] == '{"f":true,"l":[{"a":1,"z":"x"}],"m":{"a":2,"b":1},"n":null}'
    assert export.flat(df).first().asDict() == {"f": "true", "l": '[{"a":1,"z":"x"}]', "m": '{"a":2,"b":1}', "n": ""}
    with pytest.raises(ValueError):
        export.canonical_json(spark.range(1).select(F.lit(1.5)))
    assert spark.range(1).select(export.turtle_text(F.lit('a"\\\n'))).first()[0] == 'a\\"\\\\\\n'


def test_order_check(spark):
    lines = spark.createDataFrame([(1, "a"), (2, "c"), (3, "b"), (4, "b")], "position long, k string")
    assert {r["key"] for r in order_violations(lines, ["k"]).collect()} == {"3", "4"}


def test_stream_counts_equal_batch(spark, tmp_path):
    import datetime as dt

    rows = [(i, "en", f"Fever and gout. {'Fever' if i % 2 else ''}", dt.datetime(2031, 1, 1 + i % 3)) for i in range(12)]
    schema = "doc_id bigint, lang string, text string, received_at timestamp"
    df = spark.createDataFrame(rows, schema)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = stream.token_counts(stream.arriving_documents(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(str, spark.table("counts").collect())) == sorted(map(str, stream.token_counts(df).collect()))


@pytest.mark.parametrize("most", [None, 5])
def test_phrases_combined_where_documents_are_read_equal_those_by_document(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(combined, "CHUNK_TOKENS", most)  # documents of more tokens are counted in parts
    texts = ["pain in hip. pain  in hip! Pain in hip; pain", "sévère pain; sévère pain. pain in\thip", "", None, "Pain. pain. in hip, in hip", "болит колено. болит  колено", "1.5 mg/d pain"]
    rows = [(i % 9 if i % 7 else None, ("en", "de", "ru")[i % 3], ("a", "b", None)[i % 4 % 3], texts[i * i % len(texts)]) for i in range(60)] + [(50, "en", "a", "pain in hip. " * 9)] * 2
    documents = mining.corpus(spark.createDataFrame(rows, "doc_id long, lang string, note_type string, text string"))
    listed = lambda df: sorted(map(str, (r.asDict() | {"note_type_counts": sorted(r["note_type_counts"].items())} for r in df.collect())))
    for shortest, longest, least in ((1, 4, 1), (2, 3, 3)):
        found = combined.aggregates(documents, shortest, longest, least)
        assert listed(found) == listed(mining.phrase_aggregates(mining.counted_mentions(documents, shortest, longest), len(rows), least)) and found.count() > 5
    assert combined.aggregates(documents.limit(0)).count() == 0
    # nothing is shuffled by document and phrase: one exchange of texts, one of what was counted
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2 and "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
