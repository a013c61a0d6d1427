"""Command line: ``python -m noteloom VERB``, a thin layer over the library."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from noteloom.contracts import INTERNAL, ContractError


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="noteloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    run = verbs.add_parser("protected", help="a protected run over a tree of texts")
    for name in ("corpus", "index", "attestation", "out"):
        run.add_argument(f"--{name}", required=True)
    check = verbs.add_parser("verify", help="the violations of a published run")
    for name in ("index", "out"):
        check.add_argument(f"--{name}", required=True)
    check.add_argument("--floor", type=int, default=3)
    build = verbs.add_parser("build-index", help="a terminology index from CSV files in the order of the profiles")
    build.add_argument("--profiles", required=True)
    build.add_argument("--out", required=True)
    build.add_argument("sources", nargs="+")
    query = verbs.add_parser("query", help="one registered query over a folder of tables")
    query.add_argument("name")
    query.add_argument("tables")
    flat = verbs.add_parser("export", help="a published run as CSV or SKOS")
    flat.add_argument("--format", choices=("csv", "skos"), required=True)
    flat.add_argument("--run", required=True)
    flat.add_argument("--out", required=True)
    a = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("noteloom").getOrCreate()
    try:
        from noteloom.plans import pipeline
        from noteloom.sources import terminology

        if a.verb == "protected":
            print(json.dumps(pipeline.run_protected(spark, a.corpus, *terminology.read_index(spark, a.index), a.attestation, a.out), sort_keys=True))
        elif a.verb == "verify":
            found = pipeline.verify_protected(spark, a.out, *terminology.read_index(spark, a.index), a.floor)
            rows = found.limit(100).collect()
            print(json.dumps({"status": "failed" if rows else "succeeded", "violations": [r.asDict() for r in rows]}, sort_keys=True))
            return 3 if rows else 0
        elif a.verb == "build-index":
            terminology.build_index_set(spark, dict(zip(a.sources, terminology.Profile.read_all(a.profiles), strict=True)), a.out).show(truncate=False)
        elif a.verb == "query":
            from noteloom import catalogue

            catalogue.queries()[a.name](spark, a.tables).show(50, truncate=80)
        else:
            from pathlib import Path

            from noteloom.operators import export

            base = f"file://{Path(a.run).resolve()}"
            tables = {n: spark.read.schema(s).json(f"{base}/{n}.jsonl") for n, s in pipeline.SCHEMAS.items()}
            if a.format == "csv":
                for name, df in tables.items():
                    export.write_csv(df, f"{a.out}/{name}.csv")
            else:
                report = json.loads((Path(a.run) / "run_report.json").read_bytes())
                export.write_skos(tables["coding_counts"], tables["context_counts"], tables["lexical_forms"], tables["associations"], a.out, report["run_fingerprint"])
        return 0
    except ContractError as breach:
        print(json.dumps(breach.report(), sort_keys=True), file=sys.stderr)
        return breach.exit_code
    except Exception:  # the message may hold data of the corpus
        print(json.dumps({"code": "INTERNAL", "status": "failed"}), file=sys.stderr)
        return INTERNAL


if __name__ == "__main__":
    sys.exit(main())
