"""Command line: ingest a source tree, ask a store, verify it, or write the sessions of an event log."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleaner import drivers
from gleaner.operators.fusion import LEXICAL
from gleaner.plans import ingest, retrieval
from gleaner.sources import files, store


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gleaner", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    for name in ("store", "package", "lexicon"):
        one.add_argument(name)
    one.add_argument("--readme")
    one.add_argument("--papers")
    one.add_argument("--spaces", nargs="*")
    one = commands.add_parser("ask")
    for name in ("store", "text"):
        one.add_argument(name)
    one.add_argument("--module")
    one.add_argument("--plan", default="hybrid", choices=["hybrid", "pooled", "trimodal"])
    one.add_argument("--rerank", action="store_true")
    one.add_argument("-k", type=int, default=10)
    one.add_argument("--log")
    one = commands.add_parser("verify")
    one.add_argument("store")
    one.add_argument("--questions")
    one.add_argument("--json")
    one = commands.add_parser("sessions")
    for name in ("log", "out"):
        one.add_argument(name)
    one.add_argument("--force", action="store_true")
    chosen = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if chosen.command == "ingest":
        own = store.Store(spark, chosen.store)
        found = ingest.ingest(own, files.source_files(spark, chosen.package), chosen.package.rstrip("/").rsplit("/", 1)[-1], files.lexicon(spark, chosen.lexicon), chosen.spaces)
        print(json.dumps(found.first().asDict()))
        if chosen.readme:
            print(ingest.ingest_readme(own, files.readme(spark, chosen.readme), chosen.spaces), "README points")
        if chosen.papers:
            print(ingest.ingest_papers(own, files.papers(spark, chosen.papers)).count(), "points linked to papers")
    elif chosen.command == "ask":
        index = retrieval.open_index(store.Store(spark, chosen.store), None if chosen.module is None else F.col("module") == chosen.module)
        asked = spark.createDataFrame([("cli", chosen.text)], "query_id string, text string")
        options = {"reranker": LEXICAL if chosen.rerank else None} | ({"log": chosen.log} if chosen.plan != "pooled" else {})
        found = retrieval.run_plan(chosen.plan, index, asked, k=chosen.k, **options)
        for r in retrieval.with_payload(found, index.points, "source_file", "function_name", "text").orderBy("fused_rank").collect():
            print(f"{r['fused_rank'] + 1}. {r['source_file']}:{r['function_name']} {r['fused_score']:.4f}")
    elif chosen.command == "verify":
        schema = "query_id string, text string, symbol string, source_file string"
        code, facts, text = drivers.verify(store.Store(spark, chosen.store), files.json_table(spark, chosen.questions, schema) if chosen.questions else None)
        print(text)
        if chosen.json:
            with open(chosen.json, "w") as f:
                json.dump(facts, f, indent=1)
        return code
    else:
        print(*drivers.write_sessions(spark, files.event_log(spark, chosen.log, strict=False), chosen.out, force=chosen.force), sep="\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
