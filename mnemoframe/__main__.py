"""Commands over an engine's data folder: python -m mnemoframe --data FOLDER COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import sys
from datetime import date
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from mnemoframe import schema
from mnemoframe.functions.text import join_query
from mnemoframe.operators import graph, notes, recall, sync
from mnemoframe.operators.distill import Rejected, route, show_user_text
from mnemoframe.plans.engine import Engine
from mnemoframe.sources import files
from mnemoframe.sources.registry import READERS


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="mnemoframe")
    p.add_argument("--data", required=True, help="folder of the engine's tables")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest")
    c.add_argument("source", choices=sorted(READERS))
    c.add_argument("path")
    c.add_argument("--dry-run", action="store_true")
    c.add_argument("--limit", type=int, help="files to read at most")
    c.add_argument("--full", action="store_true", help="read unchanged files as well")
    sub.add_parser("index")
    c = sub.add_parser("embed", help="index with vectors of chunks that are new or changed")
    c.add_argument("encoder", help="MODULE:FUNCTION of (texts, are they queries) -> unit vectors")
    c = sub.add_parser("init", help="the skeleton of a vault")
    c.add_argument("vault")
    for name in ("remember", "remember-private"):
        c = sub.add_parser(name, help="write a note and read it in")
        c.add_argument("vault")
        c.add_argument("title")
        c.add_argument("body")
        c.add_argument("parent")
        c.add_argument("--folder", default="")
        c.add_argument("--source", default="")
    c = sub.add_parser("search")
    c.add_argument("query", nargs="+")
    for name in ("--since", "--source", "--project"):
        c.add_argument(name)
    c.add_argument("--limit", type=int, default=10)
    c.add_argument("--include-nda", action="store_true")
    c.add_argument("--ranking", default="fused")
    c.add_argument("--encoder", help="MODULE:FUNCTION, for hybrid ranking")
    c = sub.add_parser("recall", help="what earlier conversations say to a prompt, if it asks for it")
    c.add_argument("prompt")
    c.add_argument("--name", action="append", default=[], help="a known project; several may be given")
    sub.add_parser("sweep", help="delete versions that the last two manifests don't name")
    sub.add_parser("stats")
    c = sub.add_parser("export", help="documents as Markdown files")
    c.add_argument("path")
    c = sub.add_parser("timeline")
    c.add_argument("--limit", type=int, default=15)
    c = sub.add_parser("distill")
    c.add_argument("--pending", action="store_true")
    c.add_argument("--limit", type=int, default=20)
    c = sub.add_parser("show")
    c.add_argument("doc_id")
    for name in ("add-claims", "add-reviews"):
        c = sub.add_parser(name)
        c.add_argument("file")
    c = sub.add_parser("emit")
    c.add_argument("vault")
    c.add_argument("--parent", action="append", default=[], help="ENTITY=NOTE")
    sub.add_parser("progress")
    c = sub.add_parser("gate", help="what would leak: documents, notes and claims")
    c.add_argument("vault")
    c = sub.add_parser("audit")
    c.add_argument("vault")
    a = p.parse_args(args)

    spark = SparkSession.builder.appName("mnemoframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, a.data)
    show = lambda df: df.show(1000, truncate=False)
    load = lambda name: None if name is None else getattr(importlib.import_module(name.partition(":")[0]), name.partition(":")[2])
    try:
        match a.command:
            case "ingest":
                print(engine.ingest(a.source, a.path, dry_run=a.dry_run, limit=a.limit, full=a.full))
            case "index":
                engine.reindex()
            case "embed":
                engine.reindex(load(a.encoder))
            case "init":
                for path in sync.init_vault(Path(a.vault)):
                    print("new", path)
            case "remember" | "remember-private":
                w = engine.remember(Path(a.vault), a.title, a.body, a.parent, private=a.command != "remember", folder=a.folder, source=a.source)
                print("new" if w.created else "kept", w.path)
            case "search":
                since = date.fromisoformat(a.since) if a.since else None
                show(engine.search(join_query(a.query), limit=a.limit, include_nda=a.include_nda, since=since, source=a.source, project=a.project, ranking=a.ranking, encoder=load(a.encoder)))
            case "recall":
                got = spark.createDataFrame([(a.prompt,)], "p string").select(recall.decide(F.col("p"), a.name).alias("d")).first().d
                if got.fire:
                    print(recall.context(engine.index(), a.prompt, got.entity or ""))
            case "sweep":
                print(engine.sweep(), "folders")
            case "export":
                print(files.export(engine.docs(), a.path), "files")
            case "stats":
                show(engine.stats())
            case "timeline":
                show(engine.timeline(limit=a.limit))
            case "distill":
                show(engine.candidates(pending=a.pending, limit=None).limit(a.limit) if a.limit else engine.candidates(pending=a.pending))
            case "show":
                print("\n".join(r[0] for r in engine.docs().where(engine.docs().doc_id == a.doc_id).select(show_user_text("turns")).collect()))
            case "add-claims":
                engine.add_claims(spark.read.schema(schema.CLAIM).option("multiLine", "true").json(a.file).na.fill({"confidence": "medium", "rationale": "", "entity": ""}))
            case "add-reviews":
                engine.add_reviews(spark.read.schema(schema.REVIEW).option("multiLine", "true").json(a.file))
            case "emit":
                routed = route(engine.claims(), engine.docs())
                parents = dict(x.split("=", 1) for x in a.parent)
                for layer, folder in (("clean", "notes"), ("private", "private")):
                    part = routed.where(routed.layer == layer).select(*schema.columns(schema.CLAIM))
                    if part.take(1):
                        for w in notes.emit(part, Path(a.vault), folder, parents):
                            print("new" if w.created else "kept", w.path)
            case "progress":
                show(engine.progress())
            case "audit":
                report, errors = graph.audit(graph.read_nodes(spark, a.vault))
                show(report)
                show(errors)
                layout = graph.layout_errors(spark, a.vault)
                show(layout)
                return int(not report.first().ok or bool(layout.take(1)))
            case "gate":
                found = engine.leak_gate(a.vault)
                show(found)
                return int(bool(found.take(1)))
    except (Rejected, notes.NoteError, FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
