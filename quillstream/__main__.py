"""python -m quillstream convert|ingest|query|stats|prune ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from quillstream.api import Config, Converter, Pipeline


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quillstream")
    p.add_argument("--master", help="where no spark-submit sets one")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert", help="one file to Markdown, JSON, XML or chunks")
    c.add_argument("file")
    c.add_argument("--to", choices=("markdown", "json", "xml", "chunks"), default="markdown")
    c.add_argument("--strict", action="store_true")
    c.add_argument("--pages")
    for name in ("init-db", "ingest", "query", "stats", "prune"):
        s = sub.add_parser(name)
        s.add_argument("store", help="a folder that all executors reach")
        if name == "ingest":
            s.add_argument("folder")
        if name == "query":
            s.add_argument("text")
            s.add_argument("--mode", default="hybrid")
            s.add_argument("--top-k", type=int)
            s.add_argument("--extend", action="store_true")
    a = p.parse_args(argv)
    if a.command == "convert":
        r = Converter(page_range=a.pages).convert(a.file)
        if r.status != "success":
            raise SystemExit(r.error)
        print({"markdown": lambda: r.markdown(strict=a.strict), "json": r.json, "xml": r.xml, "chunks": lambda: json.dumps(r.chunks(), ensure_ascii=False, indent=2)}[a.to]())
        return
    builder = SparkSession.builder.appName("quillstream")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    pipe = Pipeline(spark, a.store, Config())
    match a.command:
        case "ingest":
            print(json.dumps(pipe.ingest(a.folder)))
        case "query":
            for r in pipe.query(a.text, mode=a.mode, top_k=a.top_k, extend=a.extend).collect():
                print(f"{r['rank']}. {r['score']:.4f} {r['doc_id'][:12]}#{r['ordinal']}: {' '.join(r['text'].split())[:200]}")
        case "prune":
            pipe.store.prune()
    if a.command in ("stats", "prune", "init-db"):
        print(json.dumps(pipe.stats()))


if __name__ == "__main__":
    main()
