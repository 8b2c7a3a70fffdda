"""Command line: ``index``, ``search``, ``stats``, ``verify``, ``delete``, ``watch``; ``STORE QUERY`` alone is a search."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.config import Config
from sylvan.functions import text as X
from sylvan.operators import index, search
from sylvan.plans import query as Q
from sylvan.streaming import watch


COMMANDS = ("index", "watch", "search", "stats", "verify", "delete")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sylvan", description="Structure-aware document retrieval on Spark")
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("index", "bring an index to a folder's state"), ("watch", "do so again whenever files come"), ("search", "ask an index"), ("delete", "remove documents"), ("stats", "count what is indexed"), ("verify", "look for rows without a document")):
        s = sub.add_parser(name, help=text)
        s.add_argument("store", help="folder of the index")
        if name in ("index", "watch"):
            s.add_argument("folder")
            s.add_argument("--no-prune", dest="prune", action="store_false", default=None)
            s.add_argument("--prune", dest="prune", action="store_true", help="reduce the index to what the folder lists")
            s.add_argument("--force", action="store_true")
            s.add_argument("--max-files", type=int, default=10_000)
            s.add_argument("--extension", action="append", help="only files of this extension; may be given again")
        if name == "delete":
            s.add_argument("paths", nargs="+", help="source paths or ids")
        if name == "verify":
            s.add_argument("--files", action="store_true", help="look for files that are gone, too")
            s.add_argument("--repair", action="store_true")
        if name == "search":
            s.add_argument("query")
            s.add_argument("--expression")
            s.add_argument("--regex", action="store_true")
            s.add_argument("--mode", choices=["auto", "flat", "tree"], default="auto")
            s.add_argument("--docs", type=int, default=3)
            s.add_argument("--nodes", type=int, default=5)
            s.add_argument("--budget", type=int, default=32_000)
            s.add_argument("--merge", choices=["interleave", "per_doc", "global_score"], default="interleave")
            s.add_argument("--format", choices=["plain", "json", "tty"], default="plain")
    return p


def rendered(result: search.Result, terms: list[str], kind: str = "plain") -> DataFrame:
    """One column ``line``: JSON objects, plain lines of up to 100 characters, or lines with marked terms."""
    flat = result.flat_nodes
    if kind == "json":
        return flat.select("rank", F.to_json(F.struct(F.lit("1.0").alias("version"), "doc_id", "doc_name", "node_id", "title", "score", "text")).alias("line"))
    head = F.concat_ws("  ", F.format_number("score", 4), "doc_name", "title")
    text = X.clipped(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), 100)
    return flat.select("rank", F.concat(head, F.lit("\n    "), X.highlight(text, terms) if kind == "tty" else text).alias("line"))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = list(sys.argv[1:] if args is None else args)
    if given and not given[0].startswith("-") and given[0] not in COMMANDS:  # STORE QUERY alone is a search
        given.insert(0, "search")
    a = parser().parse_args(given)
    spark = spark or SparkSession.builder.appName("sylvan").getOrCreate()
    store = index.Index(spark, a.store)
    if a.command == "index":
        print(json.dumps(watch.sync(store, a.folder, a.extension, prune=a.prune, force=a.force, max_files=a.max_files)))
    elif a.command == "watch":
        watch.watch(store, a.folder, a.extension, prune=a.prune, max_files=a.max_files, after=lambda done: print(json.dumps(done), flush=True)).awaitTermination()
    elif a.command == "delete":
        print(json.dumps({"deleted": store.delete_paths(*a.paths)}))
    elif a.command == "stats":
        for r in store.stats().orderBy("source_type").collect():
            print(json.dumps(r.asDict()))
    elif a.command == "verify":
        if a.repair:
            store.repair(a.files)
        found = store.verify(a.files)
        print(json.dumps(found))
        return int(any(found.values()))
    else:
        config = Config.from_env(top_k_docs=a.docs, max_nodes_per_doc=a.nodes, budget_chars=a.budget, merge_strategy=a.merge, search_mode=a.mode)
        result = search.search(search.Corpus.saved(store), a.query, config, a.expression, a.regex)
        for r in rendered(result, Q.query_plan(a.query).terms, a.format).orderBy("rank").collect():
            print(r["line"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
