"""Command line: ``python -m quillion.cli index|search|repl|serve|add|delete|merge|stats|rebuild|bench``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .functions.text import result_url
from .search_index import ORDERS, SearchIndex
from .sources.documents import parse_jsonl, read_jsonl, read_queries


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quillion", description="full-text retrieval on Spark")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, help: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=help)
        p.add_argument("--index", required=True, help="folder of the index")
        return p

    p = command("index", "build an index from JSON Lines")
    p.add_argument("--input", required=True, help="file or folder, - for standard input")
    p.add_argument("--order", choices=ORDERS, default="none")
    p.add_argument("--title-weight", type=int, default=2)
    p = command("search", "the best documents for a query")
    p.add_argument("--query", required=True)
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--url", help="template with {id} and {title}")
    p = command("repl", "queries line by line; \\bench N times the last one")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--url")
    p = command("serve", "HTTP: /search?q=&k= and /stats")
    p.add_argument("--addr", default="127.0.0.1:8080")
    p = command("add", "add or upsert documents")
    p.add_argument("--input", required=True)
    p.add_argument("--title-weight", type=int, default=2)
    p.add_argument("--upsert", action="store_true")
    p = command("delete", "delete a document")
    p.add_argument("--id", required=True)
    command("merge", "merge all segments")
    command("stats", "numbers of the index")
    command("rebuild", "write term statistics and block impacts anew")
    p = command("bench", "time the queries of a file")
    p.add_argument("--queries", required=True)
    p.add_argument("--top-k", type=int, default=10)
    return top


def _input(spark: SparkSession, source: str):
    return parse_jsonl(spark, sys.stdin.read().splitlines()) if source == "-" else read_jsonl(spark, source)


def link(url: str, text: str, terminal: bool, program: str = "") -> str:
    """A clickable title on terminals, the plain one elsewhere."""
    if not terminal:
        return text
    if program == "Apple_Terminal":
        return f"{text}  \x1b[2m{url}\x1b[0m"
    return f"\x1b]8;;{url}\x1b\\\x1b[4m{text}\x1b[24m\x1b]8;;\x1b\\"


def show(index: SearchIndex, query: str, k: int, template: str | None) -> None:
    results = index.search(query, k)
    rows = (index.with_urls(results, template) if template else results).orderBy("rank").collect()  # k rows
    for r in rows:
        title = link(r["url"], r["title"], sys.stdout.isatty(), os.environ.get("TERM_PROGRAM", "")) if template else r["title"]
        print(f"{r['rank']:>3}  {r['score']:>10.4f}  {r['id']}  {title}")
    print(f"{len(rows)} results; " + ", ".join(f"{k} {v}" for k, v in vars(index.work(query)).items()))


def repl(index: SearchIndex, k: int, template: str | None) -> None:
    last = ""
    for line in sys.stdin:
        line = line.strip()
        if line in (":q", "\\q", "exit", "quit"):
            break
        if line.startswith("\\bench"):
            word = line[6:].strip()
            times = int(word) if word.isdigit() else 1000
            print(index.bench([last] * max(1, times), k) if last else "no query yet")
        elif line:
            last = line
            show(index, line, k, template)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quillion").getOrCreate()
    if a.command == "index":
        made = SearchIndex.build(spark, _input(spark, a.input), a.index, order=a.order, title_weight=a.title_weight)
        print(made.stats())
        return 0
    if a.command == "add":
        index = SearchIndex.create(spark, a.index, a.title_weight)
        docs = _input(spark, a.input)
        if a.upsert:
            print("added {}, updated {}, unchanged {}".format(*index.upsert(docs)))
        else:
            print(index.add(docs))
        return 0
    index = SearchIndex.open(spark, a.index)
    if a.command == "search":
        show(index, a.query, a.top_k, a.url)
    elif a.command == "repl":
        repl(index, a.top_k, a.url)
    elif a.command == "serve":
        from .http_api import serve

        serve(index, a.addr)
    elif a.command == "delete":
        found = index.delete(a.id)
        print("deleted" if found else "not found")
        return 0 if found else 1
    elif a.command == "merge":
        index.merge()
        print(index.stats())
    elif a.command == "stats":
        print(index.stats())
    elif a.command == "rebuild":
        print(index.rebuild_stats())
    elif a.command == "bench":
        queries = [r["query"] for r in read_queries(spark, a.queries).orderBy("query_id").collect()]  # a file of queries
        print(index.bench(queries, a.top_k))
    return 0


__all__ = ["link", "main", "result_url"]

if __name__ == "__main__":
    sys.exit(main())
