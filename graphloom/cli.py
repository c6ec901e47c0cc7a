"""Command line: compile a folder of YANG modules, optionally with an HTML view, or run a query.

    python -m graphloom.cli models/ out/ontology.ttl --modules main.yang --base-uri http://example.org/ontology/ --html tree.html
    python -m graphloom.cli --query query.rq --graph out/ontology.ttl data/
"""

from __future__ import annotations

import argparse
import logging
import os
from pathlib import Path

DEFAULT_MAIN = "simap-yang.yang"
DEFAULT_BASE = "http://example.org/ontology/"
DEFAULT_NAME = "simap-ontology.ttl"


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom", description="Compile YANG modules to an ontology and query graphs.")
    p.add_argument("yang_dir", nargs="?", help="folder of YANG modules")
    p.add_argument("output_file", nargs="?", help="Turtle file to write")
    p.add_argument("--yang-dir", dest="yang_dir_option", help="overrides the folder")
    p.add_argument("--output", help="overrides the output")
    p.add_argument("--modules", default=DEFAULT_MAIN, help="main module's file")
    p.add_argument("--base-uri", default=DEFAULT_BASE)
    p.add_argument("--html", help="also write an HTML view")
    p.add_argument("--query", help="file with a SELECT query")
    p.add_argument("--graph", nargs="*", default=[], help="Turtle files or folders to query")
    p.add_argument("--master", help="Spark master, if the launcher sets none")
    p.add_argument("--verbose", action="store_true")
    return p


def output_path(given: str) -> Path:
    """A folder gets the default name; missing parents are made."""
    path = Path(given)
    if path.is_dir() or given.endswith(os.sep):
        path = path / DEFAULT_NAME
    path.parent.mkdir(parents=True, exist_ok=True)
    return path


def main(argv: list[str] | None = None) -> int:
    from .operators.triples import triple_stats
    from .plans.schema_graph import compile_model
    from .plans.sparql import sparql
    from .session import session
    from .sources.html import html_page
    from .sources.turtle import read_turtle, turtle_blocks
    from .sources.yang import read_modules

    a = arguments().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(message)s")
    log = logging.getLogger("graphloom")
    spark = session(master=a.master)
    if a.query:
        rows = sparql(read_turtle(spark, *a.graph), Path(a.query).read_text(encoding="utf-8"))
        print("\t".join(rows.columns))
        for r in rows.toLocalIterator():
            print("\t".join("" if v is None else v for v in r))
        return 0
    folder, out = a.yang_dir_option or a.yang_dir, a.output or a.output_file
    if not folder or not out:
        arguments().error("a folder of modules and an output file are needed")
    stmts, errors = read_modules(spark, folder, a.modules)
    for r in errors.collect():
        log.warning("skipped %s: %s", r["file"], r["reason"])
    graph = compile_model(stmts, a.base_uri).persist()
    target = output_path(out)
    with target.open("w", encoding="utf-8") as f:
        for r in turtle_blocks(graph).orderBy("s").toLocalIterator():
            f.write(r["block"] + "\n\n")
    for r in triple_stats(graph).orderBy("p").collect():
        log.info("%8d %s", r["n"], r["p"])
    log.info("%d triples in %s", graph.count(), target)
    if a.html:
        Path(a.html).write_text(html_page(stmts), encoding="utf-8")
    graph.unpersist()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
