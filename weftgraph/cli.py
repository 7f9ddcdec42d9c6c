"""Command line: workflows (*.yaml) and documents (paths or globs) to graphs."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.plans import engine
from weftgraph.plans.workflow import WorkflowError, parse
from weftgraph.session import session
from weftgraph.sources import endpoints, extract, readers, sinks


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="weftgraph", description="Runs workflows over documents; of several workflows each document keeps the best.")
    parser.add_argument("inputs", nargs="+", help="*.yaml are workflows, all others documents")
    parser.add_argument("-d", "--define", action="append", default=[], metavar="NAME=VALUE", help="a variable of all workflows")
    parser.add_argument("-o", "--output", metavar="FOLDER", help="one Turtle file for each document, and its diagnostics")
    parser.add_argument("--ntriples", metavar="FOLDER", help="all statements as N-Triples")
    parser.add_argument("--text", action="store_true", help="print the documents' texts and stop")
    parser.add_argument("-t", "--extract", metavar="URL", help="a text-extraction server for all but text, XHTML and PDF files (lh: on this machine)")
    parser.add_argument("-p", "--proxy", metavar="URL", help="a proxy to the server; - for none")
    parser.add_argument("-u", "--upload", metavar="URL", help="a graph store that takes the graphs; user and password may stand in the URL")
    parser.add_argument("-n", "--by-name", action="store_true", help="upload each graph under its document's name (the default is its number)")
    parser.add_argument("-N", "--namespace", metavar="IRI", help="upload all graphs to one of this name")
    parser.add_argument("-put", "--put", action="store_true", help="upload with PUT, which replaces a graph")
    parser.add_argument("-post", "--post", action="store_true", help="upload with POST, which adds to a graph")
    parser.add_argument("-g", "--graph", action="store_true", help="print the graphs")
    parser.add_argument("--documented", action="store_true", help="unset variables are empty")
    parser.add_argument("--python", action="store_true", help="allow exec and any eval in workflows")
    parser.add_argument("-v", "--verbose", action="store_true", help="print each workflow's result for each document")
    parser.add_argument("-V", "--very-verbose", action="store_true", help="print the log, too")
    return parser


def lines_of(rows: DataFrame, *order: str):
    """Rows for printing, without holding them all."""
    return rows.orderBy(*order).toLocalIterator()


def main(argv: list[str] | None = None) -> int:
    parser = arguments()
    at = parser.parse_args(argv)
    names = [x for x in at.inputs if x.lower().endswith((".yaml", ".yml"))]
    paths = [x for x in at.inputs if x not in names]
    if not paths or not (names or at.text):
        parser.error("at least one workflow and one document are needed")
    names = [str(f) for n in names for f in (sorted(Path().glob(n)) if any(c in n for c in "*?") and not Path(n).is_absolute() else [n])]
    try:
        workflows = [parse(Path(n).read_text(encoding="utf-8"), Path(n).stem) for n in names]
    except (WorkflowError, OSError) as e:
        parser.error(str(e))
    spark = session()
    text = dict.fromkeys((".txt", ".md", ".html", ".htm", ".xhtml", ".xml", ""), extract.decoded)
    other = extract.server(at.extract, at.proxy) if at.extract else extract.decoded
    docs = readers.files(spark, *paths, extract=extract.by_extension({**text, ".pdf": extract.pdf()}, other))
    for pair in at.define:
        name, _, value = pair.partition("=")
        docs = docs.withColumn(name, F.lit(value))
    if at.text:
        for row in docs.select("text").toLocalIterator():
            print(row.text)
        return 0
    results = [engine.run(w, docs, documented=at.documented, python=at.python) for w in workflows]
    known = docs.select("doc_id", "doc", "docname")
    failed = 0
    for result in results:
        own = result.workflow.name
        if at.verbose or at.very_verbose:
            for row in lines_of(result.stats().join(known, "doc_id"), "doc"):
                print(f"{row.doc}: {own}: {row.no_triples} triples, {row.no_matches} matches, score {row.score:.3f}")
        if at.very_verbose:
            for row in lines_of(result.log, "doc_id", "ord"):
                print(f"{row.level}: {row.message}")
        for row in result.errors.join(known, "doc_id").toLocalIterator():
            failed = 1
            print(f"{row.doc}: {own}: {row.message}")
        if at.output:
            for kind, rows, line in (("log", result.log, F.concat_ws(": ", "level", "message")), ("err", result.errors, F.col("message"))):
                text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n")
                own_rows = rows.join(known, "doc_id").groupBy("doc_id", "docname").agg(text.alias("text"))
                path = F.concat_ws("/", F.lit("diagnostics"), F.concat_ws("-", "docname", "doc_id"), F.lit(f"{own}.{kind}"))
                sinks.deliver(own_rows.select(path.alias("name"), "text"), _Plain(at.output))
    graph = engine.best_triples(results).join(known, "doc_id")
    prefixes = {s.get("prefix"): s.get("iri") for w in workflows for s in w.walk() if s.op == "prefix"}
    # documents of one name have files of their own
    often = known.groupBy("docname").count().filter("count > 1").select("docname", F.lit(True).alias("often"))
    named = graph.join(often, "docname", "left").withColumn("file", F.when(F.col("often"), F.concat_ws("-", "docname", "doc_id")).otherwise(F.col("docname")))
    if at.output:
        sinks.write_turtle(named, at.output, prefixes, "file")
    if at.ntriples:
        sinks.write_ntriples(graph, at.ntriples)
    if at.graph:
        for row in lines_of(sinks.lines(graph), "value"):
            print(row.value)
    if at.upload:
        endpoints.upload(named, at.upload, "PUT" if at.put else "POST" if at.post else None, "file" if at.by_name else "doc_id", at.namespace)
    for row in lines_of(engine.best(results).join(known, "doc_id"), "doc"):
        print(f"{row.doc}: {row.workflow}, {row.no_triples} triples, {row.no_matches} matches")
    return failed


class _Plain(sinks.Folder):
    """Files under the names they are given."""

    def write_text(self, name: str, text: str) -> None:
        self._write(name, text)
