"""Graph sinks: N-Triples in bulk, one Turtle file for each document."""

from __future__ import annotations

import os
import re
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftgraph.functions.terms import Term, c_ntriples, ntriples


def lines(graph: DataFrame) -> DataFrame:
    """value: a line of N-Triples for each distinct statement."""
    line = F.concat_ws(" ", c_ntriples(F.col("s")), c_ntriples(F.col("p")), c_ntriples(F.col("o")), F.lit("."))
    return graph.select(line.alias("value")).distinct()


def write_ntriples(graph: DataFrame, path: str) -> None:
    """All statements as text files in a folder."""
    lines(graph).write.mode("overwrite").text(path)


def turtle(statements: list[tuple[Term, Term, Term]], prefixes: dict[str, str]) -> str:
    """One graph in Turtle: prefixes, then subjects with their predicates, sorted."""

    def short(t: Term) -> str:
        if t.kind == "iri":
            for name, base in prefixes.items():
                if t.lex.startswith(base) and re.fullmatch(r"[A-Za-z0-9_]([\w-]*\w)?", t.lex[len(base) :]):
                    return f"{name}:{t.lex[len(base) :]}"
        return ntriples(t)

    out = [f"@prefix {name}: <{base}> ." for name, base in sorted(prefixes.items())] + [""]
    by: dict[str, dict[str, set[str]]] = {}
    for s, p, o in statements:
        by.setdefault(short(s), {}).setdefault(short(p), set()).add(short(o))
    for s, predicates in sorted(by.items()):
        body = " ;\n".join(f"    {p} " + ",\n        ".join(sorted(objects)) for p, objects in sorted(predicates.items()))
        out += [f"{s}\n{body} .", ""]
    return "\n".join(out)


def turtle_texts(graph: DataFrame, prefixes: dict[str, str], name: str = "doc_id") -> DataFrame:
    """doc_id, text: each document's graph in Turtle."""
    grouped = graph.groupBy(name).agg(F.array_sort(F.collect_set(F.struct("s", "p", "o"))).alias("rows"))

    def work(batches):
        for batch in batches:
            made = [turtle([tuple(Term(*(x[c][n] for n in Term._fields)) for c in ("s", "p", "o")) for x in rows], prefixes) for rows in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [name, "text"])

    return grouped.mapInArrow(work, StructType([graph.schema[name], StructField("text", StringType())]))


class Output(Protocol):
    """Where texts and graphs of documents go; it is sent to the workers, and a repeated task writes the same again."""

    def write_turtle(self, name: str, text: str) -> None: ...

    def write_text(self, name: str, text: str) -> None: ...


class Folder:
    """Files in a folder that all workers share; .ttl and .txt are added to names without them."""

    def __init__(self, path: str):
        self.path = path

    def write_turtle(self, name: str, text: str) -> None:
        self._write(name if name.endswith(".ttl") else f"{name}.ttl", text)

    def write_text(self, name: str, text: str) -> None:
        self._write(name if name.endswith(".txt") else f"{name}.txt", text)

    def _write(self, name: str, text: str) -> None:
        path = os.path.join(self.path, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{os.getpid()}", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f"{path}.{os.getpid()}", path)


def deliver(rows: DataFrame, output: Output, name: str = "name", text: str = "text", turtle: bool = False) -> None:
    """Hand each row's text to an output, in the workers."""
    picked = rows.select(F.col(name).cast("string").alias("name"), F.col(text).cast("string").alias("text"))

    def write(own) -> None:
        for row in own:
            (output.write_turtle if turtle else output.write_text)(row.name or "unnamed", row.text or "")

    picked.foreachPartition(write)


def write_turtle(graph: DataFrame, folder: str, prefixes: dict[str, str], name: str = "doc_id") -> None:
    """A file <name>.ttl for each document in a folder that all workers share."""
    deliver(turtle_texts(graph, prefixes, name), Folder(folder), name, turtle=True)
