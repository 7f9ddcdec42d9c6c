"""Runs workflows over document tables and ranks their results."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.expression import Unsupported
from weftgraph.functions.regex import Untranslatable
from weftgraph.functions.terms import TERM
from weftgraph.plans import columns, machine
from weftgraph.plans.columns import KEY, ROW
from weftgraph.plans.workflow import Workflow, WorkflowError, parse
from weftgraph.session import shared_folder, spread

_TRIPLE = {"s": TERM, "p": TERM, "o": TERM, "inverse": "boolean"}
_LOG = {"level": "string", "message": "string"}
_KINDS = {"triple": _TRIPLE, "match": {"length": "int"}, "log": _LOG, "file": _LOG, "error": {"message": "string"}}
_EVENTS = f"row long, doc_id long, kind string, ord array<int>, s {TERM}, p {TERM}, o {TERM}, inverse boolean, length int, level string, message string"
_PA_TERM = pa.struct([(n, pa.string()) for n in ("kind", "lex", "datatype", "lang")])


class Result:
    """What a workflow makes of the documents, as lazy DataFrames with doc_id and ord.

    Each input row is a document of its own, also where doc_ids are repeated or NULL; ``row`` tells them apart. Documents
    with an error have no triples; all other tables keep their rows.
    """

    def __init__(self, workflow: Workflow, docs: DataFrame, text: str = "text", engine: str = "auto", documented: bool = False, python: bool = False, graphs: dict[str, DataFrame] | None = None):
        docs = fixed(docs)
        self.workflow, self.docs, self.spark = workflow, docs, docs.sparkSession
        self.compiler: columns.Compiler | None = None
        self._events: DataFrame | None = None
        if engine in ("auto", "columns"):
            try:
                self.compiler = columns.Compiler(workflow, docs, text, documented, graphs)
            except (Unsupported, Untranslatable):
                if engine == "columns":
                    raise
        if self.compiler is None:
            self._events = interpreted(workflow, docs, text, documented, python, graphs)

    def _of(self, kind: str) -> DataFrame:
        own = _KINDS[kind]
        if self._events is not None:
            return self._events.filter(F.col("kind") == kind).select(ROW, KEY, "ord", *own)
        found = columns.events(self.compiler, kind, own)
        if found is None:
            schema = f"{ROW} long, {KEY} long, ord array<int>, " + ", ".join(f"{n} {t}" for n, t in own.items())
            return self.spark.createDataFrame([], schema)
        return found

    @property
    def errors(self) -> DataFrame:
        return self._of("error")

    @property
    def triples(self) -> DataFrame:
        """row, doc_id, ord, s, p, o, inverse of every statement, with repetitions."""
        rows = self._of("triple")
        fails = self._events is None and any(e["kind"] == "error" for f in self.compiler.frames for e in f.events)
        return rows.join(self.errors.select(ROW).distinct(), ROW, "left_anti") if fails else rows

    @property
    def graph(self) -> DataFrame:
        """doc_id, s, p, o: the set of a document's statements; rows of one doc_id share a graph."""
        return spread(self.triples.select(KEY, "s", "p", "o"), KEY, "s", "o").distinct()

    @property
    def matches(self) -> DataFrame:
        return self._of("match")

    @property
    def log(self) -> DataFrame:
        return self._of("log")

    @property
    def files(self) -> DataFrame:
        """level (the name) and message (the text) of files that the workflow writes."""
        return self._of("file")

    def tally(self) -> DataFrame:
        """row, doc_id, no_triples, no_matches, total_match_len, score, failed of each input row, from one pass over its events."""
        if self.compiler is not None:
            return columns.tally(self.compiler)
        match = F.col("kind") == "match"
        sums = (F.count_if(F.col("kind") == "triple"), F.count_if(match), F.coalesce(F.sum(F.when(match, F.col("length"))), F.lit(0)), F.coalesce(F.sum(F.when(match, 1 - 1 / F.greatest(F.lit(1), F.col("length")))), F.lit(0.0)), F.max(F.col("kind") == "error"))
        names = ("no_triples", "no_matches", "total_match_len", "score", "failed")
        return self._events.groupBy(ROW).agg(F.first(KEY).alias(KEY), *(c.alias(n) for c, n in zip(sums, names)))

    def stats(self) -> DataFrame:
        """A row for each document: workflow, no_triples, no_matches, total_match_len, score, failed."""
        return self._stats().drop(ROW)

    def _stats(self) -> DataFrame:
        kept = F.when(F.col("failed"), F.lit(0).cast("long")).otherwise(F.col("no_triples")).alias("no_triples")
        return self.tally().select(ROW, KEY, F.lit(self.workflow.name).alias("workflow"), kept, "no_matches", F.col("total_match_len").cast("long").alias("total_match_len"), "score", "failed")


#: Plans whose rows come in the same order whenever they are read.
_ORDERED = {"Project", "Filter", "LogicalRelation", "LogicalRDD", "Range", "Union", "SubqueryAlias", "Generate", "MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "View", "ResolvedHint", "DataSourceV2Relation"}


def fixed(docs: DataFrame) -> DataFrame:
    """The documents, written to the shared folder if they come from a shuffle, after which their order isn't sure."""
    if docs.isStreaming:
        return docs
    todo = [docs._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() not in _ORDERED:
            shared_folder(docs.sparkSession)
            return docs.checkpoint()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return docs


def run(source: str | list | Workflow, docs: DataFrame, text: str = "text", engine: str = "auto", documented: bool = False, python: bool = False, name: str = "workflow", graphs: dict[str, DataFrame] | None = None) -> Result:
    """Run a workflow over docs (doc_id, a text column; all other columns are variables).

    engine: "columns" compiles or raises Unsupported, "python" interprets, "auto" interprets only what can't compile.
    documented: unset variables are empty and numbered references mean the latest match, as workflows' writers are told.
    python: allow exec and arbitrary eval, which run in the workers.
    graphs: what ``select`` steps query by name; other names are N-Triples files.
    """
    workflow = source if isinstance(source, Workflow) else parse(source, name)
    return Result(workflow, docs, text, engine, documented, python, graphs)


def queried(workflow: Workflow, docs: DataFrame, graphs: dict[str, DataFrame] | None) -> dict[str, list[tuple]]:
    """Rows of the queries of a workflow's select steps that are the same for all documents, by the steps' places."""
    from weftgraph.operators import graph

    found = {}
    for step in workflow.walk():
        if step.op == "select" and not columns.references([step.get("where"), step.get("from")]):
            names, _ = columns.selected(step)
            rows = graph.ask(docs.sparkSession, step.get("from"), step.get("where"), graphs or {}, step.get("username"), step.get("password")).select(*names)
            if not step.body():
                rows = rows.agg(F.min(F.struct(*names)).alias("row")).filter("row is not null").select("row.*")
            size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in names), F.lit(16)))).first()[0] or 0
            if size > columns.SELECT_MB * 1e6:
                raise WorkflowError(f"{step.where}: {size / 1e6:.0f} MB of rows are too many to put beside every document")
            found[step.where] = sorted(map(tuple, rows.collect()), key=lambda r: [(x is not None, x or "") for x in r])
    return found


def interpreted(workflow: Workflow, docs: DataFrame, text: str, documented: bool, python: bool, graphs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Events of a workflow that is interpreted, document by document; each document has an event of kind document."""
    names = [c for c in docs.columns if c != text]
    number = F.col(KEY).cast("long") if docs.isStreaming else F.monotonically_increasing_id()
    rows = docs.select(number.alias(ROW), F.col(KEY).cast("long").alias(KEY), F.col(text).cast("string").alias("text"), *(F.col(c).cast("string").alias(f"var_{c}") for c in names))
    selects = queried(workflow, docs, graphs)

    def term(t: machine.Term) -> dict:
        return {"kind": t.kind, "lex": t.lex, "datatype": t.datatype, "lang": t.lang}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = []
            for k in range(batch.num_rows):
                key, body = (batch.column(0)[k].as_py(), batch.column(1)[k].as_py()), batch.column(2)[k].as_py()
                out = machine.run_document(workflow, body, {n: batch.column(j + 3)[k].as_py() for j, n in enumerate(names)}, documented, python, selects)
                found.append({"kind": "document", "key": key, "n": 0})
                found += [{"kind": "triple", "s": term(s), "p": term(p), "o": term(o), "inverse": i, "key": key, "n": n} for n, (s, p, o, i) in enumerate(out.triples)]
                found += [{"kind": "match", "length": m, "key": key, "n": n} for n, m in enumerate(out.lengths)]
                found += [{"kind": "log", "level": a, "message": b, "key": key, "n": n} for n, (a, b) in enumerate(out.log)]
                found += [{"kind": "file", "level": a, "message": b, "key": key, "n": n} for n, (a, b) in enumerate(out.files)]
                if out.error is not None:
                    found.append({"kind": "error", "message": out.error, "key": key, "n": 0})
            kinds = {"s": _PA_TERM, "p": _PA_TERM, "o": _PA_TERM, "inverse": pa.bool_(), "length": pa.int32(), "level": pa.string(), "message": pa.string()}
            columns_ = [pa.array([f["key"][0] for f in found], pa.int64()), pa.array([f["key"][1] for f in found], pa.int64()), pa.array([f["kind"] for f in found], pa.string()), pa.array([[f["n"]] for f in found], pa.list_(pa.int32()))]
            columns_ += [pa.array([f.get(n) for f in found], t) for n, t in kinds.items()]
            yield pa.RecordBatch.from_arrays(columns_, ["row", "doc_id", "kind", "ord", *kinds])

    return rows.mapInArrow(work, _EVENTS)


def _best(results: list[Result]) -> DataFrame:
    rows = None
    for k, result in enumerate(results):
        own = result._stats().withColumn("workflow_no", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    order = Window.partitionBy(ROW).orderBy(F.desc("no_triples"), F.desc("no_matches"), F.desc("total_match_len"), "workflow_no")
    return rows.filter(~F.col("failed")).withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank", "failed")


def best(results: list[Result]) -> DataFrame:
    """For each document the stats of the workflow with most triples, then matches, then matched text, then the first.

    The results must be of the same documents.
    """
    return _best(results).drop(ROW)


def best_triples(results: list[Result]) -> DataFrame:
    """doc_id, workflow, s, p, o of each document's best workflow."""
    chosen = _best(results).select(ROW, "workflow_no")
    rows = None
    for k, result in enumerate(results):
        own = result.triples.select(ROW, KEY, "s", "p", "o").distinct().withColumn("workflow", F.lit(result.workflow.name)).withColumn("workflow_no", F.lit(k))
        rows = own if rows is None else rows.unionByName(own)
    return rows.join(chosen, [ROW, "workflow_no"], "left_semi").drop(ROW, "workflow_no")
