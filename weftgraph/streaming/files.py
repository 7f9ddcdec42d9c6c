"""Workflows over documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from weftgraph.plans import engine
from weftgraph.plans.workflow import Workflow
from weftgraph.sources import sinks


def stream(docs: DataFrame, workflow: Workflow | str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append the statements of a streaming table of documents (doc_id, text, variables) to N-Triples files.

    Each batch writes its own folder, replaced if the batch is repeated after a failure.
    """

    def batch(rows: DataFrame, number: int) -> None:
        sinks.write_ntriples(engine.run(workflow, rows).graph, f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
