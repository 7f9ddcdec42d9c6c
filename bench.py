"""Times the headline queries; prints one line of JSON.

Each query runs once to warm up and then until it has run three times or taken LONGEST seconds, at least once; the median
counts. A few workflows also run in one plain Python process over the same texts, as a comparison.
"""

from __future__ import annotations

import importlib
import json
import os
import statistics
import time

from weftgraph.session import session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS, LONGEST = 3, 20
NAMES = [
    "match_title_triples", "match_every_links", "within_every_paragraph", "sequence_alternatives", "append_for_each", "literal_infer", "literal_typed", "dimensions_cells", "match_1_cells",
    "stats_score", "best_workflow", "bgp_join", "bgp_path_from", "borders", "segments", "page_tables",
]
PLAIN = {
    "match_every_links": ("pages", """[{match-every: '<li><a href="([^"]*)">([^<]*)', as: a, do: [{echo: "@{a_count}: @{a.1} @{a.2}"}]}]"""),
    "within_every_paragraph": ("pages", """[{within-every: '<p>([^<]*)', as: p, do: [{match-every: '([A-Z][a-z]+)[.]', as: w, do: [{echo: "@{p_count} @{w.1}"}]}]}]"""),
    "dimensions_cells": ("documents", r"""[{match-dimensions: ['([^\n]+)', '([^ ]+)'], dimensions: [i, j], as: c, do-1-*: [{echo: "@{i},@{j} head @{c.1}"}], do: [{echo: "@{i},@{j} @{c.1}"}]}]"""),
}


def plain_python() -> dict[str, float]:
    """Seconds of some queries' workflows, document after document in this process."""
    import pyarrow.parquet as pq

    from weftgraph.plans import machine, workflow

    taken = {}
    for name, (table, source) in PLAIN.items():
        rows = pq.read_table(f"{FOLDER}/{table}.parquet", columns=["html" if table == "pages" else "text"]).column(0).to_pylist()
        texts = [t if table == "documents" or t is None else t[: t.find("</html>") + 7] for t in rows]
        steps = workflow.parse(source)
        start = time.perf_counter()
        for text in texts:
            machine.run_document(steps, text or "", {})
        taken[name] = round(time.perf_counter() - start, 3)
    return taken


def main() -> None:
    entry = importlib.import_module("__spark_entry__")
    spark = session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = entry.queries()
    names = NAMES + sorted((n for n in queries if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])) + [n for n in ("pipeline",) if n in queries]
    taken, runs = {}, {}
    for name in names:
        times: list[float] = []
        for k in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
            if k:
                times.append(time.perf_counter() - start)
                if sum(times) > LONGEST:
                    break
        taken[name], runs[name] = round(statistics.median(times), 3), len(times)
    print(json.dumps({"metric": "total of median query times after a warm-up", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "runs": runs, "plain_python": plain_python(), "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
