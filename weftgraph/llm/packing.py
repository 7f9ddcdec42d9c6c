"""Best-fit packing: large items are matched in pairs, smaller ones best-fit the remaining gaps.

Every document is cut into pieces of at most CAPACITY tokens. Pieces above one third of the capacity are matched
greedily: the largest left is paired with the largest that still fits, so a bin holds at most two of them. Smaller
pieces follow from the largest down, each into the fullest bin that has room, or into a new bin.

The packing depends on the sizes alone. Their histogram has at most CAPACITY entries, whatever the corpus, so the
driver packs sizes, in runs of equal bins, exactly as if piece by piece; documents then find their place by their rank
among the pieces of their size. No text is shuffled. The pieces are range-partitioned by size, doc_id and piece, so a
frequent size (such as full pieces of long documents) is spread over as many tasks as it takes; a rank is the place in
the partition and the number of pieces of the size in the partitions before, of which the driver has a line each.

A token is a character of the text unless ``tokens`` gives each row's count. Rows that are NULL or empty have no token
and no place; a very long text is many pieces. Repeated documents are packed each; ties in size go by doc_id (NULL
first) and piece, and rows that are equal in all of these are interchangeable. Extra columns, whatever their names, are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.kernel import bounded, runs_of
from weftgraph.session import shared_folder

CAPACITY = 8192
SCHEMA = "bin_id long, place int, doc_id long, piece int, start long, tokens int"


def arrange(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, number of pieces, first bin, pieces a bin, place of the first in its bin) of each run."""
    runs: list[tuple[int, int, int, int, int, int]] = []
    left = {s: n for s, n in histogram.items() if n > 0}
    ranks: dict[int, int] = defaultdict(int)
    gaps: list[int] = []
    classes: dict[int, list[tuple[int, int, int]]] = {}
    bins = 0

    def put(size: int, n: int, first: int, per: int, place: int) -> None:
        runs.append((size, ranks[size], n, first, per, place))
        ranks[size] += n

    def keep(gap: int, first: int, n: int, held: int) -> None:
        if gap > 0 and n > 0:
            if gap not in classes:
                classes[gap] = []
                insort(gaps, gap)
            classes[gap].append((first, n, held))

    alive = sorted(s for s in left if 3 * s > capacity)
    while alive:
        a = alive.pop()
        n = left[a]
        if 2 * a <= capacity and n > 1:
            put(a, n // 2 * 2, bins, 2, 0)
            keep(capacity - 2 * a, bins, n // 2, 2)
            bins += n // 2
            n %= 2
        while n and (at := bisect_right(alive, capacity - a)):
            b = alive[at - 1]
            m = min(n, left[b])
            put(a, m, bins, 1, 0)
            put(b, m, bins, 1, 1)
            keep(capacity - a - b, bins, m, 2)
            bins += m
            n -= m
            left[b] -= m
            if not left[b]:
                del alive[at - 1]
        if n:
            put(a, n, bins, 1, 0)
            keep(capacity - a, bins, n, 1)
            bins += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            at = bisect_left(gaps, s)
            if at == len(gaps):
                gap, first, number, held = capacity, bins, -(-n // (capacity // s)), 0
                bins += number
            else:
                gap = gaps[at]
                first, number, held = classes[gap].pop()
                if not classes[gap]:
                    del classes[gap], gaps[at]
            per = min(n, gap // s)
            full = min(number, n // per)
            put(s, full * per, first, per, held)
            n -= full * per
            keep(gap - per * s, first, full, held + per)
            if full < number and n and n < per:
                put(s, n, first + full, n, held)
                keep(gap - n * s, first + full, 1, held + n)
                full, n = full + 1, 0
            keep(gap, first + full, number - full, held)
    return runs


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokens: Column | None = None) -> DataFrame:
    """doc_id, piece, start, tokens of each piece of each document."""
    size = F.coalesce(F.length(docs["text"]) if tokens is None else tokens, F.lit(0)).cast("long")
    sized = docs.select(docs["doc_id"].cast("long").alias("doc_id"), size.alias("size")).filter("size > 0")
    last = F.floor((F.col("size") - 1) / capacity).cast("int")
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * capacity
    return cut.select("doc_id", "piece", start.alias("start"), F.least(F.col("size") - start, F.lit(capacity)).cast("int").alias("tokens"))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokens: Column | None = None) -> DataFrame:
    """bin_id, place, doc_id, piece, start, tokens: where each piece goes; start counts tokens of the document."""
    spark = bounded(docs.sparkSession)
    shared_folder(spark)
    # the random number spreads rows that are equal otherwise
    cut = pieces(docs, capacity, tokens).withColumn("tie", F.rand(7)).repartitionByRange("tokens", "doc_id", "piece", "tie")
    ordered = cut.drop("tie").sortWithinPartitions("tokens", "doc_id", "piece").withColumn("part", F.spark_partition_id()).checkpoint()
    counted = sorted((r.tokens, r.part, r["count"]) for r in ordered.groupBy("part", "tokens").count().collect())
    histogram: dict[int, int] = defaultdict(int)
    begin = np.zeros((len(counted), 2), np.int64)
    for k, (size, part, n) in enumerate(counted):
        begin[k] = part << 32 | size, histogram[size]
        histogram[size] += n
    begin = begin[np.argsort(begin[:, 0])]
    runs = np.array(arrange(histogram, capacity), np.int64).reshape(-1, 6)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shared = spark.sparkContext.broadcast((runs, begin))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, begin = shared.value
        last, held = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size, part = (batch.column(k).to_numpy().astype(np.int64) for k in (3, 4))
            key = part << 32 | size
            cuts = runs_of(key)
            rank = np.arange(len(key)) - np.repeat(cuts[:-1], np.diff(cuts))
            if key[0] == last:  # the size goes on from the batch before
                rank[: cuts[1]] += held
            last, held = key[-1], rank[-1] + 1
            rank += begin[np.searchsorted(begin[:, 0], key), 1]
            wide = 1 << 44
            run = np.searchsorted(runs[:, 0] * wide + runs[:, 1], size * wide + rank, "right") - 1
            beyond = rank - runs[run, 1]
            bins, places = runs[run, 3] + beyond // runs[run, 4], runs[run, 5] + beyond % runs[run, 4]
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(places.astype(np.int32)), *(batch.column(k) for k in range(4))], ["bin_id", "place", "doc_id", "piece", "start", "tokens"])

    return ordered.mapInArrow(place, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of the documents table."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
