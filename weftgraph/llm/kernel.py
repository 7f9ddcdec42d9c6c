"""Vectorised access to the texts of Arrow batches.

Texts are handled as slices of at most a few MB of UTF-8 bytes, so memory stays bounded whatever the batch holds;
a single longer text is one slice of its own. Words are runs of ASCII letters and digits and of non-ASCII
characters, folded to lower case (ASCII and Latin-1); NULL counts as empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)

WORD = np.zeros(256, bool)
WORD[128:] = True
for _low, _high in (("0", "9"), ("a", "z"), ("A", "Z")):
    WORD[ord(_low) : ord(_high) + 1] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
#: A random 64-bit value for each byte.
SYMBOL = np.random.Generator(np.random.PCG64(20177)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the rolling multiplier and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_MULTIPLIER, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    up, down = _powers[0][:n], _powers[1][:n]
    if n > 8 * SLICE:
        _powers[:] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
    return up, down


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise hashes so that all their bits depend on all input bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows' texts in bytes and the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(off, off[low] + limit, "right")) - 1)
        yield low, high, whole[off[low] : off[high]], off[low : high + 1] - off[low]
        low = high


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte letters of Latin-1."""
    low = FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    if len(lead):
        second = data[lead + 1]
        at = lead[(second >= 0x80) & (second <= 0x9E) & (second != 0x97)] + 1
        low[at] += 32
    return low


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end of each run of bytes of the kind, index of each text's first run and their number)."""
    inside = kind[data]
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    before[cuts] = False
    after[cuts - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the given spans; equal bytes have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(low) + 1)
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(SYMBOL[low] * up[: len(low)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word and the number of words)."""
    starts, ends, first = spans(data, offsets)
    return span_hashes(fold(data), starts, ends), first


def text_words(text: str | None) -> np.ndarray:
    """Word hashes of one text."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[0]


#: Arrow batches are bounded by bytes as well as rows, so a run of very long texts can't fill a Python worker.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": (str(64 << 20), str(4 << 20)),
}


def bounded(spark: SparkSession) -> SparkSession:
    """The session with bounds for Arrow batches, unless the user has set them."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, default).rstrip("b") == default:
            spark.conf.set(key, ours)
    return spark


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """Map each Arrow batch to any number of batches; there is no state between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from work(batch)

    bounded(df.sparkSession)
    return df.mapInArrow(run, schema)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Labels (12 bytes each) that are broadcast at most; of more, documents and labels are shuffled to each other.
BROADCAST_ROWS = 1_000_000


def with_label(docs: DataFrame, labels: DataFrame, column: str, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs whose doc_id has a label, with it (of several the largest) in a column of the given name."""
    key = unused(docs, f"{name}_doc")
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    own = own.groupBy(F.col("doc_id").cast("long").alias(key)).agg(F.max(F.col(column).cast("int")).alias(name))
    if own.count() <= most:
        own = F.broadcast(own)
    return docs.join(own, docs["doc_id"].cast("long") == own[key]).drop(key)


def runs_of(column: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the end."""
    return np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [len(column)]]) if len(column) else np.zeros(1, np.int64)


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroup sorted batches so that no run of the first column's values is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0).to_numpy()
        cut = runs_of(values)[-2]
        if held and values[0] == held[-1].column(0)[-1].as_py() and cut == 0:
            held.append(batch)
            continue
        same = int(np.searchsorted(values != held[-1].column(0)[-1].as_py(), True)) if held else 0
        whole = [*held, batch.slice(0, max(cut, same))]
        if sum(b.num_rows for b in whole):
            yield pa.Table.from_batches(whole).combine_chunks()
        held = [batch.slice(max(cut, same))] if max(cut, same) < batch.num_rows else []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
