"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

All word unigrams and bigrams of the corpus are counted. A count c has the level 1 + floor(log_BASE(c)), and the filter
holds the pairs (n-gram, 1) to (n-gram, level); probing a level after another until one is missing gives the level
back (never too low; too high with the filter's small error), and the middle of its counts stands for the count. The
probability of a word interpolates its share after the word before it with its share in the corpus (one added):
p = LAMBDA * min(1, c(vw) / c(v)) + (1 - LAMBDA) * (c(w) + 1) / (N + V + 1); a document's first word has the latter.

The filter grows with the corpus, so it isn't broadcast whole: it lies in shards by the hash of the n-grams, and at every
size it is probed where its shards are. Each PART of the texts sends its distinct n-grams and their counts to the
shards, once and packed into some four bytes each; a shard adds them up, sets the bits of its filter, probes it for
all that it was sent, and sends the levels back to the parts, which are scored in one pass. A hot n-gram arrives once
from each part, and parts have keys of their own even where their texts are equal, so no task's share grows with a
frequent word, a source or a group of copies.

A row for each document: words, log2 of its probability, perplexity per word. Texts that are NULL, empty or wordless
have 0 words, 0 and NULL. A very long text is a part of its own, counted and scored whole. Repeated documents count as
often as they occur, and each has its row; equal texts tie, and a NULL doc_id is carried. Extra columns, whatever their
names, are ignored. An empty table gives no rows. The texts are read twice and must read alike (as a table's do).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.kernel import bounded, mix, runs_of, slices, whole_runs, words
from weftgraph.session import shared_folder

BASE = 1.5
LAMBDA = 0.7
#: Bits of the filter for each pair, and those that a pair sets: an error of about 0.3 %.
BITS, PROBES = 12, 7
#: MB of text whose n-grams share a shard, about; tasks that the shards and the parts are spread over, at most.
SHARD_MB, TASKS = 8, 20_000
#: Bytes of text that send n-grams and are scored at once.
PART = 2 << 20
#: Bits of an n-gram's hash that are told apart within its shard, the kind among them.
WIDTH = 40
SCHEMA = "doc_id long, words int, log2_prob double, perplexity double"
_ONE, _TWO = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def grams(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word's unigram, hash of its bigram with the word before, whether it has one)."""
    one = mix(word * _ONE)
    two = np.zeros(len(word), np.uint64)
    two[1:] = mix(word[:-1] * _TWO + mix(word[1:]))
    has = np.ones(len(word), bool)
    starts = first[:-1]
    has[starts[starts < len(word)]] = False
    return one, two, has


def level_of(count: np.ndarray) -> np.ndarray:
    """Level of a count of at least 1."""
    return (1 + np.floor(np.log(count) / math.log(BASE) + 1e-9)).astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """Middle of the counts that have the level; 0 for level 0."""
    low = np.ceil(BASE ** (np.asarray(level, float) - 1) - 1e-6)
    high = np.maximum(low, np.ceil(BASE ** np.asarray(level, float) - 1e-6) - 1)
    return np.where(np.asarray(level) > 0, (low + high) / 2, 0.0)


def _places(item: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each pair, from which its bits follow."""
    a = mix(item * _ONE + np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return a, mix(a ^ np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def build(item: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The bits of one shard, packed."""
    size = max(1, -(-int(level.sum()) * BITS // 8)) * 8
    bits = np.zeros(size, np.uint8)
    for now in range(1, int(level.max()) + 1 if len(level) else 1):
        a, b = _places(item[level >= now], now)
        for k in range(PROBES):
            bits[((a + np.uint64(k) * b) % np.uint64(size)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def probe(bits: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Level of each item by a shard's bits: of level after level until one is missing."""
    found = np.zeros(len(item), np.int64)
    size = np.uint64(len(bits) * 8)
    left = np.arange(len(item))
    level = 0
    while len(left):
        level += 1
        a, b = _places(item[left], level)
        for k in range(PROBES):
            bit = (a + np.uint64(k) * b) % size
            held = bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 > 0
            left, a, b = left[held], a[held], b[held]
            if not len(left):
                break
        found[left] = level
    return found


def placed(gram: np.ndarray, number: int, pair: bool) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each n-gram, what tells it apart there); both are in order where the n-grams are."""
    n, half = np.uint64(number), np.uint64(32)
    shard = ((gram >> half) * n + ((gram & np.uint64(0xFFFFFFFF)) * n >> half)) >> half
    return shard.astype(np.int32), gram * n >> np.uint64(65 - WIDTH) | np.uint64(pair) << np.uint64(WIDTH - 1)


def distinct(one: np.ndarray, two: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct unigrams, distinct bigrams, order of both by shard, their shards, items), the last two in this order."""
    singles, pairs = np.unique(one), np.unique(two)
    shard, item = (np.concatenate(x) for x in zip(placed(singles, number, False), placed(pairs, number, True)))
    order = np.argsort(shard, kind="stable")
    return singles, pairs, order, shard[order], item[order]


def batch_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """grams of a batch, and index of each text's first word and the number of words.

    Texts are hashed in small slices, as their bytes take many times their room, but looked at over the whole batch.
    """
    parts, firsts, n = [], [np.zeros(1, np.int64)], 0
    for _, _, data, offsets in slices(texts):
        word, first = words(data, offsets)
        parts.append(grams(word, first))
        firsts.append(first[1:] + n)
        n += len(word)
    if not parts:
        parts.append(grams(np.zeros(0, np.uint64), np.zeros(1, np.int64)))
    one, two, has = (np.concatenate(x) for x in zip(*parts))
    return one, two, has, np.concatenate(firsts)


class Scale:
    """What the probabilities need besides levels."""

    def __init__(self, total: int, vocabulary: int):
        self.total, self.vocabulary = total, vocabulary

    def log2(self, one: np.ndarray, two: np.ndarray, before: np.ndarray, has: np.ndarray) -> np.ndarray:
        """log2 of the probability of each word, from levels of its unigram, its bigram and the word before."""
        single = (count_of(one) + 1) / (self.total + self.vocabulary + 1)
        share = np.minimum(1.0, count_of(two) / np.maximum(count_of(before), 1))
        return np.log2(np.where(has, LAMBDA * share + (1 - LAMBDA) * single, single))


def shards(texts: DataFrame) -> int:
    """Shards for the texts' n-grams."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(1 << 31, max(16, math.ceil(size / (SHARD_MB * 1e6))))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, tuple[np.ndarray, ...]]]:
    """(rows, key, n-grams) of each part; the key is of what is in it and where it was read."""
    context = TaskContext.get()
    count = 0
    for batch in batches:
        for low, high, _, _ in slices(batch.column(1), PART):
            own = batch.slice(low, high - low)
            found = batch_grams(own.column(1))
            mark = hashlib.blake2b(found[0].tobytes() + found[3].tobytes(), digest_size=8)
            mark.update(f"{context.partitionId() if context else 0} {count}".encode())
            count += 1
            yield own, int.from_bytes(mark.digest(), "little", signed=True), found


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The values cut into binary items; ends: of each item, and 0 before the first."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a binary column, where each item starts and the end)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, at.astype(np.int64) - at[0]


_SENT = "shard int, part long, low binary, high binary, n binary, more binary"
_LEVELS = "part long, shard int, data binary, total long, vocabulary long"


def sent(texts: DataFrame, number: int) -> DataFrame:
    """shard, part, low, high, n, more: each part's distinct n-grams and their counts, in a row for each shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key, (one, two, has, _) in _parts(batches):
            if not len(one):
                continue
            singles, pairs, order, shard, item = distinct(one, two[has], number)
            n = np.concatenate([np.bincount(np.searchsorted(singles, one), minlength=len(singles)), np.bincount(np.searchsorted(pairs, two[has]), minlength=len(pairs))])[order]
            cuts = runs_of(shard)
            large = n >= 255
            more = np.concatenate([[0], np.cumsum(large)])[cuts]
            columns = [
                pa.array(shard[cuts[:-1]]), pa.array(np.full(len(cuts) - 1, key)), _binary((item & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts),
                _binary((item >> np.uint64(32)).astype(np.uint8), cuts), _binary(np.minimum(n, 255).astype(np.uint8), cuts), _binary(n[large].astype(np.int64), more),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "part", "low", "high", "n", "more"])

    # with fewer shards than tasks each has a partition of its own
    placed_ = texts.mapInArrow(work, _SENT).repartitionById(min(number, TASKS), F.pmod(F.col("shard"), F.lit(min(number, TASKS))))
    return placed_.sortWithinPartitions("shard")


def _opened(whole: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items, their counts, where each row's start and the end) of rows of ``sent``."""
    low, _ = _flat(whole.column(2))
    high, ends = _flat(whole.column(3))
    n = _flat(whole.column(4))[0].astype(np.int64)
    n[n == 255] = _flat(whole.column(5))[0].view(np.int64)
    return high.astype(np.uint64) << np.uint64(32) | low.view(np.uint32), n, ends


def _filled(item: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """(bits of a shard, its distinct items, each item's place among them, total and number of the unigrams)."""
    own, back = np.unique(item, return_inverse=True)
    sums = np.bincount(back, weights=n, minlength=len(own))
    single = own >> np.uint64(WIDTH - 1) == 0
    return build(own, level_of(sums)), own, back, int(sums[single].sum()), int(single.sum())


def filter_of(texts: DataFrame, number: int) -> DataFrame:
    """shard, bits, total, vocabulary: the filter of all n-grams, for use beyond ``scored``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches):
            shard = whole.column(0).to_numpy()
            cuts = runs_of(shard)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                item, n, _ = _opened(whole.slice(a, b - a))
                bits, _, _, total, vocabulary = _filled(item, n)
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32()), pa.array([bits.tobytes()], pa.binary()), pa.array([total]), pa.array([vocabulary])], ["shard", "bits", "total", "vocabulary"])

    return sent(texts, number).mapInArrow(work, "shard int, bits binary, total long, vocabulary long")


def levels(texts: DataFrame, number: int) -> DataFrame:
    """part, shard, data: levels that the filter has for the n-grams of each row of ``sent``; total and vocabulary in a row for each shard."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches):
            shard = whole.column(0).to_numpy()
            cuts = runs_of(shard)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                item, n, ends = _opened(whole.slice(a, b - a))
                bits, own, back, total, vocabulary = _filled(item, n)
                found = probe(bits, own).astype(np.int8)[back]
                m = b - a
                nothing = pa.nulls(m, pa.int64())
                yield pa.RecordBatch.from_arrays([whole.column(1).slice(a, m).combine_chunks(), pa.array(shard[a:b]), _binary(found, ends), nothing, nothing], ["part", "shard", "data", "total", "vocabulary"])
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([int(shard[a])], pa.int32()), pa.nulls(1, pa.binary()), pa.array([total]), pa.array([vocabulary])], ["part", "shard", "data", "total", "vocabulary"])

    return sent(texts, number).mapInArrow(work, _LEVELS)


def scored(docs: DataFrame, number: int | None = None) -> DataFrame:
    """doc_id, words, log2_prob, perplexity of each document, by the model of all of them; number: of shards."""
    shared_folder(bounded(docs.sparkSession))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    number = number or shards(texts)
    found = levels(texts, number).checkpoint()
    sums = found.agg(F.sum("total"), F.sum("vocabulary")).first()
    scale = Scale(sums[0] or 0, sums[1] or 0)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, key, _ in _parts(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as out:
                out.write_batch(own)
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([-1], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["part", "shard", "data"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches):
            cuts = runs_of(whole.column(0).to_numpy())
            shard, data = whole.column(1).to_numpy(), whole.column(2)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if shard[a] >= 0 or b > a + 1 and shard[a + 1] < 0:
                    raise ValueError("the texts were read in another way the second time")
                level = _flat(data.slice(a + 1, b - a - 1))[0].view(np.int8) if b > a + 1 else np.zeros(0, np.int8)
                for read in pa.ipc.open_stream(data[a].as_py()):
                    yield _scored_part(read, level, scale, number)

    carried = texts.mapInArrow(carry, "part long, shard int, data binary")
    rows = carried.unionByName(found.filter("part is not null").select("part", "shard", "data"))
    return rows.repartition(min(number, TASKS), "part").sortWithinPartitions("part", "shard").mapInArrow(score, SCHEMA)


def _scored_part(rows: pa.RecordBatch, level: np.ndarray, scale: Scale, number: int) -> pa.RecordBatch:
    """Scores of a part's rows, from the levels of its distinct n-grams in order of their shards."""
    one, two, has, first = batch_grams(rows.column(1))
    singles, pairs, order, _, _ = distinct(one, two[has], number)
    if len(order) != len(level):
        raise ValueError("a part's n-grams and levels differ: its texts came in another order")
    found = np.zeros(len(order), np.int64)
    found[order] = level
    single, double = found[np.searchsorted(singles, one)], np.zeros(len(one), np.int64)
    double[has] = found[len(singles) + np.searchsorted(pairs, two[has])]
    before = np.concatenate([single[:1], single[:-1]])
    total = np.concatenate([[0.0], np.cumsum(scale.log2(single, double, before, has))])
    return _rows(rows.column(0), np.diff(first), total[first[1:]] - total[first[:-1]])


def _rows(ids: pa.Array, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    with np.errstate(over="ignore"):
        perplexity = np.where(n > 0, np.exp2(-sums / np.maximum(n, 1)), np.nan)
    return pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int32)), pa.array(np.round(sums, 6)), pa.array(np.round(perplexity, 6), from_pandas=True)], ["doc_id", "words", "log2_prob", "perplexity"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all documents."""
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
