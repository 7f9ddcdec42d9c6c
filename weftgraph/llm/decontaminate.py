"""Benchmark decontamination by CGK embedding and bit-sampling LSH with exact edit verification.

A document leaks an item if a window of it is within ``floor(tolerance * n)`` word edits of the item's n words. The
CGK embedding walks over a word sequence, at each step emitting the current word and advancing by a random bit of
(step, word); two sequences at small edit distance then agree on many coordinates. Each of the repetitions samples
coordinates of an item's embedding; a window collides where its own walk has the same words at those steps. The
first sampled coordinate (the anchor) is drawn towards words that are rare among the items, and a window's walk is
followed from its anchor on, so that only positions that hold an anchor word are walked and agreement doesn't depend
on edits before it. The gap between coordinates is bounded, so a repetition fails only if an edit falls between
them; ``repetitions`` follows from the target recall. Every collision is verified by bit-parallel edit distance.

Items are sampled in the workers, each with random draws of its own and the frequency of its words among all items (a
table of PLACES counts), so what is found doesn't depend on the other items' order or on how they are split: the
samples are broadcast in blocks of BLOCK_MB, and the documents are passed over once for each block. Anchors that are
frequent among items or documents are followed in portions of PORTION.

Items without a word never match; documents that are NULL, empty or without words leak nothing. A very long text is
looked at whole. Repeated documents each get their row, a repeated item is matched under each item_id, and ties go to
the first window. Extra columns, whatever their names, are ignored, or carried by ``drop_leaking``; a NULL doc_id or
item_id is carried as NULL. Without items, or without documents, nothing leaks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.kernel import arrow_map, mix, slices, words
from weftgraph.session import shared_folder

TOLERANCE = 0.2
TARGET_RECALL = 0.99
#: Steps of the walk between two sampled coordinates, at most.
GAP = 12
#: MB of samples that are broadcast at once; a larger benchmark is matched in as many passes as it takes.
BLOCK_MB = 64
#: Counts of words among items, by hash; pairs of a place in a text and a sample that are followed at once.
PLACES, PORTION = 1 << 18, 1 << 21
SEED = 11
_SAMPLE = np.dtype([("anchor", "u8"), ("other", "u8"), ("run", "i4"), ("step", "i4"), ("at", "i4"), ("gap", "i4")])
SCHEMA = "doc_id long, item_id long, edits int, item_words int, word_start int"


def repetitions(tolerance: float = TOLERANCE, target: float = TARGET_RECALL) -> int:
    """Repetitions after which a window at the tolerance is found with the target probability."""
    stays = (1 - tolerance) ** (2 + GAP / 4)
    return math.ceil(math.log(1 - target) / math.log(1 - stays))


@dataclass
class Index:
    """Sampled coordinates of items, sorted by anchor word."""

    items: list[int | None]
    patterns: list[np.ndarray]
    tolerance: float
    seeds: np.ndarray
    anchors: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    sample: np.ndarray = field(default_factory=lambda: np.zeros(0, _SAMPLE))
    sieve: np.ndarray = field(default_factory=lambda: np.zeros(1 << 16, bool))


def walks(runs: int) -> np.ndarray:
    """Odd factors that make the walks' random bits, for each repetition and step."""
    return np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 63, (runs, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _advance(seeds: np.ndarray, run: np.ndarray, step: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The walk's random bit of (repetition, step, word)."""
    return ((word * seeds[run, step & 63]) >> np.uint64(63)).astype(np.int64)


def sample(words: np.ndarray, often: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """An item's coordinates, one for each repetition; often: counts of words by hash."""
    n = len(words)
    rng = np.random.Generator(np.random.PCG64(int(mix(words).sum(dtype=np.uint64))))
    rarity = 1 / np.maximum(often[(words % np.uint64(PLACES)).astype(np.int64)], 1).astype(float) ** 2
    own = words.tolist()
    factors = seeds.tolist()
    used = np.zeros(n)
    found = np.zeros(len(seeds), _SAMPLE)
    for r, factor in enumerate(factors):
        steps, at = [0], [0]
        while at[-1] < n - 1:
            at.append(at[-1] + ((own[at[-1]] * factor[steps[-1] & 63] & (1 << 64) - 1) >> 63))
            steps.append(steps[-1] + 1)
        places = np.array(at)
        weight = rarity[places] / 8 ** used[places]
        one = int(rng.choice(len(at), p=weight / weight.sum()))
        near = [j for j in range(one + 1, min(len(at), one + GAP + 1)) if at[j] > at[one]]
        two = one
        if near:
            chance = rarity[places[near]]
            two = int(rng.choice(near, p=chance / chance.sum()))
        used[at[one]] += 1
        found[r] = own[at[one]], own[at[two]], r, one, at[one], two - one
    return found


def sampled(benchmark: DataFrame, runs: int) -> DataFrame:
    """item_id, words, samples of each item that has words; written to the shared folder."""
    spark = benchmark.sparkSession
    shared_folder(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, _, data, offsets in slices(batch.column(1)):
            place, n = np.unique(words(data, offsets)[0] % np.uint64(PLACES), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(n)], ["place", "n"])

    counted = arrow_map(items, count, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(PLACES, np.int64)
    often[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    shared = spark.sparkContext.broadcast(often)
    seeds = walks(runs)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, _, data, offsets in slices(batch.column(1)):
            word, first = words(data, offsets)
            full = np.flatnonzero(np.diff(first))
            own = [word[first[k] : first[k + 1]] for k in full.tolist()]
            made = [sample(w, shared.value, seeds).tobytes() for w in own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(full + low)), pa.array([w.tobytes() for w in own], pa.binary()), pa.array(made, pa.binary())], ["item_id", "words", "samples"])

    return arrow_map(items, work, "item_id long, words binary, samples binary").checkpoint()


def build(rows: pa.Table, tolerance: float, seeds: np.ndarray) -> Index:
    """The index of some items."""
    index = Index(rows.column(0).to_pylist(), [np.frombuffer(w, np.uint64) for w in rows.column(1).to_pylist()], tolerance, seeds)
    if index.items:
        found = np.frombuffer(b"".join(rows.column(2).to_pylist()), _SAMPLE)
        order = np.argsort(found["anchor"], kind="stable")
        index.sample, index.item = found[order], (order // len(seeds)).astype(np.int32)
        index.anchors, counts = np.unique(index.sample["anchor"], return_counts=True)
        index.first = np.concatenate([[0], np.cumsum(counts)])
        index.sieve[(index.anchors & np.uint64(0xFFFF)).astype(np.int64)] = True
    return index


def candidates(index: Index, word: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct (text, item, index of the window's first word, which may be before the text)."""
    if not len(index.anchors) or not len(word):
        return np.zeros((0, 3), np.int64)
    where = np.flatnonzero(index.sieve[(word & np.uint64(0xFFFF)).astype(np.int64)])
    key = np.minimum(np.searchsorted(index.anchors, word[where]), len(index.anchors) - 1)
    same = index.anchors[key] == word[where]
    where, key = where[same], key[same]
    often = index.first[key + 1] - index.first[key]
    portion = np.cumsum(often) // PORTION
    cuts = [0, *(np.flatnonzero(np.diff(portion)) + 1).tolist(), len(where)]
    found = [_followed(index, word, first, where[a:b], key[a:b], often[a:b]) for a, b in zip(cuts, cuts[1:])]
    return np.unique(np.concatenate(found), axis=0)


def _followed(index: Index, word: np.ndarray, first: np.ndarray, where: np.ndarray, key: np.ndarray, often: np.ndarray) -> np.ndarray:
    """Candidates of some places of anchors."""
    spot = np.repeat(where, often)
    start = np.cumsum(often) - often
    entry = np.arange(len(spot)) - np.repeat(start, often) + np.repeat(index.first[key], often)
    text = np.searchsorted(first, spot, "right") - 1
    end = first[text + 1]
    now = spot.copy()
    own = index.sample[entry]
    for g in range(GAP):
        on = np.flatnonzero((own["gap"] > g) & (now < end))
        if not len(on):
            break
        now[on] += _advance(index.seeds, own["run"][on], own["step"][on] + g, word[now[on]])
    hit = now < end
    hit[hit] = word[now[hit]] == own["other"][hit]
    return np.stack([text[hit], index.item[entry[hit]].astype(np.int64), spot[hit] - own["at"][hit]], 1)


def masks(pattern: np.ndarray) -> dict[int, int]:
    """Bit mask of each word's places in the pattern."""
    found: dict[int, int] = {}
    for i, x in enumerate(pattern.tolist()):
        found[x] = found.get(x, 0) | 1 << i
    return found


def best_window(places: dict[int, int], m: int, region: list[int]) -> tuple[int, int]:
    """(least edits between the pattern and any window of the region, where that window ends)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for k, x in enumerate(region):
        eq = places.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus) & full
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, end = score, k + 1
    return best, end


def leaks(index: Index, word: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int]]:
    """(text, item) -> (edits, first word of the window), the best window of each."""
    found: dict[tuple[int, int], tuple[int, int]] = {}
    known: dict[int, dict[int, int]] = {}
    for text, item, start in candidates(index, word, first).tolist():
        pattern = index.patterns[item]
        m = len(pattern)
        most = int(index.tolerance * m + 1e-9)
        if found.get((text, item), (m, 0))[0] == 0:
            continue
        low, high = max(int(first[text]), start - most), min(int(first[text + 1]), start + m + most)
        region = word[low:high].tolist()
        if item not in known:
            known[item] = masks(pattern)
        places = known[item]
        if sum(x in places for x in region) < m - most:
            continue
        edits, end = best_window(places, m, region)
        if edits <= most:
            at = max(0, low + end - m - int(first[text]))
            if edits < found.get((text, item), (m + 1, 0))[0]:
                found[text, item] = (edits, at)
    return found


def blocks(benchmark: DataFrame, tolerance: float, target: float, block_mb: float) -> Iterator[Index]:
    """Indexes of at most about block_mb MB each, small enough to broadcast."""
    seeds = walks(repetitions(tolerance, target))
    items = sampled(benchmark, len(seeds))
    total = items.agg(F.sum(F.octet_length("words") + F.octet_length("samples") + 16)).first()[0] or 0
    parts = math.ceil(total / (block_mb * 1e6)) or 1
    for k in range(parts):
        own = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == k)
        yield build(own.toArrow(), tolerance, seeds)


def find_leaks(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, target: float = TARGET_RECALL, block_mb: float = BLOCK_MB) -> DataFrame:
    """A row for each document and item that it leaks: doc_id, item_id, edits, item_words, word_start.

    One narrow pass over the documents for each block of the benchmark; nothing is shuffled.
    """
    spark, parts = docs.sparkSession, []
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for block in blocks(benchmark, tolerance, target, block_mb):
        shared = spark.sparkContext.broadcast(block)

        def work(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            index, ids = shared.value, batch.column(0)
            for low, _, data, offsets in slices(batch.column(1)):
                word, first = words(data, offsets)
                found = leaks(index, word, first)
                if found:
                    keys = list(found)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([low + t for t, _ in keys])), pa.array([index.items[i] for _, i in keys], pa.int64()), pa.array([found[k][0] for k in keys], pa.int32()), pa.array([len(index.patterns[i]) for _, i in keys], pa.int32()), pa.array([found[k][1] for k in keys], pa.int32())],
                        ["doc_id", "item_id", "edits", "item_words", "word_start"],
                    )

        parts.append(arrow_map(texts, work, SCHEMA))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def drop_leaking(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, target: float = TARGET_RECALL, block_mb: float = BLOCK_MB) -> DataFrame:
    """The documents that leak no item, with all their columns; row by row, so NULL and repeated ids are no matter."""
    spark = docs.sparkSession
    text = docs.columns.index("text")
    for block in blocks(benchmark, tolerance, target, block_mb):
        shared = spark.sparkContext.broadcast(block)

        def work(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            keep = np.ones(batch.num_rows, bool)
            for low, _, data, offsets in slices(batch.column(text)):
                word, first = words(data, offsets)
                for k, _ in leaks(shared.value, word, first):
                    keep[low + k] = False
            yield batch.filter(pa.array(keep))

        docs = arrow_map(docs, work, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaks of the documents table."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
