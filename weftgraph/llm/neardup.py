"""MinHash near-duplicate detection with banded candidates and odd-sketch verification.

A document is its set of word 3-grams (all its words at once, if it has fewer than three). Each of K MinHash samples
toggles one bit of an odd sketch, so the XOR of two sketches holds the parity of their differing samples and its
population count z estimates the Jaccard similarity as 1 + n / (4 K) * ln(1 - 2 z / n) for n bits, most precisely
where the similarity is high. Documents that agree on all samples of a band are candidates. THRESHOLD is what is left of
the 3-grams where a tenth of the words differ: q / (2 - q) = 0.57 for q = 0.9 ** 3, less the sketch's error.

Equal texts are one text from the start, by 128 bits of hash; only the first in each partition is sampled. Within a
band's bucket the verified graph is explored by breadth-first search: members found to be similar leave the pool and
each of them is compared with what remains, so a bucket's components are exactly those that all its pairs would give,
yet a bucket of thousands of near copies costs one comparison each. Buckets with equal members are verified once.

A band that very many texts share is found from counts within each partition (one that has more than LARGE and the
number of partitions together can't be missed), and split: its texts are verified in random chunks, other ones for
each band, which links what is alike, and whatever chunks left apart is then compared across, block by block, unless it
is of one component by now. So no task holds such a bucket, and no link is lost. The components of all edges are joined
by alternating large-star and small-star steps.

Of each group the document with the smallest doc_id stays (NULL last; ties by text hash). Rows with equal doc_id and
text count as one document, of which one row stays. Documents that are NULL, empty or without words have no
similarity to any other and are left alone; very long texts are sampled whole. Extra columns, whatever their names, are
ignored, or carried by ``drop_duplicates``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.kernel import BROADCAST_ROWS, arrow_map, bounded, mix, runs_of, slices, unused, whole_runs, words
from weftgraph.session import shared_folder

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
BITS = 512
THRESHOLD = 0.55
#: Texts that a task compares with each other, about.
LARGE = 4096
#: Neighbours of a text beyond which components are joined without windows; bits of the sieve for texts that have copies.
HUB, SIEVE = 1_000_000, 1 << 26
_RNG = np.random.Generator(np.random.PCG64(404))
_FACTOR = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(1, 1 << 63, SAMPLES, dtype=np.uint64)
_SPREAD = _RNG.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the texts' word 3-grams, index of each text's first and the number of all)."""
    size = np.diff(first)
    count = np.where(size >= 3, size - 2, (size > 0).astype(np.int64))
    own = np.concatenate([[0], np.cumsum(count)])
    if not len(word):
        return np.zeros(0, np.uint64), own
    padded = np.concatenate([word, np.zeros(2, np.uint64)])
    start = np.arange(own[-1]) - np.repeat(own[:-1], count) + np.repeat(first[:-1], count)
    left = np.repeat(size, count)
    second = np.where(left >= 2, padded[start + 1], np.uint64(0))
    third = np.where(left >= 3, padded[start + 2], np.uint64(0))
    return mix(padded[start] * np.uint64(0xA24BAED4963EE407) + second * np.uint64(0x9FB21C651E98DF25) + third * np.uint64(0xD6E8FEB86659FD93)), own


def minhashes(shingle: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A row of K samples for each text that has shingles."""
    full = np.flatnonzero(np.diff(own))
    out = np.zeros((len(full), SAMPLES), np.uint32)
    starts = own[:-1][full]
    if len(full):
        work = np.empty_like(shingle)
        for k in range(SAMPLES):
            np.multiply(shingle, _FACTOR[k], out=work)
            np.add(work, _SHIFT[k], out=work)
            out[:, k] = np.minimum.reduceat((work >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketches(samples: np.ndarray) -> np.ndarray:
    """The odd sketch of each row, as 64-bit words."""
    n = len(samples)
    place = (mix(samples.astype(np.uint64) * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(BITS)).astype(np.int64)
    flat = np.bincount((place + np.arange(n)[:, None] * BITS).ravel(), minlength=n * BITS) & 1
    return np.packbits(flat.astype(np.uint8).reshape(n, BITS), axis=1).view(np.uint64)


def bands(samples: np.ndarray) -> np.ndarray:
    """A hash of each band's samples, different for each band."""
    return mix((samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64) * _SPREAD).sum(2, dtype=np.uint64)).view(np.int64)


def similarity(z: np.ndarray) -> np.ndarray:
    """Jaccard similarity that the population count of an XOR of sketches stands for; 0 at least."""
    room = np.maximum(1 - 2 * np.asarray(z, float) / BITS, 1e-9)
    return np.maximum(0.0, 1 + BITS / (4 * SAMPLES) * np.log(room))


def furthest(threshold: float) -> int:
    """The largest population count that still means the threshold."""
    return int(np.flatnonzero(similarity(np.arange(BITS // 2)) >= threshold).max())


def components(sketch: np.ndarray, most: int) -> np.ndarray:
    """For each member of a bucket the first member of its component of the graph of similar pairs."""
    n = len(sketch)
    root = np.full(n, -1)
    pool = np.arange(n)
    while len(pool):
        seed, pool = pool[0], pool[1:]
        root[seed] = seed
        queue = [seed]
        while queue and len(pool):
            near = np.bitwise_count(sketch[pool] ^ sketch[queue.pop()]).sum(1) <= most
            found = pool[near]
            root[found] = seed
            queue.extend(found.tolist())
            pool = pool[~near]
    return root


def key_of(df: DataFrame) -> Column:
    """Identifies a text: 128 bits of its hash."""
    return F.unhex(F.md5(df["text"].cast("string").cast("binary")))


def _bytes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The bytes of a binary column's items one after another."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.zeros(0, np.uint8)


def _fixed(rows: np.ndarray) -> pa.Array:
    """A binary item for each row of numbers."""
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def signatures(docs: DataFrame) -> DataFrame:
    """key, doc_id, sketch, bands of every document that has words; written once to the shared folder.

    Sketch and bands are those of the text, and stand only in the first row of each text in its partition.
    """
    shared_folder(bounded(docs.sparkSession))
    texts = docs.filter(docs["text"].isNotNull()).select(key_of(docs).alias("key"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full: dict[bytes, bool] = {}
        for batch in batches:
            keys = batch.column(0).to_pylist()
            fresh = []
            for k, key in enumerate(keys):
                if key not in full:
                    full[key] = False
                    fresh.append(k)
            own = [pa.nulls(0, pa.int64()), pa.nulls(0, pa.binary()), pa.nulls(0, pa.binary())]
            if fresh:
                parts: list[list] = [[], [], []]
                for low, _, data, offsets in slices(batch.column(2).take(pa.array(fresh))):
                    shingle, at = shingles(*words(data, offsets))
                    rows = np.flatnonzero(np.diff(at))
                    if len(rows):
                        samples = minhashes(shingle, at)
                        for part, made in zip(parts, (np.array(fresh)[rows + low], sketches(samples), bands(samples))):
                            part.append(made)
                if parts[0]:
                    at, sketch, band = (np.concatenate(x) for x in parts)
                    for k in at.tolist():
                        full[keys[k]] = True
                    own = [pa.array(at), _fixed(sketch), _fixed(band)]
            first = pa.RecordBatch.from_arrays([batch.column(0).take(own[0]), batch.column(1).take(own[0]), own[1], own[2]], ["key", "doc_id", "sketch", "bands"])
            if first.num_rows:
                yield first
            again = pa.array(sorted({k for k, key in enumerate(keys) if full[key]} - set(own[0].to_pylist())), pa.int64())
            if len(again):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(again), batch.column(1).take(again), pa.nulls(len(again), pa.binary()), pa.nulls(len(again), pa.binary())], ["key", "doc_id", "sketch", "bands"])

    return texts.mapInArrow(work, "key binary, doc_id long, sketch binary, bands binary").checkpoint()


def banded(signed: DataFrame) -> DataFrame:
    """band, key: each band of each text; a text may have several rows, though one in a partition."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        band = _bytes(batch.column(1)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(band), batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))], ["band", "key"])

    return arrow_map(signed.filter("bands is not null").select("key", "bands"), work, "band long, key binary")


def hot(signed: DataFrame, large: int) -> DataFrame:
    """band, texts: bands of more than about large texts. A band has at least an n-th of its texts in one of n partitions."""
    often = max(2, large // signed.rdd.getNumPartitions())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [_bytes(batch.column(0)).view(np.int64) for batch in batches]
        band, n = np.unique(np.concatenate([np.zeros(0, np.int64), *own]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(band[n >= often]), pa.array(n[n >= often])], ["band", "texts"])

    found = signed.filter("bands is not null").select("bands").mapInArrow(work, "band long, texts long")
    return found.groupBy("band").agg(F.sum("texts").alias("texts")).filter(F.col("texts") > large).checkpoint()


def buckets(rows: DataFrame) -> DataFrame:
    """bucket, key: the members of each distinct set of at least two texts that share a band."""
    rows = rows.repartition("band").sortWithinPartitions("band", "key")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches):
            band, keys = whole.column(0).to_numpy(), whole.column(1)
            key = _bytes(keys).view(np.uint64).reshape(-1, 2)
            new = np.ones(len(key), bool)
            new[1:] = (band[1:] != band[:-1]) | (key[1:] != key[:-1]).any(1)
            at = np.flatnonzero(new)
            band, key = band[at], key[at]
            starts = runs_of(band)
            size = np.diff(starts)
            many = np.repeat(size > 1, size)
            if not many.any():
                continue
            # a set's name: sums of mixes of its members' keys, which are in order and distinct
            salted = mix(key[:, 0] + mix(key[:, 1] + np.uint64(0x632BE59BD9B4E019)))
            name = mix(np.add.reduceat(salted, starts[:-1]) + size.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(name, size)[many]), keys.take(pa.array(at[many])).combine_chunks()], ["bucket", "key"])

    return rows.mapInArrow(group, "bucket long, key binary").distinct()


def verified(rows: DataFrame, sketch: DataFrame, threshold: float) -> DataFrame:
    """low, high: verified pairs that span the components of each bucket of (bucket, key)."""
    most = furthest(threshold)
    rows = rows.join(sketch, "key").select("bucket", "key", "sketch").repartition("bucket").sortWithinPartitions("bucket", "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches):
            starts, keys = runs_of(whole.column(0).to_numpy()), whole.column(1)
            sketch = _bytes(whole.column(2)).view(np.uint64).reshape(len(keys), -1)
            size = np.diff(starts)
            two = starts[:-1][size == 2]
            near = two[np.bitwise_count(sketch[two] ^ sketch[two + 1]).sum(1) <= most]
            low, high = [near], [near + 1]
            for a, b in zip(starts[:-1][size > 2].tolist(), starts[1:][size > 2].tolist()):
                root = components(sketch[a:b], most)
                other = np.flatnonzero(root != np.arange(b - a))
                low.append(a + root[other])
                high.append(a + other)
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(np.concatenate(x))).combine_chunks() for x in (low, high)], ["low", "high"])

    return rows.mapInArrow(verify, "low binary, high binary").distinct()


def across(rows: DataFrame, stars: DataFrame, large: int) -> DataFrame:
    """bucket, key: pairs of blocks of each hot band's (band, key) whose texts aren't of one component yet."""
    root = F.coalesce("root", "key")
    own = rows.join(stars, "key", "left").select("band", "key", root.alias("root")).checkpoint()
    mixed = own.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("band")
    sizes = own.join(mixed, "band").groupBy("band", "root").agg(F.count("*").alias("n")).checkpoint()
    wide = F.col("n") > large // 2
    pools = sizes.groupBy("band").agg(F.ceil(F.sum(F.when(~wide, F.col("n")).otherwise(0)) * 2 / large).alias("pools"))
    # a large component has blocks of its own, small ones share theirs
    block = F.when(wide, F.xxhash64("root", F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / large)))).otherwise(F.pmod(F.xxhash64("root"), F.greatest(F.lit(1), "pools")))
    placed = own.join(sizes.join(pools, "band").checkpoint(), ["band", "root"]).select("band", "key", block.alias("block"), F.when(wide, F.col("root")).alias("single")).checkpoint()
    blocks = placed.select("band", "block", "single").distinct().checkpoint()
    other = blocks.select("band", F.col("block").alias("other"), F.col("single").alias("its"))
    pairs = blocks.join(other, "band").filter((F.col("block") <= F.col("other")) & ~F.coalesce(F.col("single") == F.col("its"), F.lit(False)))
    pairs = pairs.select("band", F.explode(F.array("block", "other")).alias("block"), F.xxhash64("band", "block", "other").alias("bucket")).distinct()
    return placed.join(pairs, ["band", "block"]).select("bucket", "key").distinct()


def _with_least(rows: DataFrame, hub: bool) -> DataFrame:
    """key, root, least: each edge with the least root of its key."""
    if hub:  # a key with very many edges: their least is found before the shuffle, and the join can be split
        return rows.join(rows.groupBy("key").agg(F.min("root").alias("least")).checkpoint(), "key")
    return rows.withColumn("least", F.min("root").over(Window.partitionBy("key")))


def connected(pairs: DataFrame, hub: int = HUB) -> DataFrame:
    """key, root: each node of the graph with its component's smallest node, itself left out.

    Alternating large-star and small-star steps; each round is written to the shared folder, which cuts the lineage
    and lets a lost executor's part be read again.
    """
    shared_folder(pairs.sparkSession)
    stars = pairs.select(F.greatest("low", "high").alias("key"), F.least("low", "high").alias("root")).checkpoint()
    state: tuple | None = None
    wide = False
    while True:
        both = stars.union(stars.select(F.col("root").alias("key"), F.col("key").alias("root")))
        large = _with_least(both, wide).withColumn("least", F.least("key", "least")).filter("root > key").select(F.col("root").alias("key"), F.col("least").alias("root"))
        small = _with_least(large.checkpoint() if wide else large, wide)
        small = small.select(F.explode(F.array("key", "root")).alias("key"), F.col("least").alias("root")).filter("key <> root").distinct()
        stars = small.checkpoint()
        each = stars.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.xxhash64("key", "root").cast("decimal(38,0)")).alias("mark"))
        *now, most = each.agg(F.sum("n"), F.sum("mark"), F.max("n")).first()
        if now == state:
            return stars
        state, wide = now, (most or 0) > hub


def groups(docs: DataFrame, threshold: float = THRESHOLD, large: int = LARGE, hub: int = HUB) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, kept_key, kept_doc_id of each text that has more than one document in its group; a row for each text; signatures)."""
    signed = signatures(docs)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id"))
    texts = signed.groupBy("key").agg(best.alias("best"), F.count("*").alias("copies"), F.min("sketch").alias("sketch")).checkpoint()
    sketch = texts.select("key", "sketch")
    rows, often = banded(signed), hot(signed, large)
    n = often.count()
    if n:
        small = F.broadcast(often) if n <= BROADCAST_ROWS else often
        warm = rows.join(small, "band").groupBy("band", "key").agg(F.first("texts").alias("texts")).checkpoint()
        chunk = F.pmod(F.xxhash64("key", "band"), F.ceil(F.col("texts") / large))
        own = buckets(rows.join(small, "band", "left_anti")).unionByName(warm.select(F.xxhash64("band", chunk).alias("bucket"), "key"))
        stars = connected(verified(own, sketch, threshold), hub)
        more = verified(across(warm.select("band", "key"), stars, large), sketch, threshold).checkpoint()
        if not more.isEmpty():
            stars = connected(more.unionByName(stars.select(F.col("root").alias("low"), F.col("key").alias("high"))), hub)
    else:
        stars = connected(verified(buckets(rows), sketch, threshold), hub)
    member = stars.union(stars.select("root", "root").distinct())
    info = texts.join(member, "key", "left").filter("root is not null or copies > 1").select("key", F.coalesce("root", "key").alias("root"), "best").checkpoint()
    kept = info.groupBy("root").agg(F.min(F.struct("best", "key")).alias("kept")).checkpoint()
    named = info.join(kept, "root").select("key", F.col("kept.key").alias("kept_key"), F.col("kept.best.doc_id").alias("kept_doc_id"))
    return named.checkpoint(), texts, signed


def find_duplicates(docs: DataFrame, threshold: float = THRESHOLD, large: int = LARGE, hub: int = HUB) -> DataFrame:
    """doc_id, kept_doc_id, similarity, copies: each superfluous document, the one of its group that stays, and its rows that go.

    The similarity is the pair's own estimate, which may be below the threshold where others link the two.
    Documents that stay and documents without duplicates have no row.
    """
    named, texts, signed = groups(docs, threshold, large, hub)
    sketch = texts.select("key", "sketch")
    other = sketch.select(F.col("key").alias("kept_key"), F.col("sketch").alias("kept_sketch"))

    @F.pandas_udf("double")
    def estimate(a, b):
        import pandas as pd

        if not len(a):
            return pd.Series([], dtype="float64")
        left, right = (np.frombuffer(b"".join(x), np.uint64).reshape(len(x), -1) for x in (a, b))
        return pd.Series(similarity(np.bitwise_count(left ^ right).sum(1)))

    pairs = named.join(sketch, "key").join(other, "kept_key").select("key", "kept_key", "kept_doc_id", F.round(estimate("sketch", "kept_sketch"), 4).alias("similarity")).checkpoint()
    rows = signed.select("key", "doc_id").join(pairs, "key")
    found = rows.groupBy("key", "doc_id").agg(*(F.first(c).alias(c) for c in ("kept_key", "kept_doc_id", "similarity")), F.count("*").alias("copies"))
    stays = (F.col("key") == F.col("kept_key")) & F.col("doc_id").eqNullSafe(F.col("kept_doc_id"))
    return found.select("doc_id", "kept_doc_id", "similarity", (F.col("copies") - stays.cast("int")).alias("copies")).filter("copies > 0")


def _sieve(keys: DataFrame, name: str) -> np.ndarray:
    """SIEVE bits, packed: those at the hashes of a binary column are set."""
    width = 1 << 16

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_runs(batches):
            piece, place = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = runs_of(piece)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                bits = np.zeros(width, bool)
                bits[place[a:b]] = True
                yield pa.RecordBatch.from_arrays([pa.array([piece[a]]), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["piece", "bits"])

    at = F.pmod(F.xxhash64(name), F.lit(SIEVE))
    rows = keys.select((at / width).cast("int").alias("piece"), (at % width).cast("int").alias("place")).distinct().repartition("piece").sortWithinPartitions("piece")
    found = np.zeros((SIEVE // width, width // 8), np.uint8)
    for r in rows.mapInArrow(work, "piece int, bits binary").toLocalIterator():
        found[r.piece] = np.frombuffer(bytes(r.bits), np.uint8)
    return found.ravel()


def drop_duplicates(docs: DataFrame, threshold: float = THRESHOLD, large: int = LARGE, hub: int = HUB) -> DataFrame:
    """One document of each group and all that have no duplicate, with all their columns.

    A sieve of 8 MB lets most texts that have no duplicate pass where they are; only the others are shuffled, by the key.
    """
    named, _, _ = groups(docs, threshold, large, hub)
    shared = docs.sparkSession.sparkContext.broadcast(_sieve(named, "key"))
    key, mark = unused(docs, "key"), unused(docs, "mark")
    keyed = docs.withColumn(key, key_of(docs))
    keyed = keyed.withColumn(mark, F.pmod(F.xxhash64(key), F.lit(SIEVE)))
    at = keyed.columns.index(mark)

    def sifted(hit: bool) -> DataFrame:
        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            place = batch.column(at).to_numpy()
            yield batch.filter(pa.array((shared.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0) == hit))

        return arrow_map(keyed, work, keyed.schema)

    found = sifted(True)
    apart = found.join(named.select(F.col("key").alias(key)), key, "left_anti")
    doc, rank = unused(found, "kept_doc"), unused(found, "rank")
    stays = named.filter("key = kept_key").select(F.col("key").alias(key), F.col("kept_doc_id").alias(doc))
    own = found.join(stays, key).filter(F.col("doc_id").cast("long").eqNullSafe(F.col(doc)))
    # of equal rows the first of each task, and of these the first
    own = own.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(mark))).filter(F.col(rank) == 1)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return sifted(False).select(*names).unionByName(apart.select(*names)).unionByName(own.select(*names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All superfluous documents of the documents table."""
    return find_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
