import random
from collections import Counter, defaultdict

import pytest

from weftgraph.llm import packing as p


def by_force(sizes, capacity):
    """Contents of the bins, piece by piece."""
    large = sorted(s for s in sizes if 3 * s > capacity)
    bins = []
    while large:
        a = large.pop()
        fits = [b for b in large if a + b <= capacity]
        if fits:
            large.remove(max(fits))
            bins.append([a, max(fits)])
        else:
            bins.append([a])
    for s in sorted((s for s in sizes if 3 * s <= capacity), reverse=True):
        best = min((b for b in bins if sum(b) + s <= capacity), key=lambda b: capacity - sum(b), default=None)
        if best is None:
            bins.append([s])
        else:
            best.append(s)
    return bins


def placed(runs):
    bins = defaultdict(list)
    for size, rank, n, first, per, place in runs:
        for k in range(n):
            bins[first + k // per].append((place + k % per, size))
    return {b: [s for _, s in sorted(x)] for b, x in bins.items()}


@pytest.mark.parametrize("seed", range(40))
def test_arrange(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 97, 256])
    sizes = [min(capacity, max(1, int(rng.lognormvariate(2, 1.2)))) for _ in range(rng.randint(0, 250))]
    runs = p.arrange(Counter(sizes), capacity)
    bins = placed(runs)
    assert Counter(s for b in bins.values() for s in b) == Counter(sizes)
    assert all(sum(b) <= capacity and sum(3 * s > capacity for s in b) <= 2 for b in bins.values())
    for size in set(sizes):
        own = sorted((r, n) for s, r, n, *_ in runs if s == size)
        assert own[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and sum(own[-1]) == sizes.count(size)
    assert len(bins) == len(by_force(sizes, capacity))
    assert sorted(map(sum, bins.values())) == sorted(map(sum, by_force(sizes, capacity)))


def test_documents(frame, odd):
    rng = random.Random(1)
    rows = [*odd, *((k + 50, "y" * rng.randint(1, 300)) for k in range(400))]
    got = p.pack(frame(rows, True), capacity=100).collect()
    parts = defaultdict(list)
    for r in got:
        parts[r.doc_id].append((r.piece, r.start, r.tokens))
    lengths = Counter((k, len(t)) for k, t in rows if t)
    want = Counter(min(100, n - s) for (_, n), c in lengths.items() for _ in range(c) for s in range(0, n, 100))
    assert Counter(r.tokens for r in got) == want
    assert all(start == piece * 100 for own in parts.values() for piece, start, _ in own)
    assert 1 not in parts and 2 not in parts and len(parts[5]) == 2 * (len(dict(odd)[6]) // 100 + 1)
    bins = defaultdict(list)
    for r in got:
        bins[r.bin_id].append((r.place, r.tokens))
    assert all(sorted(k for k, _ in b) == list(range(len(b))) and sum(n for _, n in b) <= 100 for b in bins.values())
    assert len(bins) == len(by_force(list(want.elements()), 100))


def test_order_and_lengths(frame, spark):
    """Ties go by doc_id and piece however many rows and sizes there are; equal rows fill a place each."""
    docs = frame([(k % 400, "z" * 10) for k in range(500)])
    got = p.pack(docs, capacity=25).collect()
    assert len({(r.bin_id, r.place) for r in got}) == 500 and max(Counter(r.bin_id for r in got).values()) == 2
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.bin_id, r.place))]
    assert order == sorted(k % 400 for k in range(500))
    assert p.pack(frame([])).count() == 0
    counted = p.pack(docs, capacity=25, tokens=docs["doc_id"] * 0 + 5)
    assert counted.groupBy("bin_id").count().filter("count <> 5").count() == 0


def test_many_sizes(spark):
    """Thousands of sizes, each of them frequent, over many partitions and Arrow batches."""
    docs = spark.range(60_000).selectExpr("cast(id as bigint) as doc_id", "cast(null as string) as text")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    try:
        got = p.pack(docs, capacity=8192, tokens=docs["doc_id"] % 3000 + 1).toPandas()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 60_000 and not got.duplicated(["bin_id", "place"]).any()
    assert got.groupby("bin_id").tokens.sum().max() <= 8192
    assert got.bin_id.nunique() == len(by_force_count(Counter(got.tokens.tolist()), 8192))
    whole = got.sort_values(["tokens", "doc_id"])
    assert (whole.groupby("tokens").bin_id.apply(lambda b: b.nunique()) >= 1).all()


def by_force_count(histogram, capacity):
    """The bins of ``arrange``, which the tests above hold against piece-by-piece packing."""
    return placed(p.arrange(histogram, capacity))
