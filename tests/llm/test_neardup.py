import numpy as np
import pytest

from tests.llm.conftest import edited, prose
from weftgraph.llm import neardup as d
from weftgraph.llm.kernel import text_words


def grams(text):
    w = text_words(text).tolist()
    return frozenset(zip(w, w[1:], w[2:])) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def pairs_by_force(rows, threshold):
    sets = [(k, grams(t)) for k, t in rows]
    return {(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if x and y and len(x & y) >= threshold * len(x | y)}


def groups_of(found):
    root = {}
    for r in found:
        root[r.doc_id] = r.kept_doc_id
    return lambda k: root.get(k, k)


def test_recall_and_precision(frame):
    rows = []
    for k in range(40):
        base = prose(k, 80 + k)
        rows += [(10 * k, base), (10 * k + 1, base), (10 * k + 2, edited(base, k, 3)), (10 * k + 3, edited(base, k + 50, 4)), (10 * k + 4, prose(k + 1000, 90))]
    root = groups_of(d.find_duplicates(frame(rows)).collect())
    close = pairs_by_force(rows, 0.7)
    assert sum(root(a) == root(b) for a, b in close) >= 0.98 * len(close)
    assert all(a // 10 == b // 10 for a, b in ((a, root(a)) for a, _ in rows))
    assert all(root(10 * k + 4) == 10 * k + 4 for k in range(40))


def test_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    root = groups_of(d.find_duplicates(docs).collect())
    close = pairs_by_force(rows, 0.65)
    assert close and sum(root(a) == root(b) for a, b in close) >= 0.95 * len(close)


def test_large_group(frame):
    base = prose(7, 120)
    rows = [(k, edited(base, k, k % 4)) for k in range(600)]
    found = d.find_duplicates(frame(rows)).collect()
    assert len(found) == 599 and {r.kept_doc_id for r in found} == {0}
    assert d.drop_duplicates(frame(rows)).count() == 1


def test_sketch_estimates():
    rng = np.random.default_rng(3)
    for share in (0.95, 0.8, 0.6):
        a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        b = a.copy()
        n = int(4000 * (1 - share) / (1 + share))
        b[:n] = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        s = d.sketches(d.minhashes(np.concatenate([a, b]), np.array([0, 4000, 8000])))
        assert d.similarity(np.bitwise_count(s[0] ^ s[1]).sum()) == pytest.approx(share, abs=0.15)


def test_odd_rows(frame, odd):
    got = sorted(((r.doc_id, r.kept_doc_id, r.similarity, r.copies) for r in d.find_duplicates(frame(odd, True)).collect()), key=str)
    assert got == [(5, 5, 1.0, 1), (6, 5, 1.0, 1)]
    kept = d.drop_duplicates(frame(odd, True))
    assert kept.columns == frame(odd, True).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, None, 1, 2, 3, 4, 5, 7, 8, 9], key=str)
    same = frame([(None, prose(9)), (None, prose(9)), (3, prose(9))])
    assert [r.doc_id for r in d.drop_duplicates(same).collect()] == [3]
    assert d.find_duplicates(frame([])).count() == 0 and d.drop_duplicates(frame([])).count() == 0


@pytest.mark.parametrize("hub", [d.HUB, 5])
def test_chain(spark, hub):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(1000, 1001)] + [(2000, 2001 + k) for k in range(40)], "low long, high long")
    got = {r.key: r.root for r in d.connected(pairs, hub).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 1001: 1000, **{2001 + k: 2000 for k in range(40)}}


def classes(found):
    return {r.doc_id: r.kept_doc_id for r in found}


def test_hot_bands_lose_no_link(frame):
    """Buckets that are split give the groups that whole buckets give."""
    rows = []
    for g in range(4):
        base = prose(g, 90)
        rows += [(1000 * g + k, edited(base, k, k % 5)) for k in range(120)]
    # the same opening: a bucket of texts that aren't alike
    opening = prose(99, 40)
    rows += [(5000 + k, f"{opening} {prose(600 + k, 45)}") for k in range(150)]
    rows += [(6000 + k, rows[3][1]) for k in range(30)] + [(7000, None), (7001, "")]
    whole = classes(d.find_duplicates(frame(rows)).collect())
    assert len(whole) >= 4 * 119 + 30
    for large in (8, 40):
        assert classes(d.find_duplicates(frame(rows), large=large, hub=20).collect()) == whole
    kept = sorted(r.doc_id for r in d.drop_duplicates(frame(rows), large=16).collect())
    assert kept == sorted(k for k, _ in rows if k not in whole)


def test_blocks_across_components():
    """Chunks leave components apart that only pairs across them link."""
    rng = np.random.default_rng(8)
    sketch = rng.integers(0, 1 << 63, (40, 8), dtype=np.uint64)
    sketch[20:] = sketch[:20]
    sketch[20:, 0] ^= np.uint64(7)
    root = d.components(sketch, 5)
    assert (root[20:] == np.arange(20)).all() and (root[:20] == np.arange(20)).all()


def test_blocks(spark):
    """Every pair of texts of a hot band that aren't of one component meets in a block; large components don't meet themselves."""
    rows = [(b, f"k{n:03}".encode()) for b in (1, 2) for n in range(120)]
    stars = [(f"k{n:03}".encode(), b"k000") for n in range(1, 70)]
    band = spark.createDataFrame([(b, bytearray(k)) for b, k in rows], "band long, key binary")
    star = spark.createDataFrame([(bytearray(k), bytearray(r)) for k, r in stars], "key binary, root binary")
    met = {}
    for r in d.across(band, star, 16).collect():
        met.setdefault(r.bucket, set()).add(int(bytes(r.key)[1:]))
    pairs = {(a, b) for own in met.values() for a in own for b in own if a < b}
    assert {(a, b) for a in range(120) for b in range(a + 1, 120) if b >= 70} <= pairs
    assert max(map(len, met.values())) <= 64


def test_repeated_rows(frame):
    """Of many equal rows one stays; extra copies of a text are no rows of their own in the search."""
    rows = [(1, prose(5))] * 50 + [(k, prose(5)) for k in range(2, 30)] + [(None, prose(5))] * 20 + [(99, prose(6))]
    found = d.find_duplicates(frame(rows)).collect()
    assert {(r.doc_id, r.copies) for r in found} == {(1, 49), (None, 20)} | {(k, 1) for k in range(2, 30)} and {r.kept_doc_id for r in found} == {1}
    assert sorted(r.doc_id for r in d.drop_duplicates(frame(rows, True)).collect()) == [1, 99]


def test_precision_and_recall_on_real_rows(spark):
    """Groups against exact similarities of all pairs: what is alike is found, and what is linked is alike."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {k: grams(t) for k, t in rows}
    holders = {}
    for k, own in sets.items():
        for g in own:
            holders.setdefault(g, []).append(k)
    meet = {}
    for own in holders.values():
        if len(own) < 60:
            for i, a in enumerate(own):
                for b in own[i + 1 :]:
                    meet[a, b] = meet.get((a, b), 0) + 1
    close = {p for p, n in meet.items() if n >= 0.6 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    found = d.find_duplicates(docs).collect()
    root = groups_of(found)
    assert len(close) > 50 and sum(root(a) == root(b) for a, b in close) >= 0.97 * len(close)
    exact = [len(sets[r.doc_id] & sets[r.kept_doc_id]) / len(sets[r.doc_id] | sets[r.kept_doc_id]) for r in found]
    assert sum(x >= 0.45 for x in exact) >= 0.98 * len(exact)
