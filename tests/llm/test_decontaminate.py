import random

import pytest

from tests.llm.conftest import edited, prose
from weftgraph.llm import decontaminate as d
from weftgraph.llm.kernel import text_words


def least(pattern, text):
    """Least edits between the pattern and any window of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(k, prose(1000 + k, 12 + 2 * k)) for k in range(20)] + [(20, prose(1000, 12)), (None, prose(2000, 15)), (21, None), (22, ""), (23, "...")], "item_id long, text string")


def test_against_all_windows(frame, benchmark):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    rng = random.Random(5)
    rows = []
    for k in range(120):
        item = rng.choice(items[:20])[1]
        inside = edited(item, k, rng.randint(0, len(item.split()) // 4))
        rows.append((k, f"{prose(k, 40)} {inside} {prose(k + 500, 40)}"))
    rows += [(k, prose(k + 9000, 100)) for k in range(120, 160)]
    want = {}
    for k, text in rows:
        words = text_words(text).tolist()
        for item, body in items:
            own = text_words(body).tolist()
            if own and (n := least(own, words)) <= int(d.TOLERANCE * len(own) + 1e-9):
                want[k, item] = n
    got = {(r.doc_id, r.item_id): r.edits for r in d.find_leaks(frame(rows), benchmark).collect()}
    assert set(got) <= set(want)
    assert len(got) >= 0.95 * len(want)
    assert sum(got[k] == want[k] for k in got) >= 0.95 * len(got)


def test_odd_rows(frame, benchmark, odd):
    item = prose(1005, 22)
    rows = [*odd, (10, item), (10, item), (None, item.upper()), (11, prose(4, 30_000) + " " + item)]
    got = [(r.doc_id, r.item_id) for r in d.find_leaks(frame(rows, True), benchmark).collect()]
    assert sorted(got, key=str) == sorted([(10, 5), (10, 5), (None, 5), (11, 5)], key=str)
    kept = d.drop_leaking(frame(rows, True), benchmark)
    assert kept.columns == frame(rows, True).columns and kept.count() == len(odd)


def test_empty(frame, benchmark):
    assert d.find_leaks(frame([]), benchmark).count() == 0
    assert d.find_leaks(frame([(1, prose(1))]), benchmark.limit(0)).count() == 0
    assert d.drop_leaking(frame([(1, prose(1))]), benchmark.limit(0)).count() == 1


def test_blocks(frame, benchmark):
    """What is found doesn't depend on how the items are split or ordered."""
    rows = [(k, edited(prose(1000 + k, 12 + 2 * k), k, 1 + k % 5)) for k in range(20)]
    whole = sorted(map(str, d.find_leaks(frame(rows), benchmark).collect()))
    assert len(whole) >= 18
    for mb in (0.0005, 0.003):
        assert sorted(map(str, d.find_leaks(frame(rows), benchmark, block_mb=mb).collect())) == whole
    assert sorted(map(str, d.find_leaks(frame(rows), benchmark.orderBy("text")).collect())) == whole
    assert d.drop_leaking(frame(rows), benchmark, block_mb=0.0005).count() == d.drop_leaking(frame(rows), benchmark).count()


def test_frequent_anchors(frame, spark, monkeypatch):
    """Items that share their words, in a text full of them, are followed in portions."""
    items = spark.createDataFrame([(k, " ".join(["the of and"] * 4 + [f"w{k}"])) for k in range(60)], "item_id long, text string")
    rows = [(1, " ".join(["the of and"] * 300)), (2, prose(1))]
    want = sorted(map(str, d.find_leaks(frame(rows), items).collect()))
    assert len(want) == 60
    monkeypatch.setattr(d, "PORTION", 50)
    index = next(d.blocks(items, d.TOLERANCE, d.TARGET_RECALL, 64))
    word = text_words(rows[0][1])
    assert len(d.leaks(index, word, d.np.array([0, len(word)]))) == 60
