import math
from collections import Counter

import numpy as np
import pytest

from weftgraph.llm import lmscore as m
from weftgraph.llm.kernel import text_words


def by_force(texts):
    """(words, log2 of the probability) of each text, from exact counts at their levels."""
    ones, twos = Counter(), Counter()
    words = [text_words(t).tolist() for t in texts]
    for w in words:
        ones.update(w)
        twos.update(zip(w, w[1:]))

    def at(n):
        return float(m.count_of(m.level_of(np.array([n])))[0]) if n else 0.0

    total, vocabulary, out = sum(ones.values()), len(ones), []
    for w in words:
        logs = []
        for k, x in enumerate(w):
            single = (at(ones[x]) + 1) / (total + vocabulary + 1)
            logs.append(math.log2(m.LAMBDA * min(1, at(twos[w[k - 1], x]) / at(ones[w[k - 1]])) + (1 - m.LAMBDA) * single if k else single))
        out.append((len(w), sum(logs)))
    return out


def test_levels():
    counts = np.arange(1, 100_000)
    levels = m.level_of(counts)
    assert (np.diff(levels) >= 0).all() and levels[0] == 1
    assert all(m.count_of(np.array([v]))[0] == pytest.approx(np.mean(counts[levels == v][[0, -1]])) for v in range(1, 25) if (levels == v).any())


def test_filter_is_never_too_low():
    rng = np.random.default_rng(1)
    gram = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    level = m.level_of(np.ceil(rng.pareto(1, len(gram)) + 1e-9))
    bits = m.build(gram, level)
    got = m.probe(bits, gram)
    assert (got >= level).all() and (got > level).mean() < 0.01
    assert (m.probe(bits, rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)) > 0).mean() < 0.01


@pytest.mark.parametrize("number", [1, 7, 1000, 12_345_678, 1 << 31])
def test_places(number):
    gram = np.sort(np.random.default_rng(number).integers(0, 1 << 64, 50_000, dtype=np.uint64))
    shard, item = m.placed(gram, number, True)
    assert shard.tolist() == [int(g) * number >> 64 for g in gram]
    assert item.tolist() == [(int(g) * number % 2**64 >> 25) | 1 << 39 for g in gram]


@pytest.mark.parametrize("number", [None, 1, 40])
def test_scores(spark, number):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), by_force([r.text for r in rows])))
    got = {r.doc_id: r for r in m.scored(docs, number).collect()}
    assert set(got) == set(want)
    for k, (n, log) in want.items():
        assert got[k].words == n
        # the filter's errors only
        assert got[k].log2_prob == pytest.approx(log, abs=0.03 * abs(log) + 6)


@pytest.mark.parametrize("number", [None, 40])
def test_odd_rows(frame, odd, number):
    got = m.scored(frame(odd, True), number).collect()
    assert len(got) == len(odd)
    own = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all((own[k].words, own[k].log2_prob, own[k].perplexity) == (0, 0.0, None) for k in (1, 2, 3, 9))
    assert own[4].words == 60_000 and own[7].words == 1 and own[8].words == 1
    assert sum(r.doc_id == 5 for r in got) == 2 and own[5].perplexity == pytest.approx(own[6].perplexity)
    assert m.scored(frame([]), number).count() == 0


@pytest.mark.parametrize("number", [16, 50])
def test_filter_is_probed_at_every_size(spark, number):
    """Scores are those of the whole filter, looked up word by word."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).coalesce(1)
    docs = docs.unionByName(docs).unionByName(docs)  # parts of equal content
    rows = docs.collect()
    made = m.filter_of(docs, number).collect()
    bits = {r.shard: np.frombuffer(bytes(r.bits), np.uint8) for r in made}
    scale = m.Scale(sum(r.total for r in made), sum(r.vocabulary for r in made))

    def level(gram, pair):
        shard, item = m.placed(gram, number, pair)
        return np.array([m.probe(bits[s], np.array([i]))[0] for s, i in zip(shard.tolist(), item)], np.int64)

    assert scale.total == sum(len(text_words(r.text)) for r in rows)
    assert scale.vocabulary == len({w for r in rows for w in text_words(r.text).tolist()})
    want = {}
    for r in rows[:60]:
        word = text_words(r.text)
        one, two, has = m.grams(word, np.array([0, len(word)]))
        single, double = level(one, False), np.zeros(len(one), np.int64)
        double[has] = level(two[has], True)
        want[r.doc_id] = (len(word), float(scale.log2(single, double, np.concatenate([single[:1], single[:-1]]), has).sum()))
    got = m.scored(docs, number).collect()
    assert len(got) == len(rows)
    assert all(g.words == want[g.doc_id][0] and g.log2_prob == pytest.approx(want[g.doc_id][1], abs=1e-5) for g in got)
