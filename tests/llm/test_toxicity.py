import math
import re

import pytest

from tests.llm.conftest import prose
from weftgraph.llm import toxicity as t


@pytest.mark.parametrize("text", ["You IDIOT!", "1d10t", "і­dіоt", "stup!d man", "tra$h", "$cum", "ｉｄｉｏｔ", "𝐢𝐝𝐢𝐨𝐭", "Imbécile", "kill \n yourself", "!!m0r0n!!", "w0rth1ess", "d15gu5t1ng", "clówn", "piece-of_shit", "a$$hole", "@$$hole", "a$$h0le!", "idiot$", "b!+ch", "f@gg idiot", "$h!t"])
def test_found(text):
    assert len(t.Matcher().find(text)) == 1


@pytest.mark.parametrize("text", ["the trash can", "idiot-proof", "a class clown", "scumbags?", "idiotically", "Scunthorpe", "100 45 7", "dickens", "", None, "id iot", "US$ 5", "5$", "a+b@c.org"])
def test_left_alone(text):
    assert t.Matcher().find(text) == []


def test_by_force():
    lexicon, exceptions = {"ab": 1.0, "ab cd": 3.0, "cd": 0.5}, ("x ab", "cd y")
    matcher = t.Matcher(lexicon, exceptions)
    import random

    for seed in range(300):
        rng = random.Random(seed)
        text = " ".join(rng.choice(["ab", "cd", "x", "y", "abc", "A b"]) for _ in range(rng.randint(0, 9)))
        flat = t.fold(text)
        spans = sorted(((kind, -len(e), m.start(), e) for kind, own in ((0, exceptions), (1, lexicon)) for e in own for m in re.finditer(rf"(?<!\w)(?={re.escape(e)}(?!\w))", flat)))
        taken, want = [], []
        for kind, n, at, e in spans:
            if all(at >= b or at - n <= a for a, b in taken):
                taken.append((at, at - n))
                if kind:
                    want.append((at, e))
        assert [e for e, _ in matcher.find(text)] == [e for _, e in sorted(want)], text
        words = len(text.split())
        assert matcher.score(text)[0] == pytest.approx(sum(lexicon[e] for _, e in want) / math.sqrt(words) if want else 0)


def test_odd_rows(frame, odd):
    rows = [*odd, (20, "idiot"), (20, "idiot"), (None, "idiot"), (21, prose(8, 50_000) + " idiot")]
    got = t.scored(frame(rows, True)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id for r in got if r.toxic), key=str) == sorted([20, 20, None], key=str)
    assert [r.hits for r in got if r.doc_id == 21] == [1]
    kept = t.drop_toxic(frame(rows, True))
    assert kept.columns == frame(rows, True).columns and kept.count() == len(rows) - 3
    assert t.scored(frame([])).count() == 0
    assert t.scored(frame(odd), {}, ()).filter("score > 0").count() == 0


def test_learning(frame, spark):
    rows = [(k, f"{prose(k)} {'vexlor' if k % 4 == 0 else 'common'} {prose(k + 100, 20)}") for k in range(80)]
    rows += [(100 + k, prose(5000, 80)) for k in range(30)]
    labels = [(k, 1, int(k % 4 == 0)) for k in range(80)] + [(100 + k, 1, 1) for k in range(30)] + [(None, 1, 1), (3, 1, None)]
    made = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    # words of copies stand in one context
    assert set(t.learn(frame(rows), made)) == {t.fold("vexlor")}
    assert t.learn(frame([]), made) == {} and t.learn(frame(rows), made.limit(0)) == {}
    assert t.learn(frame(rows), made.filter("toxic = 1")) == {}


def test_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = t.query(spark, folder).join(labels.withColumnRenamed("toxic", "label"), "doc_id").collect()
    assert not any(r.toxic for r in got if not r.label)
    assert sum(r.toxic for r in got if r.label) >= 0.6 * sum(r.label for r in got)


def test_words_of_any_length(frame, spark):
    """Two letters or two hundred: a word is learnt, and found, whole."""
    long = "q" + "zx" * 100
    rows = [(k, f"{prose(k)} {('vx', long)[k % 8 == 0] if k % 4 == 0 else 'common'} {prose(k + 100, 20)}") for k in range(160)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(160)], "doc_id long, quality int, toxic int")
    learnt = t.learn(frame(rows), labels)
    assert set(learnt) == {"vx", long}
    assert t.Matcher(learnt).find(f"see {long}") == [(long, learnt[long])] and not t.Matcher(learnt).find(long[:-1])
