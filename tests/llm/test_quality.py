import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import prose
from weftgraph.llm import quality as q
from weftgraph.llm.kernel import slices


def rows_of(texts):
    return np.concatenate([q.statistics(data, offsets)[0] for _, _, data, offsets in slices(pa.array(texts))])


def discriminant_by_force(low, high):
    """The score of a description, from the two classes' descriptions, by plain densities."""
    x = [np.array(low), np.array(high)]
    both, total = np.concatenate(x), len(low) + len(high)
    centre, scale = both.mean(0), np.sqrt(np.maximum(both.var(0), 1e-6))
    z = [(a - centre) / scale for a in x]
    covariances = [np.cov(a.T, bias=True) for a in z]
    pooled = sum(len(a) * c for a, c in zip(x, covariances)) / total
    parts = []
    for a, c in zip(z, covariances):
        weight = q.HALF / (q.HALF + len(a))
        c = weight * pooled + (1 - weight) * c
        c = (1 - q.RIDGE) * c + q.RIDGE * max(np.trace(c) / len(c), 1e-3) * np.eye(len(c))
        parts.append((np.log(len(a) / total) - np.linalg.slogdet(c)[1] / 2, a.mean(0), np.linalg.inv(c)))

    def score(row):
        point = np.clip((row - centre) / scale, -q.REACH, q.REACH)
        bad, good = (n - (point - m) @ i @ (point - m) / 2 for n, m, i in parts)
        return good - bad

    return score


def test_against_densities():
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(60, 4)) * [1, 2, 3, 1] + 1, rng.normal(size=(90, 4))]
    model = q.fit_moments([60.0, 90.0], [a.sum(0) for a in x], [a.T @ a for a in x], half=10, ridge=0.1)
    both = np.concatenate(x)
    centre, scale = both.mean(0), both.std(0)
    z = [(a - centre) / scale for a in x]
    covariances = [np.cov(a.T, bias=True) for a in z]
    pooled = (60 * covariances[0] + 90 * covariances[1]) / 150
    points = rng.normal(size=(20, 4))
    want = []
    for a, c, n in zip(z, covariances, (60, 90)):
        c = 10 / (10 + n) * pooled + n / (10 + n) * c
        c = 0.9 * c + 0.1 * np.trace(c) / 4 * np.eye(4)
        d = np.clip((points - centre) / scale, -6, 6) - a.mean(0)
        want.append(np.log(n / 150) - np.linalg.slogdet(c)[1] / 2 - np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) / 2)
    assert np.allclose(model.score(points), want[1] - want[0])


def test_statistics_do_not_depend_on_neighbours():
    texts = [prose(1), "", "A! b\nb", prose(2, 3000), "ß%%% ß%%%", None, prose(1)]
    whole = rows_of(texts)
    assert np.allclose(whole, np.concatenate([rows_of([t]) for t in texts])) and np.allclose(whole[0], whole[-1])


def test_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = q.fit(docs, labels.filter("doc_id % 2 = 0"))
    got = q.scored(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").collect()
    assert len(got) > 150
    assert np.mean([r.keep for r in got if r.quality == 1]) >= 0.98 and np.mean([not r.keep for r in got if r.quality == 0]) >= 0.9


def test_odd_rows(frame, odd, spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(20, 60)] + [(None, 1, 0), (5, None, 0), (20, 0, 1)], "doc_id long, quality int, toxic int")
    more = [(k, prose(k) if k % 2 else "%%% " + prose(k).upper().replace(" ", " $$$ ")) for k in range(20, 60)]
    docs = frame([*odd, *more], True)
    model = q.fit(docs, labels)
    got = q.scored(docs, model).collect()
    assert len(got) == docs.count()
    own = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all(own[k].score is None and not own[k].keep for k in (1, 2, 3, 9))
    assert all(own[k].keep == bool(k % 2) for k in range(20, 60))
    kept = q.drop_low(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)
    assert q.scored(frame([]), model).count() == 0


def test_without_model(frame, spark, odd):
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    assert q.fit(frame(odd), labels) is None
    assert {r.doc_id: r.keep for r in q.scored(frame(odd), None).collect()}[4]
    assert q.drop_low(frame(odd), None).count() == 7
    assert q.fit(frame([]), labels) is None


def test_bounded_sample(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = q.fit(docs, labels, sample=60)
    assert model is not None and model.offsets != pytest.approx(q.fit(docs, labels).offsets)
