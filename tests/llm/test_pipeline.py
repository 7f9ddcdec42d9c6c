from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.conftest import edited, prose
from tests.llm.test_decontaminate import least
from tests.llm.test_neardup import pairs_by_force
from tests.llm.test_packing import by_force as bins_by_force
from tests.llm.test_privacy import by_force as words_by_force
from tests.llm.test_quality import discriminant_by_force
from weftgraph.llm import packing, privacy, quality
from weftgraph.llm.kernel import text_words


def test_stages(spark, tmp_path):
    item = prose(777, 30)
    rows = [(k, prose(k, 80)) for k in range(40)] + [(100 + k, "%%% " + prose(k + 50).upper().replace(" ", " $$$ ")) for k in range(40)]
    rows += [(200, edited(rows[3][1], 1, 2)), (201, rows[4][1]), (202, f"{prose(900)} {item} {prose(901)}"), (203, f"{prose(902)} jo@ex.org {prose(903)}"), (None, prose(904)), (205, None), (206, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k < 100), 0) for k in [*range(0, 40, 2), *range(100, 140, 2)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {}
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, own, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{name}")
        own = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in own.collect()}
        if k + 1 < len(corpus_pipeline.STAGES):
            assert own.columns == docs.columns
    assert kept["quality"] == {*range(40), 200, 201, 202, 203, None}
    assert kept["near_duplicates"] == kept["quality"] - {200, 201}
    assert kept["decontamination"] == kept["near_duplicates"] - {202}
    assert kept["privacy"] == kept["packing"] == kept["decontamination"]
    assert "[EMAIL]" in spark.read.parquet(f"{tmp_path}/privacy").filter("doc_id = 203").first().text
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(map(tuple, whole.select("doc_id", "piece", "start", "tokens").collect())) == Counter(map(tuple, own.select("doc_id", "piece", "start", "tokens").collect()))


def test_empty(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def stage_by_force(name, rows, labels, items):
    """What a stage makes of (doc_id, text) rows, without Spark."""
    if name == "quality":
        described = [(k, t, quality_statistics(t)) for k, t in rows if text_words(t).size]
        known = [(labels[k], x) for k, _, x in described if k in labels]
        score = discriminant_by_force([x for q, x in known if q == 0], [x for q, x in known if q == 1])
        return [(k, t) for k, t, x in described if score(x) >= quality.THRESHOLD]
    if name == "near_duplicates":
        close = pairs_by_force(list(enumerate(t for _, t in rows)), 0.55)
        root = list(range(len(rows)))

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for a, b in close:
            root[find(b)] = find(a)
        best = {}
        for n, (k, t) in enumerate(rows):
            if text_words(t).size:
                best[find(n)] = min(best.get(find(n), (2, 0, 0)), (k is None, k or 0, n))
            else:
                best[n] = (0, 0, n)
        return [rows[n] for n in sorted(n for _, _, n in best.values())]
    if name == "decontamination":
        return [(k, t) for k, t in rows if not any(least(i, text_words(t).tolist()) <= int(0.2 * len(i) + 1e-9) for i in items)]
    if name == "privacy":
        words = words_by_force([t for _, t in rows])
        assert not words
        return [(k, t if t is None else privacy._ENTITY.sub(lambda m: f"[{privacy._CLASSES[int(m.lastgroup[1:])][0]}]", t)) for k, t in rows]
    sizes = [min(packing.CAPACITY, len(t) - s) for _, t in rows if t for s in range(0, len(t), packing.CAPACITY)]
    return sorted(map(sum, bins_by_force(sizes, packing.CAPACITY)))


def quality_statistics(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return quality.statistics(data, np.array([0, len(data)]))[0][0]


def test_stages_by_force(spark, tmp_path, odd):
    """Odd, repeated and very long rows with clashing columns, against brute force stage by stage."""
    item = prose(777, 30)
    rows = [(k, prose(k, 80)) for k in range(40)] + [(100 + k, "%%% " + prose(k + 50).upper().replace(" ", " $$$ ")) for k in range(30)]
    rows += [(200, edited(rows[3][1], 1, 2)), (201, rows[4][1]), (202, f"{prose(900)} {edited(item, 3, 2)} {prose(901)}"), (203, f"{prose(902)} jo@ex.org {prose(903)}"), (204, prose(30_000, 9000))]
    rows += [(205, rows[5][1])] * 4 + [(None, rows[6][1]), (3, rows[3][1])] + [(400 + k if k else k, t) for k, t in odd if t != prose(2, 60_000)]
    docs = spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t), "key", "mark", "rank") for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, mark string, kept_doc string")
    labels = {k: int(k < 100) for k in [*range(0, 40, 2), *range(100, 130, 2)]}
    spark.createDataFrame([(k, q, 0) for k, q in labels.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want, own = rows, docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, own, str(tmp_path))
        want = stage_by_force(name, want, labels, [text_words(item).tolist()])
        if name == "packing":
            bins = Counter()
            for r in made.collect():
                bins[r.bin_id] += r.tokens
            assert sorted(bins.values()) == want
            break
        assert made.columns == docs.columns
        made.write.parquet(f"{tmp_path}/{name}")
        own = spark.read.parquet(f"{tmp_path}/{name}")
        got = own.collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter(want), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) and r.key == "key" for r in got)
