from itertools import combinations

import duckdb

from weftgraph.llm import urlrules as u


def rules_by_force(baskets, least, confidence):
    found = {}
    items = sorted({t for s, _ in baskets for t in s})
    for n in (1, 2, 3):
        for ante in combinations(items, n):
            own = [low for s, low in baskets if set(ante) <= s]
            if sum(own) >= least and sum(own) / len(own) >= confidence:
                found[ante] = (sum(own), sum(own) / len(own))
    return {a: v for a, v in found.items() if not any(set(b) < set(a) and found[b][1] >= v[1] for b in found)}


def test_tokens(spark):
    rows = spark.createDataFrame([("https://www.A-b.org:80/x/12.html?q=1&r=2#top",), ("",), (None,)], "url string")
    got = [r.t for r in rows.select(u.tokens(rows.url).alias("t")).collect()]
    assert got == [["host:#", "host:a", "host:b", "host:org", "host:www", "path:#", "path:html", "path:x", "query:q=#", "query:r=##top", "scheme:https"], [], []]


def test_rules_and_matches(spark):
    urls = [f"http://{'spam' if k % 5 == 0 else 'good'}.org/{'pills' if k % 3 == 0 else 'news'}" for k in range(60)]
    low = [int(not (k % 5 == 0 and (k % 3 == 0 or k % 2))) for k in range(60)]
    pages = spark.createDataFrame([(k, x, "token") for k, x in enumerate(urls)] + [(100, "http://spam.org/pills/7", ""), (101, None, ""), (102, "", ""), (None, "http://spam.org/pills", ""), (100, "http://spam.org/pills/7", "")], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(k, q, 0) for k, q in enumerate(low)] + [(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    rules = u.mine(pages, labels, confidence=0.6)
    tokens = {r.page_id: frozenset(r.t) for r in pages.select("page_id", u.tokens(pages.url).alias("t")).collect()}
    want = rules_by_force([(tokens[k], not q) for k, q in enumerate(low)], 3, 0.6)
    assert {tuple(r.antecedent): (r.hits, r.confidence) for r in rules.collect()} == want and want
    verdicts = u.judged(pages, rules).collect()
    assert len(verdicts) == pages.count()
    for r in verdicts:
        own = [v[1] for a, v in want.items() if set(a) <= set(tokens.get(r.page_id, ())) and r.url]
        if r.page_id is not None:
            assert (r.rules, r.keep) == (len(own), not own)
    kept = u.drop_matching(pages, rules)
    assert kept.columns == pages.columns and kept.count() == sum(r.keep for r in verdicts)


def test_without_labels(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert u.judged(pages, u.mine(pages, labels)).collect()[0].keep
    assert u.judged(pages.limit(0), u.mine(pages.limit(0), labels)).count() == 0


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    want = sorted(con.sql(u.SQL).fetchall())
    got = sorted((r.page_id, r.url, r.rules, r.confidence, r.keep) for r in u.query(spark, folder).collect())
    assert got == want


def test_projection_keeps_the_rules(spark):
    """The rules don't depend on how far transactions are projected before FP-growth."""
    import random

    rng = random.Random(4)
    rows = []
    for k in range(120):
        own = [t for t in "abcdef" if rng.random() < 0.45] or ["a"]
        low = ("a" in own and "c" in own and rng.random() < 0.9) or ("e" in own and "f" not in own and rng.random() < 0.8)
        rows.append((own, low))
    pages = spark.createDataFrame([(k, "http:///" + "/".join(own)) for k, (own, _) in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([(k, int(not low), 0) for k, (_, low) in enumerate(rows)], "doc_id long, quality int, toxic int")
    want = rules_by_force([({f"path:{t}" for t in own} | {"scheme:http"}, low) for own, low in rows], 3, 0.6)
    for wide in (1, 2, 3, 10):
        got = {tuple(r.antecedent): (r.hits, r.confidence) for r in u.mine(pages, labels, confidence=0.6, wide=wide).collect()}
        assert {k: v for k, v in got.items() if len(k) <= 3} == want and want, wide


def mined(spark, urls, low):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, int(not x), 0) for k, x in enumerate(low)], "doc_id long, quality int, toxic int")
    return {tuple(r.antecedent): r.confidence for r in u.mine(pages, labels).collect()}


WORDS = [f"{a}{b}" for a in "bcdfg" for b in ("ax", "ex", "ix", "ox", "ux", "yx")]


def test_thirty_tokens_on_the_same_pages(spark):
    got = mined(spark, ["http:///" + "/".join(WORDS)] * 4 + ["http:///other"] * 9, [1] * 4 + [0] * 9)
    assert got == {(f"path:{w}",): 1.0 for w in WORDS}


def test_thirty_nested_tokens(spark):
    """Each token's pages are among those of the one before it."""
    urls = ["http:///" + "/".join(WORDS[: k // 4 + 1]) for k in range(120)]
    low = [k % 4 != 3 if k < 100 else 1 for k in range(120)]
    got = mined(spark, urls, low)
    share = {w: sum(low[4 * i :]) / len(low[4 * i :]) for i, w in enumerate(WORDS)}
    assert got == {("scheme:http",): share[WORDS[0]]} | {(f"path:{w}",): c for w, c in share.items()}


def test_thirty_tokens_that_also_stand_alone(spark):
    """Thirty tokens share four pages, but none implies another: only pairs say something new."""
    urls = ["http:///" + "/".join(WORDS)] * 4 + [f"http:///{w}" for w in WORDS for _ in range(5)]
    got = mined(spark, urls, [1] * 4 + [0] * 150)
    assert got == {tuple(sorted((f"path:{a}", f"path:{b}"))): 1.0 for i, a in enumerate(WORDS) for b in WORDS[:i]}
