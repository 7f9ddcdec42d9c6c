"""Queries that return all of what others show a part of."""

import re

from tests.test_queries import FOLDER, QUERIES


def test_replaced_texts_are_whole(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r.message for r in QUERIES["replace_text"](spark, FOLDER).collect()}
    assert got == {k: re.sub("([a-z]+) ([a-z]+)", r"\2$\1", t) for k, t in texts.items()}
    assert sum(len(t) > 60 for t in got.values()) > len(got) // 2


def test_paths_through_all_orders(spark):
    keys = [r.o_orderkey for r in spark.read.parquet(f"{FOLDER}/orders.parquet").collect()]
    want, held = set(), set(keys)
    for k in keys:
        up = k // 2
        while (k, up) not in want:
            want.add((k, up))
            if up in held:
                up //= 2
    got = [(int(r.x.rsplit("/", 1)[1]), int(r.y.rsplit("/", 1)[1])) for r in QUERIES["bgp_path"](spark, FOLDER).collect()]
    assert len(got) == len(want) and set(got) == want and max(keys) > 300
