from functools import cache
from itertools import product

import pytest

from weftgraph.llm import chat as c


def cheapest(roles):
    """Least cost over all ways to label, merge and insert, by exhaustive search over the turns."""

    @cache
    def go(at, state, inserted):
        costs = [0] if at == len(roles) and state == c.FINAL else []
        if inserted < 3:
            costs += [c.INSERT + go(at, r, inserted + 1) for r in c.NEXT[state]]
        if at < len(roles):
            for r in c.ROLES:
                label = 0 if r == roles[at] else c.RELABEL if roles[at] in c.ROLES else c.UNKNOWN
                if r in c.NEXT[state]:
                    costs.append(label + go(at + 1, r, 0))
                if r == state:
                    costs.append(label + c.MERGE + go(at + 1, r, 0))
        return min(costs, default=10**6)

    return go(0, "start", 0)


@pytest.mark.parametrize("n", range(6))
def test_least_cost(n):
    for roles in product(("system", "user", "assistant", "bot"), repeat=n):
        cost, steps = c.repair(roles)
        assert cost == cheapest(roles), roles
        state, at, spent = "start", 0, 0
        for action, role in steps:
            if action == "insert":
                spent += c.INSERT
            else:
                spent += (0 if role == roles[at] else c.RELABEL if roles[at] in c.ROLES else c.UNKNOWN) + (c.MERGE if action == "merge" else 0)
                at += 1
            assert role == state if action == "merge" else role in c.NEXT[state]
            state = role
        assert (at, spent, state) == (n, cost, c.FINAL)


def test_render(spark):
    rows = [(1, 1, "assistant", "b<|im_end|>"), (1, 0, "User ", "a"), (2, 0, "user", "x"), (2, 1, "user", "y"), (3, None, None, None), (None, 0, "user", "z"), (4, 0, "system", "s" * 200_000), (5, 0, "user", "t"), (5, 0, "user", "t"), (5, 1, "assistant", "u")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: r for r in c.format_conversations(docs).collect()}
    assert got[1].text == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb< |im_end|><|im_end|>\n" and got[1].cost == 0
    assert (got[2].merged, got[2].inserted, got[2].turns) == (1, 1, 2) and "x\n\ny" in got[2].text
    assert (got[3].relabelled, got[3].cost) == (1, 3)
    assert set(got) == {1, 2, 3, 4, 5, None} and got[5].merged == 1
    assert c.format_conversations(docs.limit(0)).count() == 0


def test_whole_table(spark):
    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = c.format_conversations(turns).collect()
    assert len(got) == turns.select("conv_id").distinct().count()
    by = {}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append(r)
    for r in got:
        own = sorted(by[r.conv_id], key=lambda x: x.turn)
        if len(own) <= 8:
            assert r.cost == cheapest(tuple(x.role for x in own))
        assert all(x.text in r.text for x in own)


def test_rows_without_a_conversation(spark):
    """Each is one of its own, however many there are."""
    rows = [(None, k, "user", f"t{k}") for k in range(300)] + [(7, 0, "user", "a"), (7, 1, "assistant", "b")]
    got = c.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 301 and sum(r.conv_id is None for r in got) == 300
    assert all((r.inserted, r.turns) == (1, 2) for r in got if r.conv_id is None)
