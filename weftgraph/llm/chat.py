"""Chat formatting with minimum-cost role repair.

A conversation is legal if it has at most one system turn, which comes first, and then user and assistant in turn, to
an assistant's reply. A dynamic program over the automaton of legal turns finds the cheapest way to make it so: a turn
may take another role (RELABEL; UNKNOWN if its own is none of the three), be merged with the one before it (MERGE),
or an empty turn may be inserted (INSERT). Of equally cheap repairs that with the fewest changed
roles wins, then that with the fewest insertions. The repaired sequence is rendered in ChatML; control marks within texts
are broken up, so that no text can end its own turn.

Turns are ordered by turn (NULL first; ties by role and text); repeated rows are turns of their own. A NULL text is
empty, a NULL role is unknown, roles are compared without case and blanks. Very long texts are rendered whole. As nothing
tells which rows without a conv_id belong together, each is a conversation of its own, and isn't shuffled. The rows of a
conversation meet in one task, since its text is one cell of the result. Extra columns, whatever their names, are
ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.kernel import arrow_map

ROLES = ("system", "user", "assistant")
MERGE, INSERT, UNKNOWN, RELABEL = 1, 2, 1, 3
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = "assistant"
SCHEMA = "conv_id long, cost int, merged int, relabelled int, inserted int, turns int, text string"


def _between(old: str, new: str) -> tuple[str, ...] | None:
    """The roles to insert so that new may follow old; None if it never may."""
    todo: list[tuple[str, tuple[str, ...]]] = [(old, ())]
    seen = {old}
    for at, path in todo:
        if new in NEXT[at]:
            return path
        for role in NEXT[at]:
            if role not in seen:
                seen.add(role)
                todo.append((role, (*path, role)))
    return None


BETWEEN = {(old, new): path for old in NEXT for new in ROLES if (path := _between(old, new)) is not None}


@lru_cache(maxsize=20_000)
def repair(roles: tuple[str, ...]) -> tuple[int, tuple[tuple[str, str], ...]]:
    """(cost, (action, role) of each step); action is keep, merge or insert, and only insert takes no turn of the input."""
    # cost, changed roles and insertions so far, compared in this order
    best: dict[str, tuple[int, int, int]] = {"start": (0, 0, 0)}
    backs: list[dict[str, tuple]] = []
    for own in roles:
        options: dict[str, list[tuple]] = {}
        for new in ROLES:
            label = 0 if new == own else RELABEL if own in ROLES else UNKNOWN
            for old, (cost, changed, inserted) in best.items():
                if old == new:
                    options.setdefault(new, []).append(((cost + label + MERGE, changed + (new != own), inserted), old, "merge", ()))
                if (old, new) in BETWEEN:
                    path = BETWEEN[old, new]
                    options.setdefault(new, []).append(((cost + label + INSERT * len(path), changed + (new != own), inserted + len(path)), old, "keep", path))
        chosen = {new: min(found, key=lambda x: (x[0], x[2], x[1])) for new, found in options.items()}
        best = {new: x[0] for new, x in chosen.items()}
        backs.append({new: x[1:] for new, x in chosen.items()})
    ends = []
    for old, (cost, changed, inserted) in best.items():
        path = () if old == FINAL else (*BETWEEN[old, FINAL], FINAL)
        ends.append(((cost + INSERT * len(path), changed, inserted + len(path)), old, path))
    (cost, _, _), role, path = min(ends)
    steps: list[tuple[str, str]] = [("insert", r) for r in reversed(path)]
    for back in reversed(backs):
        old, action, between = back[role]
        steps.append((action, role))
        steps.extend(("insert", r) for r in reversed(between))
        role = old
    return cost, tuple(reversed(steps))


def render(roles: list[str], texts: list[str], steps: tuple[tuple[str, str], ...]) -> tuple[str, int, int, int, int]:
    """(text, number of merged, relabelled and inserted turns, turns of the result)."""
    turns: list[tuple[str, list[str]]] = []
    merged = relabelled = inserted = at = 0
    for action, role in steps:
        if action == "insert":
            turns.append((role, [""]))
            inserted += 1
            continue
        relabelled += role != roles[at]
        if action == "merge":
            turns[-1][1].append(texts[at])
            merged += 1
        else:
            turns.append((role, [texts[at]]))
        at += 1
    body = "".join(f"<|im_start|>{role}\n" + "\n\n".join(t.replace("<|", "< |") for t in parts) + "<|im_end|>\n" for role, parts in turns)
    return body, merged, relabelled, inserted, len(turns)


def format_conversations(turns: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, cost, merged, relabelled, inserted, turns, text."""
    role = F.lower(F.trim(F.coalesce(turns["role"].cast("string"), F.lit(""))))
    one = F.struct(turns["turn"].cast("long").alias("turn"), role.alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"))
    rows = turns.select(turns["conv_id"].cast("long").alias("conv_id"), one.alias("one"))
    grouped = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))
    grouped = grouped.unionByName(rows.filter("conv_id is null").select("conv_id", F.array("one").alias("turns")))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for conv, own in zip(batch.column(0).to_pylist(), batch.column(1)):
            flat = own.values
            roles, texts = flat.field("role").to_pylist(), flat.field("text").to_pylist()
            cost, steps = repair(tuple(roles))
            text, merged, relabelled, inserted, n = render(roles, texts, steps)
            rows.append((conv, cost, merged, relabelled, inserted, n, text))
        kinds = [pa.int64(), *[pa.int32()] * 5, pa.string()]
        names = ["conv_id", "cost", "merged", "relabelled", "inserted", "turns", "text"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return arrow_map(grouped, work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, repaired and rendered."""
    return format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
