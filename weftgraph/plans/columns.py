"""Workflows compiled to columns: all documents at once, in one lazy plan.

A *frame* is a DataFrame with a row for each live scope: the document's doc_id, ``row`` (a number that each input row
has for itself, so that repeated and NULL doc_ids are no matter), ``ord`` (the path of loop turns, whose order is the
order of execution), the current text, variables and matches. Scopes that are entered at most once add
columns to the frame: each value gets a column of its own, guarded by the scope's condition. Loops explode a child
frame; what its body writes is folded back to the parent only if it is read later. What a workflow emits is kept as
columns of the frame that emits it, and is exploded from there in one pass for each frame.

What has no columns raises Unsupported: names made at run time, Python code, state carried between turns of a loop
other than from one alternative of a sequence to another, pre and tags, breaks within a loop of their own. Text put in
by a template isn't expanded again.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import expression, regex, terms
from weftgraph.functions.expression import Unsupported
from weftgraph.plans.machine import REFERENCE
from weftgraph.plans.workflow import TRIPLE, Step, Workflow, WorkflowError, flags_of, parse_steps, patterns
from weftgraph.session import spread

KEY, ROW = "doc_id", "row"
#: Parts a hit's groups in one string; a text that holds it is matched once for each group instead.
_PART = "\ufdd1\ufdd0"
#: Distinct queries that a select step may make of documents; MB of its rows that are put beside every scope.
QUERIES, SELECT_MB = 1000, 16
_STRPTIME = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "b": "MMM", "B": "MMMM", "y": "yy", "I": "hh", "p": "a", "%": "%"}


@dataclass(frozen=True)
class Match:
    """A named match: its column of groups, the names of groups, and the scope that made it."""

    column: str
    groups: int
    names: tuple[tuple[str, int], ...]
    scope: tuple[int, ...]


@dataclass
class Frame:
    """A DataFrame and what is emitted from it."""

    df: DataFrame
    events: list[dict[str, Any]] = field(default_factory=list)


@dataclass(frozen=True)
class State:
    """What the steps see: columns of the text, the guard, variables (name: column, kind) and matches."""

    text: str
    on: str | None
    scope: tuple[int, ...]
    values: dict[str, tuple[str, str]]
    matches: dict[str, Match]


@contextmanager
def _held(owner: Any, name: str):
    before = getattr(owner, name)
    try:
        yield
    finally:
        setattr(owner, name, before)


def references(value: Any) -> set[str]:
    """Names that templates anywhere in an attribute refer to."""
    if isinstance(value, str):
        return {m[2] or m[3] for m in REFERENCE.finditer(value)}
    if isinstance(value, dict):
        return set().union(*(references(v) for v in value.values()), set())
    if isinstance(value, list):
        return set().union(*(references(v) for v in value), set())
    return set()


def reads(step: Step) -> set[str]:
    """Names that a step or its bodies may read; expressions are read by word."""
    found = references(step.at)
    for key in ("if", "eval"):
        found |= set(re.findall(r"[A-Za-z_][\w-]*", str(step.at.get(key, ""))))
    for key in ("ifdef", "ifndef", "for-each", "append"):
        if key in step.at:
            found.add(re.sub(r"\.\d+$", "", str(step.at[key])))
    for body in step.bodies.values():
        for inner in body:
            found |= reads(inner)
    return found


def writes(step: Step) -> set[str]:
    """Names that a step or its bodies may write."""
    found = {str(step.at[k]) for k in ("set", "clear", "append", "to", "as") if k in step.at and (k != "to" or step.op == "map") and not isinstance(step.at[k], list)}
    if "as" in step.at and step.op != "select":
        found.add(f"{step.at['as']}_count")
    if step.op == "match-dimensions":
        found |= set(step.at.get("dimensions") or [])
    if step.op == "call":
        found |= set((step.at.get("return") or {}).values())
    if step.op == "select":
        found |= set(selected(step)[1])
    for body in step.bodies.values():
        for inner in body:
            found |= writes(inner)
    return found


def exposed(steps: list[Step], own: set[str], sure: frozenset[str] = frozenset()) -> set[str]:
    """Names of own that the steps read before they have surely written them."""
    found: set[str] = set()
    for step in steps:
        nested = {*step.bodies, "alternatives", "steps", "any-of"}
        direct = Step(step.op, {k: v for k, v in step.at.items() if k not in nested}, step.where)
        found |= (set() if step.op == "append" else reads(direct) & own) - sure
        if step.op == "append":
            found |= (references(step.at.get("element")) & own) - sure
        names = {str(step.at[k]) for k in ("as", "as-1", "as-2", "header-as", "leading-as") if k in step.at and not isinstance(step.at[k], list)}
        if step.op == "select":
            names |= writes(Step("select", {k: v for k, v in step.at.items() if k in ("select", "as")}, ""))
        inside = sure | names | {f"{n}_count" for n in names} | set(step.at.get("dimensions") or [])
        for body in step.bodies.values():
            for part in [[s] for s in body] if step.op in ("sequence-of", "any-of") else [body]:
                found |= exposed(part, own, inside)
        if step.op == "set":
            sure = sure | {f"{n}_count" for n in names}
        if step.op in ("set", "map", "match", "call"):
            sure = sure | {str(step.at[k]) for k in ("set", "to", "as") if k in step.at} | set((step.at.get("return") or {}).values() if step.op == "call" else ())
    return found


class Compiler:
    """Compiles one workflow over documents with a key, a text and columns that are variables from the start."""

    def __init__(self, workflow: Workflow, docs: DataFrame, text: str = "text", documented: bool = False, graphs: dict[str, DataFrame] | None = None):
        self.workflow, self.documented, self.graphs = workflow, documented, graphs or {}
        self.numbers = 0
        self.prefixes: dict[str, str] = {}
        self.procedures: dict[str, list[Step]] = {}
        self.mappings: dict[str, tuple[dict, list, int]] = {}
        self.later: set[str] = set()
        values = {c: (f"var_{c}", "str") for c in docs.columns if c != text}
        kept = [F.col(c).cast("string").alias(f"var_{c}") for c in docs.columns if c != text]
        # a stream's rows can't be numbered
        row = F.col(KEY).cast("long") if docs.isStreaming else F.monotonically_increasing_id()
        df = docs.select(F.col(KEY).alias(KEY), row.alias(ROW), F.array().cast("array<int>").alias("ord"), F.col(text).cast("string").alias("text0"), *kept)
        self.base = df.select(ROW, KEY)
        self.frame = Frame(df)
        self.frames = [self.frame]
        self.state = State("text0", None, (), values, {})
        self.inside: list[set[str]] = []
        self.breaks: list[tuple[Frame, list[Column]]] = []
        self.run(workflow.steps)

    # columns

    def number(self) -> int:
        self.numbers += 1
        return self.numbers

    def add(self, kind: str, column: Column) -> str:
        name = f"{kind}_{self.number()}"
        self.frame.df = self.frame.df.withColumn(name, column)
        return name

    def guarded(self, column: Column, old: str | None) -> Column:
        if self.state.on is None:
            return column
        return F.when(F.col(self.state.on), column).otherwise(F.col(old) if old else F.lit(None))

    def write(self, name: str, column: Column, kind: str = "str") -> None:
        old = self.state.values.get(name)
        if "@{" in name:
            raise Unsupported(f"{name}: a name made at run time")
        if old and old[1] != kind and self.state.on is not None:
            if kind == "str" and old[1] == "int":
                old = (old[0], "str")
            else:
                raise Unsupported(f"{name} is a list in places")
        made = self.add("v", self.guarded(column.cast("string") if kind == "str" else column, old[0] if old else None))
        self.state = replace(self.state, values={**self.state.values, name: (made, kind)})

    def remember(self, name: str | None, column: Column, pattern: re.Pattern, scope: tuple[int, ...], latest: bool = True) -> None:
        """Keep a match under its name, and as the latest one where numbers alone mean that."""
        for own in [name] * bool(name) + [None] * (latest and self.documented):
            old = self.state.matches.get(own)
            made = self.add("m", self.guarded(column, old.column if old else None))
            match = Match(made, pattern.groups, tuple(pattern.groupindex.items()), scope)
            self.state = replace(self.state, matches={**self.state.matches, own: match})

    def emit(self, kind: str, condition: Column | None = None, **columns: Column) -> None:
        guard = F.lit(True) if self.state.on is None else F.col(self.state.on)
        guard = guard if condition is None else guard & F.coalesce(condition, F.lit(False))
        self.frame.events.append({"kind": kind, "guard": guard, "seq": self.number(), **columns})

    @contextmanager
    def scope(self, condition: Column):
        """Steps within run where the condition holds."""
        on, scope = self.state.on, self.state.scope
        guard = F.coalesce(condition, F.lit(False))
        made = self.add("on", guard if on is None else F.col(on) & guard)
        self.state = replace(self.state, on=made, scope=(*scope, self.number()))
        try:
            yield
        finally:
            self.state = replace(self.state, on=on, scope=scope)

    @contextmanager
    def text(self, name: str):
        before = self.state.text
        self.state = replace(self.state, text=name)
        try:
            yield
        finally:
            self.state = replace(self.state, text=before)

    # templates

    def template(self, text: Any) -> Column:
        if not isinstance(text, str):
            raise Unsupported(f"{text!r} isn't a template")
        parts, at = [], 0
        for m in REFERENCE.finditer(text):
            if m.start() > at:
                parts.append(F.lit(text[at : m.start()]))
            parts.append(self.reference(*m.groups()))
            at = m.end()
        if at < len(text) or not parts:
            parts.append(F.lit(text[at:]))
        if "@{" in REFERENCE.sub("", text):
            raise Unsupported(f"nested references in {text!r}")
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    def reference(self, optional: str | None, match: str | None, name: str, function: str | None) -> Column:
        if match or (self.documented and name.isdigit()):
            own = self.state.matches.get(match)
            if own is None:
                if optional or not match:
                    return F.lit("")
                if re.search(r"-\d", match):
                    raise Unsupported(f"{match}: a match by place")
                self.emit("error", None, message=F.lit(f"there is no match {match}"))
                return F.lit("")
            group = int(name) if name.isdigit() else dict(own.names).get(name, -1)
            if not 0 <= group <= own.groups:
                self.emit("error", None, message=F.lit(f"{match} has no group {name}"))
                return F.lit("")
            if not optional and self.state.scope[: len(own.scope)] != own.scope:
                self.emit("error", F.col(own.column).isNull(), message=F.lit(f"there is no match {match}"))
            value = F.coalesce(F.col(own.column)[group], F.lit(""))
        elif name in self.state.values:
            column, kind = self.state.values[name]
            value = F.col(column)
            if kind == "list":
                value = F.concat(F.lit("['"), F.concat_ws("', '", value), F.lit("']"))
            value = F.coalesce(value.cast("string"), F.lit("" if self.documented else "None"))
        else:
            value = F.lit("" if self.documented else "None")
        if function == "iri":
            return terms.c_iri_name(value)
        if function == "trim":
            return terms.c_strip(value)
        return _unescape(F.regexp_replace(terms.c_strip(value), "[\n\t\r]+", " ")) if function == "norm" else value

    def variable(self, name: str) -> Column:
        if name not in self.state.values:
            raise Unsupported(f"there is no variable {name}")
        return F.col(self.state.values[name][0]).cast("string")

    def expression(self, source: str) -> expression.Typed:
        return expression.column(source, self.template, self.variable)

    # execution

    def run(self, steps: list[Step]) -> tuple[Column, Column | None]:
        result: tuple[Column, Column | None] = (F.lit(True), None)
        outer = self.later
        for k, step in enumerate(steps):
            self.later = outer.union(*(reads(s) for s in steps[k + 1 :]))
            if step.op in TRIPLE:
                result = self.triple(step)
                continue
            method: Callable[[Step], Any] | None = getattr(self, "do_" + step.op.replace("-", "_"), None)
            if method is None:
                raise Unsupported(f"{step.where} has no columns")
            result = method(step) or (F.lit(True), None)
        self.later = outer
        return result

    def do_pass(self, step: Step) -> None:
        return None

    def do_desc(self, step: Step) -> None:
        self.emit("log", level=F.lit("DESC"), message=F.lit(str(step.get("desc"))))

    def do_echo(self, step: Step):
        message = self.template(step.get("echo"))
        self.emit("log", level=F.lit("ECHO"), message=message)
        return F.lit(True), message

    def do_dump(self, step: Step):
        what = step.get("dump")
        value = F.col(self.state.text) if what in ("_", "*", "ct", "current-text") else self.template(what)
        if step.get("file"):
            self.emit("file", level=self.template(step.get("file")), message=value)
        else:
            self.emit("log", level=F.lit("DUMP"), message=value)
        return F.lit(True), value

    def do_save_as(self, step: Step) -> None:
        at = step.get("save-as")
        self.emit("file", level=self.template(at if isinstance(at, str) else at["file"]), message=F.lit(""))

    def do_any_of(self, step: Step):
        done = self.add("done", F.lit(False))
        value: Column | None = None
        for one in step.body("any-of"):
            with self.scope(~F.col(done)):
                ok, own = self.run([one])
                took = self.add("took", F.col(self.state.on) & F.coalesce(ok, F.lit(False)))
            if own is not None:
                kept = F.col(self.add("value", F.when(F.col(took), own.cast("string"))))
                value = kept if value is None else F.coalesce(value, kept)
            done = self.add("done", F.col(done) | F.col(took))
        return F.col(done), value

    def do_set(self, step: Step):
        if "to" in step.at:
            to = step.get("to")
            if isinstance(to, (list, dict)):
                raise Unsupported(f"{step.where}: a list or mapping")
            value = self.template(to) if isinstance(to, str) else F.lit(None if to is None else str(to))
        else:
            value = expression.text_of(self.expression(step.get("eval")))
        self.write(step.get("set"), value)
        return F.lit(True), F.col(self.state.values[step.get("set")][0])

    def do_clear(self, step: Step) -> None:
        self.write(step.get("clear"), F.lit(None).cast("string"))

    def do_append(self, step: Step) -> None:
        name = step.get("append")
        old = self.state.values.get(name)
        element = self.template(step.get("element"))
        if self.inside and name in self.inside[-1]:
            # within a loop: this turn's elements, which the fold joins to the list
            before = F.coalesce(F.col(old[0]), F.array().cast("array<string>")) if old and old[1] == "list" else F.array().cast("array<string>")
        elif old is None:
            before = F.array().cast("array<string>")
        elif old[1] == "list":
            before = F.coalesce(F.col(old[0]), F.array().cast("array<string>"))
        else:
            held = F.col(old[0]).cast("string")
            before = F.when(held.isNull() | (held == ""), F.array().cast("array<string>")).otherwise(F.array(held))
            self.state = replace(self.state, values={k: v for k, v in self.state.values.items() if k != name})
            if self.state.on is not None:
                raise Unsupported(f"{name} becomes a list in places")
        self.write(name, F.array_append(before, element), "list")

    def do_if(self, step: Step):
        with self.scope(expression.truth(self.expression(step.get("if")))):
            on = self.state.on
            ok, value = self.run(step.body())
        return F.col(on) & ok, value

    def defined(self, name: str) -> Column:
        if "@{" in name:
            raise Unsupported(f"{name}: a name made at run time")
        if m := re.match(r"(\w+)\.(\d+)", name):
            own = self.state.matches.get(m[1])
            value = F.col(own.column)[int(m[2])] if own else F.lit(None).cast("string")
        else:
            held = self.state.values.get(name)
            value = F.col(held[0]).cast("string") if held else F.lit(None).cast("string")
        return F.coalesce(terms.c_strip(value) != "", F.lit(False))

    def do_ifdef(self, step: Step, wanted: bool = True):
        known = self.defined(step.get("ifdef" if wanted else "ifndef"))
        with self.scope(known if wanted else ~known):
            on = self.state.on
            ok, value = self.run(step.body())
        return F.col(on) & ok, value

    def do_ifndef(self, step: Step):
        return self.do_ifdef(step, False)

    def do_procedure(self, step: Step) -> None:
        self.procedures[step.get("procedure")] = step.body()

    def do_call(self, step: Step):
        name = step.get("call")
        if name not in self.procedures:
            self.emit("error", message=F.lit(f"there is no procedure {name}"))
            return F.lit(False), None
        values, matches = self.state.values, self.state.matches
        for own, value in (step.get("with") or {}).items():
            if isinstance(value, str) and value.startswith("~"):
                if value[1:] in matches:
                    self.state = replace(self.state, matches={**self.state.matches, own: matches[value[1:]]})
            else:
                self.write(own, self.template(value) if isinstance(value, str) else F.lit(str(value)))
        outer, self.later = self.later, self.later | set(step.get("return") or {})
        ok, value = self.run(self.procedures[name])
        self.later = outer
        back = {theirs: self.state.values.get(own) for own, theirs in (step.get("return") or {}).items()}
        self.state = replace(self.state, values=values, matches=matches)
        for theirs, own in back.items():
            self.write(theirs, F.col(own[0]) if own else F.lit(None).cast("string"), own[1] if own else "str")
            value = F.col(self.state.values[theirs][0])
        return ok, value

    # matching

    def do_replace(self, step: Step) -> None:
        pattern = regex.translate(step.get("replace"))
        new = F.regexp_replace(F.col(self.state.text), pattern, regex.replacement(step.get("with"), step.get("replace")))
        self.state = replace(self.state, text=self.add("text", self.guarded(new, self.state.text)))

    def first(self, step: Step, key: str) -> tuple[Column, Column, re.Pattern]:
        """(whether there is a hit, its groups, a pattern with its groups) of the first pattern that hits."""
        text, flags = F.col(self.state.text), flags_of(step.get("flags"))
        own = [re.compile(p, flags) for p in patterns(step, key)]
        java = [regex.translate(p.pattern, flags) for p in own]
        groups = max(p.groups for p in own)
        hits = [text.rlike(p) for p in java]
        arrays = [F.array(*(F.regexp_extract(text, j, g) if g <= p.groups else F.lit("") for g in range(groups + 1))) for p, j in zip(own, java)]
        found, value = hits[0], F.when(hits[0], arrays[0])
        for h, a in zip(hits[1:], arrays[1:]):
            found, value = found | h, value.when(h, a)
        return found, value, max(own, key=lambda p: p.groups)

    def do_match(self, step: Step):
        found, value, pattern = self.first(step, "match")
        with self.scope(found):
            on = self.state.on
            groups = self.add("groups", value)
            self.emit("match", length=F.length(F.col(groups)[0]))
            self.remember(step.get("as"), F.col(groups), pattern, self.state.scope)
            ok, own = self.run(step.body()) if step.body() else (F.lit(True), F.col(groups)[0])
        return F.col(on) & ok, own

    def do_within(self, step: Step):
        found, value, pattern = self.first(step, "within")
        group = step.get("group") or 1
        with self.scope(found & (value[group] != "")):
            on = self.state.on
            groups = self.add("groups", value)
            self.emit("match", length=F.length(F.col(groups)[0]))
            self.remember(step.get("as"), F.col(groups), pattern, self.state.scope, False)
            with self.text(self.add("text", F.col(groups)[group])):
                self.run(step.body())
        return F.col(on), None

    def do_with(self, step: Step):
        with self.text(self.add("text", self.template(step.get("with")))):
            return self.run(step.body())

    # loops

    def hits(self, text: Column, pattern: re.Pattern, flags: int) -> Column:
        """All hits, each an array of groups."""
        java = regex.translate(pattern.pattern, flags)
        return self.all_hits(text, java, pattern.groups, regex.context_free(pattern.pattern), regex.one_group(pattern))

    def all_hits(self, text: Column, java: str, groups: int, alone: bool, same: bool = False) -> Column:
        """All hits of a Java pattern; alone: a hit's groups follow from the hit itself, which is then matched once more; same: its one group is the hit."""
        columns = [F.regexp_extract_all(text, F.lit(java), F.lit(g)) for g in range(groups + 1)]
        if not groups or same:
            return F.transform(columns[0], lambda x: F.array(*[x] * (groups + 1)))
        zipped = F.transform(F.arrays_zip(*columns), lambda x: F.array(*(x[f"{k}"] for k in range(groups + 1))))
        if not alone or groups < 2:
            return zipped
        flags = re.match(r"(?:\(\?[a-zA-Z]+\))?", java)[0]
        whole = f"{flags}\\A(?:{java[len(flags):]})\\z"
        parts = F.lit(_PART.join(f"${g}" for g in range(1, groups + 1)))
        fast = F.transform(columns[0], lambda x: F.concat(F.array(x), F.split(F.regexp_replace(x, F.lit(whole), parts), F.lit(_PART))))
        return F.when(F.contains(text, F.lit(_PART[0])), zipped).otherwise(fast)

    @contextmanager
    def loop(self, rows: Column, body: list[Step], carried: bool = False):
        """A child frame with a row (column ``turn``, ``item``) for each element; folds back what is read later."""
        own = set().union(*(writes(s) for s in body), set())
        if not carried and (early := exposed(body, own)):
            raise Unsupported(f"{', '.join(sorted(early))}: carried from one turn of a loop to the next")
        parent, before, seq = self.frame, self.state, self.number()
        df = parent.df if before.on is None else parent.df.filter(F.col(before.on))
        turn, item = f"turn_{seq}", f"item_{seq}"
        # of a plain posexplode Spark infers a filter on the array's size, and finds the hits three times over
        df = df.select("*", F.posexplode_outer(rows).alias(turn, item)).filter(F.col(turn).isNotNull()).withColumn("ord", F.concat("ord", F.array(F.lit(seq), F.col(turn) + 1)))
        lists = {str(s.at["append"]) for s in _inner(body) if s.op == "append"}
        values = {k: v for k, v in before.values.items() if k not in own}
        self.frame = Frame(df)
        self.frames.append(self.frame)
        self.inside.append(lists)
        self.state = State(before.text, None, (*before.scope, seq), values, {k: m for k, m in before.matches.items() if k not in own})
        yield turn, item
        after, child = self.state, self.frame
        self.inside.pop()
        self.frame, self.state = parent, before
        live = own & self.later
        if live:
            self.fold(child, after, live, lists)

    def fold(self, child: Frame, after: State, live: set[str], lists: set[str]) -> None:
        depth = F.size("ord") - 2
        grouped = []
        for name in sorted(live):
            if name in after.values:
                column, kind = after.values[name]
                if name in lists:
                    turns = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(), F.struct(F.col("ord"), F.col(column).alias("items")))))
                    grouped.append((name, "list", F.flatten(F.transform(turns, lambda x: x["items"]))))
                else:
                    grouped.append((name, kind, F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("ord")))))
            if name in after.matches:
                column = after.matches[name].column
                grouped.append((name, "match", F.max_by(F.col(column), F.when(F.col(column).isNotNull(), F.col("ord")))))
        if not grouped:
            return
        number = self.number()
        names = [f"fold_{number}_{k}" for k in range(len(grouped))]
        rows = spread(child.df, ROW).groupBy(ROW, F.slice("ord", F.lit(1), depth).alias("ord")).agg(*(c.alias(n) for n, (_, _, c) in zip(names, grouped)))
        self.frame.df = self.frame.df.join(rows, [ROW, "ord"], "left")
        for column, (name, kind, _) in zip(names, grouped):
            if kind == "match":
                own = after.matches[name]
                old = self.state.matches.get(name)
                made = self.add("m", F.coalesce(F.col(column), F.col(old.column)) if old else F.col(column))
                self.state = replace(self.state, matches={**self.state.matches, name: replace(own, column=made)})
                continue
            old = self.state.values.get(name)
            if kind == "list":
                empty = F.array().cast("array<string>")
                before = F.coalesce(F.col(old[0]), empty) if old and old[1] == "list" else empty
                made = self.add("v", F.when(F.size(F.coalesce(F.col(column), empty)) > 0, F.concat(before, F.col(column))).otherwise(F.col(old[0]) if old and old[1] == "list" else F.lit(None)))
            else:
                made = self.add("v", F.coalesce(F.col(column).cast("string"), F.col(old[0]).cast("string")) if old else F.col(column))
                kind = "str" if old else kind
            self.state = replace(self.state, values={**self.state.values, name: (made, kind)})

    def _every(self, step: Step, key: str, inside: bool):
        flags = flags_of(step.get("flags"))
        pattern = re.compile(step.get(key), flags)
        rows = self.add("hits", self.hits(F.col(self.state.text), pattern, flags))
        name = step.get("as")
        body = [Step("set", {"set": f"{name}_count", "as": name, "to": ""}, "")] if name else []
        with self.loop(F.col(rows), [*body, *step.body("first"), *step.body()]) as (turn, item):
            self.emit("match", length=F.length(F.col(item)[0]))
            self.remember(name, F.col(item), pattern, self.state.scope)
            if name:
                self.write(f"{name}_count", (F.col(turn) + 1).cast("int"), "int")
            with self.text(self.add("text", F.col(item)[step.get("group") or 1]) if inside else self.state.text):
                if step.body("first"):
                    with self.scope(F.col(turn) == 0):
                        self.run(step.body("first"))
                    with self.scope(F.col(turn) > 0):
                        self.run(step.body())
                else:
                    self.run(step.body())
        return F.size(F.col(rows)) > 0, None

    def do_match_every(self, step: Step):
        return self._every(step, "match-every", False)

    def do_within_every(self, step: Step):
        return self._every(step, "within-every", True)

    def do_for_each(self, step: Step):
        name, element = step.get("for-each"), step.get("as")
        held = self.state.values.get(name)
        if held is None:
            return F.lit(False), None
        if held[1] != "list":
            raise Unsupported(f"{name} isn't surely a list")
        body = [Step("set", {"set": element, "as": element, "to": ""}, "")] if element else []
        with self.loop(F.coalesce(F.col(held[0]), F.array().cast("array<string>")), [*body, *step.body()]) as (turn, item):
            if element:
                self.write(element, F.col(item))
                self.write(f"{element}_count", (F.col(turn) + 1).cast("int"), "int")
            self.run(step.body())
        return F.coalesce(F.size(F.col(held[0])) > 0, F.lit(False)), None

    def do_sequence_of(self, step: Step):
        if "steps" in step.at:
            return self._sequence_steps(step)
        parts = step.bodies.get("parts", [])
        own, shift, joint = [], 1, []
        for part in parts:
            if isinstance(part.get("match"), list):
                raise Unsupported(f"{part.where}: a list of patterns in an alternative")
            flags = flags_of(part.get("flags"))
            pattern = re.compile(part.get("match"), flags)
            own.append((pattern, shift))
            joint.append(f"({regex.local(pattern.pattern, flags, shift)})")
            shift += pattern.groups + 1
        alone = all(regex.context_free(p.pattern) for p, _ in own)
        rows = self.add("hits", self.all_hits(F.col(self.state.text), regex.java_flags(0) + "|".join(joint), shift - 1, alone))
        everything = [s for part in parts for s in [Step("set", {"set": part.get("as"), "as": part.get("as"), "to": ""}, ""), *part.body()] if s.op != "set" or s.get("set")]
        names = set().union(*(writes(s) for s in everything), set())
        carried = {k: set().union(*(reads(s) for s in part.body()), set()) & names - ({part.get("as"), f"{part.get('as')}_count"} if part.get("as") else set()) - {str(s.at["append"]) for s in _inner(part.body()) if s.op == "append"} for k, part in enumerate(parts)}
        carried = {k: {n for n in v if n in exposed(parts[k].body(), names)} for k, v in carried.items()}
        wanted = set().union(*carried.values(), set())
        with self.loop(F.col(rows), everything, carried=True) as (turn, item):
            seq = turn.removeprefix("turn_")
            branch = F.lit(len(parts))
            for k in reversed(range(len(parts))):
                branch = F.when(F.col(item)[own[k][1]] != "", k).otherwise(branch)
            at = self.add("branch", branch)
            self.emit("match", length=F.length(F.col(item)[0]))
            upto = Window.partitionBy(ROW, F.slice("ord", F.lit(1), F.size("ord") - 1)).orderBy(F.element_at("ord", -1)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            for k, part in enumerate(parts):
                if name := part.get("as"):
                    same = [j for j, p in enumerate(parts) if p.get("as") == name]
                    if f"{name}_count" in self.later or any(f"{name}_count" in reads(s) for p in parts for s in p.body()):
                        count = F.sum(F.when(F.col(at).isin(same), 1).otherwise(0)).over(upto)
                        made = self.add("v", F.when(F.col(at).isin(same) | F.lit(f"{name}_count" in wanted), F.when(count > 0, count).cast("int")))
                        self.state = replace(self.state, values={**self.state.values, f"{name}_count": (made, "int")})
            for k, part in enumerate(parts):
                pattern, first = own[k]
                with self.scope(F.col(at) == k):
                    self.remember(part.get("as"), F.slice(F.col(item), F.lit(first + 1), F.lit(pattern.groups + 1)), pattern, self.state.scope)
            writers = [k for k in range(len(parts)) if set().union(*(writes(s) for s in parts[k].body()), set()) & wanted]
            if any(carried[k] - {p.get("as") for p in parts} for k in writers):
                raise Unsupported(f"{step.where}: an alternative reads and writes what is carried")
            matches = {p.get("as") for p in parts} & wanted
            self._carry(upto, {n: None for n in matches}, set())
            for k in [*writers, None, *(k for k in range(len(parts)) if k not in writers)]:
                if k is None:
                    self._carry(upto, {}, wanted - matches)
                    continue
                part = parts[k]
                with self.scope(F.col(at) == k):
                    if part.body():
                        group = part.get("within-group")
                        with self.text(self.add("text", F.col(item)[own[k][1] + group]) if group is not None else self.state.text):
                            self.run(part.body())
        return F.size(F.col(rows)) > 0, None

    def _carry(self, upto: Window, matches: dict[str, None], values: set[str]) -> None:
        """The last value so far of matches and variables that alternatives leave to each other."""
        for name in sorted(matches):
            own = self.state.matches[name]
            made = self.add("m", F.last(F.col(own.column), ignorenulls=True).over(upto))
            self.state = replace(self.state, matches={**self.state.matches, name: replace(own, column=made)})
        for name in sorted(values):
            if name in self.state.values and not name.endswith("_count"):
                column, kind = self.state.values[name]
                made = self.add("v", F.last(F.col(column), ignorenulls=True).over(upto))
                self.state = replace(self.state, values={**self.state.values, name: (made, kind)})

    def _sequence_steps(self, step: Step):
        """Each pattern is looked for in what is left after the one before it."""
        rest, going, first_on = self.add("rest", F.col(self.state.text)), None, None
        scopes = []
        for part in step.bodies.get("parts", []):
            for p in patterns(part, "match"):
                if re.search(r"\^|\(\?<|\\[AbB]", p):
                    raise Unsupported(f"{part.where}: looks behind its place")
            if isinstance(part.get("match"), list):
                raise Unsupported(f"{part.where}: a list of patterns in a sequence")
            flags = flags_of(part.get("flags"))
            pattern = re.compile(part.get("match"), flags)
            java = regex.java_flags(re.S) + "^(.*?)(" + regex.local(pattern.pattern, flags, 2) + ")(.*)$"
            scope = self.scope(F.col(rest).rlike(java))
            scope.__enter__()
            scopes.append(scope)
            first_on = first_on or self.state.on
            groups = self.add("groups", F.array(*(F.regexp_extract(F.col(rest), java, 2 + g) for g in range(pattern.groups + 1))))
            self.emit("match", length=F.length(F.col(groups)[0]))
            self.remember(part.get("as"), F.col(groups), pattern, self.state.scope)
            if part.body():
                group = part.get("within-group")
                with self.text(self.add("text", F.col(groups)[group]) if group is not None else self.state.text):
                    self.run(part.body())
            rest = self.add("rest", F.regexp_extract(F.col(rest), java, 3 + pattern.groups))
        for scope in reversed(scopes):
            scope.__exit__(None, None, None)
        return (F.col(first_on) if first_on else F.lit(False)), None

    def do_match_1(self, step: Step):
        """Rows, and their cells beside those of the first row: two loops, one within the other."""
        flags, group = flags_of(step.get("flags")), step.get("group-1") or 1
        outer, inner = (re.compile(step.get(k), flags) for k in ("match-1", "match-2"))
        rows = self.add("hits", self.hits(F.col(self.state.text), outer, flags))
        head = self.add("hits", self.hits(F.coalesce(F.try_element_at(F.col(rows), F.lit(1))[group], F.lit("")), inner, flags))
        one, two = step.get("as-1"), step.get("as-2")
        names = [step.get(k) for k in ("as-1", "as-2", "header-as", "leading-as") if step.get(k)]
        marks = [Step("set", {"set": n, "as": n, "to": ""}, "") for n in names]
        every = [*step.body("first"), *step.body("leading"), *step.body()]
        with self.loop(F.col(rows), [*marks, *every]) as (turn, item):
            self.remember(one, F.col(item), outer, self.state.scope, False)
            if one:
                self.write(f"{one}_count", (F.col(turn) + 1).cast("int"), "int")
            text = self.add("text", F.col(item)[group])
            cells = self.add("hits", self.hits(F.col(text), inner, flags))
            self.emit("error", F.size(F.col(cells)) > F.size(F.col(head)), message=F.lit("a row is longer than the first"))
            with self.loop(F.col(cells), [*(m for m in marks if m.get("as") != one), *every]) as (at, cell):
                self.remember(two, F.col(cell), inner, self.state.scope)
                self.remember(step.get("header-as"), F.get(F.col(head), F.col(at)), inner, self.state.scope, False)
                self.remember(step.get("leading-as"), F.get(F.col(cells), F.lit(0)), inner, self.state.scope, False)
                if two:
                    self.write(f"{two}_count", (F.col(at) + 1).cast("int"), "int")
                if step.get("leading-as"):
                    self.write(f"{step.get('leading-as')}_count", (F.col(turn) + 1).cast("int"), "int")
                with self.text(text):
                    done = F.lit(False)
                    for body, fits in ((step.body("first"), F.col(turn) == 0), (step.body("leading"), F.col(at) == 0), (step.body(), F.lit(True))):
                        if body:
                            with self.scope(fits & ~done):
                                self.run(body)
                            done = done | fits
        return F.size(F.col(rows)) > 0, None

    def do_break(self, step: Step) -> None:
        if not self.breaks or self.breaks[-1][0] is not self.frame:
            raise Unsupported(f"{step.where}: within a loop of its own")
        self.breaks[-1][1].append(F.lit(True) if self.state.on is None else F.col(self.state.on))

    def do_match_dimensions(self, step: Step):
        if step.body("pre") or any(s.op == "tag-dimension" for s in _inner([x for b in step.bodies.values() for x in b])):
            raise Unsupported(f"{step.where}: pre and tags")
        flags = flags_of(step.get("flags"))
        levels = [re.compile(p, flags) for p in step.get("match-dimensions")]
        names, name = step.get("dimensions") or [], step.get("as")
        bodies = {k: v for k, v in step.bodies.items() if re.fullmatch(r"do(-[^-]+){2,}", k)}
        turns: list[str] = []
        every = [s for b in (*bodies.values(), step.body()) for s in b]
        marks = [Step("set", {"set": n, "to": ""}, "") for n in names] + ([Step("set", {"set": name, "as": name, "to": ""}, "")] if name else [])
        rows = self.add("hits", self.hits(F.col(self.state.text), levels[0], flags))

        def enter(level: int, text: str, hits: str) -> None:
            with self.loop(F.col(hits), [*marks, *every]) as (turn, item):
                turns.append(turn)
                if level + 1 < len(levels):
                    inner = self.add("text", F.col(item)[1])
                    enter(level + 1, inner, self.add("hits", self.hits(F.col(inner), levels[level + 1], flags)))
                    return
                for d, own in enumerate(names):
                    self.write(own, (F.col(turns[d]) + 1).cast("int"), "int")
                if not any(s.op == "break" for s in _inner(every)):
                    cell(item)
                    return
                # what breaks is found first, as if nothing did; then all is done for cells that no cell before them has broken off
                state, count, frames = self.state, len(self.frame.events), len(self.frames)
                self.breaks.append((self.frame, []))
                cell(item)
                flags_ = self.breaks.pop()[1]
                del self.frame.events[count:], self.frames[frames:]
                self.state = state
                stop = flags_[0]
                for flag in flags_[1:]:
                    stop = stop | flag
                stop = F.col(self.add("stop", F.coalesce(stop, F.lit(False)).cast("int")))
                # the turns of the loops around it instead of ord: plain numbers, which each cell takes through the shuffle
                around = [c for c in self.frame.df.columns if c.startswith("turn_") and c != turn]
                before = Window.partitionBy(ROW, *around).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
                with self.scope(F.coalesce(F.max(stop).over(before), F.lit(0)) == 0):
                    self.breaks.append((self.frame, []))
                    cell(item)
                    self.breaks.pop()

        def cell(item: str) -> None:
            self.emit("match", length=F.length(F.col(item)[0]))
            self.remember(name, F.col(item), levels[-1], self.state.scope)
            done = F.lit(False)
            with self.text(self.add("text", F.col(item)[1 if levels[-1].groups else 0])):
                # the most specific body first: exact indices before *, from the first dimension on
                for key in sorted(bodies, key=lambda k: [p == "*" for p in k.split("-")[1:]]):
                    if len(places := key.split("-")[1:]) != len(levels):
                        continue
                    if any(p != "*" and not p.isdigit() for p in places):
                        continue
                    fits = F.lit(True)
                    for d, p in enumerate(places):
                        if p != "*":
                            fits = fits & (F.col(turns[d]) + 1 == int(p))
                    with self.scope(fits & ~done):
                        self.run(bodies[key])
                    done = done | fits
                if step.body():
                    with self.scope(~done):
                        self.run(step.body())

        enter(0, self.state.text, rows)
        return F.size(F.col(rows)) > 0, None

    # mappings

    def do_prefix(self, step: Step) -> None:
        if references(step.get("iri")):
            raise Unsupported("a prefix made at run time")
        self.prefixes[step.get("prefix")] = step.get("iri")

    def do_mapping(self, step: Step) -> None:
        flags, exact, ordered = flags_of(step.get("flags")), {}, []
        for pair in step.get("pairs") or []:
            if "from" in pair:
                exact[str(pair["from"])] = str(pair["to"])
                if flags & re.I:
                    exact[str(pair["from"]).lower()] = str(pair["to"])
            else:
                ordered.append((pair["re"], str(pair["to"])))
        self.mappings[step.get("mapping")] = (exact, ordered, flags)

    def mapped(self, value: Column, name: str) -> Column:
        if name not in self.mappings:
            self.emit("error", message=F.lit(f"there is no mapping {name}"))
            return value
        exact, ordered, flags = self.mappings[name]
        found = []
        if exact:
            plain = {k: v for k, v in exact.items() if "@{" not in v}
            if len(plain) < len(exact):
                raise Unsupported("a mapping to a template")
            table = F.create_map(*(F.lit(x) for pair in plain.items() for x in pair))
            found += [F.try_element_at(table, value)] + ([F.try_element_at(table, F.lower(value))] if flags & re.I else [])
        if ordered:
            case: Any = F
            for pattern, to in ordered:
                case = case.when(value.rlike("^(?:" + regex.translate(pattern, 0, inline=False) + ")") if not regex_flags(pattern) else value.rlike(regex_flags(pattern) + "^(?:" + regex.translate(pattern, 0, inline=False) + ")"), self.template(to))
            found.append(case)
        return F.coalesce(*found, value)

    def do_map(self, step: Step):
        value = F.col(self.add("value", self.mapped(self.template(step.get("map")), step.get("apply"))))
        if step.get("to"):
            self.write(step.get("to"), value)
        return F.lit(True), value

    def do_select(self, step: Step):
        """A query over a graph, whose first row (by its values) is bound, or each of whose rows runs the body.

        The query is the same for all documents; its rows are put beside every scope as one array.
        """
        from weftgraph.operators import graph

        names, targets = selected(step)
        found, spark = self.number(), self.frame.df.sparkSession
        column = f"rows_{found}"
        row = F.struct(*(F.col(n).alias(f"c{k}") for k, n in enumerate(names))).alias("row")

        def held(rows: DataFrame, *by: str) -> DataFrame:
            own = rows.select(*by, row).groupBy(*by)
            if step.body():
                return own.agg(F.array_sort(F.collect_list("row")).alias(column))
            return own.agg(F.min("row").alias("row")).select(*by, F.array_compact(F.array("row")).alias(column))

        if references(step.get("where")) or references(step.get("from")):
            # a query for each text that the template gives, run once for all documents that give it
            asked, where = self.add("asked", self.template(step.get("from"))), self.add("asked", self.template(step.get("where")))
            live = self.frame.df if self.state.on is None else self.frame.df.filter(F.col(self.state.on))
            texts = live.select(asked, where).distinct().limit(QUERIES + 1).collect()
            if len(texts) > QUERIES:
                raise WorkflowError(f"{step.where}: documents make more than {QUERIES} different queries")
            nothing = F.slice(F.array(F.struct(*(F.lit("").alias(f"c{k}") for k in range(len(names))))), 1, 0)
            rows = None
            for a, w in texts:
                part = graph.ask(spark, a, w, self.graphs, step.get("username"), step.get("password")).select(F.lit(a).alias(asked), F.lit(w).alias(where), *names)
                rows = part if rows is None else rows.unionByName(part)
            if rows is None:
                self.frame.df = self.frame.df.withColumn(column, nothing)
            else:
                self.frame.df = self.frame.df.join(held(rows, asked, where), [asked, where], "left").withColumn(column, F.coalesce(column, nothing))
        else:
            rows = graph.ask(spark, step.get("from"), step.get("where"), self.graphs, step.get("username"), step.get("password")).select(*names)
            if step.body():
                size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(n), F.lit(0)) for n in names), F.lit(16)))).first()[0] or 0
                if size > SELECT_MB * 1e6:
                    raise WorkflowError(f"{step.where}: {size / 1e6:.0f} MB of rows are too many to put beside every document")
            self.frame.df = self.frame.df.join(F.broadcast(held(rows)), F.lit(True))
        some = F.size(F.col(column)) > 0
        if step.body():
            marks = [Step("set", {"set": t, "to": ""}, "") for t in targets]
            with self.loop(F.col(column), [*marks, *step.body()]) as (_, item):
                for k, target in enumerate(targets):
                    self.write(target, F.col(item)[f"c{k}"])
                self.run(step.body())
            value = None
        else:
            with self.scope(some):
                for k, target in enumerate(targets):
                    self.write(target, F.try_element_at(F.col(column), F.lit(1))[f"c{k}"])
            value = F.col(self.state.values[targets[0]][0])
        ok: Column = some
        if step.body("else"):
            with self.scope(~some):
                on = self.state.on
                other, _ = self.run(step.body("else"))
            ok = some | (F.col(on) & other)
        return ok, value

    # triples

    def node(self, text: Any) -> Column:
        if not isinstance(text, str):
            raise Unsupported(f"{text!r} isn't a node")
        fixed = REFERENCE.split(text, maxsplit=1)[0]
        if fixed.startswith(("http://", "https://")):
            return terms.c_term("iri", self.template(text))
        if m := re.match(r"(\w[\w-]*):", fixed):
            if m[1] not in self.prefixes:
                raise Unsupported(f"there is no prefix {m[1]}")
            whole = self.template(text)
            member = F.regexp_extract(whole, r"(?U)^[\w-]+:([\w-]+)", 1)
            return terms.c_term("iri", F.when(member != "", F.concat(F.lit(self.prefixes[m[1]]), member)).otherwise(whole))
        return self.dynamic_node(self.template(text))

    def dynamic_node(self, whole: Column) -> Column:
        whole = F.col(self.add("node", whole))
        prefix, member = (F.regexp_extract(whole, r"(?U)^(\w[\w-]*):([\w-]+)", k) for k in (1, 2))
        plain = whole.rlike("^https?://") | (prefix == "")
        if self.prefixes:
            table = F.create_map(*(F.lit(x) for pair in self.prefixes.items() for x in pair))
            base = F.try_element_at(table, prefix)
        else:
            base = F.lit(None).cast("string")
        self.emit("error", ~plain & base.isNull(), message=F.concat(F.lit("there is no prefix "), prefix))
        return terms.c_term("iri", F.when(plain, whole).otherwise(F.concat(base, member)))

    def value(self, at: Any, where: str) -> Column:
        if isinstance(at, list):
            ok, value = self.do_any_of(Step("any-of", {}, where, {"any-of": parse_steps(at, where)}))
            self.emit("error", ~ok, message=F.lit(f"{where}: no step gives an object"))
            return terms.c_infer(value if value is not None else F.lit("None"))
        if not isinstance(at, dict):
            return terms.c_infer(F.col(self.add("object", self.template(at))))
        kind = next(k for k in ("text", "iri", "integer", "float", "bool", "date", "datetime") if k in at)
        if kind == "iri":
            return self.node(at[kind])
        text = self.template(at[kind])
        if kind == "text":
            if not at.get("apply"):
                return terms.c_term("literal", text, None, at.get("lang"))
            text = F.col(self.add("object", self.mapped(text, at["apply"])))
            prefix, member = (F.regexp_extract(text, r"(?U)^(\w[\w-]*):([\w-]+)", k) for k in (1, 2))
            table = F.create_map(*(F.lit(x) for pair in self.prefixes.items() for x in pair)) if self.prefixes else None
            base = F.try_element_at(table, prefix) if table is not None else F.lit(None).cast("string")
            return F.when(base.isNotNull(), terms.c_term("iri", F.concat(base, member))).otherwise(terms.c_term("literal", text, None, at.get("lang")))
        bare = F.col(self.add("object", terms.c_strip(text)))
        if kind == "integer":
            self.emit("error", ~bare.rlike(terms.INTEGER), message=F.concat(bare, F.lit(" isn't an integer")))
            return terms.c_term("literal", terms.c_integer(bare), "integer")
        if kind == "float":
            good = bare.rlike(terms.FLOAT) | (bare == "")
            self.emit("error", ~good, message=F.concat(bare, F.lit(" isn't a number")))
            return terms.c_term("literal", F.when(bare == "", "NaN").otherwise(terms.c_float(bare)), "float")
        if kind == "bool":
            return terms.c_term("literal", F.when(F.lower(bare).isin(*terms.FALSE), "false").otherwise("true"), "boolean")
        return self.time(kind, bare, at)

    def time(self, kind: str, bare: Column, at: dict) -> Column:
        form = at.get("format")
        if form:
            java = "".join(_STRPTIME.get(p[1:], None) or _missing(p) if p.startswith("%") else f"'{p}'" if re.search("[A-Za-z]", p) else p for p in re.findall(r"%.|[^%]+", form))
        if kind == "date":
            value = F.try_to_date(bare, java) if form else F.when(bare.rlike(r"^\d{4}-\d{2}-\d{2}$"), bare.try_cast("date")).when(bare.rlike(r"^\d{8}$"), F.try_to_date(bare, "yyyyMMdd"))
            value = F.when(bare == "today", F.lit(datetime.date.today())).otherwise(value)
            text, datatype = F.date_format(value, "yyyy-MM-dd"), "date"
        else:
            iso = bare.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?)?$")
            value = F.try_to_timestamp(bare, F.lit(java)) if form else F.when(iso, bare.try_cast("timestamp_ntz"))
            value = F.when(bare == "now", F.lit(datetime.datetime.now())).otherwise(value)
            micros = F.date_format(value, "SSSSSS")
            text, datatype = F.concat(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros != "000000", F.concat(F.lit("."), micros)).otherwise("")), "dateTime"
        self.emit("error", value.isNull(), message=F.concat(bare, F.lit(f" isn't a {kind}")))
        return terms.c_term("literal", text, datatype)

    def triple(self, step: Step) -> tuple[Column, None]:
        self._triples(step.at, None, None, None, step.where)
        return F.lit(True), None

    def _triples(self, at: Any, subject: Any, predicate: Any, inverse: Any, where: str) -> None:
        if not isinstance(at, dict) or not any(w in at for w in (*TRIPLE, "objects", "predicates")):
            at = {"object": at}
        subject, predicate, inverse = at.get("subject", subject), at.get("predicate", predicate), at.get("inverse", inverse)
        for part in at.get("predicates") or []:
            self._triples(part, subject, None, None, where)
        for part in at.get("objects") or []:
            self._triples(part, subject, predicate, inverse, where)
        if at.get("object"):
            s, p = self.node(subject), self.node(predicate)
            o = F.col(self.add("term", self.value(at["object"], where)))
            self.emit("triple", s=s, p=p, o=o, inverse=F.lit(False))
            if inverse:
                self.emit("triple", o["kind"] != "literal", s=o, p=self.node(inverse), o=s, inverse=F.lit(True))
                self.emit("log", o["kind"] == "literal", level=F.lit("WARN"), message=F.lit("a literal has no inverse"))


def selected(step: Step) -> tuple[list[str], list[str]]:
    """Names that a select step takes from the result, and the variables they go to; both are lists or parted by blanks."""
    names = step.get("select") if isinstance(step.get("select"), list) else str(step.get("select")).split()
    targets = step.get("as") or names
    targets = targets if isinstance(targets, list) else str(targets).split()
    if len(targets) != len(names):
        raise WorkflowError(f"{step.where}: as many names as variables are needed")
    return [n.lstrip("?") for n in names], [t.lstrip("?") for t in targets]


def regex_flags(pattern: str) -> str:
    """Inline flags of a mapping's pattern."""
    return regex.java_flags(re.compile(pattern).flags & (re.I | re.M | re.X | re.S))


def _missing(part: str) -> str:
    raise Unsupported(f"{part} in a date format")


def _inner(steps: list[Step]) -> list[Step]:
    return [x for s in steps for x in (s, *(y for b in s.bodies.values() for y in _inner(b)))]


def _unescape(column: Column) -> Column:
    """HTML entities as characters; Spark has no function for it."""

    @F.pandas_udf("string")
    def unescape(texts):
        import html

        return texts.map(lambda t: html.unescape(t) if t is not None else None)

    return F.when(F.contains(column, F.lit("&")), unescape(column)).otherwise(column)



def events(compiler: Compiler, kind: str, columns: dict[str, str]) -> DataFrame | None:
    """row, doc_id, ord and the given columns (name: type) of all events of a kind, one pass for each frame."""
    result = None
    for frame in compiler.frames:
        own = [e for e in frame.events if e["kind"] == kind]
        if not own:
            continue

        def row(e: dict) -> list[Column]:
            return [F.concat("ord", F.array(F.lit(e["seq"]))).alias("ord"), *(e.get(n, F.lit(None)).cast(t).alias(n) for n, t in columns.items())]

        if len(own) == 1:
            part = frame.df.filter(own[0]["guard"]).select(ROW, KEY, *row(own[0]))
        else:
            rows = F.array(*(F.when(e["guard"], F.struct(*row(e))) for e in own))
            part = frame.df.select(ROW, KEY, F.explode(F.array_compact(rows)).alias("e")).select(ROW, KEY, "e.*")
        result = part if result is None else result.unionByName(part)
    return result


def tally(compiler: Compiler) -> DataFrame:
    """row, doc_id, no_triples, no_matches, total_match_len, score, failed of each input row.

    All kinds of events are counted in one pass for each frame and one shuffle; nothing is exploded for it.
    """
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    result = compiler.base.select(ROW, KEY, zero.alias("no_triples"), zero.alias("no_matches"), zero.alias("total_match_len"), none.alias("score"), F.lit(False).alias("failed"))
    for frame in compiler.frames:
        if not any(e["kind"] in ("triple", "match", "error") for e in frame.events):
            continue

        def total(kind: str, value: Callable[[dict], Column], start: Column) -> Column:
            out = start
            for e in frame.events:
                if e["kind"] == kind:
                    out = out + F.when(e["guard"], value(e)).otherwise(start)
            return out

        one = F.lit(1).cast("long")
        failed = F.lit(False)
        for e in frame.events:
            if e["kind"] == "error":
                failed = failed | e["guard"]
        part = frame.df.select(
            ROW, KEY, total("triple", lambda e: one, zero).alias("no_triples"), total("match", lambda e: one, zero).alias("no_matches"),
            total("match", lambda e: F.coalesce(e["length"], F.lit(0)).cast("long"), zero).alias("total_match_len"),
            total("match", lambda e: 1 - 1 / F.greatest(F.lit(1), e["length"]), none).alias("score"), failed.alias("failed"),
        )
        result = result.unionByName(part)
    sums = [F.sum(c).alias(c) for c in ("no_triples", "no_matches", "total_match_len", "score")]
    return result.groupBy(ROW).agg(F.first(KEY).alias(KEY), *sums, F.max("failed").alias("failed"))
