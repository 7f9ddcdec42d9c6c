"""Workflows: YAML text to validated steps.

A step is a mapping; its operation is the first keyword of KEYWORDS, in that order, that it has. Whatever can be wrong
with a workflow without looking at a document is found here, on the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import yaml

KEYWORDS = tuple(
    "pass any-of set clear append for-each exec if ifdef ifndef save-as procedure call replace match match-every within within-every with"
    " sequence-of match-1 match-dimensions tag-dimension break prefix mapping map select subject predicate object echo desc dump".split()
)
FLAGS = {"I": re.I, "IGNORECASE": re.I, "L": re.L, "LOCALE": re.L, "A": re.A, "ASCII": re.A, "M": re.M, "MULTILINE": re.M, "S": re.S, "DOTALL": re.S, "X": re.X, "VERBOSE": re.X}
TRIPLE = ("subject", "predicate", "object")
#: Attributes whose value is a list of steps.
_BODIES = ("do", "first", "leading", "else", "pre")
_NEEDS = {"match-every": "do", "within": "do", "within-every": "do", "with": "do", "for-each": "do", "if": "do", "ifdef": "do", "ifndef": "do", "procedure": "do", "prefix": "iri", "mapping": "pairs", "map": "apply", "replace": "with", "append": "element", "tag-dimension": "at"}


class WorkflowError(ValueError):
    """A workflow that can't run, whatever the document."""


@dataclass
class Step:
    """One step: its operation, attributes (bodies as lists of steps), and place in the workflow."""

    op: str
    at: dict[str, Any]
    where: str
    bodies: dict[str, list[Step]] = field(default_factory=dict)

    def get(self, name: str, default: Any = None) -> Any:
        return self.at.get(name, default)

    def body(self, name: str = "do") -> list[Step]:
        return self.bodies.get(name, [])


def flags_of(names: Any) -> int:
    """DOTALL and the flags that are named, by letter or in full, in a list or one string."""
    found = re.S
    for name in [names] if isinstance(names, str) else names or []:
        for one in re.split(r"[\s,|]+", str(name).strip()):
            if one.upper().removeprefix("RE.") not in FLAGS:
                raise WorkflowError(f"there is no flag {one!r}")
            found |= FLAGS[one.upper().removeprefix("RE.")]
    return found


def check_pattern(pattern: Any, flags: int, where: str) -> re.Pattern:
    if not isinstance(pattern, str):
        raise WorkflowError(f"{where}: a pattern must be a string, not {pattern!r}")
    try:
        return re.compile(pattern, flags)
    except (re.error, ValueError) as e:
        raise WorkflowError(f"{where}: bad pattern {pattern!r}: {e}") from e


def patterns(step: Step, name: str) -> list[str]:
    """The pattern or list of patterns of an attribute."""
    value = step.get(name)
    return value if isinstance(value, list) else [value]


def op_of(step: dict, where: str) -> str:
    for word in KEYWORDS:
        if word in step:
            return word
    raise WorkflowError(f"{where}: no operation among {', '.join(map(str, step))}")


def parse_steps(items: Any, where: str) -> list[Step]:
    if not isinstance(items, list) or not items:
        raise WorkflowError(f"{where}: a list of steps is needed")
    return [parse_step(item, f"{where}/{k + 1}") for k, item in enumerate(items)]


def parse_step(item: Any, where: str) -> Step:
    if not isinstance(item, dict):
        raise WorkflowError(f"{where}: a step must be a mapping, not {item!r}")
    op = op_of(item, where)
    where = f"{where} {op}"
    step = Step(op, item, where)
    if op in _NEEDS and _NEEDS[op] not in item:
        raise WorkflowError(f"{where}: {_NEEDS[op]} is missing")
    for name in item:
        if (name in _BODIES or re.match(r"do-", str(name))) and item[name] is not None and op not in TRIPLE:
            step.bodies[name] = parse_steps(item[name], f"{where} {name}")
    if op == "any-of":
        step.bodies["any-of"] = parse_steps(item[op], where)
    if op == "set" and ("to" in item) == ("eval" in item):
        raise WorkflowError(f"{where}: exactly one of to and eval is needed")
    if op in ("match", "match-every", "within", "within-every"):
        if op in ("match-every", "within-every") and not isinstance(item[op], str):
            raise WorkflowError(f"{where}: one pattern is needed")
        for p in patterns(step, op):
            check_pattern(p, flags_of(item.get("flags")), where)
    if op == "replace":
        check_pattern(item[op], re.S, where)
    if op == "sequence-of":
        own = [k for k in ("alternatives", "steps") if k in item]
        if len(own) != 1:
            raise WorkflowError(f"{where}: either alternatives or steps are needed")
        for k, part in enumerate(item[own[0]] or []):
            inner = Step("match", part, f"{where} {own[0]}/{k + 1}")
            for p in patterns(inner, "match"):
                if width(p, flags_of(part.get("flags"))) == 0 and own[0] == "alternatives":
                    raise WorkflowError(f"{inner.where}: a pattern that matches nothing would never end")
                check_pattern(p, flags_of(part.get("flags")), inner.where)
            if part.get("do") is not None:
                inner.bodies["do"] = parse_steps(part["do"], inner.where)
            step.bodies.setdefault("parts", []).append(inner)
    if op == "match-dimensions":
        if not isinstance(item[op], list) or not item[op]:
            raise WorkflowError(f"{where}: a list of patterns is needed")
        for p in item[op]:
            check_pattern(p, flags_of(item.get("flags")), where)
        if "dimensions" in item and len(item["dimensions"]) != len(item[op]):
            raise WorkflowError(f"{where}: as many dimensions as patterns are needed")
        if "pre" in item and "dimensions" not in item:
            raise WorkflowError(f"{where}: pre needs dimensions")
    if op == "mapping":
        for pair in item["pairs"] or []:
            if "to" not in pair or ("from" in pair) == ("re" in pair):
                raise WorkflowError(f"{where}: a pair has to, and either from or re")
    if op in TRIPLE:
        check_triple(item, where, False, False)
    if op == "save-as" and not (isinstance(item[op], str) or isinstance(item[op], dict) and item[op].get("file")):
        raise WorkflowError(f"{where}: file is missing")
    return step


def check_triple(item: dict, where: str, subject: bool, predicate: bool) -> None:
    """Rules of nested triples: what is implied from outside, what must be there."""
    if "subject" in item and subject:
        raise WorkflowError(f"{where}: the subject is given already")
    if "predicate" in item and predicate:
        raise WorkflowError(f"{where}: the predicate is given already")
    subject, has = subject or "subject" in item, predicate or "predicate" in item
    if not subject:
        raise WorkflowError(f"{where}: the subject is missing")
    nested = [k for k in ("predicates", "objects") if k in item]
    if len(nested) + ("object" in item) != 1:
        raise WorkflowError(f"{where}: exactly one of object, objects and predicates is needed")
    if "predicates" not in item and not has:
        raise WorkflowError(f"{where}: the predicate is missing")
    if "inverse" in item and not has:
        raise WorkflowError(f"{where}: inverse needs a predicate")
    if "predicates" in item and has:
        raise WorkflowError(f"{where}: predicates within a predicate")
    for name in nested:
        for k, part in enumerate(item[name] or []):
            check_triple(part if isinstance(part, dict) and any(w in part for w in (*TRIPLE, "objects")) else {"object": part}, f"{where} {name}/{k + 1}", True, name == "objects")
    value = item.get("object")
    if isinstance(value, dict):
        own = [k for k in VALUES if k in value]
        if len(own) != 1 and not (set(own) == {"text", "apply"}):
            raise WorkflowError(f"{where}: an object has exactly one of {', '.join(VALUES)}")
        if any(not isinstance(value[k], str) for k in own):
            raise WorkflowError(f"{where}: a value must be a string")
    if isinstance(value, list):
        parse_steps(value, f"{where} object")


VALUES = ("text", "iri", "integer", "float", "bool", "date", "datetime")


def width(pattern: str, flags: int) -> int:
    """Length of the shortest text that the pattern matches."""
    from re import _parser

    return _parser.parse(pattern, flags).getwidth()[0]


@dataclass
class Workflow:
    """A named, validated workflow."""

    name: str
    steps: list[Step]

    def walk(self):
        """Every step, outside in."""
        todo = list(self.steps)
        while todo:
            step = todo.pop(0)
            yield step
            for body in step.bodies.values():
                todo += body


def parse(source: str | list, name: str = "workflow") -> Workflow:
    """A workflow from YAML text or a list of mappings."""
    items = yaml.safe_load(source) if isinstance(source, str) else source
    return Workflow(name, parse_steps(items, name))
