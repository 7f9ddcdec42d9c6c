"""A safe subset of Python expressions, evaluated in Python or compiled to a column.

Literals, arithmetic, comparisons, and/or/not, in, len, int, float, str, the string methods strip, lower, upper,
startswith, endswith and replace, variables by name or as vars['name'].
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions import terms


class Unsupported(ValueError):
    """What columns can't express."""


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}
_COMPARE = {ast.Eq: operator.eq, ast.NotEq: operator.ne, ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge, ast.In: lambda a, b: a in b, ast.NotIn: lambda a, b: a not in b, ast.Is: operator.is_, ast.IsNot: operator.is_not}
_METHODS = ("strip", "lower", "upper", "startswith", "endswith", "replace", "split", "group")
_FUNCTIONS = {"len": len, "int": int, "float": float, "str": str}


def evaluate(source: str, names: dict[str, Any]) -> Any:
    """The value of an expression; names that aren't known are errors."""

    def go(node: ast.AST) -> Any:
        if isinstance(node, ast.Expression):
            return go(node.body)
        if isinstance(node, ast.Constant):
            return node.value
        if isinstance(node, ast.Name):
            return names[node.id]
        if isinstance(node, (ast.List, ast.Tuple)):
            return [go(x) for x in node.elts]
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](go(node.left), go(node.right))
        if isinstance(node, ast.UnaryOp):
            value = go(node.operand)
            return not value if isinstance(node.op, ast.Not) else -value if isinstance(node.op, ast.USub) else +value
        if isinstance(node, ast.BoolOp):
            value = None
            for part in node.values:
                value = go(part)
                if bool(value) == isinstance(node.op, ast.Or):
                    break
            return value
        if isinstance(node, ast.Compare):
            left = go(node.left)
            for op, part in zip(node.ops, node.comparators):
                right = go(part)
                if not _COMPARE[type(op)](left, right):
                    return False
                left = right
            return True
        if isinstance(node, ast.IfExp):
            return go(node.body) if go(node.test) else go(node.orelse)
        if isinstance(node, ast.Subscript):
            return go(node.value)[go(node.slice)]
        if isinstance(node, ast.Call) and not node.keywords:
            args = [go(a) for a in node.args]
            if isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS:
                return _FUNCTIONS[node.func.id](*args)
            if isinstance(node.func, ast.Attribute) and node.func.attr in _METHODS:
                return getattr(go(node.func.value), node.func.attr)(*args)
        raise Unsupported(f"{ast.unparse(node)} isn't allowed in an expression")

    return go(ast.parse(source.strip(), mode="eval"))


Typed = tuple[str, Column]


def text_of(value: Typed) -> Column:
    """What str() gives."""
    kind, column = value
    if kind == "bool":
        return F.when(column, "True").otherwise("False")
    if kind == "float":
        return terms.c_float(column.cast("string"))
    return column.cast("string")


def truth(value: Typed) -> Column:
    kind, column = value
    if kind == "bool":
        return column
    if kind == "str":
        return F.coalesce(column != "", F.lit(False))
    if kind == "dynamic":
        return F.when(column.isin("True", "False", "None"), column == "True").otherwise(column.try_cast("double") != 0)
    return column != 0


def column(source: str, reference: Callable[[str], Column], variable: Callable[[str], Column]) -> Typed:
    """(type, column) of an expression in which references of the form ``@{...}`` are templates."""
    from weftgraph.plans.machine import REFERENCE

    held: list[Column] = []

    def keep(m) -> str:
        held.append(reference(m[0]))
        return f"__ref{len(held) - 1}__"

    marked = REFERENCE.sub(keep, source)
    if "@{" in marked:
        raise Unsupported(f"nested references in {source!r}")

    def number(value: Typed) -> Column:
        return value[1].try_cast("double") if value[0] in ("dynamic", "str") else value[1]

    def go(node: ast.AST) -> Typed:
        if isinstance(node, ast.Expression):
            return go(node.body)
        if isinstance(node, ast.Constant):
            v = node.value
            if isinstance(v, bool):
                return "bool", F.lit(v)
            if isinstance(v, int):
                return "int", F.lit(v).cast("long")
            if isinstance(v, float):
                return "float", F.lit(v)
            if isinstance(v, str):
                import re

                parts = re.split(r"__ref(\d+)__", v)
                columns = [held[int(p)] if k % 2 else F.lit(p) for k, p in enumerate(parts) if k % 2 or p]
                return "str", F.concat(*columns) if len(columns) > 1 else columns[0] if columns else F.lit("")
        if isinstance(node, ast.Name):
            if node.id.startswith("__ref"):
                return "dynamic", held[int(node.id[5:-2])]
            return "str", variable(node.id)
        if isinstance(node, ast.Subscript) and isinstance(node.value, ast.Name) and node.value.id == "vars" and isinstance(node.slice, ast.Constant):
            return "str", variable(node.slice.value)
        if isinstance(node, ast.BoolOp):
            parts = [truth(go(p)) for p in node.values]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if isinstance(node.op, ast.And) else joined | p
            return "bool", joined
        if isinstance(node, ast.UnaryOp):
            value = go(node.operand)
            if isinstance(node.op, ast.Not):
                return "bool", ~truth(value)
            return ("int" if value[0] == "int" else "float"), -number(value) if isinstance(node.op, ast.USub) else number(value)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            a, b = go(node.left), go(node.right)
            if a[0] == b[0] == "str" and isinstance(node.op, ast.Add):
                return "str", F.concat(a[1], b[1])
            if "str" in (a[0], b[0]):
                raise Unsupported(f"{ast.unparse(node)} mixes text and numbers")
            whole = a[0] == b[0] == "int" and not isinstance(node.op, ast.Div)
            x, y = number(a), number(b)
            if isinstance(node.op, ast.Mod):
                value = ((x % y) + y) % y
            elif isinstance(node.op, ast.FloorDiv):
                value = F.floor(x / y)
            else:
                value = _BINARY[type(node.op)](x, y)
            return ("int", value.cast("long")) if whole else ("float", value)
        if isinstance(node, ast.Compare) and len(node.ops) == 1:
            a, op = go(node.left), node.ops[0]
            if isinstance(op, (ast.In, ast.NotIn)):
                if isinstance(node.comparators[0], (ast.List, ast.Tuple)):
                    found = F.lit(False)
                    for element in node.comparators[0].elts:
                        b = go(element)
                        found = found | (a[1] == b[1] if a[0] == b[0] == "str" else number(a) == number(b))
                else:
                    found = F.contains(go(node.comparators[0])[1], a[1])
                return "bool", found if isinstance(op, ast.In) else ~found
            b = go(node.comparators[0])
            if type(op) not in _COMPARE or isinstance(op, (ast.Is, ast.IsNot)) or (a[0] == "str") != (b[0] == "str"):
                raise Unsupported(f"{ast.unparse(node)} has no column")
            return "bool", _COMPARE[type(op)](a[1], b[1]) if a[0] == "str" else _COMPARE[type(op)](number(a), number(b))
        if isinstance(node, ast.Call) and not node.keywords:
            if isinstance(node.func, ast.Name) and node.func.id in _FUNCTIONS and len(node.args) == 1:
                value = go(node.args[0])
                if node.func.id == "len" and value[0] == "str":
                    return "int", F.length(value[1]).cast("long")
                if node.func.id == "int":
                    return "int", terms.c_integer(terms.c_strip(text_of(value))).try_cast("long") if value[0] in ("str", "dynamic") else number(value).cast("long")
                if node.func.id == "float":
                    return "float", number(value).cast("double")
                if node.func.id == "str":
                    return "str", text_of(value)
            if isinstance(node.func, ast.Attribute):
                own, args = go(node.func.value), [go(a) for a in node.args]
                name = node.func.attr
                if own[0] == "str" and not args and name in ("strip", "lower", "upper"):
                    return "str", {"strip": terms.c_strip, "lower": F.lower, "upper": F.upper}[name](own[1])
                if own[0] == "str" and name in ("startswith", "endswith") and len(args) == 1:
                    return "bool", getattr(F, name)(own[1], args[0][1])
                if own[0] == "str" and name == "replace" and len(args) == 2:
                    return "str", F.replace(own[1], args[0][1], args[1][1])
        raise Unsupported(f"{ast.unparse(node)} has no column")

    try:
        return go(ast.parse(marked.strip(), mode="eval"))
    except SyntaxError as e:
        raise Unsupported(f"{source!r} isn't an expression until it is expanded") from e
