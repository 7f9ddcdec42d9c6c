"""A SPARQL subset over triple tables, compiled to joins.

Basic graph patterns (with ``;``, ``,``, ``a``, inverse ``^p`` and paths ``p+``, ``p*``), FILTER, [NOT] EXISTS, OPTIONAL,
UNION, MINUS, BIND, VALUES, DISTINCT, GROUP BY with aggregates, HAVING, ORDER BY, LIMIT and OFFSET. Terms are bound in
N-Triples form, so that joins are plain equi-joins of strings; patterns of one subject are joined first, those with
constants before others, so that subjects meet once filters have thinned them out. A graph that is looked into more
than once is made once, in the shared folder. With a ``by`` column each document's graph is queried by
itself.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.terms import XSD, c_ntriples
from weftgraph.session import drop, kept, spread
from weftgraph.sources import endpoints
from weftgraph.sources.readers import ntriples, turtle, unescaped

_TOKEN = re.compile(
    r"""(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>\s]*>)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<lang>@[A-Za-z-]+)|(?P<var>[?$]\w+)
    |(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][\w-]*:[\w-]*|:[\w-]*)|(?P<word>[A-Za-z_]\w*)|(?P<sign>\^\^|&&|\|\||!=|<=|>=|[{}().;,*+/^=<>!|-])""",
    re.X,
)
#: Nodes that are broadcast.
FEW = 500_000
_AGGREGATES = {"count", "sum", "avg", "min", "max", "sample", "group_concat"}


class QueryError(ValueError):
    """A query outside the subset."""


def lex(term: Column) -> Column:
    """The text of a bound term."""
    inner = F.substring(term, F.lit(2), F.length(term) - 2)
    literal = unescaped(F.regexp_extract(term, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1))
    plain = term.startswith('"') & term.endswith('"') & ~F.contains(term, F.lit("\\")) & (F.length(term) > 1)
    return F.when(plain | term.startswith("<"), inner).when(term.startswith('"'), literal).otherwise(term)


def _number(value: tuple[str, Column]) -> Column:
    return value[1] if value[0] == "num" else (lex(value[1]) if value[0] == "term" else value[1]).try_cast("double")


def _text(value: tuple[str, Column]) -> Column:
    return lex(value[1]) if value[0] == "term" else value[1].cast("string")


class _Query:
    def __init__(self, text: str, triples: DataFrame, by: str | None):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0
        self.prefixes = {"xsd": XSD, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
        self.by = [by] if by else []
        self.spark = triples.sparkSession
        self.triples = spread(triples.select(*self.by, *(c_ntriples(F.col(c)).alias(c) for c in ("s", "p", "o"))), *self.by, "s", "o").distinct()
        if sum(t[1] in (".", ";", ",", "/", "{", "+", "*") for t in self.tokens) > 1:
            self.triples = kept(self.triples)
        self.fresh = 0

    # reading

    def peek(self, *words: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][1].lower() in words

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += 1
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            raise QueryError(f"{word} is missing before {' '.join(t for _, t in self.tokens[self.at : self.at + 3])!r}")

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise QueryError("the query ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def term(self) -> str:
        """A variable (?x) or a constant in N-Triples."""
        kind, text = self.next()
        if kind == "var":
            return "?" + text[1:]
        if kind == "iri":
            return text
        if kind == "name":
            prefix, _, member = text.partition(":")
            if prefix not in self.prefixes:
                raise QueryError(f"there is no prefix {prefix}")
            return f"<{self.prefixes[prefix]}{member}>"
        if kind == "word" and text == "a":
            return f"<{self.prefixes['rdf']}type>"
        if kind == "word" and text in ("true", "false"):
            return f'"{text}"^^<{XSD}boolean>'
        if kind == "number":
            return f'"{text}"^^<{XSD}{"integer" if text.isdigit() else "float"}>'
        if kind == "string":
            body = '"' + text[1:-1].replace('"', '\\"' if text[0] == "'" else '"') + '"'
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "lang":
                return body + self.next()[1]
            return body + "^^" + self.term() if self.take("^^") else body
        raise QueryError(f"unexpected {text!r}")

    # patterns

    def pattern(self, s: str, path: tuple[str, str], o: str) -> DataFrame:
        """Bindings of one triple pattern."""
        p, mark = path
        if mark == "^":
            s, o = o, s
        if p.startswith("?"):
            rows = self.triples
        else:
            rows = self.triples.filter(F.col("p") == p)
        if mark in ("+", "*"):
            edges = rows.select(*self.by, "s", "o")
            if s.startswith("?") and o.startswith("?"):
                rows = self.closure(edges, mark == "*")
            else:
                rows = self.reached(edges, o if s.startswith("?") else s, not s.startswith("?"), mark == "*")
            rows = rows.withColumn("p", F.lit(p))
        columns, seen = [], {}
        for name, value in (("s", s), ("p", p), ("o", o)):
            if value.startswith("?"):
                if value in seen:
                    rows = rows.filter(F.col(name) == F.col(seen[value]))
                else:
                    seen[value] = name
                    columns.append(F.col(name).alias(value[1:]))
            elif name != "p":
                rows = rows.filter(F.col(name) == value)
        return rows.select(*self.by, *columns)

    def closure(self, edges: DataFrame, reflexive: bool) -> DataFrame:
        """All pairs that a path joins, by doubling the length of the paths.

        Where no node has two edges on (or none has two edges in), a node's path is one array, and arrays are put
        together; otherwise there is a row for each pair.
        """
        pairs = self.chained(edges, "s", "o")
        if pairs is None:
            pairs = self.chained(edges, "o", "s")
        if pairs is None:
            pairs = self.doubled(edges)
        if reflexive:
            own = spread(self.triples.select(*self.by, F.explode(F.array("s", "o")).alias("s")), *self.by, "s").distinct()
            pairs = spread(pairs.unionByName(own.withColumn("o", F.col("s"))), *self.by, "s", "o").distinct()
        return pairs

    def chained(self, edges: DataFrame, here: str, there: str) -> DataFrame | None:
        """Pairs of a graph in which each node has one edge on at most; None for other graphs.

        Each round puts the path of a path's last node behind it. It is done where that node has none, or one that is
        done, or where a node comes again. Few last nodes are broadcast, so that paths that run together stay in place.
        """
        rows = spread(edges.select(*self.by, F.col(here).alias("node"), F.col(there).alias("next")), *self.by, "node").groupBy(*self.by, "node").agg(F.min("next").alias("next"), F.max("next").alias("other"))
        rows = kept(rows)
        if not rows.filter("next <> other").isEmpty():
            drop(rows)
            return None
        first, rows = rows, kept(rows.select(*self.by, "node", F.array("next").alias("path"), (F.col("next") == F.col("node")).alias("done")))
        drop(first)
        while not rows.filter("not done").isEmpty():
            left = rows.withColumn("last", F.when(~F.col("done"), F.element_at("path", -1)))
            ends = kept(spread(left.filter("not done").select(*self.by, "last"), *self.by, "last").distinct())
            right = rows.select(*self.by, F.col("node").alias("last"), F.col("path").alias("more"), F.col("done").alias("ended"))
            found = None
            if ends.count() <= FEW:
                found = right = kept(right.join(F.broadcast(ends), [*self.by, "last"], "left_semi"))
                if (right.agg(F.sum(F.size("more"))).first()[0] or 0) <= FEW:
                    right = F.broadcast(right)
            longer = F.array_distinct(F.concat("path", "more"))
            step = left.filter("not done").join(right, [*self.by, "last"], "left").withColumn("longer", longer)
            over = F.col("more").isNull() | F.col("ended") | (F.size("longer") < F.size("path") + F.size("more"))
            step = step.select(*self.by, "node", F.coalesce("longer", "path").alias("path"), over.alias("done"))
            new = kept(rows.filter("done").unionByName(step))
            for x in (rows, ends, found):
                if x is not None:
                    drop(x)
            rows = new
        return rows.select(*self.by, F.col("node").alias(here), F.explode("path").alias(there))

    def doubled(self, edges: DataFrame) -> DataFrame:
        """Pairs of any graph, with the length of a shortest path.

        One of up to twice the length so far is one of just that length and one that is known: a pair is found by one
        path for each node in its middle, not for each cut.
        """
        pairs, reach = kept(spread(edges.select(*self.by, "s", "o"), *self.by, "s", "o").distinct().withColumn("far", F.lit(1))), 1
        while not pairs.filter(F.col("far") == reach).isEmpty():
            half = pairs.filter(F.col("far") == reach).select(*self.by, "s", F.col("o").alias("mid"))
            step = half.join(pairs.select(*self.by, F.col("s").alias("mid"), "o", F.col("far") + reach), [*self.by, "mid"]).toDF(*self.by, "mid", "s", "o", "far").drop("mid")
            new = kept(spread(pairs.unionByName(step), *self.by, "s", "o").groupBy(*self.by, "s", "o").agg(F.min("far").alias("far")))
            drop(pairs)
            pairs, reach = new, 2 * reach
        return pairs.drop("far")

    def reached(self, edges: DataFrame, end: str, forward: bool, reflexive: bool) -> DataFrame:
        """Pairs with the given start (or end) that a path joins: edge by edge from there, never over all pairs.

        Few nodes are broadcast to the edges, which then stay in place.
        """
        here, there = ("s", "o") if forward else ("o", "s")
        edges = kept(edges.select(*self.by, F.col(here).alias("node"), F.col(there).alias("next")))
        new = kept(spread(edges.filter(F.col("node") == end).select(*self.by, F.col("next").alias("node")), *self.by, "node").distinct())
        seen = new
        while n := new.count():
            step = edges.join(F.broadcast(new) if n <= FEW else new, [*self.by, "node"]).select(*self.by, F.col("next").alias("node"))
            both = step.withColumn("old", F.lit(False)).unionByName(seen.withColumn("old", F.lit(True)))
            new = kept(spread(both, *self.by, "node").groupBy(*self.by, "node").agg(F.max("old").alias("old")).filter("not old").drop("old"))
            seen = seen.unionByName(new)
        if reflexive:
            own = self.triples.select(*self.by).distinct() if self.by else self.spark.range(1).select()
            seen = seen.unionByName(own.withColumn("node", F.lit(end))).distinct()
        return seen.select(*self.by, F.col("node").alias(there), F.lit(end).alias(here))

    def joined(self, left: DataFrame | None, right: DataFrame, how: str = "inner") -> DataFrame:
        if left is None:
            return right
        shared = [c for c in right.columns if c in left.columns]
        if shared:
            return left.join(right, shared, how)
        if how == "left_anti":
            return left
        return left.join(right, F.lit(True), how) if how != "inner" else left.crossJoin(right)

    def group(self) -> DataFrame:
        self.need("{")
        patterns: list[tuple[str, tuple[str, str], str]] = []
        rows: DataFrame | None = None
        filters: list[tuple[str, Any]] = []

        def flush() -> None:
            nonlocal rows
            stars: dict[str, DataFrame] = {}
            for k, x in enumerate(sorted(patterns, key=lambda x: sum(t.startswith("?") for t in (x[0], x[2])))):
                subject = x[2] if x[1][1] == "^" else x[0]
                star = subject if subject.startswith("?") else str(k)
                stars[star] = self.joined(stars.get(star), self.pattern(*x))
            patterns.clear()
            while stars:
                known = set() if rows is None else set(rows.columns) - set(self.by)
                star = next((k for k, x in stars.items() if rows is None or set(x.columns) & known), next(iter(stars)))
                shared = known & set(stars[star].columns)
                if shared and star[1:] not in shared:  # many meet many: little comes in, much goes out
                    rows = spread(rows, *self.by, *sorted(shared))
                rows = self.joined(rows, stars.pop(star))

        while not self.take("}"):
            if self.take("filter"):
                if self.take("not"):
                    self.need("exists")
                    filters.append(("left_anti", self.group()))
                elif self.take("exists"):
                    filters.append(("left_semi", self.group()))
                else:
                    start = self.at
                    self.skip()
                    filters.append(("filter", start))
            elif self.take("optional"):
                flush()
                rows = self.joined(rows, self.group(), "left")
            elif self.take("minus"):
                flush()
                rows = self.joined(rows, self.group(), "left_anti")
            elif self.take("bind"):
                flush()
                self.need("(")
                value = self.expression(rows)
                self.need("as")
                name = self.term()[1:]
                self.need(")")
                rows = rows.withColumn(name, self.bound(value))
            elif self.take("values"):
                flush()
                rows = self.joined(rows, self.values())
            elif self.peek("{"):
                flush()
                part = self.group()
                while self.take("union"):
                    part = part.unionByName(self.group(), allowMissingColumns=True)
                rows = self.joined(rows, part)
            elif not self.take("."):
                self.statement(patterns)
        flush()
        if rows is None:
            raise QueryError("the pattern is empty")
        end = self.at
        for kind, value in filters:
            if kind == "filter":
                self.at = value
                rows = rows.filter(self.truth(self.expression(rows)))
            else:
                rows = self.joined(rows, value, kind)
        self.at = end
        return rows

    def skip(self) -> None:
        """Past a filter's expression."""
        if not self.peek("("):
            self.next()
        depth = 0
        while True:
            _, text = self.next()
            depth += (text == "(") - (text == ")")
            if not depth:
                return

    def statement(self, patterns: list) -> None:
        s = self.term()
        while True:
            mark = "^" if self.take("^") else ""
            path = [(self.term(), mark or ("+" if self.take("+") else "*" if self.take("*") else ""))]
            while self.take("/"):
                mark = "^" if self.take("^") else ""
                path.append((self.term(), mark or ("+" if self.take("+") else "*" if self.take("*") else "")))
            while True:
                o, at = self.term(), s
                for k, step in enumerate(path):
                    if k + 1 < len(path):
                        self.fresh += 1
                        patterns.append((at, step, f"?_{self.fresh}"))
                        at = f"?_{self.fresh}"
                    else:
                        patterns.append((at, step, o))
                if not self.take(","):
                    break
            if not self.take(";") or self.peek(".", "}"):
                return

    def values(self) -> DataFrame:
        names = [self.term()[1:]] if not self.take("(") else []
        if not names:
            while not self.take(")"):
                names.append(self.term()[1:])
            many = True
        else:
            many = False
        self.need("{")
        rows = []
        while not self.take("}"):
            if many:
                self.need("(")
            rows.append(tuple(self.term() for _ in names))
            if many:
                self.need(")")
        return self.spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))

    # expressions: (kind, column) of kind term, num, str or bool

    def bound(self, value: tuple[str, Column]) -> Column:
        kind, column = value
        if kind == "term":
            return column
        if kind == "num":
            whole = column == F.floor(column)
            return F.concat(F.lit('"'), F.when(whole, column.cast("long").cast("string")).otherwise(column.cast("string")), F.lit('"^^<' + XSD), F.when(whole, "integer").otherwise("float"), F.lit(">"))
        if kind == "bool":
            return F.concat(F.lit('"'), column.cast("string"), F.lit(f'"^^<{XSD}boolean>'))
        return F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(column, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))

    def truth(self, value: tuple[str, Column]) -> Column:
        kind, column = value
        return column if kind == "bool" else _number(value) != 0 if kind == "num" else lex(column) == "true"

    def expression(self, rows: DataFrame) -> tuple[str, Column]:
        value = self.conjunction(rows)
        while self.take("||"):
            value = ("bool", self.truth(value) | self.truth(self.conjunction(rows)))
        return value

    def conjunction(self, rows: DataFrame) -> tuple[str, Column]:
        value = self.comparison(rows)
        while self.take("&&"):
            value = ("bool", self.truth(value) & self.truth(self.comparison(rows)))
        return value

    def comparison(self, rows: DataFrame) -> tuple[str, Column]:
        a = self.sum(rows)
        for sign in ("!=", "<=", ">=", "=", "<", ">"):
            if self.take(sign):
                b = self.sum(rows)
                if a[0] == b[0] == "term" and sign in ("=", "!="):
                    x, y = _number(a), _number(b)
                    same = F.coalesce(x == y, a[1] == b[1])
                    return "bool", same if sign == "=" else ~same
                ops = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
                if "str" in (a[0], b[0]):
                    return "bool", getattr(_text(a), ops[sign])(_text(b))
                return "bool", F.coalesce(getattr(_number(a), ops[sign])(_number(b)), getattr(_text(a), ops[sign])(_text(b)))
        return a

    def sum(self, rows: DataFrame) -> tuple[str, Column]:
        value = self.product(rows)
        while self.peek("+", "-"):
            sign = self.next()[1]
            other = _number(self.product(rows))
            value = ("num", _number(value) + other if sign == "+" else _number(value) - other)
        return value

    def product(self, rows: DataFrame) -> tuple[str, Column]:
        value = self.atom(rows)
        while self.peek("*", "/"):
            sign = self.next()[1]
            other = _number(self.atom(rows))
            value = ("num", _number(value) * other if sign == "*" else _number(value) / other)
        return value

    def atom(self, rows: DataFrame) -> tuple[str, Column]:
        if self.take("!"):
            return "bool", ~self.truth(self.atom(rows))
        if self.take("-"):
            return "num", -_number(self.atom(rows))
        if self.take("("):
            value = self.expression(rows)
            self.need(")")
            return value
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind == "word" and self.tokens[self.at + 1][1] == "(":
            return self.call(rows)
        term = self.term()
        if term.startswith("?"):
            return "term", F.col(term[1:]) if term[1:] in rows.columns else F.lit(None).cast("string")
        return "term", F.lit(term)

    def call(self, rows: DataFrame) -> tuple[str, Column]:
        name = self.next()[1].lower()
        self.need("(")
        distinct = self.take("distinct")
        if name in _AGGREGATES:
            if self.take("*"):
                value: tuple[str, Column] = ("num", F.lit(1))
            else:
                value = self.expression(rows)
            separator = " "
            if self.take(";"):
                self.need("separator")
                self.need("=")
                separator = self.next()[1][1:-1]
            self.need(")")
            if name == "count":
                return "num", F.count_distinct(value[1]) if distinct else F.count(value[1])
            if name == "group_concat":
                return "str", F.concat_ws(separator, F.array_sort((F.collect_set if distinct else F.collect_list)(_text(value))))
            if name in ("min", "max", "sample"):
                number = (F.max if name == "max" else F.min)(_number(value))
                text = (F.max if name == "max" else F.min)(value[1])
                return "term", F.coalesce(self.bound(("num", number)), text)
            return "num", (F.sum_distinct if distinct and name == "sum" else F.sum if name == "sum" else F.avg)(_number(value))
        args = []
        while not self.take(")"):
            args.append(self.expression(rows))
            self.take(",")
        one = args[0] if args else ("str", F.lit(""))
        if name == "bound":
            return "bool", one[1].isNotNull()
        if name == "regex":
            flags = "(?i)" if len(args) > 2 else ""
            return "bool", F.regexp_like(_text(one), F.concat(F.lit(flags), _text(args[1])))
        if name in ("str", "lcase", "ucase", "lang", "datatype"):
            extract = {"lang": r'"@([A-Za-z0-9-]+)$', "datatype": r'"\^\^<([^>]*)>$'}
            return "str", F.regexp_extract(one[1], extract[name], 1) if name in extract else {"str": lambda x: x, "lcase": F.lower, "ucase": F.upper}[name](_text(one))
        if name == "strlen":
            return "num", F.length(_text(one)).cast("double")
        if name == "abs":
            return "num", F.abs(_number(one))
        if name == "concat":
            return "str", F.concat(*(_text(a) for a in args))
        if name in ("contains", "strstarts", "strends"):
            return "bool", {"contains": F.contains, "strstarts": F.startswith, "strends": F.endswith}[name](_text(one), _text(args[1]))
        if name in ("isiri", "isuri", "isliteral"):
            return "bool", one[1].startswith('"' if name == "isliteral" else "<")
        if name == "coalesce":
            return "term", F.coalesce(*(self.bound(a) for a in args))
        if name == "if":
            return "term", F.when(self.truth(one), self.bound(args[1])).otherwise(self.bound(args[2]))
        raise QueryError(f"there is no function {name}")

    # the whole

    def run(self) -> DataFrame:
        while self.take("prefix"):
            name = self.next()[1].rstrip(":")
            self.prefixes[name] = self.next()[1][1:-1]
        self.need("select")
        distinct = self.take("distinct")
        start = self.at
        while not self.peek("where", "{"):
            self.next()
        head_end = self.at
        self.take("where")
        rows = self.group()
        keys: list[str] = []
        if self.take("group"):
            self.need("by")
            while self.at < len(self.tokens) and self.tokens[self.at][0] == "var":
                keys.append(self.term()[1:])
        having = None
        if self.take("having"):
            having = self.at
            self.skip()
        tail, self.at = self.at, start
        names, made = [], {}
        while self.at < head_end:
            if self.take("*"):
                names += [c for c in rows.columns if c not in self.by and not c.startswith("_")]
            elif self.take("("):
                value = self.expression(rows)
                self.need("as")
                name = self.term()[1:]
                self.need(")")
                names.append(name)
                made[name] = self.bound(value)
            else:
                names.append(self.term()[1:])
        grouped = bool(keys) or any(t[1].lower() in _AGGREGATES for t in self.tokens[start:head_end])
        if grouped:
            columns = [c.alias(n) for n, c in made.items()]
            if having is not None:
                self.at = having
                columns.append(self.truth(self.expression(rows)).alias("_having"))
            rows = rows.groupBy(*self.by, *keys).agg(*columns)
            if having is not None:
                rows = rows.filter("_having")
        else:
            for name, column in made.items():
                rows = rows.withColumn(name, column)
        for name in names:
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast("string"))
        self.at = tail
        order = []
        if self.take("order"):
            self.need("by")
            while self.at < len(self.tokens) and (self.tokens[self.at][0] == "var" or self.peek("asc", "desc", "(")):
                down = self.take("desc") or (self.take("asc") and False)
                value = self.atom(rows)
                for column in (_number(value), _text(value)):
                    order.append(column.desc() if down else column.asc())
        if order:
            rows = rows.orderBy(*order)
        rows = rows.select(*self.by, *names)
        if distinct:
            rows = rows.distinct()
        limit = offset = None
        while self.peek("limit", "offset"):
            word = self.next()[1].lower()
            value = int(self.next()[1])
            limit, offset = (value, offset) if word == "limit" else (limit, value)
        if offset:
            rows = rows.offset(offset)
        if limit is not None:
            rows = rows.limit(limit)
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.tokens[self.at][1]!r}")
        return rows


def select(triples: DataFrame, query: str, by: str | None = None, terms: bool = False) -> DataFrame:
    """Rows of a SELECT query over triples (s, p, o structs); the texts of terms, or N-Triples with ``terms``."""
    rows = _Query(query, triples, by).run()
    if terms:
        return rows
    return rows.select(*(F.col(c) if c == by else lex(F.col(c)).alias(c) for c in rows.columns))


def first(triples: DataFrame, query: str, by: str = "doc_id") -> DataFrame:
    """The first row of each document's result, by its values: what a workflow's select binds."""
    rows = select(triples, query, by)
    names = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.min(F.struct(*names)).alias("row")).select(by, "row.*")


def ask(spark: SparkSession, name: str, query: str, graphs: dict[str, DataFrame], user: str | None = None, password: str | None = None) -> DataFrame:
    """Texts of a query's rows: over a graph given by name, files, or, for a URL, at the SPARQL endpoint that is there."""
    if name not in graphs and endpoints.is_remote(name):
        rows = endpoints.ask(spark, name, query, user, password)
        return rows.select(*(lex(F.col(f"`{c}`")).alias(c) for c in rows.columns))
    return select(source(spark, name, graphs), query)


def source(spark: SparkSession, name: str, graphs: dict[str, DataFrame]) -> DataFrame:
    """Statements of a graph that is given by name, or of Turtle (.ttl, .turtle, .n3) or N-Triples files."""
    if name in graphs:
        return graphs[name]
    return turtle(spark, name) if name.lower().rstrip("*/").endswith((".ttl", ".turtle", ".n3")) else ntriples(spark, name)
