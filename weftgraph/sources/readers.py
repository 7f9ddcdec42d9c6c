"""Document and graph sources."""

from __future__ import annotations

import re
import urllib.parse
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.terms import TERM, XSD, Term
from weftgraph.session import table


def content(html: Column) -> Column:
    """What belongs to a page: up to the first </html>; without one, the first six characters."""
    return F.left(html, F.locate("</html>", html) + F.lit(6))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as documents: doc_id, text, page_id."""
    return table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), content(F.col("html")).alias("text"), "page_id")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The documents table: doc_id, text."""
    return table(spark, folder, "documents").select("doc_id", "text")


def files(spark: SparkSession, *patterns: str, extract: Callable[[bytes, str], str | None] | None = None) -> DataFrame:
    """Files (globs are allowed) as documents: doc_id, text, doc, docname, docpathname.

    ``extract`` makes text of a file's bytes and path, in the workers (see ``sources.extract``); by default files are
    UTF-8 text or XHTML. doc_id is 63 bits of the path's hash.
    """
    raw = spark.read.format("binaryFile").load(list(patterns))

    def work(batches):
        for batch in batches:
            made = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made.append(extract(data, path) if extract else data.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["path", "text"])

    rows = raw.select("path", "content").mapInArrow(work, "path string, text string")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "[^A-Za-z0-9_-]", "_")
    text = F.when(F.contains("text", F.lit("</html>")), content(F.col("text"))).otherwise(F.col("text"))
    number = F.shiftrightunsigned(F.conv(F.substring(F.sha2("path", 256), 1, 16), 16, -10).cast("long"), 1)
    return rows.select(number.alias("doc_id"), text.alias("text"), F.col("path").alias("doc"), stem.alias("docname"), F.regexp_replace("path", r"\.[^./]*$", "").alias("docpathname"))


_PA_TERM = pa.struct([(n, pa.string()) for n in Term._fields])
_NT = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*\.\s*(?:#.*)?$'


def unescaped(text: Column) -> Column:
    """A literal's text without escapes."""
    mark = "\ue000"
    out = F.regexp_replace(text, r"\\\\", mark)
    for escape, raw in ((r"\\n", "\n"), (r"\\r", "\r"), (r"\\t", "\t"), (r"\\b", "\b"), (r"\\f", "\f"), (r"\\\"", '"')):
        out = F.regexp_replace(out, escape, raw)
    return F.replace(out, F.lit(mark), F.lit("\\"))


def term(text: Column) -> Column:
    """A term in N-Triples as a struct."""
    lex = F.regexp_extract(text, r'(?s)^"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?$', 1)
    datatype, lang = F.regexp_extract(text, r'"\^\^<([^>]*)>$', 1), F.regexp_extract(text, r'"@([A-Za-z0-9-]+)$', 1)
    none = F.lit(None).cast("string")

    def struct(*columns: Column) -> Column:
        return F.struct(*(c.alias(n) for c, n in zip(columns, ("kind", "lex", "datatype", "lang"))))

    rest = F.substring(text, F.lit(3), F.length(text))
    return (
        F.when(text.startswith("<"), struct(F.lit("iri"), F.substring(text, F.lit(2), F.length(text) - 2), none, none))
        .when(text.startswith("_:"), struct(F.lit("bnode"), rest, none, none))
        .otherwise(struct(F.lit("literal"), unescaped(lex), F.nullif(datatype, F.lit("")), F.nullif(lang, F.lit(""))))
        .cast(TERM)
    )


def ntriples(spark: SparkSession, *paths: str) -> DataFrame:
    """s, p, o of N-Triples files; other lines are ignored."""
    lines = spark.read.text(list(paths)).filter(F.col("value").rlike(_NT))
    return lines.select(*(term(F.regexp_extract("value", _NT, k)).alias(n) for k, n in ((1, "s"), (2, "p"), (3, "o"))))


_TURTLE = re.compile(
    r"""(?P<space>[ \t\r\n]+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\x00-\x20]*>)|(?P<long>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|\'{3}(?:[^'\\]|\\.|'(?!''))*\'{3})
    |(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<word>@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^|(?i:PREFIX|BASE)\b(?!:))|(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<bnode>_:[\w][\w.-]*(?<!\.))|(?P<name>(?:[^\W\d_][\w.-]*(?<!\.))?:(?:[\w:%\\][\w:.%\\-]*(?<!\.))?)|(?P<mark>[\[\]().;,]|(?:a|true|false)\b)""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}


def _plain(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def parse_turtle(text: str) -> list[tuple[Term, Term, Term]]:
    """Statements of a Turtle text: prefixes, base, lists of predicates and objects, blank nodes, collections, all literals."""
    tokens, at, out, names = [], 0, [], iter(range(1 << 62))
    while at < len(text):
        m = _TURTLE.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at : at + 20]!r}")
        if m.lastgroup != "space":
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.reverse()
    prefixes, base = {}, ""
    rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"

    def need(mark: str) -> None:
        if not tokens or tokens.pop()[1] != mark:
            raise ValueError(f"{mark} is missing")

    def resource(raw: str) -> str:
        return urllib.parse.urljoin(base, _plain(raw[1:-1])) if base else _plain(raw[1:-1])

    def fresh() -> Term:
        return Term("bnode", f"b{next(names)}")

    def node() -> Term:
        kind, raw = tokens.pop()
        if kind == "iri":
            return Term("iri", resource(raw))
        if kind == "name":
            prefix, _, member = raw.partition(":")
            if prefix not in prefixes:
                raise ValueError(f"there is no prefix {prefix}")
            return Term("iri", prefixes[prefix] + re.sub(r"\\(.)", r"\1", member))
        if kind == "bnode":
            return Term("bnode", raw[2:])
        if kind in ("string", "long"):
            body = _plain(raw[3:-3] if kind == "long" else raw[1:-1])
            if tokens and tokens[-1][1].startswith("@"):
                return Term("literal", body, None, tokens.pop()[1][1:])
            if tokens and tokens[-1][1] == "^^":
                tokens.pop()
                return Term("literal", body, node().lex)
            return Term("literal", body)
        if kind == "number":
            return Term("literal", raw, XSD + ("double" if "e" in raw.lower() else "decimal" if "." in raw else "integer"))
        if raw in ("true", "false"):
            return Term("literal", raw, XSD + "boolean")
        if raw == "a":
            return Term("iri", rdf + "type")
        if raw == "[":
            own = fresh()
            predicates(own, "]")
            need("]")
            return own
        if raw == "(":
            items = []
            while tokens[-1][1] != ")":
                items.append(node())
            tokens.pop()
            last = Term("iri", rdf + "nil")
            for item in reversed(items):
                own = fresh()
                out.extend([(own, Term("iri", rdf + "first"), item), (own, Term("iri", rdf + "rest"), last)])
                last = own
            return last
        raise ValueError(f"unexpected {raw!r}")

    def predicates(subject: Term, end: str) -> None:
        while tokens and tokens[-1][1] != end:
            if tokens[-1][1] == ";":
                tokens.pop()
                continue
            verb = node()
            while True:
                out.append((subject, verb, node()))
                if not tokens or tokens[-1][1] != ",":
                    break
                tokens.pop()

    try:
        while tokens:
            word = tokens[-1][1].lower()
            if word in ("@prefix", "prefix"):
                tokens.pop()
                name = tokens.pop()[1].rstrip(":")
                prefixes[name] = resource(tokens.pop()[1])
            elif word in ("@base", "base"):
                tokens.pop()
                base = resource(tokens.pop()[1])
            else:
                predicates(node(), ".")
                need(".")
                continue
            if word.startswith("@"):
                need(".")
    except IndexError as e:
        raise ValueError("the text ends too soon") from e
    return out


def turtle_graphs(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, s, p, o of each Turtle text (key, text); blank nodes are named by the key; a text that isn't Turtle fails the job."""

    def work(batches):
        for batch in batches:
            keys, rows = [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for statement in parse_turtle(text or ""):
                    keys.append(name)
                    rows.append([t._replace(lex=f"{zlib.crc32(str(name).encode()):08x}{t.lex}") if t.kind == "bnode" else t for t in statement])
            terms = [pa.array([r[k]._asdict() for r in rows], _PA_TERM) for k in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), *terms], [key, "s", "p", "o"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col("text").cast("string").alias("text")).mapInArrow(work, f"`{key}` {kind}, s {TERM}, p {TERM}, o {TERM}")


def turtle(spark: SparkSession, *paths: str) -> DataFrame:
    """s, p, o of Turtle files, each of which is read whole."""
    raw = spark.read.format("binaryFile").load(list(paths)).select(F.col("path").alias("name"), F.col("content").cast("string").alias("text"))
    return turtle_graphs(raw, "name").drop("name")
