"""RDF terms: structs of kind, lexical form, datatype and language, in Python and as columns."""

from __future__ import annotations

import datetime
import html
import math
import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
TERM = "struct<kind:string,lex:string,datatype:string,lang:string>"
INTEGER = r"^[+-]?[0-9]+(_[0-9]+)*$"
FLOAT = r"^([+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?|[+-]?(?i:nan|inf|infinity))$"
FALSE = ("false", "0", "0.0", "", "none")
STRIP = r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


class Term(NamedTuple):
    """An IRI, a blank node or a literal."""

    kind: str
    lex: str
    datatype: str | None = None
    lang: str | None = None


def iri(text: str) -> Term:
    return Term("iri", text)


def literal(lex: str, datatype: str | None = None, lang: str | None = None) -> Term:
    return Term("literal", lex, XSD + datatype if datatype else None, lang)


def infer(text: str) -> Term:
    """The literal that plain text stands for: integer, float, boolean, or else a string (^ in front forces one)."""
    bare = text.strip()
    if re.match(INTEGER, bare):
        return literal(str(int(bare)), "integer")
    if re.match(FLOAT, bare):
        return literal(float_text(float(bare)), "float")
    if bare in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return literal(bare.lower(), "boolean")
    return literal(text.removeprefix("^"))


def float_text(value: float) -> str:
    """Lexical form of a float."""
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "INF" if value > 0 else "-INF"
    return repr(value)


def typed(kind: str, text: str, form: str | None = None, lang: str | None = None) -> Term:
    """The literal of an object that names its type; ValueError if the text isn't of it."""
    bare = text.strip()
    if kind == "integer":
        return literal(str(int(bare)), "integer")
    if kind == "float":
        return literal(float_text(float(bare) if bare else math.nan), "float")
    if kind == "bool":
        return literal("false" if bare.lower() in FALSE else "true", "boolean")
    if kind == "date":
        day = datetime.date.today() if bare == "today" else datetime.datetime.strptime(bare, form).date() if form else datetime.date.fromisoformat(bare)
        return literal(day.isoformat(), "date")
    if kind == "datetime":
        time = datetime.datetime.now() if bare == "now" else datetime.datetime.strptime(bare, form) if form else datetime.datetime.fromisoformat(bare)
        return literal(time.isoformat(), "dateTime")
    return literal(text, None, lang)


def norm(text: str) -> str:
    """Without outer blanks, line ends and tabs as one blank, HTML entities as characters."""
    return html.unescape(re.sub(r"[\n\t\r]+", " ", text.strip()))


def iri_name(text: str) -> str:
    """Text as part of an IRI: other characters than letters, digits, _ and - become _."""
    return re.sub(r"[^a-zA-Z0-9_-]", "_", text.strip())


_ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def ntriples(term: Term) -> str:
    """A term in N-Triples."""
    if term.kind == "iri":
        return "<" + re.sub(r'[\x00-\x20<>"{}|^`\\]', lambda m: f"\\u{ord(m[0]):04X}", term.lex) + ">"
    if term.kind == "bnode":
        return f"_:{term.lex}"
    text = '"' + re.sub(r'[\\"\n\r\t\x08\f]', lambda m: _ESCAPES[m[0]], term.lex) + '"'
    return text + (f"@{term.lang}" if term.lang else f"^^<{term.datatype}>" if term.datatype else "")


# columns


def c_strip(text: Column) -> Column:
    return F.regexp_replace(text, "(?U)" + STRIP, "")


def c_iri_name(text: Column) -> Column:
    return F.regexp_replace(c_strip(text), "[^a-zA-Z0-9_-]", "_")


def c_term(kind: str, lex: Column, datatype: Column | str | None = None, lang: str | None = None) -> Column:
    kind_of = F.lit(XSD + datatype if isinstance(datatype, str) else None).cast("string") if not isinstance(datatype, Column) else datatype
    return F.struct(F.lit(kind).alias("kind"), lex.alias("lex"), kind_of.alias("datatype"), F.lit(lang).cast("string").alias("lang"))


def c_integer(bare: Column) -> Column:
    """Python's spelling of an integer of any length."""
    plain = F.regexp_replace(F.regexp_replace(bare, "_", ""), r"^\+", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^(-?)0+(?=[0-9])", "$1"), "^-0$", "0")
    return plain


def c_float(bare: Column) -> Column:
    """Python's spelling of a float."""
    value = F.regexp_replace(bare, "_", "").try_cast("double") if hasattr(bare, "try_cast") else F.expr("NULL")
    low = F.lower(bare)
    text = value.cast("string")
    # Java writes 1.0E20 and 1.0E-5, Python 1e+20 and 1e-05; plain from 1e-4 to 1e16
    size = F.abs(value)
    big = (size >= 1e7) & (size < 1e16)
    small = (size >= 1e-4) & (size < 1e-3)
    mantissa = F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)", 1), r"\.0$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    exponent = F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
    digits = F.regexp_replace(F.regexp_replace(F.regexp_extract(text, r"^(-?[0-9.]+)", 1), r"\.0$", ""), "[.-]", "")
    sign = F.when(value < 0, "-").otherwise("")
    whole = F.concat(sign, F.when(F.length(digits) > power + 1, F.concat(F.substring(digits, F.lit(1), power + 1), F.lit("."), F.substring(digits, power + 2, F.lit(40)))).otherwise(F.concat(F.rpad(digits, power + 1, F.lit("0")), F.lit(".0"))))
    return (
        F.when(low.rlike("nan"), "NaN").when(low.rlike("^-inf"), "-INF").when(low.rlike("inf"), "INF")
        .when(big, whole).when(small, F.concat(sign, F.lit("0.000"), digits)).when((size > 0) & ((size >= 1e16) | (size < 1e-4)), exponent).otherwise(text)
    )


def c_infer(text: Column) -> Column:
    """infer, as a column."""
    bare = c_strip(text)
    integer, number, boolean = bare.rlike(INTEGER), bare.rlike(FLOAT), bare.isin("true", "True", "TRUE", "false", "False", "FALSE")
    lex = F.when(integer, c_integer(bare)).when(number, c_float(bare)).when(boolean, F.lower(bare)).otherwise(F.regexp_replace(text, r"^\^", ""))
    kind = F.when(integer, XSD + "integer").when(number, XSD + "float").when(boolean, XSD + "boolean")
    return c_term("literal", lex, kind.cast("string"))


def c_ntriples(term: Column) -> Column:
    """ntriples, as a column."""
    text = F.regexp_replace(term["lex"], r"\\", r"\\\\")
    for raw, escaped in (('"', '\\\\"'), ("\n", "\\\\n"), ("\r", "\\\\r"), ("\t", "\\\\t"), ("\b", "\\\\b"), ("\f", "\\\\f")):
        text = F.regexp_replace(text, F.lit({"\b": "\\x08"}.get(raw, raw)), F.lit(escaped))
    tail = F.when(term["lang"].isNotNull(), F.concat(F.lit("@"), term["lang"])).when(term["datatype"].isNotNull(), F.concat(F.lit("^^<"), term["datatype"], F.lit(">"))).otherwise("")
    name = term["lex"]
    for c in ' <>"{}|^`\\':
        name = F.replace(name, F.lit(c), F.lit(f"\\u{ord(c):04X}")) if c != "\\" else name
    return F.when(term["kind"] == "iri", F.concat(F.lit("<"), name, F.lit(">"))).when(term["kind"] == "bnode", F.concat(F.lit("_:"), term["lex"])).otherwise(F.concat(F.lit('"'), text, F.lit('"'), tail))
