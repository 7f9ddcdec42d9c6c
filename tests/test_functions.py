import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions import expression, regex, terms

PATTERNS = [
    r"(\w+)", r"^\w+$", r"(?i)É", r"a.c", r"[^<\n]+$", r"(?P<a_b>\d+)-(?P=a_b)", r"(a)|(b)", r"[[a&&b]+", r"x{,2}y", r"{x}", r"a\Z", r"(\d)\1", r"[\]\-^]", r"\bfoo\b", r"(?:ab)+?c", r"(?m)^b", r"(?s:a.b)", r"[a\b]",
    r"(?<=a)b(?!c)", r"\x41\u00e9", r"a{2,3}", r"(?#no)z", r"\.\*", r"[\d-]+", r"é+", r"\S+\s", r"a}b",
]
TEXTS = ["", "foo été É bar", "a\nc", "a\r\nc\n", "12-12 33", "[a&b]", "xxy {x} y", "cba", "abababc", "a\nb", "foo-]^", "A\u00e9", "aab abc\x08", "zaaz . * a}b", "ß<b>1</b>\n"]


def test_patterns(spark):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, t string")
    columns = [F.regexp_extract_all("t", F.lit(regex.translate(p)), F.lit(0)).alias(f"p{n}") for n, p in enumerate(PATTERNS)]
    for row in rows.select("t", *columns).collect():
        for n, p in enumerate(PATTERNS):
            assert row[f"p{n}"] == [m[0] for m in re.finditer(p, row.t, re.S)], (p, row.t)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "(", ")", "[ab]", "\\d", "\\w", "|", "*", "+", "?", ".", "^", "$", "{2}", "é", "\\.", " "]), max_size=8).map("".join), st.lists(st.text("ab1é .\n", max_size=12), min_size=1, max_size=5))
def test_random_patterns(spark, pattern, texts):
    try:
        re.compile(pattern, re.S)
    except re.error:
        return
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", F.regexp_like("t", F.lit(regex.translate(pattern))).alias("hit")).collect():
        assert r.hit == bool(re.search(pattern, r.t, re.S)), (pattern, r.t)


@pytest.mark.parametrize(("pattern", "template"), [(r"(\w+) (\w+)", r"\2\1"), ("(a)", r"\g<1>0"), ("(?P<x>a)", r"<\g<x>>$1"), ("b", r"\\n\n"), ("(a)", r"\g<0>\g<0>")])
def test_replacements(spark, pattern, template):
    texts = ["a b ab ba", "", "aa"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select("t", F.regexp_replace("t", F.lit(regex.translate(pattern)), F.lit(regex.replacement(template, pattern))).alias("r")).collect()
    assert all(r.r == re.sub(pattern, template, r.t, flags=re.S) for r in got)


VALUES = ["5", " 42 ", "+07", "-0", "1_000", "1__0", "1e5", "5d", "1.0f", "nan", "-INF", "infinity", ".5", "5.", "1e20", "1e-7", "123456789.5", "0.0001", "0.00012", "99999999999999999999", "true", "TRUE", "tRUE", "^12", "^", "", " ", "x", "1.5e300", "-2.50", "12345678", "1e16", "1234567890123456", "1.25e15"]


def test_literals(spark):
    rows = spark.createDataFrame([(v,) for v in VALUES], "v string")
    for r in rows.select("v", terms.c_infer(F.col("v")).alias("t")).collect():
        assert tuple(r.t) == tuple(terms.infer(r.v)), r.v


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.floats().map(repr), st.integers().map(str), st.text("+-0123456789._eEdfnai ", max_size=8)), min_size=1, max_size=40))
def test_random_literals(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for r in rows.select("v", terms.c_infer(F.col("v")).alias("t")).collect():
        want = terms.infer(r.v)
        if want.datatype == terms.XSD + "float":
            # the digits of a double may be spelled in more than one way
            assert r.t.datatype == want.datatype and (r.t.lex == want.lex or float(r.t.lex.replace("INF", "inf")) == float(want.lex.replace("INF", "inf")))
        else:
            assert tuple(r.t) == tuple(want), r.v


def test_formatters(spark):
    texts = [" a/b ü\n", "\tx", "", "a&amp;b\n\tc", "-_9"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select("t", terms.c_iri_name(F.col("t")).alias("i"), terms.c_strip(F.col("t")).alias("s")).collect():
        assert (r.i, r.s) == (terms.iri_name(r.t), r.t.strip())
    assert terms.norm(" a&amp;b\n\tc ") == html.unescape("a&b c")


def test_ntriples(spark):
    own = [terms.iri("http://x/é y"), terms.literal('a "b" \\ \n\t\r', None, "en"), terms.literal("5", "integer"), terms.literal(""), terms.Term("bnode", "b1")]
    rows = spark.createDataFrame([(tuple(t),) for t in own], f"t {terms.TERM}")
    assert [r.n for r in rows.select(terms.c_ntriples(F.col("t")).alias("n")).collect()] == [terms.ntriples(t) for t in own]


@pytest.mark.parametrize(
    "source",
    ["1 + 2 * 3", "a == 'x' and not b == 'x'", "len(a) > 0 or False", "'y' in b", "a in ['x', 'z']", "a.upper() + b", "int('7') // 2", "-7 % 3", "-7 // 2", "float('1.5') * 2", "str(5) + a", "b.startswith('y')", "a.replace('x', 'zz')", "7 / 2", "vars['b']", "1 < 2", "'a' < 'b'"],
)
def test_expressions(spark, source):
    names = {"a": "x", "b": "yx"}
    value = expression.column(source, lambda r: F.lit(""), lambda n: F.lit(names[n]))
    got = spark.range(1).select(expression.text_of(value).alias("v")).first().v
    assert got == str(expression.evaluate(source, {**names, "vars": names}))


@pytest.mark.parametrize("source", ["__import__('os')", "().__class__", "a.__class__", "open('x')", "[x for x in 'ab']", "lambda: 1"])
def test_refused(source):
    with pytest.raises((expression.Unsupported, KeyError)):
        expression.evaluate(source, {"a": "x"})


def test_patterns_of_one_group():
    for pattern in (r"([^\n]+)", "(a|b)", r"(\()", "([)(]+)", "(a*)"):
        assert regex.one_group(re.compile(pattern))
    for pattern in ("(a)+", "(a)b", "(a)|(b)", "(?:a)", "a", "((a))", "(?P<n>a)", "(a)|b", "([]a])", "((?:a))"):
        assert not regex.one_group(re.compile(pattern))
