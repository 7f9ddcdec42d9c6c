"""Compiled workflows against the interpreter, document by document."""

import re

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.expression import Unsupported
from weftgraph.plans import engine
from weftgraph.plans.workflow import WorkflowError, parse

TEXTS = [
    "# Alpha\nred: 1, green: 22; blue: 333\n# Beta\nx: 9",
    "",
    None,
    "no match here",
    "foo 123 and foo 7 été É <b>a &amp; b</b>",
    "# Gamma\r\nk: 1_000; k: 5d, k: nan\n\n# Alpha\nred: 1",
    "@{doc_id} $1 \\ \"quoted\"\tk: -5",
    "# Alpha\nred: 1, green: 22; blue: 333\n# Beta\nx: 9",
]
PREFIX = "- {prefix: ex, iri: http://ex.org/}\n"

WORKFLOWS = {
    "echo": r"""
- match: foo (\d+)
  as: foo-number
  do: [{echo: "Foo: @{foo-number.1}"}]
""",
    "pattern list": r"""
- {match: ['zzz(\d)', '(\w+): (\d+)', '#'], as: m, do: [{echo: "@{m.0}|@{m.1}|@{m.2:trim}"}]}
""",
    "every with first": r"""
- match-every: '(?P<name>\w+): (?P<n>\w+)'
  as: p
  first: [{echo: "first @{p.name}"}]
  do: [{echo: "@{p_count} @{p.name}=@{p.n:iri}"}]
""",
    "within": r"""
- within: ['# (\w+)\n', '(foo.*)']
  as: w
  do:
    - {match-every: '[a-z]+', as: l, do: [{echo: "@{w.1}/@{l.0}"}]}
    - {replace: '[aeiou]', with: '<\g<0>>'}
    - {dump: _}
- {dump: _, file: "@{doc_id}.txt"}
""",
    "within every": r"""
- within-every: '#([^#]*)'
  do:
    - {match: '(\w+)', as: h, do: [{match-every: '(\w+): (\w+)', as: p, do: [{echo: "@{h.1}.@{p.1}=@{p.2} @{p_count}"}]}]}
""",
    "loop values": r"""
- {set: last, to: none}
- match-every: '(\w+): (\w+)'
  as: p
  do: [{set: last, to: "@{p.1}"}, {append: all, element: "@{p.2}"}]
- {echo: "@{last} @{?p.2} @{p_count}"}
- {for-each: all, as: a, do: [{echo: "@{a_count}. @{a}"}]}
""",
    "any of": r"""
- any-of:
    - {match: 'green: (\d+)', as: g, do: [{set: colour, to: "green @{g.1}"}]}
    - {match: 'k: (\S+)', as: k, do: [{set: colour, to: "k @{k.1}"}, {ifdef: nothing, do: [{pass: }]}]}
    - {set: colour, to: other}
- {echo: "@{colour}"}
""",
    "conditions": r"""
- {match: '(\d+)', as: n, do: [{set: n, to: "@{n.1}"}]}
- {ifdef: n, do: [{if: "@{n} > 5 and len('@{n}') < 4", do: [{echo: big}]}, {if: "not ('@{n}'.startswith('1') or @{n} % 2 == 1)", do: [{echo: even}]}, {set: m, eval: "int('@{n}') * 2 - 1"}, {echo: "@{m}"}]}
- {ifndef: n, do: [{echo: none}]}
- {clear: n}
- {echo: "@{n}"}
""",
    "procedure": r"""
- procedure: shout
  do: [{set: out, eval: "'@{word}'.upper() + '!'"}, {set: secret, to: lost}]
- {match: '([a-z]+)', as: w, do: [{call: shout, with: {word: "@{w.1}"}, return: {out: loud}}, {echo: "@{loud} @{secret}"}]}
""",
    "alternatives": r"""
- sequence-of: lines
  alternatives:
    - {match: '# (\w+)', as: h, do: [{set: head, to: "@{h.1}"}]}
    - {match: '(\w+): (\w+)', as: p, within-group: 1, do: [{ifdef: head, do: [{match: '(.)', as: c, do: [{echo: "@{head}: @{p.1} @{p_count} @{c.1}"}]}]}]}
- {echo: "@{h_count} @{p_count}"}
""",
    "steps": r"""
- sequence-of: things
  steps:
    - {match: 'red: (\d)', as: r, do: [{echo: "r @{r.1}"}]}
    - {match: '(?i)BLUE: (\d+)', as: b, do: [{echo: "b @{b.1} @{r.1}"}]}
    - {match: 'red', as: z, do: [{echo: never}]}
""",
    "dimensions": r"""
- match-dimensions: ['([^\n]+)', '(\w+)']
  dimensions: [row, col]
  as: c
  do-1-*: [{echo: "head @{col} @{c.1}"}]
  do-*-2: [{echo: "second @{row} @{c.1}"}]
  do: [{echo: "@{row},@{col} @{c.1}"}]
""",
    "mapping": r"""
- {mapping: colours, flags: I, pairs: [{from: Red, to: rouge}, {re: 'gr.*', to: vert}, {re: 'b', to: bleu}]}
- {match-every: '(\w+): (\w+)', as: p, do: [{map: "@{p.1}", apply: colours, to: c}, {echo: "@{c}"}]}
""",
    "triples": PREFIX
    + r"""
- match-every: '(\w+): (\S+)'
  as: p
  do:
    - subject: "ex:@{doc_id}-@{p_count}"
      predicates:
        - {predicate: ex:name, object: {text: "@{p.1}", lang: en}}
        - {predicate: ex:value, object: "@{p.2}"}
        - {predicate: ex:same, inverse: ex:back, object: {iri: "ex:@{p.1}"}}
        - {predicate: ex:flag, objects: [{bool: "@{p.2}"}, "^@{p.2}", ""]}
        - {predicate: ex:twice, inverse: ex:no, object: {text: "@{p.1}"}}
        - {predicate: "http://other.org/p", object: [{match: 'zzz', do: [{pass: }]}, {map: "@{p.1}", apply: m}]}
""".replace("- match-every", "- {mapping: m, pairs: [{from: red, to: '7'}]}\n- match-every", 1),
    "errors": PREFIX + r"""
- {match: 'k: (\S+)', as: k, do: [{subject: "ex:@{doc_id}", predicate: ex:k, object: {integer: "@{k.1}"}}]}
- {match: 'red', do: [{echo: "@{k.1}"}]}
- {subject: "ex:@{doc_id}", predicate: ex:seen, object: "yes"}
""",
    "dates": PREFIX + r"""
- {set: d, to: "2024-02-29"}
- subject: ex:s
  predicates:
    - {predicate: ex:d, object: {date: "@{d}"}}
    - {predicate: ex:t, object: {datetime: "2024-02-29T10:11:12.5"}}
    - {predicate: ex:f, object: {float: "1e3"}}
    - {predicate: ex:x, object: {date: "3.4.2021", format: "%d.%m.%Y"}}
""".replace("3.4.2021", "03.04.2021"),
    "html": "- {match: '<b>(.*?)</b>', as: b, do: [{echo: '@{b.1:norm}'}]}",
}


def seen(result):
    """Everything a result holds, in order for each document."""
    out = {}
    for kind in ("log", "files"):
        for r in sorted(getattr(result, kind).collect(), key=lambda r: (r.doc_id, r.ord)):
            out.setdefault((r.doc_id, kind), []).append((r.level, r.message))
    for r in sorted(result.matches.collect(), key=lambda r: (r.doc_id, r.ord)):
        out.setdefault((r.doc_id, "match"), []).append(r.length)
    for r in sorted(result.triples.collect(), key=lambda r: (r.doc_id, r.ord)):
        out.setdefault((r.doc_id, "triple"), []).append((r.s, r.p, r.o, r.inverse))
    failed = {r.doc_id for r in result.errors.collect()}
    return {k: v for k, v in out.items() if k[0] not in failed}, failed


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS) if t is not None], "doc_id long, text string").withColumn("extra", F.lit("e")).repartition(3)


@pytest.mark.parametrize("name", WORKFLOWS)
def test_columns_are_as_interpreted(docs, name):
    compiled = engine.run(WORKFLOWS[name], docs, engine="columns")
    got, failed = seen(compiled)
    want, failures = seen(engine.run(WORKFLOWS[name], docs, engine="python"))
    assert failed == failures
    assert got == want and (want or failures)


def test_null_text_is_an_error_or_no_match(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    result = engine.run("[{match: a, do: [{echo: a}]}]", docs)
    assert result.log.count() == 0 and result.triples.count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "[{set: '@{a}', to: b}]",
        "[{exec: 'vars[\"a\"] = 1'}]",
        r"[{match-every: '(\w)', as: m, do: [{set: n, to: '@{n}@{m.1}'}]}]",
        r"[{match-every: '(?(1)a|b)|(\w)', do: [{pass: }]}]",
        r"[{match-dimensions: ['(\w+)'], do: [{match-every: '(\w)', do: [{break: }]}]}]",
        r"[{match-dimensions: ['(\w+)'], dimensions: [i], pre: [{tag-dimension: 1, at: 1, as: a}], do: [{pass: }]}]",
    ],
)
def test_what_has_no_columns_is_interpreted(docs, text):
    with pytest.raises((Unsupported, ValueError)):
        engine.run(text, docs, engine="columns")
    assert engine.run(text, docs).compiler is None


def test_python_is_asked_for(docs):
    text = "[{exec: \"vars['a'] = sum(range(4))\"}, {echo: '@{a}'}]"
    assert engine.run(text, docs).log.count() == 0 and engine.run(text, docs).errors.count() == docs.count()
    assert {r.message for r in engine.run(text, docs, python=True).log.collect()} == {"6"}


def test_nested_reference(docs):
    text = r"[{match-dimensions: ['([^\n]+)', '(\w+)'], dimensions: [i, j], as: material, pre: [{set: row, to: '1-1.1'}, {any-of: [{ifdef: x, do: [{pass: }]}, {echo: '@{material-@{row}:trim}'}]}], do: [{pass: }]}]"
    got = {r.doc_id: r.message for r in engine.run(text, docs).log.collect()}
    assert got[0] == "Alpha" and got[4] == "foo"


def test_tags_and_breaks(docs):
    text = r"""
- match-dimensions: ['([^\n]+)', '(\w+)']
  dimensions: [i, j]
  as: c
  pre: [{tag-dimension: 1, at: 1, as: top}]
  do-top-*: [{echo: "top @{c.1}"}, {if: "'@{c.1}' == '1'", do: [{break: }]}]
  do: [{echo: "@{i} @{c.1}"}]
"""
    got = [r.message for r in engine.run(text, docs).log.filter("doc_id = 0").orderBy("ord").collect()]
    assert got == ["top Alpha", "2 red", "2 1", "2 green", "2 22", "2 blue", "2 333", "3 Beta", "4 x", "4 9"]


def test_two_dimensional_match(docs):
    text = r"""
- match-1: '([^\n]+)'
  match-2: '(\w+)'
  as-2: cell
  header-as: head
  leading-as: lead
  first: [{pass: }]
  do: [{echo: "@{head.1} @{lead.1} @{cell.1}"}]
"""
    docs = docs.sparkSession.createDataFrame([(1, "a b\nc d\ne f")], "doc_id long, text string")
    assert [r.message for r in engine.run(text, docs).log.orderBy("ord").collect()] == ["a c c", "b c d", "a e e", "b e f"]


def test_documented_references(docs):
    text = r"[{match: 'foo (\d+)', do: [{echo: '@{1}|@{nothing}'}]}]"
    assert {r.message for r in engine.run(text, docs).log.collect()} == {"None|None"}
    for how in ("columns", "python"):
        assert {r.message for r in engine.run(text.replace("do:", "as: f, do:"), docs, engine=how, documented=True).log.collect()} == {"123|"}


@pytest.mark.parametrize(
    "text",
    ["{}", "[]", "[{nothing: 1}]", "[{match: '(', do: [{pass: }]}]", "[{match: a, do: []}]", "[{set: a}]", "[{set: a, to: b, eval: c}]", "[{match: a, flags: Q}]", "[{within: a}]", "[{sequence-of: a}]",
     "[{sequence-of: a, alternatives: [{match: 'b*'}]}]", "[{predicate: a, object: b}]", "[{subject: a, object: b}]", "[{subject: a, predicate: b}]", "[{subject: a, predicate: b, object: {integer: 1}}]", "[{subject: a, predicate: b, object: {text: a, iri: b}}]",
     "[{mapping: a, pairs: [{to: b}]}]", "[{subject: a, predicate: b, objects: [{subject: c, object: d}]}]", "[{match-dimensions: [a], dimensions: [b, c]}]", "[{save-as: {bucket: b}}]", "[{match-every: [a], do: [{pass: }]}]"],
)
def test_bad_workflows(text):
    with pytest.raises(WorkflowError):
        parse(text)


def test_first_keyword_of_the_table_wins():
    assert [s.op for s in parse("[{echo: a, pass: b}, {with: a, replace: b}, {desc: d, set: a, to: b}]").steps] == ["pass", "replace", "set"]


def test_ranking(spark):
    docs = spark.createDataFrame([(1, "a a b"), (2, "b"), (3, "c"), (4, "a b")], "doc_id long, text string")
    body = PREFIX + "- {match-every: LETTER, do: [{subject: ex:s, predicate: ex:p, object: x}]}"
    bad = PREFIX + "- {subject: ex:s, predicate: ex:p, object: {integer: x}}"
    results = [engine.run(bad, docs, name="bad"), *(engine.run(body.replace("LETTER", x), docs, name=x) for x in "ab")]
    assert {r.doc_id: r.workflow for r in engine.best(results).collect()} == {1: "a", 2: "b", 3: "a", 4: "a"}
    assert engine.best_triples(results).count() == 3
    stats = {r.doc_id: r for r in results[1].stats().collect()}
    assert (stats[1].no_triples, stats[1].no_matches, stats[1].total_match_len, stats[1].score) == (2, 2, 2, 0.0)
    assert results[0].stats().filter("failed").count() == 4


def test_partitions_do_not_matter(docs):
    for name in ("loop values", "alternatives"):
        assert seen(engine.run(WORKFLOWS[name], docs.repartition(1))) == seen(engine.run(WORKFLOWS[name], docs.repartition(7)))


def test_select(docs, spark):
    where = "SELECT ?a ?b WHERE { ?a <http://ex.org/p> ?b }"
    made = engine.run(PREFIX + "- {subject: 'ex:@{doc_id}', predicate: ex:p, object: {text: '@{extra}'}}", docs.filter("doc_id < 3")).graph
    text = f"[{{select: [b, a], from: g, where: '{where}', as: [x, y], else: [{{echo: never}}]}}, {{echo: '@{{x}} @{{y}}'}}]"
    assert {r.message for r in engine.run(text, docs, graphs={"g": made}).log.collect()} == {"e http://ex.org/0"}
    text = f"[{{select: b, from: g, where: '{where}', do: [{{echo: '@{{b}}'}}], else: [{{echo: none}}]}}]"
    assert engine.run(text, docs, graphs={"g": made}).log.count() == docs.count() * made.count()
    assert {r.message for r in engine.run(text, docs, graphs={"g": made.limit(0)}).log.collect()} == {"none"}


def test_rows_are_documents_of_their_own(spark):
    """Repeated and NULL doc_ids, equal rows, and documents from a shuffle; compiled and interpreted alike."""
    rows = [(1, "a b"), (1, "x y z"), (None, "p q"), (2, "k"), (1, "a b"), (None, None), (None, "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.col("text"))
    loop = r"""[{match-every: '(\w)', as: w, do: [{set: last, to: "@{w.1}"}]}, {ifdef: last, do: [{echo: "@{w_count} @{last}"}]}]"""
    fails = """[{prefix: ex, iri: http://e/}, {subject: "ex:a", predicate: "ex:b", object: {integer: "@{n}"}}]"""
    numbers = spark.createDataFrame([(None, "x", "bad"), (None, "x", "5"), (3, "x", "7"), (3, "x", "no")], "doc_id long, text string, n string")
    for engine_ in ("columns", "python"):
        for own in (docs, docs.repartition(3, "text")):
            if engine_ == "python":
                own = own.filter("text is not null")
            got = sorted(((r.doc_id, r.message) for r in engine.run(loop, own, engine=engine_).log.collect()), key=str)
            assert got == sorted([(1, "2 b"), (1, "2 b"), (1, "3 z"), (2, "1 k"), (None, "2 q"), (None, "3 d")], key=str)
            assert sorted(r.no_matches for r in engine.run(loop, own, engine=engine_).stats().collect()) == sorted([2, 2, 3, 1, 2, 3] + [0] * (engine_ == "columns"))
        result = engine.run(fails, numbers, engine=engine_)
        assert sorted(((r.doc_id, r.o.lex) for r in result.triples.collect()), key=str) == sorted([(None, "5"), (3, "7")], key=str)
        assert sorted((r.no_triples, r.failed) for r in result.stats().collect()) == [(0, True), (0, True), (1, False), (1, False)]


def test_groups_of_hits_by_one_match(spark):
    """Hits with groups are matched once more by themselves; texts that hold the mark between groups are not."""
    docs = spark.createDataFrame([(1, "ab12 cd3 e \\1 $x"), (2, "ab1\ufdd1 q9"), (3, ""), (4, None), (5, "x7y8 z")], "doc_id long, text string")
    for source in (r"([a-z]+)(\d)?(\d*)", r"((?P<l>[a-z])(\d))*", r"\b(\w)(\w)", r"(?i:([A-Z])(\d)?)(?=\W|$)"):
        workflow = f"""[{{match-every: '{source}', as: m, do: [{{echo: "@{{m.0}}|@{{m.1}}|@{{m.2}}"}}]}}]"""
        got = sorted((r.doc_id, r.message) for r in engine.run(workflow, docs, engine="columns").log.collect())
        want = sorted((r.doc_id, "|".join(m[k] or "" for k in range(3))) for r in docs.collect() if r.text for m in re.finditer(source, r.text))
        assert got == [w for w in want] or source.endswith("*"), source


def test_select_within_interpreted_workflows(docs, spark):
    graph = engine.run("""[{prefix: ex, iri: http://e/}, {subject: "ex:@{doc_id}", predicate: ex:p, object: {text: "v@{doc_id}"}}]""", spark.createDataFrame([(1, ""), (2, "")], "doc_id long, text string")).graph
    query = "SELECT ?v WHERE { ?s <http://e/p> ?v }"
    workflow = f"""[{{select: v, from: g, where: "{query}", do: [{{set: "n-@{{v}}", to: "@{{v}}"}}, {{echo: "@{{v}}"}}]}}, {{select: v, from: g, where: "{query}", as: w}}, {{echo: "first @{{w}}"}}]"""
    got = engine.run(workflow, docs, graphs={"g": graph})
    assert got.compiler is None
    assert sorted({r.message for r in got.log.collect()}) == ["first v1", "v1", "v2"] and got.errors.count() == 0


@pytest.mark.parametrize("source", [
    r"""[{match-1: '([^\n]+)', as-1: r, match-2: '([^|]+)', as-2: c, header-as: h, leading-as: l, first: [{echo: "head @{c.1}"}], leading: [{echo: "lead @{r_count} @{l.1}"}], do: [{echo: "@{h.1}=@{c.1} @{c_count} @{l_count}"}]}]""",
    r"""[{match-1: '([^\n]+)', match-2: '(\w)(\w)?', as-2: c, do: [{echo: "@{c.1}@{c.2}"}, {subject: "http://e/@{c.1}", predicate: "http://e/p", object: "@{c_count}"}]}]""",
    r"""[{match-dimensions: ['([^\n]+)', '([^|]+)'], dimensions: [i, j], as: c, do: [{echo: "@{i},@{j} @{c.1}"}, {match: 'x', do: [{break: }]}, {echo: after}]}]""",
    r"""[{match-dimensions: ['([^\n]+)', '([^|]+)'], dimensions: [i, j], as: c, do-1-*: [{echo: "one @{c.1}"}], do: [{if: "@{j} == 2", do: [{break: }]}, {echo: "@{i} @{j}"}]}]""",
    r"""[{match-dimensions: ['([^|\n]+)'], dimensions: [i], do: [{match-every: '(\w)', as: m, do: [{echo: "@{m.1}"}]}, {match: 'b', do: [{break: }]}]}]""",
])
def test_rows_and_cells_in_columns(spark, source):
    texts = ["a|bb|c\nd|x|f\nx|h|i", "a\nb", "", "ab|cd\nef|gh", "x|y\nz", "a|b\nc|d|e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = {e: engine.run(source, docs, engine=e) for e in ("columns", "python")}
    failed = {r.doc_id for r in made["python"].errors.collect()}
    assert failed == {r.doc_id for r in made["columns"].errors.collect()}
    for table in ("log", "matches", "triples"):
        got = {e: [(r.doc_id, *(r.asDict().get(n) for n in ("message", "length", "s", "o"))) for r in getattr(m, table).orderBy("doc_id", "ord").collect() if r.doc_id not in failed] for e, m in made.items()}
        assert got["columns"] == got["python"], table


def test_what_a_loop_leaves_is_folded_in_parts(spark):
    """Rows of a loop are shuffled before they are sorted for the fold, so that no task sorts all that come from one file."""
    docs = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "d e f")], "doc_id long, text string")
    rows = engine.run("""[{match-every: '([a-z])', as: a, do: [{set: last, to: "@{a.1}"}]}, {echo: "@{a_count} @{last}"}]""", docs).log
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortAggregate") and plan.rindex("SortAggregate") < plan.index("REPARTITION_BY_NUM")
    assert sorted(r.message for r in rows.collect()) == ["1 c", "2 b", "3 f"]


def test_hits_of_a_loop_are_found_once(spark):
    """One pass of each pattern, whatever Spark infers from the loop; documents without hits have no turns."""
    docs = spark.createDataFrame([(1, "a b\nc"), (2, ""), (3, "\n"), (4, None)], "doc_id long, text string")
    rows = engine.run(r"""[{match-dimensions: ['([^\n]+)', '([^ ]+)'], dimensions: [i, j], as: c, do: [{echo: "@{i}@{j}@{c.1}"}]}]""", docs).log
    assert rows._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") == 2
    assert sorted((r.doc_id, r.message) for r in rows.collect()) == [(1, "11a"), (1, "12b"), (1, "21c")]


def test_cells_take_numbers_through_the_break(spark):
    """A break's window goes by the turns of the loops around it; turns of an outer loop tell lines apart too."""
    docs = spark.createDataFrame([(1, "a b, c\nd, e;f g"), (2, "h, i")], "doc_id long, text string")
    rows = engine.run(r"""
- match-every: '([^;]+)'
  as: p
  do:
    - within: '(?s)(.*)'
      do: [{match-dimensions: ['([^\n]+)', '([^ ]+)'], dimensions: [i, j], as: c, do: [{echo: "@{i}@{j}@{c.1}"}, {match: ',$', do: [{break: }]}]}]
""", docs).log
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(row#\w+, turn_\w+#", plan) and "slice(ord" not in plan
    both = [["11a", "12b,", "21d,"], ["11h,"]]
    assert sorted(r.message for r in rows.filter("doc_id = 2").collect()) == both[1]
    assert sorted(set(r.message for r in rows.filter("doc_id = 1").collect())) == both[0]
