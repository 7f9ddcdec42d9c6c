import urllib.error

import pytest
from pyspark.sql import functions as F

from weftgraph.functions.terms import TERM, XSD, Term, iri, literal
from weftgraph.operators import graph
from weftgraph.sources import endpoints, readers, sinks

EX = "http://ex.org/"


@pytest.fixture(scope="module")
def triples(spark):
    def node(x):
        return iri(EX + x)

    rows = [("a", "knows", node("b")), ("b", "knows", node("c")), ("c", "knows", node("a")), ("c", "knows", node("d"))]
    rows += [("a", "age", literal("30", "integer")), ("b", "age", literal("7", "integer")), ("c", "age", literal("abc")), ("a", "name", literal('A "quoted"\\n', None, "en")), ("b", "name", literal("Bé")), ("a", "name", literal("A2"))]
    rows = [(1, tuple(node(s)), tuple(node(p)), tuple(o)) for s, p, o in rows] + [(2, tuple(node("a")), tuple(node("knows")), tuple(node("z")))]
    return spark.createDataFrame(rows, f"doc_id long, s {TERM}, p {TERM}, o {TERM}")


def ask(triples, query, **more):
    return sorted(tuple((v or "").replace(EX, "") for v in r) for r in graph.select(triples, f"PREFIX : <{EX}> {query}", **more).collect())


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("SELECT ?x WHERE { :a :knows ?x }", [("b",), ("z",)]),
        ("SELECT ?x ?y WHERE { ?x :knows ?y . ?y :knows ?x }", []),
        ("SELECT ?x WHERE { ?x :knows :c ; :age 7 }", [("b",)]),
        ("SELECT ?n WHERE { :a :name ?n FILTER(LANG(?n) = 'en') }", [('A "quoted"\\n',)]),
        ("SELECT ?x WHERE { ?x :age ?a FILTER(?a > 8 && isIRI(?x)) }", [("a",), ("c",)]),
        ("SELECT ?x ?n WHERE { ?x :age ?a OPTIONAL { ?x :name ?n } }", [("a", 'A "quoted"\\n'), ("a", "A2"), ("b", "Bé"), ("c", "")]),
        ("SELECT DISTINCT ?x WHERE { ?x :knows ?y FILTER NOT EXISTS { ?x :name ?n } }", [("c",)]),
        ("SELECT DISTINCT ?x WHERE { ?x :knows ?y FILTER EXISTS { ?x :name ?n } }", [("a",), ("b",)]),
        ("SELECT DISTINCT ?x WHERE { ?x :knows ?y MINUS { ?x :age 7 } }", [("a",), ("c",)]),
        ("SELECT ?x WHERE { { ?x :age 7 } UNION { :b :knows ?x } }", [("b",), ("c",)]),
        ("SELECT ?x ?d WHERE { ?x :age ?a BIND(?a * 2 AS ?d) FILTER(BOUND(?d)) }", [("a", "60"), ("b", "14")]),
        ("SELECT ?x ?a WHERE { VALUES ?x { :a :b } ?x :age ?a }", [("a", "30"), ("b", "7")]),
        ("SELECT ?x WHERE { ?x ^:knows :b }", [("c",)]),
        ("SELECT ?x WHERE { :b :knows/:knows ?x }", [("a",), ("d",)]),
        ("SELECT ?x WHERE { :b :knows+ ?x }", [("a",), ("b",), ("c",), ("d",), ("z",)]),
        ("SELECT ?x WHERE { :d :knows* ?x }", [("d",)]),
        ("SELECT ?x (COUNT(*) AS ?n) WHERE { ?x :knows ?y } GROUP BY ?x HAVING (COUNT(*) > 1)", [("a", "2"), ("c", "2")]),
        ("SELECT (MAX(?a) AS ?m) (SUM(?a) AS ?s) WHERE { ?x :age ?a FILTER(?a < 100) }", [("30", "37")]),
        ("SELECT ?x WHERE { ?x :age ?a } ORDER BY DESC(?a) LIMIT 1", [("a",)]),
        ("SELECT ?x WHERE { ?x :age ?a } ORDER BY ?x LIMIT 1 OFFSET 1", [("b",)]),
        ("SELECT * WHERE { ?x :age 7 ; :knows ?y }", [("b", "c")]),
        ("SELECT (CONCAT(STR(?n), '!') AS ?t) WHERE { ?x :name ?n FILTER(REGEX(?n, '^b', 'i')) }", [("Bé!",)]),
        ("SELECT ?x WHERE { ?x a :t , :u ; :age ?a . }", []),
    ],
)
def test_select(triples, query, want):
    assert ask(triples, query) == want


@pytest.mark.parametrize("query", ["ASK { ?s ?p ?o }", "SELECT ?x", "SELECT ?x WHERE { }", "SELECT ?x WHERE { ?x q:p ?y }", "SELECT ?x WHERE { ?x :p ?y } nonsense", "SELECT ?x WHERE { ?x :p ?y FILTER(NOPE(?x)) }"])
def test_refused(triples, query):
    with pytest.raises(graph.QueryError):
        ask(triples, query)


def test_subjects_meet_last(triples):
    """Patterns of one subject are joined before subjects meet; many that meet many are spread first."""
    found = graph.select(triples, f"PREFIX : <{EX}> SELECT ?x ?y WHERE {{ ?x :knows ?z . ?y :knows ?z ; :age ?a FILTER(?a > 8) }}")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "z#" in joins[0] and "y#" in joins[1] and "RepartitionByExpression [z#" in plan
    assert sorted(tuple(v.replace(EX, "") for v in r) for r in found.collect()) == [("a", "a"), ("a", "a"), ("c", "c"), ("c", "c")]


@pytest.mark.parametrize(("term", "text"), [('"a"', "a"), ('""', ""), ('"a"@en', "a"), ('"a\\"b"', 'a"b'), ('"\\\\"', "\\"), ('"7"^^<x>', "7"), ("<i>", "i"), ("_:b", "_:b"), ('"a"b"', 'a"b')])
def test_text_of_a_term(spark, term, text):
    assert spark.createDataFrame([(term,)], "t string").select(graph.lex(F.col("t"))).first()[0] == text


def test_by_document(triples):
    assert ask(triples.withColumn("doc_id", triples.doc_id.cast("string")), "SELECT ?x WHERE { :a :knows ?x }", by="doc_id") == [("1", "b"), ("2", "z")]
    first = {r.doc_id: r.x for r in graph.first(triples, f"SELECT ?x WHERE {{ ?s <{EX}knows> ?x }}").collect()}
    assert first == {1: EX + "a", 2: EX + "z"}


def test_ntriples_come_back(triples, spark, tmp_path):
    own = triples.select("s", "p", "o")
    sinks.write_ntriples(own, f"{tmp_path}/out")
    back = readers.ntriples(spark, f"{tmp_path}/out")
    assert sorted(map(str, back.collect())) == sorted(map(str, own.distinct().collect()))


@pytest.mark.parametrize("few", [0, graph.FEW])
@pytest.mark.parametrize(
    "edges",
    [
        [(k, k // 2) for k in range(1, 40)] + [(0, 0)],
        [(k // 2, k) for k in range(2, 20)],
        [(k, k + 1) for k in range(20)] + [(30, 31), (31, 32), (32, 30), (33, 30), (40, 41), (41, 42), (42, 41)],
        [(1, 2), (2, 3), (3, 1), (3, 4), (1, 5), (5, 4), (4, 6), (6, 7), (7, 5), (8, 8)],
    ],
)
def test_paths(spark, monkeypatch, edges, few):
    """Trees, chains, circles and others, against plain search; a path's pairs come once, whatever is broadcast."""
    monkeypatch.setattr(graph, "FEW", few)
    rows = [(tuple(iri(f"{EX}n{a}")), tuple(iri(EX + "e")), tuple(iri(f"{EX}n{b}"))) for a, b in edges]
    triples = spark.createDataFrame(rows, f"s {TERM}, p {TERM}, o {TERM}")
    pairs = set(edges)
    while more := {(a, d) for a, b in pairs for c, d in edges if b == c} - pairs:
        pairs |= more
    assert ask(triples, "SELECT ?x ?y WHERE { ?x :e+ ?y }") == sorted((f"n{a}", f"n{b}") for a, b in pairs)
    assert ask(triples, "SELECT ?x WHERE { ?x :e+ :n1 }") == sorted((f"n{a}",) for a, b in pairs if b == 1)
    assert ask(triples, "SELECT ?x WHERE { :n3 :e* ?x }") == sorted({(f"n{b}",) for a, b in pairs if a == 3} | {("n3",)})


def test_paths_of_a_tree_stay_in_place(spark):
    """Pairs come from one array a node: they pass no exchange and aren't written."""
    rows = [(tuple(iri(f"{EX}{k}")), tuple(iri(EX + "e")), tuple(iri(f"{EX}{k // 2}"))) for k in range(1, 64)]
    found = graph.select(spark.createDataFrame(rows, f"s {TERM}, p {TERM}, o {TERM}"), f"PREFIX : <{EX}> SELECT ?x ?y WHERE {{ ?x :e+ ?y }}")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode" in plan and "Exchange" not in plan


def test_turtle(triples, tmp_path):
    sinks.write_turtle(triples, f"{tmp_path}/ttl", {"ex": EX})
    text = (tmp_path / "ttl" / "1.ttl").read_text()
    assert f"@prefix ex: <{EX}> ." in text and "ex:knows ex:a,\n        ex:d" in text and f'"30"^^<{XSD}integer>' in text
    assert sinks.turtle([(Term("bnode", "b"), iri(EX + "p"), iri("http://other/x"))], {"ex": EX}).endswith("_:b\n    ex:p <http://other/x> .\n")


def test_upload(triples, tmp_path):
    def send(request):
        name = request.full_url.rsplit(":", 1)[1]
        (tmp_path / name).write_text(f"{request.method} {request.get_header('Authorization')}\n{request.data.decode()}")
        return open(tmp_path / name)

    endpoints.upload(triples, "http://me:pw@store/data", send=send)
    assert (tmp_path / "2").read_text() == f"PUT Basic bWU6cHc=\n<{EX}a> <{EX}knows> <{EX}z> ."
    endpoints.upload(triples.filter("doc_id = 2"), "http://store/data", into="urn:all", token="t", send=send)
    assert (tmp_path / "all").read_text().startswith("POST Bearer t\n")


def test_tokens_are_asked_for_again(triples, tmp_path):
    def send(request):
        seen = tmp_path / "seen"
        seen.write_text((seen.read_text() if seen.exists() else "") + request.get_header("Authorization") + ";")
        if seen.read_text().count(";") < 3:
            raise urllib.error.HTTPError(request.full_url, 401, "no", {}, None)
        return open(seen)

    count = tmp_path / "count"

    def token():
        count.write_text((count.read_text() if count.exists() else "") + "x")
        return count.read_text()

    one = triples.filter("doc_id = 2")
    endpoints.upload(one, "http://store/data", token=token, send=send)
    assert (tmp_path / "seen").read_text() == "Bearer x;Bearer xx;Bearer xxx;"

    def never(request):
        raise urllib.error.HTTPError(request.full_url, 401, "no", {}, None)

    with pytest.raises(Exception, match="401"):
        endpoints.upload(one, "http://store/data", token="t", send=never)
