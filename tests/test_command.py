import base64
import json

import pytest
from pyspark.sql import functions as F

from weftgraph import cli
from weftgraph.operators import layout
from weftgraph.plans import engine
from weftgraph.sources import endpoints, extract, readers, sinks
from weftgraph.streaming import files

WORKFLOW = r"""
- {prefix: ex, iri: http://ex.org/}
- match: 'id (\d+)'
  as: m
  do: [{echo: "found @{m.1} in @{docname}"}, {subject: "ex:@{docname}", predicate: "ex:@{kind}", object: "@{m.1}"}]
"""


def test_command(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "w.yaml").write_text(WORKFLOW)
    (tmp_path / "v.yaml").write_text("[{pass: }]")
    (tmp_path / "a b.txt").write_text("id 5")
    (tmp_path / "c.txt").write_text("none")
    code = cli.main([f"{tmp_path}/v.yaml", f"{tmp_path}/w.yaml", f"{tmp_path}/*.txt", "-d", "kind=number", "-o", f"{tmp_path}/out", "--ntriples", f"{tmp_path}/nt", "-V", "-g"])
    said = capsys.readouterr().out
    assert code == 0 and "ECHO: found 5 in a_b" in said and "w, 1 triples, 1 matches" in said and "v, 0 triples" in said
    assert "ex:a_b\n    ex:number" in (tmp_path / "out" / "a_b.ttl").read_text() and '<http://ex.org/a_b> <http://ex.org/number> "5"' in said
    assert any(p.name == "w.log" and "ECHO: found 5" in p.read_text() for p in (tmp_path / "out" / "diagnostics").rglob("*.log"))
    assert cli.main([f"{tmp_path}/c.txt", "--text"]) == 0 and "none" in capsys.readouterr().out


def test_content(spark):
    rows = spark.createDataFrame([("<html>x</html>y</html>",), ("<html>no end",), (None,), ("",)], "h string")
    assert [r.c for r in rows.select(readers.content(F.col("h")).alias("c")).collect()] == ["<html>x</html>", "<html>", None, ""]


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "id 5", "a"), (2, "no", "b"), (3, "id 7", "c")], "doc_id long, text string, docname string").withColumn("kind", F.lit("k"))
    docs.write.parquet(f"{tmp_path}/in")
    query = files.stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), WORKFLOW, f"{tmp_path}/out", f"{tmp_path}/state")
    query.awaitTermination(120)
    assert spark.read.text(f"{tmp_path}/out").filter("value <> ''").count() == 2


def test_names_that_clash(spark, tmp_path, monkeypatch):
    """Documents of one name in two folders keep graphs of their own."""
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "w.yaml").write_text(WORKFLOW)
    for folder, n in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.txt").write_text(f"id {n}")
    cli.main([f"{tmp_path}/w.yaml", f"{tmp_path}/a/*.txt", f"{tmp_path}/b/*.txt", "-d", "kind=k", "-o", f"{tmp_path}/out"])
    texts = [p.read_text() for p in (tmp_path / "out").glob("*.ttl")]
    assert len(texts) == 2 and sum('"1"' in t for t in texts) == sum('"2"' in t for t in texts) == 1


class Answer:
    def __init__(self, body):
        self.body = body

    def read(self):
        return self.body

    def close(self):
        pass

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


def test_extractors(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(b"\x00binary")
    (tmp_path / "b.TXT").write_text("plain")
    (tmp_path / "c.pdf").write_text("2")

    def read(data):
        for page in range(int(data)):
            yield page, [(5.0, 4.0, 25.0, 14.0, f"word{page}")], [(0.0, 50.0, 100.0, 51.0)]

    send = lambda request: Answer(f"<html>{request.method} {len(request.data)}</html>tail".encode())
    own = extract.by_extension({".docx": extract.server("http://server/tika", send=send), ".pdf": extract.pdf(read, {1})})
    got = {r.docname: r.text for r in readers.files(spark, f"{tmp_path}/*", extract=own).collect()}
    assert got["a"] == "<html>PUT 7</html>" and got["b"] == "plain"
    assert got["c"] == '<html><body>\n<div class="page" pageno="2">\n<p>word1</p>\n</div>\n</body></html>'
    words, rects = extract.page_tables(spark, f"{tmp_path}/c.pdf", read=read)
    assert sorted((r.page, r.text) for r in words.collect()) == [(0, "word0"), (1, "word1")] and rects.count() == 2
    assert layout.layout(words.withColumn("doc_id", F.lit(1)), rects.withColumn("doc_id", F.lit(1))).count() == 2


def test_endpoint(spark, monkeypatch):
    said = {}

    def send(request):
        said.update(url=request.full_url, body=request.data.decode(), auth=request.get_header("Authorization"))
        bindings = [{"x": {"type": "uri", "value": "http://e/1"}, "n": {"type": "literal", "value": 'o"ne', "xml:lang": "en"}}, {"x": {"type": "literal", "value": "5", "datatype": "http://e/t"}}]
        return Answer(json.dumps({"head": {"vars": ["x", "n"]}, "results": {"bindings": bindings}}).encode())

    monkeypatch.setenv("PW", "secret")
    rows = endpoints.ask(spark, "http://store/db/query", "SELECT ?x ?n WHERE { ?x ?p ?n }", "me", "$PW", send).collect()
    assert [tuple(r) for r in rows] == [("<http://e/1>", '"o\\"ne"@en'), ('"5"^^<http://e/t>', None)]
    assert said["auth"] == "Basic " + base64.b64encode(b"me:secret").decode() and said["body"].startswith("query=SELECT")
    assert endpoints.split_user("http://a:b%40c@host:1/db") == ("http://host:1/db", "Basic " + base64.b64encode(b"a:b@c").decode())
    monkeypatch.setattr(endpoints.ask, "__defaults__", (None, None, send))
    docs = spark.createDataFrame([(1, "t")], "doc_id long, text string")
    workflow = """[{select: "?x ?n", from: "http://me@store/db/query", where: "SELECT ?x ?n WHERE { ?x ?p ?n }", as: a b, do: [{echo: "@{a} @{b}"}]}]"""
    assert sorted(r.message for r in engine.run(workflow, docs).log.collect()) == ["5 None", 'http://e/1 o"ne']
    assert sorted(r.message for r in engine.run(workflow, docs, engine="python").log.collect()) == ["5 None", 'http://e/1 o"ne']


def test_outputs(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b.txt", None)], "name string, text string")
    sinks.deliver(rows, sinks.Folder(f"{tmp_path}/out"))
    assert (tmp_path / "out" / "a.txt").read_text() == "x" and (tmp_path / "out" / "b.txt").read_text() == ""


def test_turtle_texts():
    text = """@prefix ex: <http://e/> . PREFIX : <#> @base <http://b/x> .
    # a comment
    ex:a a ex:C ; ex:p "t\\"q"@en , 5, 1.5 , 1e3, true, \'\'\'long 'x' \n\'\'\' ; .
    <rel> ex:l ( 1 [ ex:q _:n ] ) . ex:a.b ex:t "2020"^^ex:y ."""
    got = readers.parse_turtle(text)
    lex = {(s.lex, p.lex.rsplit("/", 1)[1], o.lex) for s, p, o in got if s.kind == "iri"}
    assert ("http://e/a", "p", 't"q') in lex and ("http://e/a", "p", "long 'x' \n") in lex and ("http://e/a.b", "t", "2020") in lex
    assert {o.datatype.rsplit("#", 1)[-1] for _, _, o in got if o.datatype} == {"integer", "decimal", "double", "boolean", "http://e/y"}
    assert any(s.lex == "http://b/rel" for s, _, _ in got) and len(got) == 14
    for bad in ("ex:a ex:b ex:c .", "<a> <b> .", "<a> <b> <c>", "<a> <b> 'x"):
        with pytest.raises(ValueError):
            readers.parse_turtle(bad)
