"""Queries that show the operators, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import graph, layout
from weftgraph.plans import engine
from weftgraph.session import shared_folder, table
from weftgraph.sources import readers, sinks

EX = "http://example.org/"
TITLE = r"""
- {prefix: ex, iri: http://example.org/}
- match: <title>([^<]*)</title>
  as: t
  do:
    - {subject: "ex:page-@{page_id}", predicate: ex:title, object: {text: "@{t.1}"}}
"""
CONTENT = "(SELECT page_id, left(html, instr(html, '</html>')::INT + 6) AS text FROM pages)"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return keep


def flat(rows: DataFrame) -> DataFrame:
    """Statements as doc_id, s, p, o, datatype."""
    return rows.select("doc_id", F.col("s.lex").alias("s"), F.col("p.lex").alias("p"), F.col("o.lex").alias("o"), F.coalesce(F.col("o.datatype"), F.lit("")).alias("datatype"))


def messages(result: engine.Result) -> DataFrame:
    """What a workflow echoes: doc_id, message."""
    return result.log.filter("level = 'ECHO'").select("doc_id", "message")


def over_pages(spark: SparkSession, folder: str, workflow: str) -> engine.Result:
    return engine.run(workflow, readers.pages(spark, folder))


def over_documents(spark: SparkSession, folder: str, workflow: str) -> engine.Result:
    return engine.run(workflow, readers.documents(spark, folder))


def over_table(spark: SparkSession, folder: str, name: str, key: str, text: str, workflow: str, *more: str) -> engine.Result:
    rows = table(spark, folder, name).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *more)
    return engine.run(workflow, rows)


@query("content_cut", "SELECT page_id, left(html, instr(html, '</html>')::INT + 6) AS text FROM pages")
def content_cut(spark, folder):
    return table(spark, folder, "pages").select("page_id", readers.content(F.col("html")).alias("text"))


@query("match_title_triples", f"SELECT page_id AS doc_id, '{EX}page-' || page_id AS s, '{EX}title' AS p, regexp_extract(text, '<title>([^<]*)</title>', 1) AS o, '' AS datatype FROM {CONTENT} WHERE regexp_matches(text, '<title>([^<]*)</title>')")
def match_title_triples(spark, folder):
    return flat(over_pages(spark, folder, TITLE).triples)


@query("match_first", r"SELECT doc_id, 'number ' || regexp_extract(text, '([0-9]+)', 1) AS message FROM documents WHERE regexp_matches(text, '[0-9]+')")
def match_first(spark, folder):
    return messages(over_documents(spark, folder, r"[{match: '([0-9]+)', as: n, do: [{echo: 'number @{n.1}'}]}]"))


@query("match_any_pattern", r"SELECT doc_id, CASE WHEN regexp_matches(text, '([A-Z])[0-9]') THEN regexp_extract(text, '([A-Z])[0-9]', 1) ELSE regexp_extract(text, '([A-Z][a-z]+)[.]', 1) END AS message FROM documents WHERE regexp_matches(text, '([A-Z])[0-9]') OR regexp_matches(text, '([A-Z][a-z]+)[.]')")
def match_any_pattern(spark, folder):
    return messages(over_documents(spark, folder, r"[{match: ['([A-Z])[0-9]', '([A-Z][a-z]+)[.]'], as: w, do: [{echo: '@{w.1}'}]}]"))


_LINK = '<li><a href="([^"]*)">([^<]*)'
_LINKS = f"""SELECT page_id AS doc_id, unnest(regexp_extract_all(text, '{_LINK}', 1)) AS href, unnest(regexp_extract_all(text, '{_LINK}', 2)) AS label, generate_subscripts(regexp_extract_all(text, '{_LINK}', 1), 1) AS n FROM {CONTENT}"""


@query("match_every_links", f"SELECT doc_id, n || ': ' || href || ' ' || label AS message FROM ({_LINKS})")
def match_every_links(spark, folder):
    return messages(over_pages(spark, folder, f"""[{{match-every: '{_LINK}', as: a, do: [{{echo: "@{{a_count}}: @{{a.1}} @{{a.2}}"}}]}}]"""))


@query("match_every_first", f"SELECT doc_id, CASE WHEN n = 1 THEN 'first ' ELSE 'then ' END || label AS message FROM ({_LINKS})")
def match_every_first(spark, folder):
    return messages(over_pages(spark, folder, f"""[{{match-every: '{_LINK}', as: a, first: [{{echo: "first @{{a.2}}"}}], do: [{{echo: "then @{{a.2}}"}}]}}]"""))


@query("within_nav", f"""WITH nav AS (SELECT page_id, regexp_extract(text, '(?s)<nav>(.*?)</nav>', 1) AS t FROM {CONTENT})
SELECT page_id AS doc_id, unnest(regexp_extract_all(t, '<a href="([^"]*)"', 1)) AS message FROM nav WHERE t <> ''""")
def within_nav(spark, folder):
    return messages(over_pages(spark, folder, """[{within: '<nav>(.*?)</nav>', do: [{match-every: '<a href="([^"]*)"', as: a, do: [{echo: "@{a.1}"}]}]}]"""))


@query("within_every_paragraph", rf"""WITH p AS (SELECT page_id, unnest(regexp_extract_all(text, '(?s)<p>([^<]*)', 1)) AS t, generate_subscripts(regexp_extract_all(text, '(?s)<p>([^<]*)', 1), 1) AS n FROM {CONTENT})
SELECT page_id AS doc_id, n || ' ' || unnest(regexp_extract_all(t, '([A-Z][a-z]+)[.]', 1)) AS message FROM p""")
def within_every_paragraph(spark, folder):
    return messages(over_pages(spark, folder, """[{within-every: '<p>([^<]*)', as: p, do: [{match-every: '([A-Z][a-z]+)[.]', as: w, do: [{echo: "@{p_count} @{w.1}"}]}]}]"""))


@query("with_template", "SELECT n_nationkey::BIGINT AS doc_id, regexp_extract(n_name || '/' || n_regionkey, '^(.).*/(.)', 1) || regexp_extract(n_name || '/' || n_regionkey, '^(.).*/(.)', 2) AS message FROM nation")
def with_template(spark, folder):
    return messages(over_table(spark, folder, "nation", "n_nationkey", "n_name", """[{with: "@{n_name}/@{n_regionkey}", do: [{match: '^(.).*/(.)', as: m, do: [{echo: "@{m.1}@{m.2}"}]}]}]""", "n_name", "n_regionkey"))


@query("replace_text", r"SELECT doc_id, regexp_replace(text, '([a-z]+) ([a-z]+)', '\2$\1', 'g') AS message FROM documents")
def replace_text(spark, folder):
    return messages(over_documents(spark, folder, r"""[{replace: '([a-z]+) ([a-z]+)', with: '\2$\1'}, {match: '^(.*)', as: m, do: [{echo: "@{m.1}"}]}]"""))


@query("template_format", r"SELECT p_partkey AS doc_id, regexp_replace(trim(p_name), '[^a-zA-Z0-9_-]', '_', 'g') || '|' || trim(p_type) || '|' || p_name AS message FROM part")
def template_format(spark, folder):
    return messages(over_table(spark, folder, "part", "p_partkey", "p_name", """[{echo: "@{p_name:iri}|@{p_type:trim}|@{p_name:norm}"}]""", "p_name", "p_type"))


@query("norm_unescape", f"SELECT page_id AS doc_id, replace(replace(replace(replace(replace(regexp_replace(trim(t), '[\n\t\r]+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&middot;', '·'), '&amp;', '&') AS message FROM (SELECT page_id, regexp_extract(text, '<title>([^<]*)</title>', 1) AS t FROM {CONTENT} WHERE regexp_matches(text, '<title>([^<]*)</title>'))")
def norm_unescape(spark, folder):
    return messages(over_pages(spark, folder, """[{match: '<title>([^<]*)</title>', as: t, do: [{echo: "@{t.1:norm}"}]}]"""))


_LINE = "l_orderkey * 10 + l_linenumber"


@query("set_if_eval", f"SELECT {_LINE} AS doc_id, CASE WHEN l_quantity::INT > 25 THEN 'large ' ELSE 'small ' END || (l_quantity::INT * 2 + 1) AS message FROM lineitem")
def set_if_eval(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), F.col("l_quantity").cast("int").cast("string").alias("text"))
    workflow = r"""
- match: '(\d+)'
  as: q
  do:
    - {set: twice, eval: "int('@{q.1}') * 2 + 1"}
    - {set: size, to: small}
    - {if: "@{q.1} > 25", do: [{set: size, to: large}]}
    - {echo: "@{size} @{twice}"}
"""
    return messages(engine.run(workflow, rows))


_MAIL = r"[\w.]+@[\w.]+"


@query("ifdef_email", rf"SELECT doc_id, CASE WHEN regexp_matches(text, '{_MAIL}') THEN 'has ' || regexp_extract(text, '{_MAIL}') ELSE 'none' END AS message FROM documents")
def ifdef_email(spark, folder):
    return messages(over_documents(spark, folder, rf"""[{{match: '({_MAIL})', flags: A, as: mail, do: [{{set: found, to: "@{{mail.1}}"}}]}}, {{ifdef: found, do: [{{echo: "has @{{found}}"}}]}}, {{ifndef: found, do: [{{echo: none}}]}}]"""))


@query("any_of", r"SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{5}') THEN 'long' WHEN regexp_matches(text, '[0-9]') THEN 'short' ELSE 'no' END || ' number' AS message FROM documents")
def any_of(spark, folder):
    return messages(over_documents(spark, folder, """[{any-of: [{match: '[0-9]{5}', do: [{set: n, to: long}]}, {match: '[0-9]', do: [{set: n, to: short}]}, {set: n, to: "no"}]}, {echo: "@{n} number"}]"""))


@query("append_for_each", f"SELECT doc_id, n || '=' || label AS message FROM ({_LINKS})")
def append_for_each(spark, folder):
    return messages(over_pages(spark, folder, f"""[{{match-every: '{_LINK}', as: a, do: [{{append: labels, element: "@{{a.2}}"}}]}}, {{for-each: labels, as: l, do: [{{echo: "@{{l_count}}=@{{l}}"}}]}}]"""))


@query("loop_last_value", f"SELECT page_id AS doc_id, len(regexp_extract_all(text, '{_LINK}', 1)) || ' ' || regexp_extract_all(text, '{_LINK}', 2)[-1] AS message FROM {CONTENT} WHERE regexp_matches(text, '{_LINK}')")
def loop_last_value(spark, folder):
    return messages(over_pages(spark, folder, f"""[{{match-every: '{_LINK}', as: a, do: [{{set: last, to: "@{{a.2}}"}}]}}, {{ifdef: last, do: [{{echo: "@{{a_count}} @{{last}}"}}]}}]"""))


@query("procedure_call", "SELECT n_nationkey::BIGINT AS doc_id, lower(left(n_name, 1)) || '-' || n_regionkey || ' ' || n_name AS message FROM nation")
def procedure_call(spark, folder):
    workflow = """
- procedure: code
  do:
    - {set: out, eval: "'@{first}'.lower() + '-' + '@{n_regionkey}'"}
- match: '^(.)'
  as: m
  do:
    - {call: code, with: {first: "@{m.1}"}, return: {out: code}}
    - {echo: "@{code} @{n_name}"}
"""
    return messages(over_table(spark, folder, "nation", "n_nationkey", "n_name", workflow, "n_name", "n_regionkey"))


@query("mapping_exact", "SELECT o_orderkey AS doc_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'now' WHEN '2-HIGH' THEN 'soon' ELSE o_orderpriority END AS message FROM orders")
def mapping_exact(spark, folder):
    return messages(over_table(spark, folder, "orders", "o_orderkey", "o_orderpriority", """[{mapping: when, pairs: [{from: 1-URGENT, to: now}, {from: 2-HIGH, to: soon}]}, {map: "@{o_orderpriority}", apply: when, to: w}, {echo: "@{w}"}]""", "o_orderpriority"))


@query("mapping_regex", "SELECT p_partkey AS doc_id, CASE WHEN regexp_matches(p_type, '^(?:[A-Z]*O)') THEN 'o' WHEN regexp_matches(p_type, '^(?:S)') THEN 's' ELSE p_type END AS message FROM part")
def mapping_regex(spark, folder):
    return messages(over_table(spark, folder, "part", "p_partkey", "p_type", """[{mapping: kind, pairs: [{re: '[A-Z]*O', to: o}, {re: S, to: s}]}, {map: "@{p_type}", apply: kind, to: w}, {echo: "@{w}"}]""", "p_type"))


_ALTERNATIVES = "(?s)(<h1>([^<]*))|(<p>([^<]*))|(<li>(.*?)</li>)"


@query("sequence_alternatives", f"""WITH hits AS (SELECT page_id, unnest(regexp_extract_all(text, '{_ALTERNATIVES}', 0)) AS hit, generate_subscripts(regexp_extract_all(text, '{_ALTERNATIVES}', 0), 1) AS n FROM {CONTENT}),
kinds AS (SELECT page_id, n, hit, CASE WHEN hit[:4] = '<h1>' THEN 'h' WHEN hit[:3] = '<p>' THEN 'p' ELSE 'l' END AS kind FROM hits)
SELECT page_id AS doc_id, kind || row_number() OVER (PARTITION BY page_id, kind ORDER BY n) || ' ' || regexp_extract(hit, '(?s)^<[a-z1]+>(.*?)(</li>)?$', 1) AS message FROM kinds""")
def sequence_alternatives(spark, folder):
    return messages(over_pages(spark, folder, """
- sequence-of: blocks
  alternatives:
    - {match: '<h1>([^<]*)', as: h, do: [{echo: "h@{h_count} @{h.1}"}]}
    - {match: '<p>([^<]*)', as: p, do: [{echo: "p@{p_count} @{p.1}"}]}
    - {match: '<li>(.*?)</li>', as: l, do: [{echo: "l@{l_count} @{l.1}"}]}
"""))


@query("sequence_carry", f"""WITH hits AS (SELECT page_id, unnest(regexp_extract_all(text, '<h1>[^<]*|<p>[^<]+', 0)) AS hit, generate_subscripts(regexp_extract_all(text, '<h1>[^<]*|<p>[^<]+', 0), 1) AS n FROM {CONTENT}),
heads AS (SELECT page_id, n, hit, last_value(CASE WHEN hit[:4] = '<h1>' THEN hit[5:] END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY n) AS head FROM hits)
SELECT page_id AS doc_id, head || ': ' || hit[4:] AS message FROM heads WHERE hit[:3] = '<p>' AND head IS NOT NULL""")
def sequence_carry(spark, folder):
    return messages(over_pages(spark, folder, """
- sequence-of: blocks
  alternatives:
    - {match: '<h1>([^<]*)', as: h, do: [{set: head, to: "@{h.1}"}]}
    - {match: '<p>([^<]+)', as: p, do: [{ifdef: head, do: [{echo: "@{head}: @{p.1}"}]}]}
"""))


@query("sequence_steps", f"""WITH a AS (SELECT page_id, regexp_extract(text, '(?s)^(.*?)(<title>([^<]*))(.*)$', 3) AS title, regexp_extract(text, '(?s)^(.*?)(<title>([^<]*))(.*)$', 4) AS rest FROM {CONTENT} WHERE regexp_matches(text, '<title>([^<]*)')),
b AS (SELECT *, regexp_matches(rest, '<h1>([^<]*)') AS has FROM a)
SELECT page_id AS doc_id, 'title ' || title AS message FROM a UNION ALL SELECT page_id, 'h1 ' || regexp_extract(rest, '<h1>([^<]*)', 1) FROM b WHERE has""")
def sequence_steps(spark, folder):
    return messages(over_pages(spark, folder, """
- sequence-of: parts
  steps:
    - {match: '<title>([^<]*)', as: t, do: [{echo: "title @{t.1}"}]}
    - {match: '<h1>([^<]*)', as: h, do: [{echo: "h1 @{h.1}"}]}
"""))


_LINES = r"""lines AS (SELECT doc_id, unnest(regexp_extract_all(text, '([^\n]+)', 1)) AS line, generate_subscripts(regexp_extract_all(text, '([^\n]+)', 1), 1) AS i FROM documents),
cells AS (SELECT doc_id, i, unnest(regexp_extract_all(line, '([^ ]+)', 1)) AS cell, generate_subscripts(regexp_extract_all(line, '([^ ]+)', 1), 1) AS j FROM lines)"""


@query("dimensions_cells", rf"WITH {_LINES} SELECT doc_id, i || ',' || j || ' ' || CASE WHEN i = 1 THEN 'head ' ELSE '' END || cell AS message FROM cells")
def dimensions_cells(spark, folder):
    return messages(over_documents(spark, folder, r"""
- match-dimensions: ['([^\n]+)', '([^ ]+)']
  dimensions: [i, j]
  as: c
  do-1-*: [{echo: "@{i},@{j} head @{c.1}"}]
  do: [{echo: "@{i},@{j} @{c.1}"}]
"""))


@query("dimensions_tags", rf"WITH {_LINES} SELECT doc_id, i || ',' || j || ' ' || CASE WHEN j = 2 THEN 'second ' ELSE '' END || cell AS message FROM cells")
def dimensions_tags(spark, folder):
    return messages(over_documents(spark, folder, r"""
- match-dimensions: ['([^\n]+)', '([^ ]+)']
  dimensions: [i, j]
  as: c
  pre: [{any-of: [{ifdef: c-1-2.1, do: [{tag-dimension: 2, at: 2, as: second}]}, {match: '^\S+\s+\S', do: [{tag-dimension: 2, at: 2, as: second}]}, {pass: }]}]
  do-*-second: [{echo: "@{i},@{j} second @{c.1}"}]
  do: [{echo: "@{i},@{j} @{c.1}"}]
"""))


@query("dimensions_break", rf"WITH {_LINES}, stops AS (SELECT doc_id, i, min(j) FILTER (cell LIKE '%,') AS k FROM cells GROUP BY doc_id, i) SELECT doc_id, i || ',' || j || ' ' || cell AS message FROM cells JOIN stops USING (doc_id, i) WHERE j <= coalesce(k, j)")
def dimensions_break(spark, folder):
    return messages(over_documents(spark, folder, r"""
- match-dimensions: ['([^\n]+)', '([^ ]+)']
  dimensions: [i, j]
  as: c
  do: [{echo: "@{i},@{j} @{c.1}"}, {match: ',$', do: [{break: }]}]
"""))


@query("match_1_cells", """WITH t AS (SELECT o_orderkey AS doc_id, [['key', 'state', 'who'], [o_orderkey::VARCHAR, o_orderstatus, o_custkey::VARCHAR], [o_custkey::VARCHAR, 'x', o_orderkey::VARCHAR]] AS m FROM orders)
SELECT doc_id, CASE WHEN i = 1 THEN 'first ' || m[1][j] WHEN j = 1 THEN 'lead ' || i || ' ' || m[i][j] ELSE m[1][j] || '=' || m[i][j] || ' of ' || m[i][1] || ' ' || j END AS message FROM t, range(1, 4) a(i), range(1, 4) b(j)""")
def match_1_cells(spark, folder):
    text = F.concat_ws("\n", F.lit("key|state|who"), F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_custkey"), F.concat_ws("|", "o_custkey", F.lit("x"), "o_orderkey"))
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text"))
    return messages(engine.run(r"""
- match-1: '([^\n]+)'
  as-1: row
  match-2: '([^|]+)'
  as-2: cell
  header-as: head
  leading-as: lead
  first: [{echo: "first @{cell.1}"}]
  leading: [{echo: "lead @{row_count} @{cell.1}"}]
  do: [{echo: "@{head.1}=@{cell.1} of @{lead.1} @{cell_count}"}]
""", rows))


def nations(spark: SparkSession, folder: str, workflow: str, **more) -> engine.Result:
    """A workflow over the nations, with their names as texts and variables."""
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.col("n_name").alias("text"), "n_name", "n_regionkey")
    return engine.run(workflow, rows, **more)


@query("clear_ifndef", "SELECT n_nationkey::BIGINT AS doc_id, CASE WHEN n_regionkey = 1 THEN 'cleared ' || n_nationkey ELSE n_name END AS message FROM nation")
def clear_ifndef(spark, folder):
    return messages(nations(spark, folder, """[{set: a, to: "@{n_name}"}, {if: "@{n_regionkey} == 1", do: [{clear: a}]}, {ifdef: a, do: [{echo: "@{a}"}]}, {ifndef: a, do: [{echo: "cleared @{doc_id}"}]}]"""))


@query("desc_dump", "SELECT n_nationkey::BIGINT AS doc_id, unnest(['DESC', 'DUMP', 'DUMP']) AS level, unnest(['names', 'n ' || n_name, n_name]) AS message FROM nation")
def desc_dump(spark, folder):
    return nations(spark, folder, """[{desc: names}, {dump: "n @{n_name}"}, {dump: _}]""").log.select("doc_id", "level", "message")


@query("save_as", "SELECT n_nationkey::BIGINT AS doc_id, unnest(['out/' || n_name || '.ttl', n_regionkey || '.txt']) AS name, unnest(['', n_name]) AS content FROM nation")
def save_as(spark, folder):
    return nations(spark, folder, """[{save-as: "out/@{n_name:iri}.ttl"}, {dump: _, file: "@{n_regionkey}.txt"}]""").files.select("doc_id", F.col("level").alias("name"), F.col("message").alias("content"))


@query("exec_python", "SELECT n_nationkey::BIGINT AS doc_id, reverse(n_name) || ' ' || floor(sqrt(n_nationkey))::BIGINT AS message FROM nation")
def exec_python(spark, folder):
    return messages(nations(spark, folder, """[{exec: "import math\\nvars['back'] = vars['n_name'][::-1]\\nvars['root'] = math.isqrt(int(vars['doc_id']))"}, {echo: "@{back} @{root}"}]""", python=True))


@query("reference_optional", "SELECT doc_id, '[' || regexp_extract(text, '([0-9]+)', 1) || ']' AS message FROM documents")
def reference_optional(spark, folder):
    return messages(over_documents(spark, folder, """[{any-of: [{match: '([0-9]+)', as: m, do: [{pass: }]}, {pass: }]}, {echo: "[@{?m.1}]"}]"""))


@query("reference_missing", "SELECT doc_id, 'there is no match m' AS message FROM documents WHERE NOT regexp_matches(text, '[0-9]') UNION ALL SELECT doc_id, 'm has no group 7' FROM documents")
def reference_missing(spark, folder):
    docs = readers.documents(spark, folder)
    return engine.run("""[{match: '([0-9]+)', as: m, do: [{pass: }]}, {echo: "@{m.1}"}]""", docs).errors.select("doc_id", "message").unionByName(engine.run("""[{match: '(?s)(.*)', as: m, do: [{echo: "@{m.7}"}]}]""", docs).errors.select("doc_id", "message"))


@query("documented_references", "SELECT doc_id, regexp_extract(text, '([0-9]+)', 1) || '/' AS message FROM documents WHERE regexp_matches(text, '[0-9]')")
def documented_references(spark, folder):
    return messages(engine.run("""[{match: '([0-9]+)', do: [{echo: "@{1}/@{unset}"}]}]""", readers.documents(spark, folder), documented=True))


@query("unknown_function", "SELECT n_nationkey::BIGINT AS doc_id, n_name || ' None' AS message FROM nation")
def unknown_function(spark, folder):
    return messages(nations(spark, folder, """[{echo: "@{n_name:shout} @{unset}"}]"""))


@query("rows_of_one_document", "WITH t AS (SELECT CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END AS doc_id, c_name || ' ' || c_mktsegment AS text FROM customer) SELECT doc_id, len(regexp_extract_all(text, '[A-Z]')) || ' ' || regexp_extract_all(text, '[A-Z]')[-1] AS message FROM t")
def rows_of_one_document(spark, folder):
    """Repeated and NULL doc_ids: each row is a document of its own."""
    rows = table(spark, folder, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3).alias("doc_id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    return messages(engine.run("""[{match-every: '([A-Z])', as: a, do: [{set: last, to: "@{a.1}"}]}, {echo: "@{a_count} @{last}"}]""", rows))


@query("select_template", "SELECT c_custkey AS doc_id, c_name || ' ' || coalesce((SELECT min(n_name) FROM nation WHERE n_regionkey = c_nationkey % 7), 'nowhere') AS message FROM customer")
def select_template(spark, folder):
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("text"), "c_name", (F.col("c_nationkey") % 7).alias("r"))
    return messages(engine.run("""
- select: name
  from: places
  where: "PREFIX ex: <http://example.org/> SELECT ?name WHERE { ?n ex:in ex:r@{r} ; ex:name ?name }"
  as: nation
  else: [{set: nation, to: nowhere}]
- {echo: "@{c_name} @{nation}"}
""", rows, graphs={"places": places(spark, folder).graph}))


# Python's regular expressions


@query("regex_unicode", r"SELECT doc_id, regexp_extract(text, '([^\s\p{L}\p{N}_]+)[\p{L}\p{N}_]', 1) || '|' || regexp_extract(text, '[^\x00-\x7F]') AS message FROM documents WHERE regexp_matches(text, '([^\s\p{L}\p{N}_]+)[\p{L}\p{N}_]') AND regexp_matches(text, '[^\x00-\x7F]')")
def regex_unicode(spark, folder):
    return messages(over_documents(spark, folder, r"""[{match: '([^\s\w]+)\w', as: a, do: [{match: '[^\x00-\x7f]', as: b, do: [{echo: "@{a.1}|@{b.0}"}]}]}]"""))


@query("regex_case", "SELECT doc_id, len(regexp_extract_all(text, '(?i)é[a-z]'))::VARCHAR AS message FROM documents WHERE regexp_matches(text, '(?i)é[a-z]')")
def regex_case(spark, folder):
    return messages(over_documents(spark, folder, """[{match-every: 'É[A-Z]', flags: I, as: e, do: [{pass: }]}, {ifdef: e_count, do: [{echo: "@{e_count}"}]}]"""))


@query("regex_ends", "SELECT n_nationkey::BIGINT AS doc_id, unnest(['last ' || n_name[-1:], 'any ' || chr(13), 'space 3']) AS message FROM nation")
def regex_ends(spark, folder):
    """$ stands before a last line break, \\Z doesn't; a dot takes a carriage return; \\s takes separators."""
    text = F.concat(F.lit("a\rb "), F.lit("\x1c\x1d"), F.col("n_name"), F.lit("\n"))
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), text.alias("text"))
    return messages(engine.run(r"""[{match: '(\w)$', as: l, do: [{echo: "last @{l.1}"}]}, {match: '(\w)\Z', do: [{echo: never}]}, {match: 'a(.)b', as: d, do: [{echo: "any @{d.1}"}]}, {match: 'b(\s{3})\w', as: s, do: [{set: n, eval: "len('x@{s.1}x') - 2"}, {echo: "space @{n}"}]}]""", rows))


@query("regex_groups", "SELECT p_partkey AS doc_id, p_type || '/' || regexp_extract(p_brand, '#([0-9]+)', 1) || '/' || CASE WHEN p_brand[7:7] = '1' THEN '1' ELSE '' END AS message FROM part")
def regex_groups(spark, folder):
    """Named groups, and one that may be unset."""
    return messages(over_table(spark, folder, "part", "p_partkey", "p_brand", r"""[{match: '(?P<maker>Brand)#(?P<the_number>(1)?\d*)', as: b, do: [{echo: "@{p_type}/@{b.the_number}/@{b.3}"}]}]""", "p_type"))


@query("regex_conditional", "SELECT p_partkey AS doc_id, CASE WHEN p_brand[7:7] = '1' AND length(p_brand) > 7 THEN 'one ' || p_brand[8:] ELSE 'other ' || p_brand[7:] END AS message FROM part")
def regex_conditional(spark, folder):
    return messages(over_table(spark, folder, "part", "p_partkey", "p_brand", r"""[{match: '#(1)?((?(1)\d+|\d{1,2}))$', as: b, do: [{set: kind, to: other}, {ifdef: b.1, do: [{set: kind, to: one}]}, {echo: "@{kind} @{b.2}"}]}]"""))


_VALUES = "(SELECT o_orderkey AS doc_id, CASE o_orderkey % 7 WHEN 0 THEN '1_000' WHEN 1 THEN '+07' WHEN 2 THEN 'TRUE' WHEN 3 THEN '^12' WHEN 4 THEN '5d' WHEN 5 THEN ' 42 ' ELSE o_orderpriority END AS v FROM orders)"
_XSD = "http://www.w3.org/2001/XMLSchema#"


@query("literal_infer", f"""SELECT doc_id, '{EX}' || doc_id AS s, '{EX}v' AS p, CASE WHEN regexp_matches(trim(v), '^[+-]?[0-9]+(_[0-9]+)*$') THEN (replace(trim(v), '_', '')::BIGINT)::VARCHAR WHEN v = 'TRUE' THEN 'true' ELSE ltrim(v, '^') END AS o,
CASE WHEN regexp_matches(trim(v), '^[+-]?[0-9]+(_[0-9]+)*$') THEN '{_XSD}integer' WHEN v = 'TRUE' THEN '{_XSD}boolean' ELSE '' END AS datatype FROM {_VALUES}""")
def literal_infer(spark, folder):
    value = F.when(F.col("o_orderkey") % 7 == 0, "1_000").when(F.col("o_orderkey") % 7 == 1, "+07").when(F.col("o_orderkey") % 7 == 2, "TRUE").when(F.col("o_orderkey") % 7 == 3, "^12").when(F.col("o_orderkey") % 7 == 4, "5d").when(F.col("o_orderkey") % 7 == 5, " 42 ").otherwise(F.col("o_orderpriority"))
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), value.alias("text")).withColumn("v", F.col("text"))
    return flat(engine.run("""[{prefix: ex, iri: http://example.org/}, {subject: "ex:@{doc_id}", predicate: "ex:v", object: "@{v}"}]""", rows).triples)


@query("literal_typed", f"""WITH o AS (SELECT o_orderkey AS d, strftime(o_orderdate, '%Y-%m-%d') AS day, (floor(o_totalprice)::BIGINT)::VARCHAR AS price, o_orderstatus AS f FROM orders)
SELECT d AS doc_id, '{EX}o' || d AS s, '{EX}day' AS p, day AS o, '{_XSD}date' AS datatype FROM o UNION ALL SELECT d, '{EX}o' || d, '{EX}price', price, '{_XSD}integer' FROM o
UNION ALL SELECT d, '{EX}o' || d, '{EX}open', CASE WHEN f = 'O' THEN 'true' ELSE 'false' END, '{_XSD}boolean' FROM o UNION ALL SELECT d, '{EX}o' || d, '{EX}at', day || 'T00:00:00', '{_XSD}dateTime' FROM o""")
def literal_typed(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("").alias("text"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("german"), F.floor("o_totalprice").cast("string").alias("price"), F.when(F.col("o_orderstatus") == "O", "yes").otherwise("0").alias("open"))
    return flat(engine.run("""
- {prefix: ex, iri: http://example.org/}
- subject: "ex:o@{doc_id}"
  predicates:
    - {predicate: ex:day, object: {date: "@{german}", format: "%d.%m.%Y"}}
    - {predicate: ex:price, object: {integer: "@{price}"}}
    - {predicate: ex:open, object: {bool: "@{open}"}}
    - {predicate: ex:at, object: {datetime: "@{day}"}}
""", rows).triples)


def places(spark: SparkSession, folder: str) -> engine.Result:
    """Nations and regions as a graph."""
    return over_table(spark, folder, "nation", "n_nationkey", "n_name", """
- {prefix: ex, iri: http://example.org/}
- subject: "ex:n@{doc_id}"
  predicates:
    - {predicate: ex:name, object: {text: "@{n_name}", lang: en}}
    - {predicate: ex:in, inverse: ex:holds, object: {iri: "ex:r@{n_regionkey}"}}
    - {predicate: ex:code, objects: ["@{doc_id}", {text: "@{doc_id}"}]}
""", "n_name", "n_regionkey")


_PLACES = f"""(SELECT n_nationkey::BIGINT AS doc_id, '{EX}n' || n_nationkey AS s, '{EX}name' AS p, n_name AS o, '' AS datatype, false AS inverse FROM nation
UNION ALL SELECT n_nationkey, '{EX}n' || n_nationkey, '{EX}in', '{EX}r' || n_regionkey, '', false FROM nation UNION ALL SELECT n_nationkey, '{EX}r' || n_regionkey, '{EX}holds', '{EX}n' || n_nationkey, '', true FROM nation
UNION ALL SELECT n_nationkey, '{EX}n' || n_nationkey, '{EX}code', n_nationkey::VARCHAR, '{_XSD}integer', false FROM nation UNION ALL SELECT n_nationkey, '{EX}n' || n_nationkey, '{EX}code', n_nationkey::VARCHAR, '', false FROM nation)"""


@query("triples_nested", f"SELECT doc_id, s, p, o, datatype FROM {_PLACES} WHERE NOT inverse")
def triples_nested(spark, folder):
    return flat(places(spark, folder).triples.filter("not inverse"))


@query("triples_inverse", f"SELECT doc_id, s, p, o, datatype FROM {_PLACES} WHERE inverse")
def triples_inverse(spark, folder):
    return flat(places(spark, folder).triples.filter("inverse"))


@query("graph_distinct", f"SELECT DISTINCT c_custkey % 10 AS doc_id, '{EX}' || c_mktsegment AS s, '{EX}nation' AS p, c_nationkey::VARCHAR AS o, '{_XSD}integer' AS datatype FROM customer")
def graph_distinct(spark, folder):
    rows = table(spark, folder, "customer").select((F.col("c_custkey") % 10).alias("doc_id"), F.lit("").alias("text"), "c_mktsegment", "c_nationkey")
    return flat(engine.run("""[{prefix: ex, iri: http://example.org/}, {subject: "ex:@{c_mktsegment}", predicate: ex:nation, object: "@{c_nationkey}"}]""", rows).graph)


@query("stats_score", r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]*', 0)) AS hit FROM documents)
SELECT doc_id, 'workflow' AS workflow, 0::BIGINT AS no_triples, count(hit)::BIGINT AS no_matches, coalesce(sum(length(hit)), 0)::BIGINT AS total_match_len, round(coalesce(sum(1 - 1.0 / greatest(1, length(hit))), 0), 4)::DOUBLE AS score, false AS failed FROM documents LEFT JOIN w USING (doc_id) GROUP BY doc_id""")
def stats_score(spark, folder):
    return over_documents(spark, folder, "[{match-every: '[A-Z][a-z]*', do: [{pass: }]}]").stats().withColumn("score", F.round("score", 4))


@query("best_workflow", f"""WITH a AS (SELECT page_id AS doc_id, len(regexp_extract_all(text, '<li>', 0)) AS links, len(regexp_extract_all(text, '<p>', 0)) AS paragraphs FROM {CONTENT}),
r AS (SELECT doc_id, 'links' AS workflow, 0 AS workflow_no, links AS n, links * 4 AS l FROM a UNION ALL SELECT doc_id, 'paragraphs', 1, paragraphs, paragraphs * 3 FROM a)
SELECT doc_id, workflow, n::BIGINT AS no_triples, workflow_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, n DESC, l DESC, workflow_no) AS k FROM r) WHERE k = 1""")
def best_workflow(spark, folder):
    docs = readers.pages(spark, folder)
    body = """[{{prefix: ex, iri: http://example.org/}}, {{match-every: <{0}>, as: x, do: [{{subject: "ex:@{{page_id}}", predicate: ex:{0}, object: "@{{x_count}}"}}]}}]"""
    results = [engine.run(body.format(tag), docs, name=name) for name, tag in (("links", "li"), ("paragraphs", "p"))]
    return engine.best(results).select("doc_id", "workflow", "no_triples", "workflow_no")


@query("error_drops_document", f"SELECT o_orderkey AS doc_id, '{EX}' || o_orderkey AS s, '{EX}v' AS p, o_orderkey::VARCHAR AS o, '{_XSD}integer' AS datatype FROM orders WHERE o_orderstatus = 'O'")
def error_drops_document(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("").alias("text"), F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey").cast("string")).otherwise("closed").alias("v"))
    return flat(engine.run("""[{prefix: ex, iri: http://example.org/}, {subject: "ex:@{doc_id}", predicate: ex:v, object: {integer: "@{v}"}}]""", rows).triples)


@query("literal_steps", f"SELECT p_partkey AS doc_id, '{EX}p' || p_partkey AS s, '{EX}size' AS p, CASE WHEN p_size > 25 THEN 'big' ELSE p_size::VARCHAR END AS o, CASE WHEN p_size > 25 THEN '' ELSE '{_XSD}integer' END AS datatype FROM part")
def literal_steps(spark, folder):
    """An object that the first of some steps gives."""
    return flat(over_table(spark, folder, "part", "p_partkey", "p_name", """
- {prefix: ex, iri: http://example.org/}
- subject: "ex:p@{doc_id}"
  predicate: ex:size
  object: [{if: "@{p_size} > 25", do: [{echo: big}]}, {echo: "@{p_size}"}]
""", "p_size").triples)


@query("best_triples", f"""WITH a AS (SELECT page_id, len(regexp_extract_all(text, '<li>', 0)) AS li, len(regexp_extract_all(text, '<p>', 0)) AS p FROM {CONTENT})
SELECT page_id AS doc_id, CASE WHEN li >= p AND (li > p OR li * 4 >= p * 3) THEN 'links' ELSE 'paragraphs' END AS workflow, '{EX}' || page_id AS s, '{EX}n' AS p, unnest(range(1, greatest(li, p) + 1))::VARCHAR AS o FROM a""")
def best_triples(spark, folder):
    docs = readers.pages(spark, folder)
    body = """[{{prefix: ex, iri: http://example.org/}}, {{match-every: <{0}>, as: x, do: [{{subject: "ex:@{{page_id}}", predicate: ex:n, object: "@{{x_count}}"}}]}}]"""
    rows = engine.best_triples([engine.run(body.format(tag), docs, name=name) for name, tag in (("links", "li"), ("paragraphs", "p"))])
    return rows.select("doc_id", "workflow", *(F.col(f"{c}.lex").alias(c) for c in "spo"))


@query("ntriples_lines", f"""SELECT '<' || s || '> <' || p || '> ' || CASE WHEN p IN ('{EX}in', '{EX}holds') THEN '<' || o || '>' WHEN p = '{EX}name' THEN '"' || o || '"@en' WHEN datatype <> '' THEN '"' || o || '"^^<' || datatype || '>' ELSE '"' || o || '"' END || ' .' AS value FROM (SELECT DISTINCT s, p, o, datatype FROM {_PLACES})""")
def ntriples_lines(spark, folder):
    return sinks.lines(places(spark, folder).graph)


@query("ntriples_read", f"SELECT DISTINCT s, p, o, datatype, CASE WHEN p = '{EX}name' THEN 'en' ELSE '' END AS lang FROM {_PLACES}")
def ntriples_read(spark, folder):
    """A graph that is written to the shared folder and read again."""
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    sinks.write_ntriples(places(spark, folder).graph, path)
    return readers.ntriples(spark, path).select(*(F.col(f"{c}.lex").alias(c) for c in "spo"), *(F.coalesce(F.col(f"o.{c}"), F.lit("")).alias(c) for c in ("datatype", "lang")))


@query("turtle_text", f"""SELECT n_nationkey::BIGINT AS doc_id, '@prefix ex: <{EX}> .' || chr(10) || chr(10) || 'ex:n' || n_nationkey || chr(10) || '    ex:code "' || n_nationkey || '",' || chr(10) || '        "' || n_nationkey || '"^^<{_XSD}integer> ;' || chr(10) || '    ex:in ex:r' || n_regionkey || ' ;' || chr(10) || '    ex:name "' || n_name || '"@en .' || chr(10) || chr(10)
|| 'ex:r' || n_regionkey || chr(10) || '    ex:holds ex:n' || n_nationkey || ' .' || chr(10) AS text FROM nation""")
def turtle_text(spark, folder):
    return sinks.turtle_texts(places(spark, folder).graph, {"ex": EX})


@query("turtle_read", f"SELECT n_nationkey::BIGINT AS doc_id, s, p, o, datatype FROM (SELECT DISTINCT doc_id AS n_nationkey, s, p, o, datatype FROM {_PLACES})")
def turtle_read(spark, folder):
    """Turtle texts, parsed again."""
    return flat(readers.turtle_graphs(sinks.turtle_texts(places(spark, folder).graph, {"ex": EX})))


# graph queries


def suppliers(spark: SparkSession, folder: str) -> DataFrame:
    """Regions, nations, and their suppliers and customers, as one graph; queries take each statement once."""
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("text"), "s_name", "s_nationkey", F.col("s_acctbal").cast("int").alias("balance"))
    more = engine.run("""
- {prefix: ex, iri: http://example.org/}
- subject: "ex:s@{doc_id}"
  predicates: [{predicate: ex:label, object: {text: "@{s_name}"}}, {predicate: ex:from, object: {iri: "ex:n@{s_nationkey}"}}, {predicate: ex:balance, object: {integer: "@{balance}"}}]
""", rows).triples
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("text"), "c_name", "c_nationkey", "c_mktsegment")
    buyers = engine.run("""
- {prefix: ex, iri: http://example.org/}
- subject: "ex:c@{doc_id}"
  predicates: [{predicate: ex:called, object: {text: "@{c_name}"}}, {predicate: ex:lives, object: {iri: "ex:n@{c_nationkey}"}}, {predicate: ex:segment, object: {text: "@{c_mktsegment}"}}]
""", rows).triples
    rows = table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("doc_id"), F.col("r_name").alias("text"), "r_name")
    regions = engine.run("""[{prefix: ex, iri: http://example.org/}, {subject: "ex:r@{doc_id}", predicate: ex:title, object: {text: "@{r_name}"}}]""", rows).triples
    parts = [rows.select("s", "p", "o") for rows in (places(spark, folder).triples, more, buyers, regions)]
    return reduce(DataFrame.unionByName, parts)


_PREFIX = f"PREFIX ex: <{EX}> "


@query("bgp_join", "SELECT s_name AS label, n_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE trunc(s_acctbal)::INT > 5000")
def bgp_join(spark, folder):
    return graph.select(suppliers(spark, folder), _PREFIX + "SELECT ?label ?name WHERE { ?s ex:label ?label ; ex:from ?n ; ex:balance ?b . ?n ex:name ?name FILTER(?b > 5000) }")


@query("bgp_customers", "SELECT c_name AS customer, s_name AS supplier, r_name AS region FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND trunc(s_acctbal)::INT < 0")
def bgp_customers(spark, folder):
    return graph.select(suppliers(spark, folder), _PREFIX + 'SELECT ?customer ?supplier ?region WHERE { ?c ex:called ?customer ; ex:segment "BUILDING" ; ex:lives ?n . ?n ex:in/ex:title ?region . ?s ex:from ?n ; ex:label ?supplier ; ex:balance ?b FILTER(?b < 0) }')


@query("bgp_optional", "SELECT n_name AS name, s_name AS label FROM nation LEFT JOIN (SELECT * FROM supplier WHERE trunc(s_acctbal)::INT > 9000) ON s_nationkey = n_nationkey")
def bgp_optional(spark, folder):
    return graph.select(suppliers(spark, folder), _PREFIX + "SELECT ?name ?label WHERE { ?n ex:name ?name OPTIONAL { ?s ex:from ?n ; ex:label ?label ; ex:balance ?b FILTER(?b > 9000) } }")


@query("bgp_not_exists", "SELECT n_name AS name FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND trunc(s_acctbal)::INT > 8000)")
def bgp_not_exists(spark, folder):
    return graph.select(suppliers(spark, folder), _PREFIX + "SELECT ?name WHERE { ?n ex:name ?name FILTER NOT EXISTS { ?s ex:from ?n ; ex:balance ?b FILTER(?b > 8000) } }")


@query("bgp_group", "SELECT n_name AS name, count(*)::VARCHAR AS n, max(trunc(s_acctbal)::INT)::VARCHAR AS most FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name HAVING count(*) > 2")
def bgp_group(spark, folder):
    return graph.select(suppliers(spark, folder), _PREFIX + "SELECT ?name (COUNT(?s) AS ?n) (MAX(?b) AS ?most) WHERE { ?s ex:from/ex:name ?name ; ex:balance ?b } GROUP BY ?name HAVING (COUNT(?s) > 2)")


@query("bgp_union", f"SELECT '{EX}r' || n_regionkey AS x FROM nation WHERE n_nationkey = 3 UNION SELECT '{EX}n' || n_nationkey FROM nation WHERE n_name LIKE '%1%'")
def bgp_union(spark, folder):
    return graph.select(suppliers(spark, folder), _PREFIX + 'SELECT DISTINCT ?x WHERE { { ex:n3 ex:in ?x } UNION { ?x ex:name ?m FILTER(CONTAINS(?m, "1")) } }')


_UP = """[{prefix: ex, iri: http://example.org/}, {subject: "ex:@{doc_id}", predicate: ex:up, object: {iri: "ex:@{up}"}}]"""
_EDGES = "e AS (SELECT o_orderkey AS a, o_orderkey // 2 AS b FROM orders)"


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """Each order and the one with half its number, as a graph."""
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("").alias("text"), F.floor(F.col("o_orderkey") / 2).alias("up"))
    return engine.run(_UP, rows).triples.select("s", "p", "o")


@query("bgp_path", f"""WITH RECURSIVE {_EDGES}, w AS (SELECT a, b FROM e UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a) SELECT '{EX}' || a AS x, '{EX}' || b AS y FROM w""")
def bgp_path(spark, folder):
    return graph.select(tree(spark, folder), _PREFIX + "SELECT ?x ?y WHERE { ?x ex:up+ ?y }")


@query("bgp_path_from", f"WITH RECURSIVE {_EDGES}, w AS (SELECT 100 AS b UNION SELECT e.b FROM w JOIN e ON w.b = e.a) SELECT '{EX}' || b AS y FROM w")
def bgp_path_from(spark, folder):
    """Paths of any length, none too, from one node."""
    return graph.select(tree(spark, folder), _PREFIX + "SELECT ?y WHERE { ex:100 ex:up* ?y }")


@query("bgp_path_to", f"WITH RECURSIVE {_EDGES}, w AS (SELECT a FROM e WHERE b = 5 UNION SELECT e.a FROM w JOIN e ON w.a = e.b) SELECT '{EX}' || a AS x FROM w")
def bgp_path_to(spark, folder):
    """Paths of one edge at least to one node."""
    return graph.select(tree(spark, folder), _PREFIX + "SELECT ?x WHERE { ?x ex:up+ ex:5 }")


@query("bgp_minus", "SELECT n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE trunc(s_acctbal)::INT > 8000)")
def bgp_minus(spark, folder):
    return graph.select(suppliers(spark, folder), _PREFIX + "SELECT ?name WHERE { ?n ex:name ?name MINUS { ?s ex:from ?n ; ex:balance ?b FILTER(?b > 8000) } }")


@query("bgp_exists", "SELECT n_name AS name FROM nation WHERE EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND trunc(s_acctbal)::INT > 8000)")
def bgp_exists(spark, folder):
    return graph.select(suppliers(spark, folder), _PREFIX + "SELECT ?name WHERE { ?n ex:name ?name FILTER EXISTS { ?s ex:from ?n ; ex:balance ?b FILTER(?b > 8000) } }")


@query("bgp_bind", "SELECT s_name AS label, (trunc(s_acctbal)::INT * 2 + 1)::VARCHAR AS twice, upper(s_name) || '!' AS loud FROM supplier")
def bgp_bind(spark, folder):
    return graph.select(suppliers(spark, folder), _PREFIX + 'SELECT ?label ?twice ?loud WHERE { ?s ex:label ?label ; ex:balance ?b BIND(?b * 2 + 1 AS ?twice) BIND(CONCAT(UCASE(?label), "!") AS ?loud) }')


@query("bgp_values", "SELECT n_name AS name, s_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey IN (2, 5, 11)")
def bgp_values(spark, folder):
    return graph.select(suppliers(spark, folder), _PREFIX + "SELECT ?name ?label WHERE { VALUES ?n { ex:n2 ex:n5 ex:n11 } ?s ex:from ?n ; ex:label ?label . ?n ex:name ?name }")


@query("bgp_order", "SELECT s_name AS label, trunc(s_acctbal)::INT::VARCHAR AS b FROM supplier ORDER BY trunc(s_acctbal)::INT DESC, s_name LIMIT 7 OFFSET 3")
def bgp_order(spark, folder):
    """A report of the top few."""
    return graph.select(suppliers(spark, folder), _PREFIX + "SELECT ?label ?b WHERE { ?s ex:label ?label ; ex:balance ?b } ORDER BY DESC(?b) ?label LIMIT 7 OFFSET 3")


@query("select_first", f"SELECT p_partkey AS doc_id, p_brand || ' ' || (SELECT min(n_name) FROM nation WHERE n_regionkey = 2) AS message FROM part")
def select_first(spark, folder):
    rows = table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("text"), "p_brand")
    return messages(engine.run("""
- select: [name]
  from: places
  where: "PREFIX ex: <http://example.org/> SELECT ?name WHERE { ?n ex:in ex:r2 ; ex:name ?name }"
  as: [nation]
  else: [{echo: none}]
- {echo: "@{p_brand} @{nation}"}
""", rows, graphs={"places": places(spark, folder).graph}))


@query("select_rows", "SELECT s_suppkey AS doc_id, s_name || ' ' || n_name AS message FROM supplier, nation WHERE n_regionkey = 1")
def select_rows(spark, folder):
    rows = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.col("s_name").alias("text"), "s_name")
    return messages(engine.run("""
- select: name
  from: places
  where: "PREFIX ex: <http://example.org/> SELECT ?name WHERE { ?n ex:in ex:r1 ; ex:name ?name }"
  do: [{echo: "@{s_name} @{name}"}]
""", rows, graphs={"places": places(spark, folder).graph}))


# page layout, on rectangles made of numbers


def _rects(spark: SparkSession, folder: str) -> DataFrame:
    """Thin rectangles: two orders share a page."""
    k = F.col("l_orderkey") % 50
    thin = F.col("l_linenumber") % 2 == 0
    x, y = (F.col("l_partkey") % 40) * 10.0, (F.col("l_suppkey") % 30) * 10.0
    rows = table(spark, folder, "lineitem").select(k.alias("doc_id"), (F.col("l_orderkey") % 7).cast("int").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rect_no"), x.alias("x0"), y.alias("y0"), thin.alias("thin"), "l_quantity")
    return rows.select("doc_id", "page", "rect_no", "x0", "y0", F.when(F.col("thin"), F.col("x0") + F.col("l_quantity")).otherwise(F.col("x0") + 1).alias("x1"), F.when(F.col("thin"), F.col("y0") + 1).otherwise(F.col("y0") + F.col("l_quantity")).alias("y1"))


_RECTS = """rects AS (SELECT l_orderkey % 50 AS doc_id, (l_orderkey % 7)::INT AS page, l_orderkey * 10 + l_linenumber AS rect_no, (l_partkey % 40) * 10.0::DOUBLE AS x0, (l_suppkey % 30) * 10.0::DOUBLE AS y0,
CASE WHEN l_linenumber % 2 = 0 THEN (l_partkey % 40) * 10.0::DOUBLE + l_quantity ELSE (l_partkey % 40) * 10.0::DOUBLE + 1 END AS x1, CASE WHEN l_linenumber % 2 = 0 THEN (l_suppkey % 30) * 10.0::DOUBLE + 1 ELSE (l_suppkey % 30) * 10.0::DOUBLE + l_quantity END AS y1 FROM lineitem),
guides AS (SELECT *, CASE WHEN y1 - y0 <= 1.2 THEN CASE WHEN x1 - x0 >= 5 THEN 'h' END WHEN x1 - x0 < 1.2 AND y1 - y0 >= 5 THEN 'v' END AS kind FROM rects)"""


@query("guide_lines", f"WITH {_RECTS} SELECT * FROM guides WHERE kind IS NOT NULL")
def guide_lines(spark, folder):
    return layout.guide_lines(_rects(spark, folder))


def _border(own: str, middle: str, other: str, end: str, side: str) -> str:
    return f"SELECT a.doc_id, a.page, a.rect_no, '{side}' AS side FROM guides a JOIN guides b ON a.doc_id = b.doc_id AND a.page = b.page AND a.kind = '{own}' AND b.kind = '{other}' AND abs((a.{middle}0 + a.{middle}1) / 2 - b.{end}) <= 2 GROUP BY ALL HAVING count(*) >= 4"


@query("borders", f"WITH {_RECTS} {_border('h', 'y', 'v', 'y0', 'top')} UNION ALL {_border('h', 'y', 'v', 'y1', 'bottom')} UNION ALL {_border('v', 'x', 'h', 'x0', 'left')} UNION ALL {_border('v', 'x', 'h', 'x1', 'right')}")
def borders(spark, folder):
    return layout.borders(layout.guide_lines(_rects(spark, folder)))


def _words(spark: SparkSession, folder: str) -> DataFrame:
    """The words of documents on a grid of 12 columns."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "[ \\n]+")).alias("word_no", "text")).filter("text <> ''")
    place = F.col("word_no") % 600
    x, y = (place % 12) * 50.0 + 3, F.floor(place / 12) * 12.0 + 1
    return rows.select("doc_id", F.floor(F.col("word_no") / 600).cast("int").alias("page"), F.col("word_no").cast("long").alias("word_no"), x.cast("double").alias("x0"), y.cast("double").alias("y0"), (x + F.least(F.length("text"), F.lit(9)) * 5).cast("double").alias("x1"), (y + 10).cast("double").alias("y1"), "text")


@query("cell_assign", r"""WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \n]+')) AS t, generate_subscripts(regexp_split_to_array(text, '[ \n]+'), 1) - 1 AS word_no FROM documents),
p AS (SELECT doc_id, (word_no // 600)::INT AS page, word_no::BIGINT AS word_no, ((word_no % 600) % 12) * 50.0 + 3 AS x0, ((word_no % 600) // 12) * 12.0 + 1 AS y0, ((word_no % 600) % 12) * 50.0 + 3 + least(length(t), 9) * 5 AS x1, ((word_no % 600) // 12) * 12.0 + 11 AS y1 FROM w WHERE t <> ''),
c AS (SELECT i.range * 20 + j.range AS cell_no, i.range * 37.0 AS cx0, j.range * 31.0 AS cy0, i.range * 37.0 + 37 AS cx1, j.range * 31.0 + 31 AS cy1 FROM range(17) i, range(20) j),
o AS (SELECT doc_id, page, word_no, cell_no, greatest(0, least(x1, cx1) - greatest(x0, cx0)) * greatest(0, least(y1, cy1) - greatest(y0, cy0)) AS overlap, (x1 - x0) * (y1 - y0) AS area FROM p JOIN c ON x0 < cx1 AND cx0 < x1 AND y0 < cy1 AND cy0 < y1)
SELECT doc_id, page, word_no, cell_no::INT AS cell_no FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, word_no ORDER BY overlap DESC, cell_no) AS k FROM o) WHERE k = 1 AND overlap >= 0.5 * area""")
def cell_assign(spark, folder):
    words = _words(spark, folder)
    grid = spark.range(17).crossJoin(spark.range(20).withColumnRenamed("id", "j"))
    cells = grid.select((F.col("id") * 20 + F.col("j")).cast("int").alias("cell_no"), (F.col("id") * 37.0).alias("x0"), (F.col("j") * 31.0).alias("y0"), (F.col("id") * 37.0 + 37).alias("x1"), (F.col("j") * 31.0 + 31).alias("y1"))
    pages = words.select("doc_id", "page").distinct()
    return layout.words_to_cells(words, pages.crossJoin(cells))


_GRID = ([(60.0 * c, 99.5 + 20 * r, 60.0 * c + 60, 100.5 + 20 * r) for r in range(5) for c in range(3) if (r, c) != (1, 0)]
         + [(60.0 * c - 0.5, 100.0 + 20 * r, 60.0 * c + 0.5, 120.0 + 20 * r) for c in range(4) for r in range(4)] + [(300.0, 150.0, 310.0, 151.0)])
_TD = "'<td><p>t{0}{1}-' || n_nationkey || '</p></td>'"


@query("page_tables", """SELECT n_nationkey::BIGINT AS doc_id, 0 AS page, '<div class="page" pageno="1">' || chr(10) || '<p>Nation ' || n_name || '</p>' || chr(10) || '<table>' || chr(10) || """
       + " || ".join("'<tr>' || " + " || ".join(_TD.format(0 if (r, c) == (1, 0) else r, c) for c in range(3)) + " || '</tr>' || chr(10)" for r in range(4))
       + """ || '</table>' || chr(10) || '<p>below ' || n_nationkey || '<br/>goes on</p>' || chr(10) || '<p>right</p>' || chr(10) || '</div>' || chr(10) AS xhtml FROM nation""")
def page_tables(spark, folder):
    """Ruled tables in segments of one cell, with a cell that spans rows, between a heading and lines of text in two columns."""
    def box(x0, y0, x1, y1, text=None):
        own = [F.lit(float(v)).alias(n) for n, v in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))]
        return F.struct(*own) if text is None else F.struct(*own, text.cast("string").alias("text"))

    key = F.col("n_nationkey").cast("string")
    words = [box(5, 10, 45, 20, F.lit("Nation")), box(48, 10, 110, 20, F.col("n_name"))]
    words += [box(60 * c + 5, 104 + 20 * r, 60 * c + 50, 114 + 20 * r, F.concat(F.lit(f"t{r}{c}-"), key)) for r in range(4) for c in range(3) if (r, c) != (1, 0)]
    words += [box(5, 212, 60, 222, F.lit("goes on")), box(5, 200, 40, 210, F.lit("below")), box(43, 200, 60, 210, key), box(250, 215, 280, 225, F.lit("right"))]
    rows = table(spark, folder, "nation").select(F.col("n_nationkey").cast("long").alias("doc_id"), F.lit(0).alias("page"), "n_nationkey", "n_name")
    own = rows.select("doc_id", "page", F.posexplode(F.array(*words)).alias("word_no", "w")).select("doc_id", "page", F.col("word_no").cast("long").alias("word_no"), "w.*")
    rects = rows.select("doc_id", "page", F.posexplode(F.array(*(box(*b) for b in _GRID))).alias("rect_no", "r")).select("doc_id", "page", F.col("rect_no").cast("long").alias("rect_no"), "r.*")
    return layout.layout(own, rects)


@query("segments", f"""WITH RECURSIVE {_RECTS}, ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, kind, CASE kind WHEN 'h' THEN y0 ELSE x0 END ORDER BY CASE kind WHEN 'h' THEN x0 ELSE y0 END, rect_no) AS n, CASE kind WHEN 'h' THEN y0 ELSE x0 END AS level, CASE kind WHEN 'h' THEN x0 ELSE y0 END AS a, CASE kind WHEN 'h' THEN x1 ELSE y1 END AS b FROM guides WHERE kind IS NOT NULL),
runs AS (SELECT doc_id, page, kind, level, n, 1 AS run, b AS upto, a, b FROM ordered WHERE n = 1 UNION ALL
SELECT o.doc_id, o.page, o.kind, o.level, o.n, CASE WHEN abs(o.a - r.upto) <= 1.5 THEN r.run ELSE r.run + 1 END, CASE WHEN abs(o.a - r.upto) <= 1.5 THEN greatest(r.upto, o.b) ELSE o.b END, o.a, o.b FROM runs r JOIN ordered o ON r.doc_id = o.doc_id AND r.page = o.page AND r.kind = o.kind AND r.level = o.level AND o.n = r.n + 1)
SELECT doc_id, page, kind, level AS at, min(a) AS low, max(b) AS high FROM runs GROUP BY doc_id, page, kind, level, run HAVING max(b) - min(a) > 16""")
def segments(spark, folder):
    rows = layout.segments(layout.guide_lines(_rects(spark, folder)))
    flat_ = F.col("kind") == "h"
    return rows.select("doc_id", "page", "kind", F.when(flat_, F.col("y0")).otherwise(F.col("x0")).alias("at"), F.when(flat_, F.col("x0")).otherwise(F.col("y0")).alias("low"), F.when(flat_, F.col("x1")).otherwise(F.col("y1")).alias("high"))


@query("page_xhtml")
def page_xhtml(spark, folder):
    words, rects = _words(spark, folder), _rects(spark, folder)
    return layout.layout(words, rects)
