"""Graphs behind HTTP: SPARQL endpoints that queries go to, stores that graphs go to."""

from __future__ import annotations

import base64
import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.terms import Term, c_ntriples, ntriples

TRIES = 3


class EndpointError(RuntimeError):
    """A server that doesn't do what it is asked for."""


def secret(text: str | None) -> str | None:
    """A credential; $NAME is looked up in the environment."""
    if text and text.startswith("$"):
        if text[1:] not in os.environ:
            raise EndpointError(f"{text} isn't set")
        return os.environ[text[1:]]
    return text


def basic(user: str | None, password: str | None) -> str | None:
    """An Authorization header, if there is a user."""
    if not user:
        return None
    return "Basic " + base64.b64encode(f"{secret(user)}:{secret(password) or ''}".encode()).decode()


def split_user(url: str) -> tuple[str, str | None]:
    """(the URL without user and password, Authorization header that they make); the password may be $NAME."""
    parts = urllib.parse.urlsplit(url)
    if not parts.username:
        return url, None
    host = parts.hostname + (f":{parts.port}" if parts.port else "")
    unquote = lambda x: urllib.parse.unquote(x) if x else x
    return urllib.parse.urlunsplit(parts._replace(netloc=host)), basic(unquote(parts.username), unquote(parts.password) or os.environ.get("GRAPH_STORE_PASSWORD"))


def is_remote(name: str | None) -> bool:
    return bool(name) and name.startswith(("http://", "https://"))


def term_of(value: dict) -> str:
    """A binding of SPARQL's JSON results, in N-Triples."""
    kind = value["type"]
    if kind == "uri":
        return ntriples(Term("iri", value["value"]))
    if kind == "bnode":
        return ntriples(Term("bnode", value["value"]))
    return ntriples(Term("literal", value["value"], value.get("datatype"), value.get("xml:lang")))


def ask(spark: SparkSession, url: str, query: str, user: str | None = None, password: str | None = None, send: Callable = urllib.request.urlopen) -> DataFrame:
    """The rows of a SELECT query at an endpoint, terms in N-Triples; the driver asks once, for all documents."""
    bare, header = split_user(url)
    header = basic(user, password) or header
    request = urllib.request.Request(bare, urllib.parse.urlencode({"query": query}).encode(), {"Accept": "application/sparql-results+json", "Content-Type": "application/x-www-form-urlencoded"}, method="POST")
    if header:
        request.add_header("Authorization", header)
    try:
        with send(request) as answer:
            found = json.loads(answer.read())
        names = found["head"]["vars"]
        rows = [tuple(term_of(b[n]) if n in b else None for n in names) for b in found["results"]["bindings"]]
    except (OSError, ValueError, KeyError) as e:
        raise EndpointError(f"{bare}: {e}") from e
    return spark.createDataFrame(rows, ", ".join(f"`{n}` string" for n in names))


def upload(graph: DataFrame, url: str, method: str | None = None, name: str = "doc_id", into: str | None = None, token: str | Callable[[], str] | None = None, send: Callable = urllib.request.urlopen) -> None:
    """Each document's graph to a graph store as ``url?graph=urn:doc:<name>``, or all of them to one graph.

    The URL may hold user and password. PUT, which makes repeated tasks harmless, is the usual verb; one graph for all
    documents is added to by POST. A token (or what gives a fresh one) is sent as bearer, and asked for anew up to TRIES times
    where the store says no.
    """
    bare, header = split_user(url)
    method = method or ("POST" if into else "PUT")
    line = F.concat_ws(" ", c_ntriples(F.col("s")), c_ntriples(F.col("p")), c_ntriples(F.col("o")), F.lit("."))
    grouped = graph.groupBy(F.col(name).cast("string").alias("name")).agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("body"))

    def post(rows) -> None:
        for row in rows:
            target = f"{bare}?graph={urllib.parse.quote(into or f'urn:doc:{row.name}', safe=':/')}"
            for left in reversed(range(TRIES)):
                request = urllib.request.Request(target, row.body.encode(), {"Content-Type": "application/n-triples"}, method=method)
                if token:
                    request.add_header("Authorization", f"Bearer {token() if callable(token) else token}")
                elif header:
                    request.add_header("Authorization", header)
                try:
                    send(request).close()
                    break
                except urllib.error.HTTPError as e:
                    if e.code not in (401, 407) or not left:
                        raise EndpointError(f"{target}: {e}") from e

    grouped.foreachPartition(post)


def client_token(url: str, client: str, password: str, scope: str, send: Callable = urllib.request.urlopen) -> Callable[[], str]:
    """What asks an OAuth2 server for a token by client credentials."""

    def fresh() -> str:
        body = urllib.parse.urlencode({"grant_type": "client_credentials", "client_id": secret(client), "client_secret": secret(password), "scope": scope}).encode()
        try:
            with send(urllib.request.Request(url, body, method="POST")) as answer:
                return json.loads(answer.read())["access_token"]
        except (OSError, ValueError, KeyError) as e:
            raise EndpointError(f"{url}: {e}") from e

    return fresh
