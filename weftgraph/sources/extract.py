"""Texts of binary documents: a text-extraction server, and words and drawings of PDF files.

An extractor is a function of a file's bytes and path that gives text or XHTML; it runs in the workers.
"""

from __future__ import annotations

import os
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

Extractor = Callable[[bytes, str], str | None]
LOCAL = "http://localhost:9998/tika"
_OFF = ("", "-", "none")


class ExtractionError(RuntimeError):
    """A file that gives no text."""


def decoded(data: bytes, path: str) -> str:
    """Files that are text already."""
    return data.decode("utf-8", "replace")


def opener(url: str, proxy: str | None = None) -> Callable:
    """What opens requests: through the proxy, or without any if it is "", "-" or none, or the server is this machine."""
    host = urllib.parse.urlsplit(url).hostname or ""
    if proxy is None and host not in ("localhost", "127.0.0.1", "::1"):
        return urllib.request.urlopen
    off = proxy is None or proxy.strip().lower() in _OFF
    return urllib.request.build_opener(urllib.request.ProxyHandler({} if off else {"http": proxy, "https": proxy})).open


def server(url: str | None = None, proxy: str | None = None, send: Callable | None = None) -> Extractor:
    """An extractor that asks an Apache Tika server, by default the one in TIKA_ENDPOINT or on this machine."""
    url = url or os.environ.get("TIKA_ENDPOINT") or LOCAL
    if url.lower() in ("lh", "local", "localhost"):
        url = LOCAL

    def extract(data: bytes, path: str) -> str:
        request = urllib.request.Request(url, data, {"Accept": "text/html", "Content-Type": "application/octet-stream"}, method="PUT")
        try:
            with (send or opener(url, proxy))(request) as answer:
                return answer.read().decode("utf-8", "replace")
        except OSError as e:
            raise ExtractionError(f"{path}: {e}") from e

    return extract


def by_extension(extractors: dict[str, Extractor], other: Extractor = decoded) -> Extractor:
    """An extractor that goes by the file's extension (".pdf"), in any case."""
    known = {k.lower(): v for k, v in extractors.items()}

    def extract(data: bytes, path: str) -> str | None:
        return known.get(os.path.splitext(path)[1].lower(), other)(data, path)

    return extract


def pdf_pages(data: bytes) -> Iterator[tuple[int, list[tuple], list[tuple]]]:
    """(page, words (x0, y0, x1, y1, text), rectangles (x0, y0, x1, y1)) of a PDF file, where PyMuPDF is installed."""
    try:
        import pymupdf
    except ImportError as e:
        raise ExtractionError("PDF files need PyMuPDF, or a reader of one's own") from e
    with pymupdf.open(stream=data, filetype="pdf") as document:
        for number, page in enumerate(document):
            yield number, [tuple(w[:5]) for w in page.get_text("words")], [tuple(d["rect"]) for d in page.get_drawings()]


def pdf(read: Callable[[bytes], Iterator[tuple[int, list[tuple], list[tuple]]]] = pdf_pages, pages: set[int] | None = None) -> Extractor:
    """An extractor of PDF files by page layout; pages: numbers from 0 on, all by default."""

    def extract(data: bytes, path: str) -> str:
        from weftgraph.operators.layout import Box, Line, recognise

        parts = [recognise([Line(Box(*w[:4]), w[4]) for w in words], [Box(*r) for r in rects], number) for number, words, rects in read(data) if pages is None or number in pages]
        return "<html><body>\n" + "".join(parts) + "</body></html>"

    return extract


def page_tables(spark: SparkSession, *patterns: str, read: Callable[[bytes], Iterator[tuple[int, list[tuple], list[tuple]]]] = pdf_pages, pages: set[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(words, rectangles) of PDF files, for the operators of ``operators.layout``; the files' paths are their doc_id."""
    raw = spark.read.format("binaryFile").load(list(patterns)).select("path", "content")

    def work(words: bool):
        def run(batches):
            for batch in batches:
                for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    for number, texts, boxes in read(data):
                        own = texts if words else boxes
                        if own and (pages is None or number in pages):
                            columns = [pa.array([path] * len(own)), pa.array([number] * len(own), pa.int32()), pa.array(range(len(own)), pa.int64())]
                            columns += [pa.array([float(x[k]) for x in own]) for k in range(4)] + ([pa.array([x[4] for x in own])] if words else [])
                            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "page", "word_no" if words else "rect_no", "x0", "y0", "x1", "y1", *["text"] * words])

        return run

    box = "x0 double, y0 double, x1 double, y1 double"
    return raw.mapInArrow(work(True), f"doc_id string, page int, word_no long, {box}, text string"), raw.mapInArrow(work(False), f"doc_id string, page int, rect_no long, {box}")

