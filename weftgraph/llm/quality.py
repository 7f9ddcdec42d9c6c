"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each document is described by statistics of its bytes, words and lines; shares are smoothed towards a usual value, so
that short texts don't look extreme, and spread by an arcsine transform, counts by a logarithm. For either quality in
the labels a normal distribution is fitted; its covariance is shrunk towards the pooled one (the more, the fewer its
documents) and the result towards a multiple of the identity. The score is the difference of the log densities and
log priors, from squared Mahalanobis lengths with inverse Cholesky factors that are computed once and cached in the
model. Documents with a score below THRESHOLD are rejected.

Of the labels at most SAMPLE documents are used to fit (the bound is a parameter; those whose hashed doc_id is least).
NULL, empty and wordless texts have score NULL and are rejected; a very long text is described whole. If either
quality has fewer than two labelled documents, no model exists: scores are NULL and all documents with words are kept.
Of several labels of a document the highest counts, and documents of one doc_id each count with it. Every row is judged
by itself, so repeated rows and NULL ids are no matter, equal texts tie, and a score of exactly THRESHOLD is kept; extra
columns, whatever their names, are ignored, or carried by ``drop_low``. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.kernel import arrow_map, mix, slices, span_hashes, spans, fold, with_label

#: Labelled documents that the model is fitted to, at most.
SAMPLE = 200_000
#: Clean text is worth more than junk costs: a document goes only if it is e**10 times as likely to be of low quality.
THRESHOLD = -10.0
#: Documents of a class at which half of its covariance is the pooled one; share of the identity.
HALF, RIDGE = 50, 0.02
#: Standard deviations beyond which a statistic counts as this far out.
REACH = 6.0
NAMES = ("words", "word_length", "symbols", "capitals", "digits", "stops", "marks", "lines", "blanks", "foreign", "repeated_words", "repeated_triples", "repeated_lines", "spread")
SCHEMA = "doc_id long, score double, keep boolean"

_CLASS = np.zeros((8, 256), bool)
_LETTER, _CAPITAL, _DIGIT, _STOP, _SYMBOL, _LINE, _BLANK, _FOREIGN = range(8)
for _c in range(256):
    _s = chr(_c)
    _CLASS[_CAPITAL, _c] = "A" <= _s <= "Z"
    _CLASS[_LETTER, _c] = "a" <= _s <= "z" or "A" <= _s <= "Z" or _c >= 0xC0
    _CLASS[_DIGIT, _c] = "0" <= _s <= "9"
    _CLASS[_STOP, _c] = _s in ".,;:?'\"-()"
    _CLASS[_SYMBOL, _c] = 33 <= _c < 127 and not _s.isalnum() and _s not in ".,;:?!'\"-()"
    _CLASS[_LINE, _c] = _s == "\n"
    _CLASS[_BLANK, _c] = _s in " \t\r"
    _CLASS[_FOREIGN, _c] = _c >= 0xC0
_MARK = np.arange(256) == ord("!")


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _distinct(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of distinct values of each text."""
    size = np.diff(first)
    own = np.repeat(np.arange(len(size), dtype=np.uint64), size)
    _, at = np.unique(mix(values + own * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(own[at].astype(np.int64), minlength=len(size)).astype(float)


def _share(part: np.ndarray, whole: np.ndarray, usual: float, weight: float = 40.0) -> np.ndarray:
    """Arcsine of the smoothed share."""
    return np.arcsin(np.sqrt(np.clip((part + usual * weight) / (whole + weight), 0, 1)))


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of statistics for each text, its number of words)."""
    bytes_ = np.diff(offsets).astype(float)
    kind = {k: _sums(_CLASS[k][data], offsets) for k in range(8)}
    marks = _sums(_MARK[data], offsets)
    low = fold(data)
    starts, ends, first = spans(data, offsets)
    count = np.diff(first).astype(float)
    length = (ends - starts).astype(float)
    hashes = span_hashes(low, starts, ends)
    mean = (_sums(length, first) + 5 * 10) / (count + 10)
    square = (_sums(length**2, first) + 40 * 10) / (count + 10)
    words = np.maximum(count, 1)
    triples = np.maximum(count - 2, 0)
    if len(hashes) > 2:
        three = mix(hashes[:-2] * np.uint64(3) + hashes[1:-1] * np.uint64(0x9FB21C651E98DF25) + hashes[2:] * np.uint64(0xD6E8FEB86659FD93))
        own = np.repeat(np.arange(len(count)), np.diff(first))
        inside = own[:-2] == own[2:]
        bound = np.concatenate([[0], np.cumsum(np.bincount(own[:-2][inside], minlength=len(count)))]).astype(np.int64)
        alike = triples - _distinct(three[inside], bound)
    else:
        alike = np.zeros(len(count))
    line_starts, line_ends, line_first = spans(data, offsets, ~_CLASS[_LINE])
    lines = np.diff(line_first).astype(float)
    same_lines = lines - _distinct(span_hashes(low, line_starts, line_ends), line_first)
    columns = (
        np.log1p(count),
        np.log(mean),
        _share(kind[_SYMBOL], bytes_, 0.002),
        _share(kind[_CAPITAL], kind[_LETTER], 0.03),
        _share(kind[_DIGIT], bytes_, 0.003),
        _share(kind[_STOP], bytes_, 0.02),
        _share(marks, bytes_, 0.001),
        _share(kind[_LINE], bytes_, 0.004),
        _share(kind[_BLANK], bytes_, 0.15),
        _share(kind[_FOREIGN], kind[_LETTER], 0.03),
        np.log(np.maximum(_distinct(hashes, first), 1)) / np.log(words + 1),
        _share(alike, triples, 0.02),
        _share(same_lines, lines, 0.02, 20.0),
        np.log(np.maximum(square - mean**2, 0.1)),
    )
    return np.stack(columns, 1), count


@dataclass
class Model:
    """Centre and scale of the statistics; of either class (low, high) the mean, inverse Cholesky factor and offset."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]

    def standard(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.centre) / self.scale, -REACH, REACH)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Log density of high quality less that of low quality, with priors."""
        x = self.standard(rows)
        low, high = (c - 0.5 * (((x - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.means, self.factors, self.offsets))
        return high - low


def fit_moments(counts: list[float], sums: list[np.ndarray], squares: list[np.ndarray], half: float = HALF, ridge: float = RIDGE) -> Model | None:
    """The model from number, sum and sum of outer products of either class's statistics."""
    if min(counts) < 2:
        return None
    total = sum(counts)
    centre = sum(sums) / total
    scale = np.sqrt(np.maximum(np.diag(sum(squares)) / total - centre**2, 1e-6))
    means, covariances = [], []
    for n, s, q in zip(counts, sums, squares):
        mean = s / n
        covariances.append((q / n - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - centre) / scale)
    pooled = sum(n * c for n, c in zip(counts, covariances)) / total
    factors, offsets = [], []
    for n, own in zip(counts, covariances):
        weight = half / (half + n)
        mixed = (1 - weight) * own + weight * pooled
        mixed = (1 - ridge) * mixed + ridge * max(np.trace(mixed) / len(mixed), 1e-3) * np.eye(len(mixed))
        root = np.linalg.cholesky((mixed + mixed.T) / 2)
        factors.append(np.linalg.inv(root))
        offsets.append(math.log(n / total) - float(np.log(np.diag(root)).sum()))
    return Model(centre, scale, means, factors, offsets)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model for labelled documents; None if a class is missing. Only sums go to the driver."""
    own = labels.filter("doc_id is not null and quality in (0, 1)").select("doc_id", "quality")
    if own.count() > sample:
        own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = with_label(docs.select("doc_id", F.col("text").cast("string").alias("text")), own, "quality", "quality").select("quality", "text")
    d = len(NAMES)

    def moments(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        quality = batch.column(0).to_numpy()
        sums = np.zeros((2, 1 + d + d * d))
        for low, high, data, offsets in slices(batch.column(1)):
            rows, words = statistics(data, offsets)
            for k in (0, 1):
                x = rows[(quality[low:high] == k) & (words > 0)]
                sums[k] += np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
        width = sums.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([0, 1], width).astype(np.int32)), pa.array(np.tile(np.arange(width, dtype=np.int32), 2)), pa.array(sums.ravel())], ["k", "place", "value"])

    found = np.zeros((2, 1 + d + d * d))
    for row in arrow_map(texts, moments, "k int, place int, value double").groupBy("k", "place").agg(F.sum("value").alias("value")).collect():
        found[row.k, row.place] = row.value
    return fit_moments([float(r[0]) for r in found], [r[1 : 1 + d] for r in found], [r[1 + d :].reshape(d, d) for r in found])


def _scores(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(score, NaN without words or a model; whether the document is kept)."""
    scores, keep = np.full(len(texts), np.nan), np.zeros(len(texts), bool)
    for low, high, data, offsets in slices(texts):
        rows, words = statistics(data, offsets)
        full = words > 0
        if model is None:
            keep[low:high] = full
        elif full.any():
            own = np.full(high - low, np.nan)
            own[full] = model.score(rows[full])
            scores[low:high] = own
            keep[low:high] = own >= THRESHOLD
    return scores, keep


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, keep; a row for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        scores, keep = _scores(shared.value, batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(scores, 6), from_pandas=True), pa.array(keep)], ["doc_id", "score", "keep"])

    return arrow_map(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), work, SCHEMA)


def drop_low(docs: DataFrame, model: Model | None) -> DataFrame:
    """The documents that aren't rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield batch.filter(pa.array(_scores(shared.value, batch.column(text))[1]))

    return arrow_map(docs, work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document, by a model of the labels."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, fit(docs, labels))
