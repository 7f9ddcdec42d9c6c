"""Information-theoretic sanitisation of personal data.

Protected entities are identifiers with a form of their own: e-mail addresses, telephone, card, account and social
security numbers, network addresses, keys, tokens and passwords. Each is replaced by its class. What stands around an
entity may reveal it too: for each word t of at least LEAST different contexts of one entity e (the whole documents that
hold it, without their identifiers; documents of the same words are one context) the corpus tells how many documents
hold both and how many hold t at all, copies counting in either. Of the IC(e) = -log2 p(e) bits that hide the entity
the word discloses PMI(e; t) = log2 p(e, t) / (p(e) p(t)), which leaves IC - PMI = -log2 p(e | t) bits. A word that
leaves at most REMOVE bits for some entity is removed wherever it occurs, one that leaves at most GENERALISE bits
becomes the class of words that it belongs to. Words are compared by their letters and digits, in lower case; marks
stay. Copies of a page, however many, are one context: they alone disclose nothing, and hide nothing.

Texts that hold neither stay as they are, byte by byte; NULL and empty texts too. A very long text is looked at whole,
as one context. Every row is judged by itself once the words are known, so repeated rows and NULL ids are no matter;
words that disclose equally much tie and are treated alike, and one that discloses several entities goes by the one it
discloses most. Extra columns are ignored, or carried by ``sanitise`` whatever their names, which keeps n_chars (if
there is one) in step. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from weftgraph.llm.kernel import arrow_map, mix, slices, span_hashes, spans, fold, unused, words
from weftgraph.session import shared_folder

LEAST = 3
#: Bits left of an entity's information.
REMOVE, GENERALISE = 0.25, 1.0
#: Words that are broadcast at most (8 bytes each); of more, those that a document holds are found by a shuffle.
BROADCAST_WORDS = 4_000_000
#: Entries of the sieve that spares the corpus' other words from being counted.
SIEVE = 1 << 22
SCHEMA = "doc_id long, text string, entities int, disclosing int"

_CLASSES = (
    ("EMAIL", r"[\w.+%-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("SECRET", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}|\bsk-[A-Za-z0-9_-]{20,}|\bxox[abprs]-[A-Za-z0-9-]{10,}|\beyJ[\w-]+\.[\w-]+\.[\w-]+|-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----)?"),
    ("SECRET", r"(?i:\b(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s*[=:]\s*)(?:\"[^\"\n]{4,}\"|'[^'\n]{4,}'|[^\s\"'<>]*[0-9][^\s\"'<>]*)"),
    ("IP", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w.]*\d)|(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    ("IBAN", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("CARD", r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"),
    ("SSN", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("PHONE", r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)\d{3}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])"),
)
_ENTITY = re.compile("|".join(f"(?P<c{k}>{p})" for k, (_, p) in enumerate(_CLASSES)))
#: What a text without it can't hold an entity.
_HINT = r"[0-9@]|\p{Nd}|PRIVATE KEY|AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|eyJ|(?:[A-Fa-f]{1,4}:){7}|(?i:pass|pwd|secret|token|key|auth)"
_WORD = re.compile(r"[^\W_]+")


def entities(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, class) of each protected entity."""
    for m in _ENTITY.finditer(text):
        yield m.start(), m.end(), _CLASSES[int(m.lastgroup[1:])][0]


def word_hashes(items: list[str]) -> np.ndarray:
    """The kernel's hash of each word."""
    raw = [w.encode() for w in items]
    data = np.frombuffer(b" ".join(raw), np.uint8) if raw else np.zeros(0, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    size = np.array([len(w) for w in raw])
    starts = np.concatenate([[0], np.cumsum(size[:-1] + 1)])
    return span_hashes(fold(data), starts, starts + size)


def _hinted(texts: pa.Array) -> list[int]:
    return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _HINT), False).to_numpy(zero_copy_only=False)).tolist()


def around(text: str) -> Iterator[tuple[str, list[str]]]:
    """(entity in normal form, words of its context) of each occurrence; the context is the text without identifiers."""
    found = list(entities(text))
    ends = [0, *(high for _, high, _ in found)]
    words = [w for a, b in zip(ends, [*(low for low, _, _ in found), len(text)]) for w in _WORD.findall(text[a:b])]
    for low, high, kind in found:
        entity = text[low:high].lower()
        yield f"{kind}:{entity if kind in ('EMAIL', 'SECRET', 'IP') else re.sub('[^0-9a-z]', '', entity)}", words


def _contexts(texts: pa.Array) -> Iterator[tuple[int, set[str], np.ndarray]]:
    """(context, its entities, hashes of its words) of each text with an entity; a context is the multiset of its words."""
    for k in _hinted(texts):
        own = list(around(texts[k].as_py()))
        if own:
            word = word_hashes(own[0][1])
            yield int(mix(word + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64).view(np.int64)), {name for name, _ in own}, word


def _named(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """entity, context: hashes of each entity and of the text that it is in."""
    names, places = [], []
    for context, own, _ in _contexts(batch.column(0)):
        names += own
        places += [context] * len(own)
    entity = word_hashes([n.encode().hex() for n in names])
    yield pa.RecordBatch.from_arrays([pa.array(entity.view(np.int64)), pa.array(np.array(places, np.int64))], ["entity", "context"])


def _marks(rows: DataFrame, name: str) -> np.ndarray:
    """The places of a sieve that hashes in a column have; SIEVE of them at most."""
    sieve = np.zeros(SIEVE, bool)
    sieve[rows.select(F.pmod(name, F.lit(SIEVE)).cast("int").alias("mark")).distinct().toArrow().column(0).to_numpy()] = True
    return sieve


def disclosing(docs: DataFrame, least: int = LEAST, generalise: float = GENERALISE) -> DataFrame:
    """word, bits: hash of each word that discloses an entity, and the bits it leaves; in the shared folder.

    One pass looks for entities; if none is in enough contexts that is all, else a second gathers the words of those
    contexts, and a third counts the documents of the words that go with an entity often enough.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    named = arrow_map(texts, _named, "entity long, context long").groupBy("entity", "context").agg(F.count("*").alias("documents")).checkpoint()
    often = named.groupBy("entity").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= least).select("entity")
    kept = named.join(often, "entity").checkpoint()
    held_contexts = _marks(kept, "context")
    if not held_contexts.any():
        return spark.createDataFrame([], "word long, bits double")
    shared_contexts = spark.sparkContext.broadcast(np.packbits(held_contexts))

    def gather(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sieve = np.unpackbits(shared_contexts.value)
        for context, _, word in _contexts(batch.column(0)):
            if sieve[context % SIEVE]:
                word = np.unique(word.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), context, np.int64)), pa.array(word)], ["context", "word"])

    inside = arrow_map(texts, gather, "context long, word long").distinct()
    both = kept.join(inside, "context").groupBy("entity", "word").agg(F.count("*").alias("contexts"), F.sum("documents").alias("together")).filter(F.col("contexts") >= least)
    both = both.groupBy("word").agg(F.max("together").alias("together")).checkpoint()
    sieve = _marks(both, "word")
    if not sieve.any():
        return spark.createDataFrame([], "word long, bits double")
    shared = spark.sparkContext.broadcast(np.packbits(sieve))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sieve = np.unpackbits(shared.value)
        for _, _, data, offsets in slices(batch.column(0)):
            word, first = words(data, offsets)
            own = np.repeat(np.arange(len(first) - 1), np.diff(first))
            held = sieve[(word & np.uint64(SIEVE - 1)).astype(np.int64)] > 0
            rows = np.unique(np.stack([own[held], word[held].view(np.int64)], 1), axis=0)
            word, n = np.unique(rows[:, 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], ["word", "n"])

    counted = arrow_map(texts, count, "word long, n long").groupBy("word").agg(F.sum("n").alias("documents"))
    bits = -F.log2(F.least(F.lit(1.0), F.col("together") / F.greatest("documents", "together")))
    return both.join(counted, "word").select("word", F.abs(bits).alias("bits")).filter(F.col("bits") <= generalise).checkpoint()


def general(word: str) -> str:
    """The class of words that stands for a word."""
    if any(c.isdigit() for c in word):
        return "[NUMBER]" if word.isdigit() else "[CODE]"
    return "[NAME]" if word[:1].isupper() else "[WORD]"


def clean(text: str, removed: set[int], generalised: set[int]) -> tuple[str, int, int]:
    """(text, number of entities, number of disclosing words): entities by class, words removed or generalised."""
    parts, at, changed = [], 0, 0

    def plain(piece: str) -> str:
        nonlocal changed
        if not removed and not generalised:
            return piece
        own = list(_WORD.finditer(piece))
        hashes = word_hashes([m[0] for m in own]).tolist()
        hits = [(m, h) for m, h in zip(own, hashes) if h in removed or h in generalised]
        if not hits:
            return piece
        out, last = [], 0
        for m, h in hits:
            out += [piece[last : m.start()], "[REMOVED]" if h in removed else general(m[0])]
            last = m.end()
            changed += 1
        return "".join(out) + piece[last:]

    number = 0
    for low, high, kind in entities(text):
        parts += [plain(text[at:low]), f"[{kind}]"]
        at = high
        number += 1
    parts.append(plain(text[at:]))
    return "".join(parts), number, changed


def _batch_cleaner(word: np.ndarray, bits: np.ndarray) -> Callable[[pa.Array], tuple[list, np.ndarray, np.ndarray]]:
    """Cleans texts of a batch; only those that may hold something are looked at."""
    order = np.argsort(word)
    word, bits = word[order], bits[order]
    sieve = np.zeros(1 << 16, bool)
    sieve[(word & np.uint64(0xFFFF)).astype(np.int64)] = True

    def run(texts: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        n = len(texts)
        todo = dict.fromkeys(_hinted(texts), ((), ()))
        if len(word):
            for low, _, data, offsets in slices(texts):
                own, first = words(data, offsets)
                at = np.flatnonzero(sieve[(own & np.uint64(0xFFFF)).astype(np.int64)])
                key = np.minimum(np.searchsorted(word, own[at]), len(word) - 1)
                hit = word[key] == own[at]
                at, key = at[hit], key[hit]
                rows = np.searchsorted(first, at, "right") - 1 + low
                cuts = np.flatnonzero(np.diff(rows, prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
                    keys = np.unique(key[a:b])
                    gone = bits[keys] <= REMOVE
                    todo[int(rows[a])] = (word[keys[gone]].tolist(), word[keys[~gone]].tolist())
        out: list = [None] * n
        number, changed = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for k, (removed, generalised) in todo.items():
            text, number[k], changed[k] = clean(texts[k].as_py(), set(removed), set(generalised))
            if number[k] or changed[k]:
                out[k] = text
        return out, number, changed

    return run


def _put(texts: pa.Array, new: list) -> pa.Array:
    """The texts, with those that have changed in their place."""
    return pc.coalesce(pa.array(new, texts.type), texts)


def _cleaned(docs: DataFrame, secret: DataFrame, text: str, number: str, changed: str) -> DataFrame:
    """docs with clean texts and two more columns, how many entities and words went."""
    spark = docs.sparkSession
    at = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(number, IntegerType()), StructField(changed, IntegerType())])
    if secret.count() <= BROADCAST_WORDS:
        rows = secret.toArrow()
        shared = spark.sparkContext.broadcast((rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()))
        made: list = []

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if not made:
                made.append(_batch_cleaner(*shared.value))
            new, n, m = made[0](batch.column(at))
            columns = batch.columns[:at] + [_put(batch.column(at), new)] + batch.columns[at + 1 :]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(m)], schema.names)

        return arrow_map(docs, work, schema)
    return _joined(docs, secret, text, number, changed)


def _joined(docs: DataFrame, secret: DataFrame, text: str, number: str, changed: str) -> DataFrame:
    """As _cleaned, for words too many to broadcast: each distinct text meets its own by a shuffle."""
    key, own = unused(docs, "text_key"), unused(docs, "text_words")

    def hold(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, _, data, offsets in slices(batch.column(1)):
            word, first = words(data, offsets)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first)) + low
            rows = np.unique(np.stack([row, word.view(np.int64)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[:, 0])), pa.array(rows[:, 1])], ["key", "word"])

    keyed = docs.withColumn(key, F.xxhash64(F.col(text)))
    held = arrow_map(keyed.select(F.col(key), F.col(text)), hold, "key long, word long").distinct()
    found = held.join(secret, "word").groupBy("key").agg(F.collect_list(F.struct("word", "bits")).alias(own)).withColumnRenamed("key", key)
    rows = keyed.join(found, key, "left")
    at, last = rows.columns.index(text), rows.columns.index(own)
    names = docs.columns
    where = [rows.columns.index(c) for c in names]
    schema = StructType([*docs.schema.fields, StructField(number, IntegerType()), StructField(changed, IntegerType())])

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        new, n, m = [], [], []
        for value, pairs in zip(batch.column(at).to_pylist(), batch.column(last).to_pylist()):
            split: tuple[set, set] = (set(), set())
            for pair in pairs or ():
                split[pair["bits"] > REMOVE].add(pair["word"] & (1 << 64) - 1)
            result = clean(value, *split) if value else (None, 0, 0)
            new.append(result[0] if result[1] or result[2] else None)
            n.append(result[1])
            m.append(result[2])
        columns = [_put(batch.column(k), new) if k == at else batch.column(k) for k in where]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int32()), pa.array(m, pa.int32())], schema.names)

    return arrow_map(rows, work, schema)


def sanitised(docs: DataFrame) -> DataFrame:
    """doc_id, text, entities, disclosing; a row for each document."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return _cleaned(rows, disclosing(docs), "text", "entities", "disclosing").select("doc_id", "text", "entities", "disclosing")


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with clean texts, with all their columns."""
    number = unused(docs, "entities")
    changed = unused(docs, "disclosing")
    columns = docs.columns
    done = _cleaned(docs, disclosing(docs), "text", number, changed)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.when(F.col(number) + F.col(changed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table without personal data."""
    return sanitised(spark.read.parquet(f"{sf_dir}/documents.parquet"))
