"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Texts are folded to lower case without accents, homoglyphs (Cyrillic, Greek, full-width and mathematical letters) and
digit or sign substitutions are replaced by the Latin letter they stand for, and invisible characters are dropped; the
lexicon is folded in the same way, where i, l and 1 are one letter. Runs of signs count as letters beside letters. A
term counts where it is a whole word (of overlapping terms the longest, of equally long ones the first), unless an
exception phrase covers it. The score is the sum of the weights over the square root of the number of words; a document
is toxic from THRESHOLD on. Terms with separators between their letters are not found.

NULL and empty texts have score 0; a very long text is scored whole. Every row is judged by itself, so repeated rows
and NULL ids are no matter; extra columns, whatever their names, are ignored, or carried by ``drop_toxic``. An empty
table gives no rows.

The built-in terms are joined by those that the labels teach: words of toxic documents that stand there in at least
SUPPORT different contexts (neighbouring words, so that copies of a document count once), at least PURITY of whose
occurrences in labelled documents are toxic, and for which chance is ruled out (a likelihood ratio test, corrected for
the number of words tested). Their weight is a quarter of the log odds ratio, at most 1.5. Words of any length are
tested. Without labels the built-in terms stand alone.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.kernel import arrow_map, with_label
from weftgraph.session import shared_folder

#: Different contexts in toxic documents, and toxic share of the occurrences, that a word from the labels needs.
SUPPORT, PURITY = 3, 0.8
#: Chance that any word at all is taken up wrongly.
ERROR = 0.01
#: MB of terms from the labels beyond which the lexicon is refused, as workers hold it in memory.
LEXICON_MB = 64
SCHEMA = "doc_id long, score double, hits int, terms array<string>, toxic boolean"
#: Score from which a document is toxic: one term of weight 1 in 400 words, or two in 1,600.
THRESHOLD = 0.05
LEXICON = {
    "idiot": 1.0, "idiots": 1.0, "idiotic": 0.8, "moron": 1.0, "morons": 1.0, "moronic": 0.9, "imbecile": 1.0, "imbeciles": 1.0,
    "stupid": 0.8, "stupidity": 0.5, "dumb": 0.6, "dumbass": 1.2, "dimwit": 0.9, "halfwit": 0.9, "fool": 0.5, "loser": 0.9, "losers": 0.9,
    "clown": 0.6, "clowns": 0.6, "scum": 1.2, "scumbag": 1.3, "trash": 0.6, "garbage": 0.5, "filth": 0.9, "vermin": 1.0, "pathetic": 0.8,
    "worthless": 0.9, "disgusting": 0.9, "despicable": 0.8, "repulsive": 0.8, "revolting": 0.7, "creep": 0.7, "pervert": 1.2,
    "degenerate": 0.8, "lowlife": 1.1, "retard": 1.5, "retarded": 1.4, "freak": 0.6, "jerk": 0.7, "bastard": 1.2, "bastards": 1.2,
    "bitch": 1.4, "bitches": 1.4, "asshole": 1.4, "assholes": 1.4, "fuck": 1.3, "fucking": 1.3, "fucker": 1.5, "motherfucker": 1.6, "shit": 1.0,
    "bullshit": 1.0, "crap": 0.5, "cunt": 1.6, "dick": 0.8, "dickhead": 1.3, "prick": 1.0, "slut": 1.5, "whore": 1.5, "twat": 1.3, "wanker": 1.2,
    "kill yourself": 2.0, "go to hell": 1.2, "shut up": 0.6, "drop dead": 1.2, "piece of shit": 1.6, "hate you": 0.9,
    "dummkopf": 0.9, "arschloch": 1.4, "schwachkopf": 1.0, "vollidiot": 1.1, "abschaum": 1.2, "trottel": 0.8, "miststück": 1.3,
    "connard": 1.4, "salope": 1.5, "imbécile": 1.0, "crétin": 1.0, "abruti": 0.9, "enfoiré": 1.3,
    "pendejo": 1.2, "gilipollas": 1.2, "imbécil": 1.0, "cabrón": 1.2, "estúpido": 0.8, "idiota": 1.0, "escoria": 1.0, "basura humana": 1.4,
}
#: Phrases within which a term isn't meant.
EXCEPTIONS = (
    "trash can", "trash cans", "trash bin", "trash bag", "trash collection", "take out the trash", "garbage collection", "garbage collector", "garbage can", "garbage truck",
    "clown fish", "circus clown", "rodeo clown", "class clown", "pond scum", "idiot proof", "idiot light", "moby dick", "dick tracy", "dick cheney", "philip k dick", "sore loser",
    "april fool", "fool proof", "jerk chicken", "jerk seasoning", "jerk reaction", "dumb waiter", "dumb bell", "deaf and dumb", "freak accident", "freak wave", "degenerate matter", "degenerate case",
    "winner and loser", "creep up", "feature creep", "mission creep", "scope creep",
)
_LATIN = {
    "a": "аα4ɑ", "b": "ЬƄβ8", "c": "сϲᴄ", "d": "ԁɗ", "e": "еε3єҽ", "f": "ƒ", "g": "ɡց", "h": "һн", "i": "іιӏӀıℓl1", "j": "јϳ", "k": "кκ", "m": "м", "n": "пոη",
    "o": "оο0օσ", "p": "рρ", "q": "ԛ", "r": "гᴦ", "s": "ѕ5ꜱ", "t": "тτ7", "u": "υսцᴜ", "v": "νѵ", "w": "ԝωш", "x": "хχ×", "y": "уγү", "z": "ᴢ",
}
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


def _table() -> dict[int, str]:
    """Each character that isn't itself already, with what it is folded to."""
    found: dict[int, str] = {}
    for code in range(0x80, 0x1D800):
        base = unicodedata.normalize("NFKD", chr(code))
        plain = "".join(c for c in base if not unicodedata.combining(c)).lower()
        if len(plain) == 1 and plain != chr(code):
            found[code] = plain
    for letter, others in _LATIN.items():
        for other in others:
            found[ord(other)] = letter
            for upper in (other.upper(), other.lower()):
                if len(upper) == 1 and not upper.isascii():
                    found[ord(upper)] = letter
    for code, plain in list(found.items()):
        found[code] = found.get(ord(plain), plain)
    for code in range(ord("A"), ord("Z") + 1):
        low = chr(code + 32)
        found[code] = found.get(ord(low), low)
    return found | {ord(c): "" for c in _INVISIBLE} | {ord("ß"): "ss"} | dict.fromkeys(range(0x300, 0x370), "")


FOLDED = _table()
_ASCII = str.maketrans({k: v for k, v in FOLDED.items() if k < 128})
#: Runs of signs stand for letters where letters or digits are on both sides, or behind those that begin a word; $ also at the end of letters.
_SIGN = re.compile(r"(?<=\w)[!|+@$]+(?=\w)|[@$]+(?=\w)|(?<=[^\W\d_])\$+(?!\w)")
_SIGNS = str.maketrans("!|+@$", "iitas")
_GAP = re.compile(r"[\s\-_]{2,}|[^\S ]|[-_]")
#: Words, for the length of a text, and as the labels teach them.
MANY = re.compile(r"\S+")
_TERM = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The text as it is matched."""
    if any(c in text for c in "!|+@$"):
        text = _SIGN.sub(lambda m: m[0].translate(_SIGNS), text)
    return _GAP.sub(" ", text.translate(_ASCII if text.isascii() else FOLDED))


class Matcher:
    """A compiled lexicon; terms and phrases of several words match across any blanks, hyphens or underscores."""

    def __init__(self, lexicon: dict[str, float] | None = None, exceptions: tuple[str, ...] | None = None):
        self.tree = ahocorasick.Automaton()
        lexicon = LEXICON if lexicon is None else lexicon
        for entry, weight in [*lexicon.items(), *((x, None) for x in (EXCEPTIONS if exceptions is None else exceptions))]:
            if text := fold(entry).strip():
                self.tree.add_word(text, (len(text), weight, entry))
        if len(self.tree):
            self.tree.make_automaton()

    def find(self, text: str | None) -> list[tuple[str, float]]:
        """(term, weight) of each hit, in order of place."""
        if not text or not len(self.tree):
            return []
        flat = fold(text)
        spans = []
        for end, (n, weight, entry) in self.tree.iter(flat):
            low = end + 1 - n
            if (low == 0 or not flat[low - 1].isalnum()) and (end + 1 == len(flat) or not flat[end + 1].isalnum()):
                spans.append((weight is not None, -n, low, low + n, weight, entry))
        spans.sort(key=lambda s: s[:3])
        taken: list[tuple[int, int]] = []
        found = []
        for _, _, low, high, weight, entry in spans:
            at = bisect_left(taken, (low, high))
            if at and taken[at - 1][1] > low or at < len(taken) and taken[at][0] < high:
                continue
            taken.insert(at, (low, high))
            if weight is not None:
                found.append((low, entry, weight))
        return [(entry, weight) for _, entry, weight in sorted(found)]

    def score(self, text: str | None) -> tuple[float, list[str]]:
        """(score, terms found)."""
        found = self.find(text)
        if not found:
            return 0.0, []
        return sum(w for _, w in found) / math.sqrt(sum(1 for _ in MANY.finditer(text))), [t for t, _ in found]


def _terms(flat: str) -> list[str]:
    return _TERM.findall(flat)


def _toxic_contexts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """term, context of each word; the contexts are hashes of the words on either side."""
    terms: list[str] = []
    around: list[int] = []
    for text in batch.column(0).to_pylist():
        words = _terms(fold(text or ""))
        marks = [zlib.crc32(w.encode()) for w in ["", *words, ""]]
        seen = set(zip(words, (a << 32 | b for a, b in zip(marks, marks[2:]))))
        terms += [w for w, _ in seen]
        around += [c - (1 << 63) for _, c in seen]
    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(around, pa.int64())], ["term", "context"])


def learn(docs: DataFrame, labels: DataFrame, support: int = SUPPORT, purity: float = PURITY, error: float = ERROR) -> dict[str, float]:
    """Terms and weights from all labelled documents."""
    spark = docs.sparkSession
    shared_folder(spark)
    texts = with_label(docs.select("doc_id", F.col("text").cast("string").alias("text")), labels, "toxic", "toxic")
    pairs = arrow_map(texts.filter("toxic = 1").select("text"), _toxic_contexts, "term string, context long").distinct()
    found = pairs.groupBy("term").agg(F.count("*").alias("toxic")).checkpoint()
    tokens = found.agg(F.sum("toxic"), F.count("*")).first()
    if not tokens[0]:
        return {}
    candidates = found.filter(F.col("toxic") >= support)
    marks = np.zeros(1 << 20, bool)
    marks[[r[0] for r in candidates.select((F.crc32(F.col("term").cast("binary")) % (1 << 20)).cast("int").alias("mark")).distinct().collect()]] = True
    shared = spark.sparkContext.broadcast(np.packbits(marks))

    def clean(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sieve = np.unpackbits(shared.value)
        often: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            often.update(_terms(fold(text or "")))
        rows = [("", often.total()), *((w, n) for w, n in often.items() if sieve[zlib.crc32(w.encode()) & 0xFFFFF])]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["term", "n"])

    counted = arrow_map(texts.filter("toxic = 0").select("text"), clean, "term string, n long").groupBy("term").agg(F.sum("n").alias("clean")).checkpoint()
    total = counted.filter("term = ''").first()
    share = tokens[0] / (tokens[0] + (total.clean if total else 0))
    if share == 1:
        return {}
    need = math.log(max(1, tokens[1]) / error)
    rows = candidates.join(counted, "term", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
    n, rate = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    surprise = F.col("toxic") * F.log(rate / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - share))).otherwise(0)
    odds = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5) * F.lit((1 - share) / share))
    kept = rows.filter((rate >= purity) & (n > 0) & (rate > share) & (surprise >= need)).select("term", F.round(F.least(odds / 4, F.lit(1.5)), 6).alias("weight")).checkpoint()
    size = kept.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if size > LEXICON_MB * 1e6:
        raise ValueError(f"the labels teach {size / 1e6:.0f} MB of terms; raise support or purity")
    return {r.term: r.weight for r in kept.collect()}


def lexicon_of(docs: DataFrame, labels: DataFrame) -> dict[str, float]:
    """The built-in lexicon and what the labels add to it."""
    known = {fold(entry) for entry in LEXICON}
    return LEXICON | {t: w for t, w in learn(docs, labels).items() if t not in known}


def scored(docs: DataFrame, lexicon: dict[str, float] | None = None, exceptions: tuple[str, ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, hits, terms (distinct, in order of the alphabet), toxic; a row for each document."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    made: list[Matcher] = []

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(lexicon, exceptions))
        results = [made[0].score(text.as_py()) for text in batch.column(1)]
        scores = [round(s, 9) for s, _ in results]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(scores, pa.float64()), pa.array([len(t) for _, t in results], pa.int32()), pa.array([sorted(set(t)) for _, t in results], pa.list_(pa.string())), pa.array([s >= threshold for s in scores], pa.bool_())],
            ["doc_id", "score", "hits", "terms", "toxic"],
        )

    return arrow_map(rows, work, SCHEMA)


def drop_toxic(docs: DataFrame, lexicon: dict[str, float] | None = None, exceptions: tuple[str, ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that aren't toxic, with all their columns."""
    text = docs.columns.index("text")
    made: list[Matcher] = []

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not made:
            made.append(Matcher(lexicon, exceptions))
        yield batch.filter(pa.array([round(made[0].score(t.as_py())[0], 9) < threshold for t in batch.column(text)], pa.bool_()))

    return arrow_map(docs, work, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, by the built-in lexicon and the words that all labels teach."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, lexicon_of(docs, labels))
