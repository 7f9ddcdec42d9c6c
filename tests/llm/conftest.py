import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASHING = "key string, bands string, rank string, share string, tokens string, score string, keep string, entities string, disclosing string, text_key string, word string, place string"


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n)).capitalize() + "."


def edited(text, seed, n):
    """The text with n of its words replaced, dropped or doubled."""
    rng = random.Random(seed)
    words = text.split()
    for at in sorted(rng.sample(range(len(words)), n), reverse=True):
        words[at : at + 1] = rng.choice([["zzqx"], [], [words[at], words[at] + "q"]])
    return " ".join(words)


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, extra=False):
        rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in rows]
        if extra:
            names = [x.split()[0] for x in CLASHING.split(", ")]
            return spark.createDataFrame([(*r, *names) for r in rows], f"{SCHEMA}, {CLASHING}")
        return spark.createDataFrame(rows, SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd():
    """Rows that every operator must bear: NULL ids and texts, empty, blank, very long, repeated and tied ones."""
    return [(None, prose(1)), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, prose(2, 60_000)), (5, prose(3)), (5, prose(3)), (6, prose(3)), (7, "x"), (8, "é" * 50_000), (9, "!?. --")]
