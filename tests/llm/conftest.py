import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> list[str]:
    import random

    rng = random.Random(seed)
    return [rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "er"]) + str(rng.randint(0, 40)) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, near and exact copies, shared lines."""
    base = prose(1, 120)
    near = list(base)
    near[60] = "changed"
    shared = "This very line stands in many documents"
    rows = [
        (1, " ".join(base), "en", "a"),
        (2, " ".join(near), "en", "a"),
        (3, "  ".join(base).upper(), "en", "b"),
        (4, None, "en", "a"),
        (5, "", None, None),
        (6, " \t\n\x0b\x0c\r ", "en", "a"),
        (7, "two words", "en", "b"),
        (8, "TWO\nwords", "en", "b"),
        (None, " ".join(base), "en", "a"),
        (9, " ".join(prose(2, 60_000)), "fr", "a"),
        (10, shared + "\n" + " ".join(prose(3, 30)), "en", "c"),
        (11, "x\n  " + shared.upper() + "\r\nend\n", "en", "c"),
        (12, shared + "\n" + shared + "\nlast", "en", None),
        (12, shared + "\n" + shared + "\nlast", "en", None),
        (13, "naïve Ünïcode — 日本語 text with <|endoftext|> 🙂\n\n\nend", "de", "a"),
        (14, "a" * 200_000, "en", "a"),
        (15, "x\n" * 3000 + shared, "en", "a"),
    ]
    return [(i, t, lang, src, len(t or "")) for i, t, lang, src in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with extra columns whose names operators also use."""
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(odd_rows, DOC).repartition(3)
    return frame.withColumns({c: F.lit("mine") for c in ("n_lines", "n_dropped", "mix_slot", "score", "keep_id", "row1", "id", "comp", "m", "label", "fold", "payload")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOC)
