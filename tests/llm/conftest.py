from __future__ import annotations

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, n_words long, key string, _key long, _score double, copy_id string, labels string, words string, bucket int, x int"
WORDS = [a + b for a in "ba ka mo ri tu pe shi wa lor gen".split() for b in ("n", "s", "la", "ri", "to", "mer")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    base = prose(1, 300)
    near = base.replace(base.split()[150], "changed", 1)
    out = [
        (1, base), (2, base), (3, near), (4, prose(2, 200)), (4, prose(3, 40)), (None, prose(4, 60)), (5, None), (6, ""), (7, " \n\t "), (8, "one two three"), (9, "one two three"),
        (10, "\u00e9\u4e2d\U0001f389 " * 30), (11, "word " * 400), (11, "word " * 400), (12, "\0 \x1c\x85 \u3000x"), (None, None), (13, prose(5, 20_000)), (14, "a" * 5000), (-(2**63), prose(6, 30)), (2**63 - 1, prose(7, 30)),
        (15, "###" * 50 + " " + prose(8, 50)), (16, "\n".join(["same line of words here"] * 30)),
    ]
    return out + [(100 + i, prose(100 + i, 20 + 13 * i)) for i in range(30)]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty, short and long texts, copies, repeated rows and columns named like results."""
    rows = [(i, t, None if k % 3 else "en", "s", None, 0.5, None, k, "k", k, None, "c", None, "w", k, k) for k, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).checkpoint()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
