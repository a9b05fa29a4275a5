from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def messy(spark):
    """Documents with nulls in every column, empty and long texts, copies, repeated rows and a hot source."""
    rng = random.Random(3)
    base = " ".join(words(rng, 120))
    rows = [(1, base, "en", "hot", 1), (2, base, "en", "hot", 1), (2, base, "en", "hot", 1), (3, base + " tail of its own", None, "hot", None)]
    rows += [(4, "", "en", "a", 0), (5, None, "en", "a", 0), (6, " \n\t ", None, None, 4), (None, base, "en", "hot", 1), (None, "only here", None, None, None)]
    rows += [(7, "x", "de", "b", 1), (8, "A b\x0bC\fd  e", "de", "b", 1), (9, "Ünï 日本 🙂 " * 60, "de", "b", 1), (10, "ab " * 400, "en", "hot", 1)]
    rows += [(11, " ".join(words(rng, 60000, 9000)), "en", "hot", 1)]
    rows += [(100 + i, " ".join(words(rng, rng.randrange(1, 90))), "en", "hot" if i % 3 else f"s{i % 5}", i) for i in range(60)]
    passage = " ".join(words(rng, 35))
    rows += [(200 + i, f"{' '.join(words(rng, 15))} {passage} {' '.join(words(rng, 15))}", "en", "hot", i) for i in range(12)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
