"""Small documents with every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string, set string, words string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    base = words(rng, 120)
    w = base.split()
    near = [" ".join([*w[:k], "changed", *w[k + 1 :]]) for k in (10, 60, 110)]
    half = " ".join([*w[:60], *words(rng, 60).split()])
    rows = [(1, base), (2, base), (3, near[0]), (4, near[1]), (5, near[2]), (6, half), (7, None), (8, ""), (9, " \n\t "), (10, "one two three"), (11, "One TWO three"), (12, words(rng, 20_000)), (13, "é É ſ " * 9), (1, base), (1, words(rng, 30)), (None, base), (None, None), (14, "a b c d e f g " * 40), (15, "x\n" * 30 + words(rng, 40)), (16, "one <|endoftext|> two <|startoftext|>")]
    return rows + [(20 + i, words(rng, rng.randint(1, 200))) for i in range(30)]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "s", None if t is None else len(t), "clash", "clash", "clash") for i, t in texts()]
    return spark.createDataFrame(rows, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
