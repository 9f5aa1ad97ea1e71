"""Small documents with everything that real tables throw at an operator."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, kept string, size int, _row string, id int, s int, n_words string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng: random.Random, n: int, line: int = 9) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "ed"]) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) + "." for i in range(0, n, line))


def docs(spark: SparkSession, texts: list[tuple[int | None, str | None]], sources=("a", "b", None)) -> DataFrame:
    """Rows of (id, text) with further columns whose names clash with those inside the operators."""
    rows = [
        (i, t, sources[k % len(sources)], "en", None if t is None else len(t), "x", 1, "y", 2, 3, "z") for k, (i, t) in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def awkward(rng: random.Random) -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, a repeated row, copies, near copies, one long text, control characters."""
    base, other = prose(rng, 120), prose(rng, 90)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base), (2, None), (3, ""), (4, " \n\t "), (5, base), (6, near), (7, other), (7, other), (None, base), (8, "one"), (9, "one"),
        (10, prose(rng, 30) + "\n" + other + "\n" + prose(rng, 30)), (11, "same line here again and again\n" * 40), (12, "\x00\x01\x02 é ß 日本語   \U0001f600"),
        (13, prose(rng, 6000)), (14, "a" * 700), (15, "A" * 300 + "a" * 300), (16, base.upper()),
    ]
    return rows


def by_id(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
