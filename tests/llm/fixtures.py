"""Small tables with the awkward rows that every operator is held to."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _group string, shard int, digest string, score double"


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "er", "th", "ou", "is", "re", "ly", "on"]) for _ in range(r.randint(1, 3))) for _ in range(n))


def rows() -> list[tuple[int | None, str | None]]:
    """Null and empty texts, a null id, a repeated row, ties, copies, near copies, a very long text."""
    base = words(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    out = [(1, base), (2, base), (9, base), (3, near), (4, words(2, 100)), (5, None), (6, ""), (7, "   \n"), (8, "one two"), (10, "one two"), (11, words(3, 30_000)), (4, words(2, 100)), (None, words(4, 40)), (12, "Ünï cödé \U0001f600 日本語 " + words(5, 20)), (13, "a" * 5000)]
    return out + [(20 + i, words(50 + i, 30 + i)) for i in range(10)]


def docs(spark, data=None):
    """As a table with further columns whose names the operators might use themselves."""
    data = rows() if data is None else data
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "g", 1, "d", 0.5) for i, t in data], DOCS)
