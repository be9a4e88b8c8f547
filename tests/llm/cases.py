"""Small tables with the awkward cases, for all operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, rate string, row int, ids string"

_rng = random.Random(5)
_WORDS = ["the", "of", "lamp", "river", "stone", "Über", "naïve", "walk", "seven", "quiet", "metal", "x1", "日本", "road"]


def prose(n: int, seed: int | None = None) -> str:
    r = random.Random(seed) if seed is not None else _rng
    return " ".join(r.choice(_WORDS) + (str(r.randrange(40)) if r.random() < 0.6 else "") for _ in range(n))


def awkward(spark):
    """Nulls in every column, empty and blank texts, ties, repeated rows, a
    very long text, and extra columns named like the operators' own."""
    base = prose(120, 1)
    near = base.split(" ")
    near[60] = "changed"
    texts = [(1, base), (2, base), (3, " ".join(near)), (4, ""), (5, None), (6, " \t\n "), (7, "one two"),
             (8, "One\tTWO"), (9, prose(40, 2) + "\n" + prose(40, 3) + "\n" + prose(40, 2)), (10, prose(40, 3) + "\n\n---\n" + prose(9, 4)),
             (11, prose(30000, 5)), (12, "a" * 3000), (None, base), (None, None), (13, prose(60, 6)), (13, prose(60, 6)),
             (14, "\n".join([prose(60, 7)] * 5)), (15, "😀 " * 300), (16, "x  y   z ▁ w\0v")]
    rows = [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, k, "r", 7, "i")
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
