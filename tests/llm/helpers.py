"""Small awkward tables and brute-force versions."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def frame(spark, rows):
    """(doc_id, text) rows with null columns and a column name that clashes with outputs."""
    return spark.createDataFrame([(d, t, None, None, None, 0.5) for d, t in rows], SCHEMA)


def words(text):
    return WORD.findall((text or "").encode())


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 8))) for _ in range(n))


def awkward_rows():
    """Nulls, empty and long texts, ties and repeated rows, shared passages."""
    shared = prose(1, 120)
    long = prose(2, 3000)
    return [
        (0, None),
        (1, ""),
        (2, " \t\n\x0b\x0c\r "),
        (3, shared),
        (4, "start " + shared + " end"),
        (5, prose(3, 30) + "\n" + shared[40:] + " " + prose(4, 60)),
        (6, long),
        (7, long),
        (7, long),
        (7, prose(5, 80)),
        (8, "the " * 300),
        (9, "a" * 1500),
        (None, shared + " " + prose(6, 20)),
        (None, prose(7, 90)),
        (10, prose(7, 90) + " x"),
        (11, "word"),
        (12, "word"),
    ]


def labelled_shingles(text):
    w = words(text)
    seen: Counter = Counter()
    out = []
    for i in range(max(len(w) - 4, 1 if w else 0)):
        s = tuple(w[i : i + 5])
        out.append((s, seen[s]))
        seen[s] += 1
    return out
