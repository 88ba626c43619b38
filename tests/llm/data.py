"""Hand-made rows for the edge cases that every operator must take."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Further columns whose names clash with those that operators add.
CLASHING = ["DOC_ID", "Text", "size", "host", "part", "rank", "level", "copies", "c1", "task", "sig"]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "to"] * 6 + [f"w{rng.randrange(4000)}" for _ in range(words)]
    return " ".join(rng.choice(vocabulary) for _ in range(words))


def edge_documents() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    long_text = "\n".join(prose(900 + i, 200) for i in range(120))
    rows = [
        (1, prose(1, 60), "en", "a", 1), (2, prose(1, 60), "en", "a", 1), (2, prose(1, 60), "en", "a", 1),
        (3, None, "en", "a", None), (4, "", None, None, 0), (5, " \n\t ", "en", "b", 4), (None, prose(2, 40), "en", "b", 1),
        (None, None, None, None, None), (6, long_text, "en", "b", 1), (7, long_text + " more", "en", None, 1),
        (8, "one", "en", "c", 3), (9, "ONE", "en", "c", 3), (10, "x\x0by\x0cz \x1c é…", "fr", "c", 9),
        (-5, prose(3, 30) + "\n" + prose(4, 30) + "\n" + prose(3, 30), "en", "c", 1),
    ]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(edge_documents() if rows is None else rows, DOC_SCHEMA)


def with_clashes(df):
    """``df`` with further columns of clashing names (built by position, case kept)."""
    spark = df.sparkSession
    taken = df.columns
    extra = [c for c in CLASHING if c not in taken]
    wide = df.select("*", *[df[taken[0]].cast("string").alias(f"x{i}") for i in range(len(extra))])
    assert spark is not None
    return wide.toDF(*taken, *extra)
