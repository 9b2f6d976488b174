"""Documents with every oddity the operators define a result for."""

from __future__ import annotations

LONG = " ".join(f"w{i % 977}" for i in range(30_000))

ODD_TEXTS = [
    None, "", " \t\n ", "one", "a b c d", "The cat sat on the mat. " * 12,
    "The cat sat on the mat. " * 12, "x\ny\nx\n\ny", "Ünïcode ß 中文 😀 <|endoftext|>",
    "!!! ### $$$", LONG,
]


def odd_documents(spark, extra: str = ""):
    """(doc_id, text, and columns that clash with names the operators write)."""
    rows = [(i, t, f"kept{i}") for i, t in enumerate(ODD_TEXTS)]
    rows.append((5, ODD_TEXTS[5], "kept5"))  # a row repeated in full
    return spark.createDataFrame(rows, f"doc_id long, text string, {extra or 'note'} string")


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
