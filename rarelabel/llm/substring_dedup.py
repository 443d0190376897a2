"""Substring dedup: remove every word of a passage that started earlier.

A relative Lempel-Ziv parse would factor each document against reference blocks
and keep factors of at least 20 words.  A word is covered by such a factor if and
only if one of its 20-word windows also starts earlier, so windows are grouped
instead: each is dealt by its seed to the one index block that can hold an equal
one (see ``repeats``) and points to the earliest copy.  Factors are not built; the
spans of covered words are the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import without_repeats

WINDOW = 20
SEED_WORDS = 5


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_units (words), n_removed, spans, kept_text``: kept words joined by one space.

    Texts of any length are read whole, other columns are not read, and an empty
    table gives no rows.  Nulls and ties: see ``repeats.without_repeats``.
    """
    return without_repeats(docs, "word", window, min(SEED_WORDS, window), id_col, text)
