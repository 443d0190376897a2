"""Line dedup by winnowing over line hashes.

Of each window of lines the smallest line hash (rightmost on ties) is selected
as a fingerprint, so any repeated run as long as the window shares one.  Places
are joined on fingerprints, matches are extended to both sides by prints of the
windows around them, and lines of later runs are deleted; the first run stays.
Runs shorter than the window are not found; with a window of 1 each line is a
fingerprint of its own, and every later copy of a line is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import without_repeats

WINDOW = 3


def remove_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_units (lines), n_removed, spans, kept_text``.

    Blank lines are no units and stay.  Lines are compared without white space at
    their ends.  Nulls, ties and empty tables: see ``repeats.without_repeats``.
    """
    return without_repeats(docs, "line", window, 1, id_col, text, keep_anchors=True)
