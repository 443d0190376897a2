"""Rows with nulls, empty and long texts, ties, repeats and clashing column names."""

from __future__ import annotations

import random
import uuid

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *(T.StructField(c, T.StringType()) for c in ("row", "_row_number", "key", "tie", "size", "_copies", "text_hash", "score")),
])


def table(spark, rows, folder):
    """A stored table of (doc_id, text, source) rows, in two files."""
    full = [(i, t, "en", s, None if t is None else len(t), *(c for c in "abcdefgh")) for i, t, s in rows]
    path = f"{folder}/{uuid.uuid4().hex}.parquet"
    spark.createDataFrame(full, SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def awkward(seed=0, words=30):
    """Texts from few words, so that copies, near copies and shared passages abound."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["é", "Ж", "日本"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base = [text(r.randint(25, 3 * words)) for _ in range(12)]
    rows, at = [], 0

    def add(t, source="a"):
        nonlocal at
        rows.append((at, t, source))
        at += r.randint(1, 3)

    for t in base:
        for _ in range(r.randint(1, 4)):
            w = t.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            add(" ".join(w), r.choice("abc"))
    for _ in range(6):
        add(text(5) + "\n" + " ".join(r.choice(base).split()[:22]) + "\n" + text(5), None)
    for t in (None, "", " \n\t", "one", "ONE", "one", "two words", "Two Words", base[0].upper(), base[0], "x " * 30_000, None, ""):
        add(t, r.choice(["a", None, "zz"]))
    rows += [rows[3], rows[3], (None, base[1], "a"), (None, None, None), (rows[5][0], "other text of the same id", "b"), (-4, base[2], "Ä")]
    return rows
