"""Toxicity: a CRF tags toxic spans, and its marginals give document scores.

Labels are of documents; labelled words come from them (``crf.toxic_keys``).
The model is fitted on the driver to a bounded sample of whole texts, the first by a
hash of their id.  Three parameters bound it: ``most_toxic`` toxic and ``most_clean``
clean documents give the labelled words and the scale of scores, and the chain itself
is fitted to the toxic ones and the first ``fitted_clean`` clean ones among them.  Kinds
of toxic words too rare for ``most_toxic`` texts are not learned.  Scoring is one pass
over all texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarelabel.functions.hashing import uniform_hash

from . import crf, hyperminhash
from .common import WORD, row_number

MOST_TOXIC, MOST_CLEAN, FITTED_CLEAN = 600, 1_800, 400
REJECT = 0.7
_WORDS = re.compile(WORD)
_SEED = 4
_CHUNK_CHARS, _SLICE_ROWS = 500_000, 512
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("marginal", pa.float64())]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string")) % 3 == 1


def sample(docs: DataFrame, labels: DataFrame, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> list[tuple[str, int, int]]:
    """(text, label, documents of that label) of the sample.

    Rows with a null id, text or label are left out; of several labels of one id
    the larger counts, and of several texts the one with the smallest hash, so the
    sample does not depend on how rows are dealt.
    """
    usable = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    usable = usable.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    ranked = usable.withColumn("_order", uniform_hash("doc_id", seed=_SEED))
    picked = [ranked.where(F.col("toxic") == y).orderBy("_order", "doc_id").limit(most) for y, most in ((1, most_toxic), (0, most_clean))]
    # at most most_toxic + most_clean ids
    chosen = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").join(chosen, "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text")
    rows = texts.groupBy("_order", "doc_id", "toxic").agg(one).collect()
    return [(r["text"], r["toxic"], sizes[r["toxic"]]) for r in sorted(rows, key=lambda r: (r["toxic"], r["_order"], r["doc_id"]))]


def _unlike(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without rows that share a band key with an earlier row of their label.

    The words of one text and its near copies would else look frequent.
    """
    seen: set[tuple[int, int]] = set()
    out = []
    for text, y, size in rows:
        shingles = hyperminhash.shingle_set(text, 2)
        keys = {(y, k) for k in hyperminhash.band_keys(hyperminhash.registers(shingles)).tolist()} if len(shingles) else set()
        if not keys & seen:
            out.append((text, y, size))
        seen |= keys
    return out


def fit(rows: list[tuple[str, int, int]], fitted_clean: int = FITTED_CLEAN) -> crf.Model:
    """The chain is fitted to toxic texts and the first ``fitted_clean`` clean ones; all rows scale its scores.

    Without labels of both kinds, a model that scores all texts alike.
    """
    toxic = np.array([y for _, y, _ in rows], np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        model = crf.Model({}, {}, {}, -3.0, 0.0, 0.0)
        model.scale = np.array([3.0 if len(rows) and toxic.min() else -3.0, 0.0, 0.0, 0.0])
        return model
    rows = _unlike(rows)
    toxic = np.array([y for _, y, _ in rows], np.int64)
    clean_so_far = np.cumsum(toxic == 0)
    fitted = (toxic == 1) | (clean_so_far <= fitted_clean)
    # each label weighs as much as it has documents
    weights = np.array([size for _, _, size in rows]) / np.where(toxic == 1, (toxic == 1).sum(), (toxic == 0).sum())
    return crf.train([t for t, _, _ in rows], toxic, fitted, weights / weights.mean())


def _spans(text: str, odds: np.ndarray) -> list[dict]:
    hits = np.flatnonzero(odds > 0)
    if not len(hits):
        return []
    places = [m.span() for m in _WORDS.finditer(text)]
    if len(places) != len(odds):  # the text has white space beyond ASCII, which str.split also cuts at
        places = [m.span() for m in re.finditer(r"\S+", text)]
    out: list[dict] = []
    for k in hits.tolist():
        start, end = places[k]
        p = float(crf.sigmoid(odds[k]))
        if out and out[-1]["_last"] == k - 1:
            out[-1] |= {"length": end - out[-1]["start"], "marginal": max(p, out[-1]["marginal"]), "_last": k}
        else:
            out.append({"start": start, "length": end - start, "marginal": p, "_last": k})
    return [{k: v for k, v in s.items() if k != "_last"} for s in out]


def score(docs: DataFrame, model: crf.Model, id_col: str = "doc_id", text: str = "text", number: str | None = None) -> DataFrame:
    """``row, doc_id, score, spans`` of each row; spans are (start, length, marginal) in characters.

    Null and empty texts get the score of a text without evidence and no spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            scores, spans = [], []
            for first in range(0, batch.num_rows, _SLICE_ROWS):
                texts = [t or "" for t in batch.column(2).slice(first, _SLICE_ROWS).to_pylist()]
                at = 0
                while at < len(texts):
                    end, chars = at, 0
                    while end < len(texts) and (end == at or chars + len(texts[end]) < _CHUNK_CHARS):
                        chars += len(texts[end])
                        end += 1
                    odds = own.word_odds([t.split() for t in texts[at:end]])
                    scores += [own.score(o) for o in odds]
                    spans += [_spans(t, o) for t, o in zip(texts[at:end], odds, strict=True)]
                    at = end
            arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(spans, _SPANS)]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "doc_id", "score", "spans"])
        own.forget()  # the worker lives on for other stages

    read = docs.select(row_number(number), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return read.mapInArrow(run, "row bigint, doc_id bigint, score double, spans array<struct<start:bigint,length:bigint,marginal:double>>")


def toxicity(docs: DataFrame, labelled_docs: DataFrame, labels: DataFrame, number: str | None = None, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, fitted_clean: int = FITTED_CLEAN) -> DataFrame:
    """``row, doc_id, held_out, score, predicted, spans`` of all rows of ``docs``.

    ``labelled_docs`` is where the texts of labelled ids are read.  A null id is
    not held out.  Repeated ids are scored row by row; each text is scored whole.
    ``row`` is the column ``number`` of ``docs``, see
    ``common.numbered``, or a number of this pass only.  An empty table gives no rows.
    """
    scored = score(docs, fit(sample(labelled_docs, labels, most_toxic, most_clean), fitted_clean), number=number)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return scored.select("row", "doc_id", out, "score", (F.col("score") >= REJECT).cast("int").alias("predicted"), "spans")
