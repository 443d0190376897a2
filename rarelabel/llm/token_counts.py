"""Token counts of whole texts by a public sentencepiece model.

See ``tokens.PieceCounter`` for the whole-token shortcut.  The work is one pass
over the text column without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import piece_counter

LIMIT = 4096
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each row.

    Counts have no begin, end or added special tokens; special strings in a text
    are ordinary text.  A null text counts as empty: 0 bytes, 0 tokens.  Null
    and repeated ids are kept as they are; an empty table gives no rows.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode()) if t else 0 for t in texts]
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counter.counts(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)

    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    counted = read.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
