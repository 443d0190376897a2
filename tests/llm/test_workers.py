"""What Python workers of an executor hold: few rows at a time, and no workers of a second kind."""

import public_tokenizers
import pyarrow as pa

from rarelabel.llm import minhash, packing, tokens
from rarelabel.llm.common import SLICE_ROWS, numbered, slices


class OneBatch:
    """In place of a table: all of its rows come as one batch; what the function yields is kept."""

    def __init__(self, *columns):
        self.batch = pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=list("abcdef"[: len(columns)]))

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return list(run(iter([self.batch])))


def rows_of(batches, column):
    return [v for b in batches for v in b.column(column).to_pylist()]


TEXTS = [None if i % 50 == 0 else f"text number {i} of many that come at once" for i in range(3 * SLICE_ROWS + 7)]
IDS = list(range(len(TEXTS)))


def test_slices_hold_the_same_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(IDS)], names=["n"])
    found = list(slices(iter([batch, batch.slice(0, 0), batch.slice(5, 3)])))
    assert rows_of(found, 0) == IDS + [5, 6, 7]
    assert max(b.num_rows for b in found) == SLICE_ROWS


def test_near_copies_by_slices():
    for found in (minhash.sketches(OneBatch(IDS, IDS, TEXTS), 5), minhash._full_sets(OneBatch(IDS, TEXTS), 5)):
        assert rows_of(found, 0) == IDS
        assert max(b.num_rows for b in found) <= SLICE_ROWS


def test_packing_by_slices(spark):
    found = packing.pieces(OneBatch(IDS, TEXTS), public_tokenizers.path("byte_bpe_50k.json"))
    assert rows_of(found, 0) == IDS
    assert max(b.num_rows for b in found) <= SLICE_ROWS


def test_tables_of_the_driver_need_no_python_workers(spark, docs):
    counted, number = numbered(docs([(i, f"text {i}", "a") for i in range(20)]))
    assert "LogicalRDD" not in counted._jdf.queryExecution().analyzed().toString()
    assert counted.select(number).distinct().count() == 20
    items = spark.range(20).selectExpr("id as doc_id", "0 as piece", "0L as start", "id + 1 as length", "id as ids_crc32")
    placed = packing.place(spark, items)
    assert "LocalRelation" in placed._jdf.queryExecution().analyzed().toString()
    assert placed.count() == 20


def test_probes_go_to_the_library_in_small_batches(monkeypatch):
    sizes = []
    agree = tokens.ByteIds._agree
    monkeypatch.setattr(tokens.ByteIds, "_agree", lambda self, probes: sizes.append(len(probes)) or agree(self, probes))
    assert tokens.ByteIds(public_tokenizers.path("byte_bpe_50k.json")).same
    assert max(sizes) <= tokens.PROBES and sum(sizes) > 40_000
