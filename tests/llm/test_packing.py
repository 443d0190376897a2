import bisect
import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from awkward_tables import awkward

from rarelabel.llm import packing
from rarelabel.llm.tokens import ByteIds

PATH = public_tokenizers.path("byte_bpe_50k.json")


def best_fit_decreasing(sizes, capacity):
    gaps, n = [], 0
    for s in sorted(sizes, reverse=True):
        k = bisect.bisect_left(gaps, s)
        if k == len(gaps):
            n += 1
            gap = capacity
        else:
            gap = gaps.pop(k)
        bisect.insort(gaps, gap - s)
    return n


@pytest.mark.parametrize("seed", range(8))
def test_rounds_equal_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 2048])
    sizes = [min(capacity, 1 + int(r.expovariate(1 / (capacity * r.choice([0.05, 0.3, 0.6]))))) for _ in range(r.choice([1, 50, 3000]))]
    plan = packing.best_fit_plan(collections.Counter(sizes), capacity)
    held, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for size, rank, count, first, per, used in plan:
        for j in range(count):
            ranks[size].append(rank + j)
            held[first + j // per].append((used + j % per * size, size))
    assert {s: sorted(v) for s, v in ranks.items()} == {s: list(range(n)) for s, n in collections.Counter(sizes).items()}
    for pieces in held.values():
        ends = 0
        for start, size in sorted(pieces):
            assert start == ends
            ends += size
        assert ends <= capacity
    assert len(held) == best_fit_decreasing(sizes, capacity)


def test_cut():
    assert packing.cut(5, 5) == [(0, 5)]
    assert packing.cut(12, 5) == [(0, 2), (2, 5), (7, 5)]
    assert packing.cut(10, 5) == [(0, 5), (5, 5)]
    assert packing.cut(1, 5) == [(0, 1)]


def test_operator_keeps_every_token(docs):
    rows = awkward()
    library = ByteIds(PATH).library
    found = packing.pack(docs(rows), PATH, capacity=64).collect()
    want = collections.Counter()
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        for k, (start, length) in enumerate(packing.cut(len(ids) // 4, 64)):
            want[(i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by = collections.defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        ends = 0
        for offset, length in sorted(pieces):
            assert offset == ends
            ends += length
        assert ends <= 64
    assert len(by) == best_fit_decreasing([r.length for r in found], 64)
    assert packing.pack(docs([]), PATH).collect() == []
