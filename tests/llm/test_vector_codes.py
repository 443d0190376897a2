import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from rarelabel.llm import vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, units string, bounds string, _label string, error string"


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, "u", "b", "l", "e") for r in rows], SCHEMA).repartition(partitions)


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes, errors, sums by label and the digest, by full scans in plain integers."""
    kept = [(i, [math.floor(float(np.float32(x)) * scale) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts if kept else 0
    cut = lambda u, p: u[p * width : (p + 1) * width]
    books = [[cut(u, p) for _, u, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for _, u, _ in kept:
                held[nearest(cut(u, p), books[p])[1]].append(cut(u, p))
            for j, xs in held.items():
                books[p][j] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found = [(i, [nearest(cut(u, p), books[p]) for p in range(parts)], y) for i, u, y in kept]
    by_label = defaultdict(int)
    for _, f, y in found:
        by_label[y] += sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted((str(i), "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f), by_label[y]) for i, f, y in found), digest


def coded(df, **options):
    codes = vector_codes.encode(df, **options)
    rows = vector_codes.with_label_error(codes.rows).collect()
    return sorted((str(r.vec_id), bytes(r.owners).hex(), r.error, r.label_error) for r in rows), codes.digest()


def awkward(seed, n=160, dimension=24):
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.4) for _ in range(dimension)] for _ in range(9)]
    rows = [(r.randrange(-50, 10**6), [x + r.gauss(0, 0.08) for x in r.choice(centres)], r.choice([0, 1, None, 7])) for _ in range(n)]
    bad = [None, [float("nan")] * dimension, [0.0] * (dimension - 1) + [None], [float("inf")] + [0.0] * (dimension - 1)]
    rows += [(-99 - k, v, 1) for k, v in enumerate(bad)]
    same = [0.25] * dimension
    return rows + [(-60, same, 3), (-60, same, 3), (-61, same, None), (None, rows[0][1], 0), rows[1], (rows[2][0], rows[3][1], 5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_full_scans(spark, seed):
    rows = awkward(seed)
    assert coded(table(spark, rows)) == brute(rows)


def test_few_levels_give_ties(spark):
    r = random.Random(5)
    rows = [(i, [r.choice([0.0, 0.5, -0.5]) for _ in range(8)], i % 2) for i in range(90)]
    assert coded(table(spark, rows)) == brute(rows)


def test_fewer_rows_than_entries_and_no_rows(spark):
    rows = [(i, [i / 7] * 16, None) for i in range(5)]
    assert coded(table(spark, rows)) == brute(rows)
    assert coded(table(spark, [(1, None, 1)])) == ([], hashlib.sha256(b"").hexdigest())
    assert coded(table(spark, []))[0] == []


def test_same_answer_however_rows_are_dealt(spark):
    rows = awkward(3, 60)
    assert coded(table(spark, rows, 1)) == coded(table(spark, rows, 7))


def test_other_sizes(spark):
    rows = awkward(4, 70)
    assert coded(table(spark, rows), parts=4, entries=5, rounds=3) == brute(rows, 4, 5, 3)


def test_unlike_dimensions_and_overflow_are_errors(spark):
    for rows in ([(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)], [(1, [0.0] * 9, 1)], [(1, [3e38] * 8, 1)]):
        with pytest.raises(Exception, match="components|beyond"):
            coded(table(spark, rows))


def test_net_displacement_saves_scans():
    """Entries that move there and back have come nowhere: the bound of the first round is as tight as ever."""
    g = np.random.Generator(np.random.PCG64(1))
    far = np.array([[0, 0], [1000, 0], [0, 1000]], np.int64)
    x = far[g.integers(0, 3, 300)] + g.integers(-50, 50, (300, 2))
    bounds = np.zeros(300, vector_codes._BOUND)
    history = [far]
    assert vector_codes.reassign(x, bounds, history) == 300
    for k in range(1, 9):
        history.append(far + (400 if k % 2 else 0))
        scans = vector_codes.reassign(x, bounds, history)
        assert (bounds["owner"] == vector_codes.distances(x, history[-1]).argmin(axis=1)).all()
        if k % 2 == 0:
            assert scans == 0
    assert (bounds["upper"] ** 2 >= np.square(x - history[-1][bounds["owner"]]).sum(axis=1) * 0.999).all()
