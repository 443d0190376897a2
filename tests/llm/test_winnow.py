import hashlib
import random

import numpy as np
import pytest
from awkward_tables import awkward
from hypothesis import given, settings
from hypothesis import strategies as st

from rarelabel.llm import winnow


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=0, max_size=60), st.integers(1, 12))
def test_selection_equals_brute_force(values, window):
    hashes = np.array(values, np.uint64)
    want = set()
    for i in range(max(0, len(values) - min(window, max(1, len(values))) + 1) if values else 0):
        part = values[i : i + min(window, len(values))]
        want.add(i + max(k for k, v in enumerate(part) if v == min(part)))
    assert winnow.select(hashes, window).tolist() == sorted(want)


def test_gram_hashes_depend_on_the_gram_alone():
    r = random.Random(1)
    text = "".join(r.choice("ab日é") for _ in range(500))
    hashes = winnow.gram_hashes(winnow.code_points(text), 4)
    by = {}
    for i, h in enumerate(hashes.tolist()):
        assert by.setdefault(text[i : i + 4], h) == h
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("seed", range(5))
def test_guarantee(seed):
    """Texts that share w + k - 1 characters share a hash."""
    r = random.Random(seed)
    made = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    shared = made(winnow.WINDOW + winnow.GRAM - 1)
    a, b = (winnow.fingerprint(made(r.randint(0, 300)) + shared + made(r.randint(0, 300)))[0] for _ in range(2))
    assert set(a.tolist()) & set(b.tolist())


def order(rows, tie):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1])))


def test_edited_texts(docs, spark):
    from pyspark.sql import functions as F

    rows = awkward(4)
    table = docs(rows)
    ties = {r.text: r.h for r in table.select("text", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h")).collect()}
    ordered = order(rows, ties.__getitem__)
    found = winnow.edited_fingerprints(table).collect()
    want = []
    for k, (i, t, _) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        a, b, c = (np.unique(winnow.fingerprint(x)[0]) for x in (t, edited, after))
        want.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), round(winnow.likeness(a, b), 9), round(winnow.likeness(a, c), 9)))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in found) == sorted(want)


def test_operator_positions_and_empty(docs):
    rows = awkward(5)
    found = winnow.fingerprints(docs(rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert list(r.places) == sorted(set(r.places)) and len(r.places) == len(r.hashes)
    assert winnow.fingerprints(docs([])).collect() == []
    assert winnow.edited_fingerprints(docs([])).collect() == []
    (one,) = winnow.edited_fingerprints(docs([(3, "only one text here", "a")])).collect()
    assert one.doc_id == 3 and one.near_next == 1.0
