import random

import numpy as np
import pytest
from awkward_tables import awkward
from test_minhash import brute, families

from rarelabel.llm import hyperminhash, set_join


def alike(a, b, num, den):
    common = len(np.intersect1d(a, b))
    return common * den >= (len(a) + len(b) - common) * num


@pytest.mark.parametrize("similarity", [(90, 100), (4, 5), (1, 2), (99, 100)])
def test_alike_sets_share_a_signature(similarity):
    """Pairs at and about the threshold, of equal and unequal sizes."""
    num, den = similarity
    g = np.random.Generator(np.random.PCG64(3))
    bands = set_join.Bands(similarity)

    def signed(s):
        own = [(b, set_join.signatures(s, b, bands.differences(b))) for b in bands.bands(len(s))]
        return {k for _, keys in own for k in keys.tolist()}

    tried = 0
    for size in [*range(1, 60), 97, 240, 1_000]:
        for _ in range(12):
            a = np.unique(g.integers(0, 1 << 63, size, np.uint64))
            away, more = int(g.integers(0, max(1, size // 5) + 1)), int(g.integers(0, max(1, size // 5) + 1))
            b = np.unique(np.concatenate([a[away:], g.integers(0, 1 << 63, more, np.uint64)]))
            if len(b) and not np.array_equal(a, b) and alike(a, b, num, den):
                tried += 1
                assert signed(a) & signed(b), (size, away, more)
    assert tried > 20 or num == 99


def test_bands_cover_all_sizes_and_partners():
    bands = set_join.Bands((90, 100))
    for size in range(1, 5_000):
        for partner in range(size, size * 100 // 90 + 1):
            assert set(bands.bands(size)) & {bands.band(partner)}
            assert 2 * bands.largest(bands.band(partner)) >= size + partner


def test_unlike_sets_share_few_signatures():
    g = np.random.Generator(np.random.PCG64(4))
    bands = set_join.Bands((90, 100))
    keys = [k for _ in range(200) for s in [np.unique(g.integers(0, 1 << 63, 200, np.uint64))] for b in bands.bands(len(s)) for k in set_join.signatures(s, b, bands.differences(b)).tolist()]
    assert len(keys) - len(set(keys)) <= 2


@pytest.mark.parametrize("rows", [awkward(6), awkward(8, 60), families(1, 25)], ids=["awkward", "longer", "families"])
def test_equals_brute_force(docs, rows):
    found = set_join.jaccard_join(docs(rows)).collect()
    want, _ = brute(rows, 3, 90, 100)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == sorted(map(str, want))


def test_blocks_lose_no_link(docs):
    """Families of many small blocks, with sets that the smallest row does not hold together."""
    rows = families(2, 40)
    want, _ = brute(rows, 2, 80, 100)
    for block_rows, block_shingles in ((4, 1 << 20), (1_000, 700)):
        found = set_join.jaccard_join(docs(rows), words=2, similarity=(80, 100), block_rows=block_rows, block_shingles=block_shingles).collect()
        assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == sorted(map(str, want))


def test_a_third_of_all_rows_alike(docs):
    r = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(f"v{r.randrange(10**6)}" for _ in range(60)), "a") for i in range(160)]
    for i in range(90):
        w = list(base)
        w[r.randrange(200)] = f"x{i % 40}"
        rows.append((1_000 + i, " ".join(w), "a"))
    found = set_join.jaccard_join(docs(rows), block_rows=16).collect()
    want, _ = brute(rows, 3, 90, 100)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(want)
    assert sum(r.component_id == 1_000 for r in found) == 90


def test_very_long_and_empty_texts_and_no_rows(docs):
    r = random.Random(2)
    words = [f"l{r.randrange(10**7)}" for _ in range(30_000)]
    edited = list(words)
    for k in range(0, 30_000, 90):
        edited[k] = "e"
    rows = [(5, " ".join(words), "a"), (3, " ".join(edited), "a"), (9, "", "a"), (8, None, "a"), (7, " \t", "a"), (None, " ".join(words), "a")]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in set_join.jaccard_join(docs(rows)).collect()}
    want, _ = brute(rows, 3, 90, 100)
    assert found == {i: (n, c) for i, n, c in want}
    assert set_join.jaccard_join(docs(rows).where("false")).collect() == []


def test_links_in_block_joins_and_skips():
    sets = [np.arange(k, k + 100, dtype=np.uint64) for k in (0, 2, 4, 50)]
    args = ([10, 11, 12, 13], [1, 2, 3, 4], [True, True, False, False], sets, (90, 100))
    assert sorted(set_join.links_in_block(*args, False)) == [(10, 11), (10, 12)]
    assert set_join.links_in_block(*args, True) == [(10, 12), (11, 12)] or len(set_join.links_in_block(*args, True)) == 2
    assert set_join.links_in_block(args[0], [1, 1, 1, 1], *args[2:], False) == []
    assert hyperminhash.shingle_set("a b", 3).shape == (1,)
