import random

import numpy as np
from awkward_tables import awkward

from rarelabel.llm import hyperminhash, minhash
from rarelabel.llm.components import components


def shingles(t, words):
    units = (t or "").encode().lower().split()
    n = min(words, len(units))
    return {tuple(units[i : i + n]) for i in range(len(units) - n + 1)} if units else set()


def brute(rows, words, num=80, den=100):
    """Smallest id of each row's component (null ids last), and set sizes."""
    sets = [shingles(t, words) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    root[find(a)] = find(b)
    best = {}
    for k, (i, _, _) in enumerate(rows):
        f = find(k)
        best[f] = min(best.get(f, (True, 0)), (i is None, i or 0))
    return [(i, len(s), None if best[find(k)][0] else best[find(k)][1]) for k, ((i, _, _), s) in enumerate(zip(rows, sets, strict=True))], len(best)


def test_equals_brute_force(docs):
    rows, words = awkward(6), 2
    found = minhash.near_duplicates(docs(rows), words=words).collect()
    want, n = brute(rows, words)
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == sorted(map(str, want))
    assert sum(r.stays for r in found) == n


def families(seed, n):
    """Members differ from their base more and more, so stars do not hold them together."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for f in range(4):
        base = [r.choice(vocabulary) for _ in range(120)]
        for _ in range(n):
            w = list(base)
            for _ in range(r.randint(0, 12)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            rows.append((r.randrange(10**6), " ".join(w), "a"))
            if f == 0:
                base = w  # a chain
    return list({i: (i, t, s) for i, t, s in rows}.values())


def test_families_in_blocks(docs, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    rows = families(1, 60)
    found = minhash.near_duplicates(docs(rows), words=2).collect()
    want, _ = brute(rows, 2)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(want)
    assert len({r.component_id for r in found}) > 4


def test_dedup_keeps_one_row_of_each(docs):
    rows = awkward(7)
    table = docs(rows)
    kept = minhash.near_dedup(table)
    assert kept.columns == table.columns
    assert kept.count() == brute(rows, 5)[1]
    assert minhash.near_duplicates(docs([])).collect() == []


def test_estimate_and_recall_near_the_threshold():
    r = np.random.Generator(np.random.PCG64(5))
    missed, estimates = 0, []
    for _ in range(300):
        both, one = r.integers(0, 1 << 64, 320, np.uint64), r.integers(0, 1 << 64, 80, np.uint64)
        a, b = np.concatenate([both, one[:40]]), np.concatenate([both, one[40:]])
        ra, rb = hyperminhash.registers(a), hyperminhash.registers(b)
        missed += not (hyperminhash.band_keys(ra) == hyperminhash.band_keys(rb)).any()
        estimates.append(hyperminhash.estimated_jaccard(np.array((ra == rb).sum()), np.array(360), np.array(360)))
    assert missed == 0
    assert abs(np.mean(estimates) - 0.8) < 0.01
    far = [float(hyperminhash.estimated_jaccard(np.array((hyperminhash.registers(r.integers(0, 1 << 64, 300, np.uint64)) == hyperminhash.registers(r.integers(0, 1 << 64, 300, np.uint64))).sum()), 300, 300)) for _ in range(50)]
    assert abs(np.mean(far)) < 0.003


def test_components(spark):
    r = random.Random(2)
    chain = [(k, k + 1) for k in range(100, 130)]
    links = [*chain, (1, 2), (2, 1), (3, 3), *((5, 1000 + k) for k in range(300)), *((r.randrange(2000, 2100), r.randrange(2000, 2100)) for _ in range(60))]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    found = {x.node: x.component for x in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in root if x != 3}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_few_links_take_one_job_for_all_turns(spark):
    """Chains and stars, with the last task's turn at once, after some turns of all tasks, and never."""
    r = random.Random(8)
    links = [(k, k + 1) for k in range(100, 160)] + [(200, 200 + r.randrange(1, 40)) for _ in range(60)] + [(300 - k, 301 - k) for k in range(0, 40, 2)] + [(7, 7), (-5, 1_000)]
    want = {n: min(c) for c in [set(range(100, 161)), {x for p in links[60:120] for x in p}, *({x, y} for x, y in links[120:140]), {-5, 1_000}] for n in c}
    table = spark.createDataFrame(links, "a bigint, b bigint")
    for last_rows in (0, 150, 500_000):
        assert {x.node: x.component for x in components(table, last_rows=last_rows).collect()} == want
    spark.sparkContext.setJobGroup("few-links", "")
    components(table)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("few-links")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(jobs) <= 10, len(jobs)
