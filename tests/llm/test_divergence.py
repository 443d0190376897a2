import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rarelabel.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, term string, n bigint, entries string, i string, value string"
WORD = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(i, t, lang, s, "t", 1, "e", "i", "v") for i, (t, lang, s) in enumerate(rows)], SCHEMA).repartition(partitions)


def brute(rows, least_docs=3, most=200):
    """All parts by plain integers over every kept term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    docs, counts, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (t, lang, s) in enumerate(rows):
        groups[lang].add(s)
        for w in WORD.findall(lower(t)):
            docs[lang, w].add(i)
            counts[lang, s][w] += 1
            counts[lang, None][w] += 1
    out = []
    for lang, sources in groups.items():
        kept = [w for (own, w), d in docs.items() if own == lang and len(d) >= least_docs]
        total = {s: sum(counts[lang, s][w] for w in kept) for s in [*sources, None]}
        p = {s: [1 + 10**9 * (counts[lang, s][w] + 1) // (total[s] + len(kept)) for w in kept] for s in [*sources, None]}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(map(f, p[s], p[o]))) for o in sources if o != s]
            terms = [(w, f(a, b)) for w, a, b in zip(kept, p[s], p[None], strict=True) if counts[lang, s][w] and a > b]
            for part, found in (("pair", pairs), ("term", terms)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[: most if part == "term" else None]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ordered, 1)]
    return sorted(out)


def plain(df):
    return sorted((r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in df.collect())


def awkward(seed, n=150, sources="abcdef"):
    r = random.Random(seed)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(90)] + ["été", "ÉTÉ", "日本", "ÀÉ", "Zz", "zz"]
    rows = []
    for _ in range(n):
        s = r.choice([*sources, None])
        near = words[: 20 + 10 * (ord(s or "a") % 7)]
        rows.append((r.choice(["-", " ", "9", "_", "\x00", "\n"]).join(r.choice(near).upper() if r.random() < 0.2 else r.choice(near) for _ in range(r.randrange(0, 40))), r.choice(["x", "y", None]), s))
    rows += [("", "z", "a"), (None, "z", "b"), ("one two", "z", "a"), ("12 34", "q", "only"), ("solo solo", "p", None), ("", "", "")]
    return rows + [rows[0]] * 3 + [("long " * 4_000 + "tail", "x", "a")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = awkward(seed)
    assert plain(divergence.divergence(table(spark, rows))) == brute(rows)


def test_blocks_of_sources_and_chunks_of_terms(spark):
    """Sources in several blocks: terms that neither block of a pair has are counted in."""
    rows = awkward(3, 120, "abcdefghij")
    want = brute(rows)
    assert plain(divergence.divergence(table(spark, rows), terms=7, sources=3)) == want
    assert plain(divergence.divergence(table(spark, rows, 1), terms=1_000, sources=1)) == want


def test_few_terms_shown_and_ties(spark):
    rows = [(f"{w} common", "x", s) for s in "ab" for w in ("p", "q", "r", "ä", "Z") for _ in range(3)]
    rows += [("p q r ä z", "x", "a")]
    assert plain(divergence.divergence(table(spark, rows), most_terms=2)) == brute(rows, most=2)


def test_a_source_with_a_third_of_all_rows(spark):
    r = random.Random(4)
    rows = [(" ".join(r.choice(["red", "blue", "green", "tall", "small"]) for _ in range(9)), "x", "hot" if k % 3 == 0 else f"s{k % 17}") for k in range(400)]
    assert plain(divergence.divergence(table(spark, rows))) == brute(rows)


def test_no_rows_and_no_kept_terms(spark):
    assert divergence.divergence(table(spark, [])).collect() == []
    rows = [("once", "x", "a"), ("twice", "x", "b"), (None, None, None)]
    assert plain(divergence.divergence(table(spark, rows))) == [("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)]


def test_joint_prices_are_the_same_in_any_blocks(monkeypatch):
    g = np.random.Generator(np.random.PCG64(2))
    counts = g.integers(0, 60, (300, 5)) * (g.random((300, 5)) < 0.4)
    totals, kept = counts.sum(axis=0).tolist(), 310
    side = np.array([True, True, False, False, False])
    whole = divergence.joint_prices(counts, totals, kept, np.ones(5, bool), np.ones(5, bool))
    monkeypatch.setattr(divergence, "COLUMNS", 40)
    assert (divergence.joint_prices(counts, totals, kept, np.ones(5, bool), np.ones(5, bool)) == whole).all()
    across = divergence.joint_prices(counts, totals, kept, side, ~side)
    assert (across == np.where(np.outer(side, ~side) | np.outer(~side, side), whole, 0)).all()


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    cases = [(0, 1, 1), (10**12, 3 * 10**13, 10**9), (10**15, 10**16 + 7, 12_345), (5, 0, 7)]
    df = spark.createDataFrame(cases, "n bigint, total bigint, kept bigint").select("*", divergence.share(F.col("n"), F.col("total"), F.col("kept")).alias("p"))
    for r in df.collect():
        assert r.p == 1 + 10**9 * (r.n + 1) // (r.total + r.kept)
        assert divergence._shares(np.array([r.n]), r.total, r.kept)[0] == r.p
