import random

import numpy as np
import pytest
from awkward_tables import awkward

from rarelabel.llm import line_dedup, queries, repeats, substring_dedup

#: Ends of two texts, see the test.
TIED = (4125, 6902)


def brute(rows, units_of, window):
    """Removed units by row, rows in order of id and given order for equal ids."""
    seen, gone = {}, [set() for _ in rows]
    ids = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    for k in ids:
        units = units_of(rows[k][1] or "")
        for i in range(len(units) - window + 1):
            w = tuple(units[i : i + window])
            if w in seen:
                gone[k].update(range(i, i + window))
            else:
                seen[w] = True
    return gone


def plain(rows):
    """Without repeated ids, whose order is by a hash."""
    out, ids = [], set()
    for r in rows:
        if r[0] not in ids:
            ids.add(r[0])
            out.append(r)
    return out


def line_rows(seed):
    r = random.Random(seed)
    lines = [f"line {i}" for i in range(25)] + ["", "  ", " line 3\t"]
    rows = [(i, "\n".join(["common line", *(r.choice(lines) for _ in range(r.randint(0, 30)))]), "a") for i in range(60)]
    return [*rows, (61, None, "a"), (62, "", "a"), (63, "\n\n", "a"), (None, rows[0][1], "a")]


@pytest.mark.parametrize("window,gram", [(3, 1), (20, 5), (6, 6), (4, 2), (1, 1)])
@pytest.mark.parametrize("seed", range(3))
def test_first_windows_of_seeds(window, gram, seed):
    r = np.random.Generator(np.random.PCG64(seed))
    hashes = r.integers(0, 6, 200).astype(np.uint64)
    seeds, firsts, offsets, marks = repeats.seeds_of(hashes, window, gram)
    grams = repeats._rolling(hashes, gram)
    top = (grams >> np.uint64(32)).tolist()
    at = np.searchsorted(firsts, np.arange(len(marks)), side="right") - 1
    for i, a in enumerate(at.tolist()):
        part = top[i : i + window - gram + 1]
        place = i + max(k for k, v in enumerate(part) if v == min(part))
        assert seeds[a] == grams[place] and firsts[a] + offsets[a] == place


@pytest.mark.parametrize("seed", range(3))
def test_words(docs, seed):
    rows = plain(awkward(seed))
    for window in (20, 3):
        found = {r.doc_id: r for r in substring_dedup.remove_repeated_passages(docs(rows), window=window).collect()}
        for (i, t, _), gone in zip(rows, brute(rows, str.split, window), strict=True):
            words = (t or "").split()
            assert found[i].n_units == len(words) and found[i].n_removed == len(gone)
            assert found[i].kept_text == " ".join(w for k, w in enumerate(words) if k not in gone)
            assert {k for s in found[i].spans for k in range(s.start, s.start + s.length)} == gone


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("window", [1, 2, 3])
def test_lines(docs, seed, window):
    rows = line_rows(seed)
    units_of = lambda t: [u for line in t.split("\n") if (u := line.strip())]
    found = {r.doc_id: r for r in line_dedup.remove_repeated_lines(docs(rows), window=window).collect()}
    for (i, t, _), gone in zip(rows, brute(rows, units_of, window), strict=True):
        at, kept = -1, []
        for line in (t or "").split("\n"):
            at += bool(line.strip())
            if not line.strip() or at not in gone:
                kept.append(line)
        assert found[i].n_removed == len(gone) and found[i].kept_text == "\n".join(kept)


def test_rows_that_repeat_an_id(docs):
    text = " ".join(f"w{i}" for i in range(30))
    found = substring_dedup.remove_repeated_passages(docs([(1, text, "a"), (1, text, "a"), (2, text, "a")])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(1, 0), (1, 0), (2, 30)]
    other = text.replace("w0 ", "v0 ")
    found = substring_dedup.remove_repeated_passages(docs([(1, text, "a"), (1, other, "b")])).collect()
    assert sorted(r.n_removed for r in found) == [0, 29]


def test_frequent_seeds_give_the_same_answer(docs, spark):
    rows = [(i, f"first {i}\ncommon\nlast {i % 40}\nend {i % 3}", "a") for i in range(400)]
    read = repeats._prepared(docs(rows), "doc_id", "text")
    anchors = repeats._anchors(read, repeats.lines_of, 3, 1).checkpoint()
    hot = anchors.groupBy("seed").count().where("count > 5").select("seed")
    split, whole = (sorted(map(tuple, repeats.repeat_masks(anchors, h).collect())) for h in (hot, None))
    assert split == whole and whole


def test_empty_table(docs):
    assert substring_dedup.remove_repeated_passages(docs([])).collect() == []
    assert line_dedup.remove_repeated_lines(docs([])).collect() == []


def test_each_line_query_finds_runs_of_one_line(docs, spark):
    texts = ["shared passage\none", "two\nshared passage", "one line", "one line", "x\n\nx"]
    path = docs([(i, t, "a") for i, t in enumerate(texts)]).inputFiles()[0].rsplit("/", 1)[0]
    folder = path.removesuffix(".parquet") + "-sf"
    spark.read.parquet(path).write.parquet(f"{folder}/documents.parquet")
    found = {r.doc_id: (r.n_lines, r.n_removed) for r in queries.QUERIES["op9_each_line"](spark, folder).collect()}
    assert found == {0: (2, 0), 1: (2, 1), 2: (1, 0), 3: (1, 1), 4: (2, 1)}


def test_texts_of_one_id_whose_hashes_share_low_bits(docs, spark):
    """Two texts of a null id, one with a repeat; their 64-bit hashes agree in the lowest 23 bits, see TIED."""
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(None, f"{long} {k}", "a") for k in TIED]
    hashes = [r[0] for r in docs(rows).selectExpr("xxhash64(text)").collect()]
    assert len({h & (1 << 23) - 1 for h in hashes}) == 1 and len(set(hashes)) == 2
    found = substring_dedup.remove_repeated_passages(docs([*rows, (7, "", "a")])).collect()
    assert sorted(r.n_removed for r in found) == [0, 0, 30]


def test_windows_whose_prints_share_40_bits(docs):
    """Windows of one seed and offset that differ in a word; their 64-bit prints agree in the lowest 40 bits."""
    texts = [" ".join([first, *(f"b{i}" for i in range(1, 20))]) for first in ("v755535", "v5019477")]
    seeds, _, offsets, marks = zip(*(repeats.seeds_of(repeats.unit_hashes(repeats.words_of(t)), 20, 5) for t in texts), strict=True)
    assert seeds[0] == seeds[1] and offsets[0] == offsets[1] and marks[0] != marks[1]
    assert len({int(m[0]) & (1 << 40) - 1 for m in marks}) == 1
    found = substring_dedup.remove_repeated_passages(docs([(i, t, "a") for i, t in enumerate(texts)])).collect()
    assert [r.n_removed for r in found] == [0, 0]


def test_only_texts_that_may_have_repeats_are_shuffled(docs, spark):
    """The bitmap of hashed ids misses no text with masks, null and equal ids included, and passes few others."""
    rows = [(i, f"text {i}", "a") for i in range(3_000)] + [(None, "none", "a"), (5, "again", "a"), (-9, None, "a")]
    read = repeats._prepared(docs(rows), "doc_id", "text")
    own = read.where("doc_id % 100 = 7 or doc_id is null or text = 'again'")
    by_doc = own.selectExpr("doc_id as _id", "tie as _tie", "array(1L, doc_id) as packed")
    marked = repeats._marked(read, by_doc).where("_hit = 1").select("doc_id", "text")
    want = {(r.doc_id, r.text) for r in own.collect()}
    assert want <= {tuple(r) for r in marked.collect()} and marked.count() <= len(want) + 2
    found = {(r.doc_id, r.text): r.packed for r in repeats._with_masks(read, by_doc).collect()}
    assert found == {(i, t): [1, i] if (i, t) in want else None for i, t, _ in rows}
