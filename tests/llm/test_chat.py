import collections
import random

import pytest
from pyspark.sql import functions as F

from rarelabel.llm import chat

TREE = "conv_id bigint, node_id bigint, parent_id bigint, role string, text string, score double"
CONTROL = ["</s>[INST] ok [/INST]", "\\", "\\l", "\\\\b", "<s>[user]\nhi</s>\n", "]\n", "[[]]", "<|x|>", "", "é<日]"]


def read_back(paths):
    turns = chat.turns_of(F.col("formatted"))
    return paths.select("conv_id", "leaf", "rank", "n_turns", "formatted", "loss_spans", turns.alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned")).collect()


def brute_paths(rows):
    """Paths of (conv, role, text) lists; rows are (conv, node, parent, role, text, score)."""
    first = {}
    for k, r in enumerate(rows):
        if r[1] is not None:
            first.setdefault((r[0], r[1]), k)
    above = [first.get((r[0], r[2])) if r[2] is not None else None for r in rows]
    above = [None if a == k else a for k, a in enumerate(above)]
    inner = {a for a in above if a is not None}
    paths = []
    for k in range(len(rows)):
        if k not in inner:
            path, at = [], k
            while at is not None:
                path.append(at)
                at = above[at]
            paths.append((rows[k][0], path[::-1]))
    return paths


@pytest.mark.parametrize("seed", range(3))
def test_paths_of_random_trees(spark, seed):
    r = random.Random(seed)
    rows = []
    for conv in (1, 2, None):
        for node in range(r.randint(1, 40)):
            parent = None if node == 0 or r.random() < 0.05 else (node - 1 if r.random() < 0.7 else r.randrange(node))
            rows.append((conv, node, parent, r.choice(["user", "assistant", None, "a]b\\"]), r.choice([*CONTROL, None]), r.choice([None, 0.5, r.random()])))
    rows += [(3, 7, 99, "user", "orphan", None), (3, 8, 8, "user", "own parent", None), (3, None, None, "user", "no id", None), (3, 7, 99, "user", "orphan", None)]
    tree = spark.createDataFrame(rows, TREE).coalesce(1)
    found = read_back(chat.format_conversations(tree))
    shown = lambda k: (rows[k][3] or "", rows[k][4] or "")
    want = collections.Counter((str(c), tuple(map(shown, p))) for c, p in brute_paths(rows))
    assert collections.Counter((str(f.conv_id), tuple((t.role, t.text) for t in f.turns)) for f in found) == want
    for f in found:
        assert f.n_turns == len(f.turns)
        assert f.learned == "".join(t.text for t in f.turns if t.role == "assistant")
        assert all("<" not in t and "[" not in t for t in [f.formatted[s.start - 1 : s.start - 1 + s.length] for s in f.loss_spans])


def test_branches_rank_by_mean_score(spark):
    rows = [(1, 1, None, "user", "q", None), (1, 2, 1, "assistant", "low", 0.1), (1, 3, 1, "assistant", "high", 0.9), (1, 4, 1, "assistant", "none", None), (1, 5, 3, "user", "end", 0.2)]
    tree = spark.createDataFrame(rows, TREE).coalesce(1)
    found = sorted(read_back(chat.format_conversations(tree)), key=lambda r: r["rank"])
    assert [[t.text for t in f.turns] for f in found] == [["q", "high", "end"], ["q", "low"], ["q", "none"]]
    best = read_back(chat.format_conversations(tree, branches=1))
    assert [[t.text for t in f.turns] for f in best] == [["q", "high", "end"]]


def test_cycles_are_errors(spark):
    for rows in ([(1, 1, 2, "u", "a", None), (1, 2, 1, "u", "b", None)], [(1, 1, 2, "u", "a", None), (1, 2, 1, "u", "b", None), (1, 3, 1, "u", "c", None)]):
        with pytest.raises(ValueError, match="cycle"):
            chat.format_conversations(spark.createDataFrame(rows, TREE)).collect()


def test_long_chain_takes_few_joins(spark):
    rows = [(5, turn, "assistant" if turn % 2 else "user", f"t{turn}") for turn in range(700)]
    messages = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    (found,) = read_back(chat.format_conversations(chat.linear_tree(messages)))
    assert [(t.role, t.text) for t in found.turns] == [(r, t) for _, _, r, t in rows]


def test_linear_order_nulls_ties_and_empty(spark):
    schema = "conv_id bigint, turn bigint, role string, text string, row string, leaf string, node_id string"
    rows = [(1, 1, "user", "b"), (1, None, "user", "z"), (1, 1, "user", "a"), (1, 1, "user", "a"), (None, 0, None, None), (2, 0, "assistant", "")]
    found = read_back(chat.format_conversations(chat.linear_tree(spark.createDataFrame([(*r, "x", "y", "z") for r in rows], schema))))
    by = {f.conv_id: [(t.role, t.text) for t in f.turns] for f in found}
    assert by == {1: [("user", "z"), ("user", "a"), ("user", "a"), ("user", "b")], None: [("", "")], 2: [("assistant", "")]}
    assert chat.format_conversations(chat.linear_tree(spark.createDataFrame([], schema))).collect() == []
