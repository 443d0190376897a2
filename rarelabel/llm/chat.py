"""Chat formatting of reply trees with DataFrame operations alone.

A tree's nodes name their parents.  Nodes with a single reply form runs; their
heads are found by iterated self-joins that double the distance each time, and
further self-joins, one per level of branching, enumerate paths from roots to
leaves.  So a chain of n turns takes about log2(n) joins.  Paths are ranked by
score within their conversation, and each chosen path becomes one text.

Template, for each turn: ``<s>[role]\\ntext</s>\\n``.  In roles and texts the
characters ``\\ < [ ]`` are written ``\\b \\l \\o \\c``, so no control string can
stand inside a text, and reading back is exact.  The loss mask lists the places
of assistant texts in the formatted text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEARNED_ROLE = "assistant"
_ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c"))
_OPEN, _ROLE_END, _CLOSE = "<s>[", "]\n", "</s>\n"


def escape(text: Column) -> Column:
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(_ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def linear_tree(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, node_id, parent_id, role, text, score`` where each row replies to the one before.

    Rows of a conversation are ordered by turn (null first), then role, then
    text; repeated turns are turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.withColumn("node_id", F.row_number().over(order).cast("bigint"))
    parent = F.when(F.col("node_id") > 1, F.col("node_id") - 1)
    return rows.select("conv_id", "node_id", parent.alias("parent_id"), "role", "text", F.lit(None).cast("double").alias("score"))


def _linked(nodes: DataFrame) -> DataFrame:
    """(row, conv_id, score, parent row): a parent that is not there, or is the node itself, counts as none."""
    named = nodes.where("node_id is not null").select(F.col("conv_id").alias("_conv"), F.col("node_id").alias("_node"), F.col("row").alias("_row"))
    first = named.groupBy("_conv", "_node").agg(F.min("_row").alias("parent"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("parent_id") == F.col("_node"))
    found = nodes.join(first, same, "left").select("row", "conv_id", "score", F.when(F.col("parent") != F.col("row"), F.col("parent")).alias("parent"))
    return stored(found)


def _runs(links: DataFrame) -> DataFrame:
    """(head, run, tail, above): unary runs as arrays of rows, and the row above each head."""
    replies = links.where("parent is not null").groupBy(F.col("parent").alias("_p")).count()
    forks = replies.where("count > 1").select(F.col("_p").alias("parent"), F.lit(True).alias("fork"))
    roots = links.where("parent is null").select("row", F.lit(True).alias("is_head"), "parent")
    marked = links.where("parent is not null").join(forks, "parent", "left").select("row", F.coalesce("fork", F.lit(False)).alias("is_head"), "parent")
    up, far = F.when(F.col("is_head"), F.col("row")).otherwise(F.col("parent")), F.when(F.col("is_head"), 0).otherwise(1).cast("bigint")
    jump = stored(roots.unionByName(marked).select("row", up.alias("up"), far.alias("far"), (~F.col("is_head")).alias("open")))
    rows, reach = jump.count(), 1
    while not jump.where("open").isEmpty():
        if reach > 2 * rows:
            raise ValueError("replies form a cycle")
        reach *= 2
        # a row is done once it points to a head; only the others are joined again
        above = jump.select(F.col("row").alias("up"), F.col("up").alias("_up"), F.col("far").alias("_far"))
        moved = jump.where("open").join(above, "up").select("row", F.col("_up").alias("up"), (F.col("far") + F.col("_far")).alias("far"), (F.col("_far") > 0).alias("open"))
        jump = stored(jump.where("not open").unionByName(moved))
    runs = jump.groupBy(F.col("up").alias("head")).agg(F.sort_array(F.collect_list(F.struct("far", "row"))).alias("run"))
    runs = runs.select("head", F.col("run.row").alias("run"), F.element_at("run.row", -1).alias("tail"))
    ends = links.select(F.col("row").alias("head"), F.col("parent").alias("above"), "conv_id")
    inner = replies.select(F.col("_p").alias("tail"), F.lit(True).alias("inner"))
    return stored(runs.join(ends, "head").join(inner, "tail", "left").withColumn("leaf", F.col("inner").isNull()).drop("inner"))


def root_to_leaf_paths(links: DataFrame) -> DataFrame:
    """(conv_id, leaf, path): all paths, as arrays of rows."""
    runs = _runs(links)
    leaves, found = runs.where("leaf").count(), 0
    front = runs.where("above is null").select("conv_id", "tail", "leaf", F.col("run").alias("path"))
    below = runs.where("above is not null").select(F.col("above").alias("tail"), F.col("run").alias("_run"), F.col("tail").alias("_tail"), F.col("leaf").alias("_leaf"))
    done = None
    while True:
        ended = front.where("leaf").select("conv_id", F.col("tail").alias("leaf"), "path")
        done = ended if done is None else done.unionByName(ended)
        found += ended.count()
        if found == leaves:
            return done
        front = front.where("not leaf").drop("leaf").join(below, "tail")
        front = stored(front.select("conv_id", F.col("_tail").alias("tail"), F.col("_leaf").alias("leaf"), F.concat("path", "_run").alias("path")))
        if front.isEmpty():
            raise ValueError("replies form a cycle")


def format_conversations(tree: DataFrame, branches: int | None = None, learned_role: str = LEARNED_ROLE) -> DataFrame:
    """One row per chosen path: ``conv_id, leaf, rank, n_turns, formatted, loss_spans``.

    ``tree`` has ``conv_id, node_id, parent_id, role, text, score``.  Paths rank
    by the mean score of their nodes (none: last; ties: smaller leaf); the first
    ``branches`` of a conversation are formatted, all if it is None.  Null roles
    and texts are empty.  A null ``conv_id`` is a conversation of its own.  Rows
    that repeat a node id are siblings, and replies hang on the first of them.
    A node whose parent is not there is a root; replies that form a cycle are an
    error.  ``loss_spans`` are (start from 1, length) in code points, in order.
    """
    nodes = stored(
        tree.select(
            F.monotonically_increasing_id().alias("row"), "conv_id", "node_id", "parent_id",
            F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score",
        )
    )
    links = _linked(nodes)
    steps = root_to_leaf_paths(links).select("conv_id", "leaf", F.posexplode("path").alias("step", "row"))
    scored = steps.join(links.select("row", "score"), "row").groupBy("conv_id", "leaf").agg(F.avg("score").alias("score"))
    best = Window.partitionBy("conv_id").orderBy(F.col("score").desc_nulls_last(), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(best))
    if branches is not None:
        chosen = chosen.where(F.col("rank") <= branches)
    role, text = escape(F.col("role")), escape(F.col("text"))
    turns = steps.join(chosen.select("leaf", "rank"), "leaf").join(nodes.select("row", "role", "text"), "row").select(
        "conv_id", "leaf", "rank", "step", (F.col("role") == learned_role).alias("learned"),
        F.concat(F.lit(_OPEN), role, F.lit(_ROLE_END), text, F.lit(_CLOSE)).alias("turn"), F.char_length(text).alias("n"),
    )
    so_far = Window.partitionBy("leaf").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    text_end = F.sum(F.char_length("turn")).over(so_far) - len(_CLOSE)
    turns = turns.withColumn("start", (text_end - F.col("n") + 1).cast("int"))
    paths = turns.groupBy("conv_id", "leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("step", "turn", "learned", "start", "n"))).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), t["n"].alias("length")))
    return paths.select("conv_id", "leaf", "rank", F.size("turns").cast("bigint").alias("n_turns"), F.array_join("turns.turn", "").alias("formatted"), spans.alias("loss_spans"))


def turns_of(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted text."""
    parts = F.split(formatted, _CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    body = lambda p: F.substring(p, F.lit(len(_OPEN) + 1), F.char_length(p))
    role = lambda b: F.substring_index(b, _ROLE_END, 1)

    def read(part: Column) -> Column:
        b = body(part)
        text = F.substring(b, F.char_length(role(b)) + len(_ROLE_END) + 1, F.char_length(b))
        return F.struct(unescape(role(b)).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, read)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")
