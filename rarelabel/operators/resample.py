"""Exact, seeded sampling per class.

Rows of a class are ordered by their hash, so "row number i of class c" and
"the m rows with the smallest hash" are both facts about the data.  Large
classes are cut into hash buckets; no task ever holds a whole class.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import as_columns, hash_bucket, uniform_hash
from .counts import MAX_CLASSES, class_counts, class_histogram, collect_bounded

ROWS_PER_BUCKET = 500_000
DRAWS_PER_CHUNK = 1 << 18
DRAWS_PER_COPY_TASK = 1 << 16


# ---- plans: how many rows each class gets ---------------------------------


def oversample_plan(df: DataFrame, label: str = "label", mode: str = "rounds") -> DataFrame:
    """``(label, n, draws)``: extra rows per class to reach the largest class.

    ``rounds``: with M and m the largest and smallest class and T = M div m + 1,
    a class gets T * ceil((M - n) / T) draws, so it may pass M by up to T - 1.
    ``exact``: M - n draws.
    """
    sizes = _with_extremes(class_histogram(df, label))
    gap = F.col("_hi") - F.col("n")
    if mode == "exact":
        draws = gap
    elif mode == "rounds":
        rounds = F.expr("_hi div _lo + 1")
        draws = rounds * F.expr("(_hi - n + (_hi div _lo)) div (_hi div _lo + 1)")
    else:
        raise ValueError("mode must be 'rounds' or 'exact'")
    return sizes.select(label, "n", draws.cast("bigint").alias("draws"))


def undersample_plan(
    df: DataFrame, label: str = "label", target: int | float | None = None
) -> DataFrame:
    """``(label, n, draws)``: every class down to one size.

    ``target``: None for the smallest class, a float for a share of it, an int
    for a fixed number of rows.
    """
    sizes = _with_extremes(class_histogram(df, label))
    if target is None:
        draws: Column = F.col("_lo")
    elif isinstance(target, float):
        draws = F.ceil(F.col("_lo") * F.lit(target))
    else:
        draws = F.lit(target)
    return sizes.select(label, "n", draws.cast("bigint").alias("draws"))


def _with_extremes(histogram: DataFrame) -> DataFrame:
    """Add ``_hi`` and ``_lo``, the largest and the smallest class."""
    ends = histogram.agg(F.max("n").alias("_hi"), F.min("n").alias("_lo"))
    # one row
    return histogram.join(F.broadcast(ends))


def _plan_rows(plan: DataFrame, label: str) -> list[dict[str, Any]]:
    rows = [r.asDict() for r in collect_bounded(plan, MAX_CLASSES, "classes")]
    if any(r[label] is None for r in rows):
        raise ValueError(f"column {label} has null labels; drop or fill them first")
    return sorted(rows, key=lambda r: r[label])


def _class_table(df: DataFrame, label: str, name: str, values: Mapping[Any, int]) -> DataFrame:
    """One row per class, at most MAX_CLASSES as checked when planning: fit to broadcast."""
    schema = T.StructType(
        [T.StructField(label, df.schema[label].dataType), T.StructField(name, T.LongType())]
    )
    return F.broadcast(df.sparkSession.createDataFrame(list(values.items()), schema))


# ---- numbering -------------------------------------------------------------


def _narrow(df: DataFrame, label: str, keys: list[str], seed: int, bits: int) -> DataFrame:
    """``(label, key..., _h, _b)``: hash and hash bucket of each row; null keys are an error."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    message = F.lit(f"row key ({', '.join(keys)}) is null")
    hashed = F.when(missing, F.raise_error(message).cast("bigint")).otherwise(
        uniform_hash(*keys, seed=seed)
    )
    narrow = df.select(label, *keys, hashed.alias("_h"))
    return narrow.withColumn("_b", hash_bucket(F.col("_h"), bits) if bits else F.lit(0))


def bucket_bits(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hash bits so that one bucket of the largest class stays small."""
    return min(24, max(0, (max(1, rows) - 1) // rows_per_bucket).bit_length())


def number_within_class(
    df: DataFrame, label: str, key: str | Sequence[str], seed: int, bits: int
) -> DataFrame:
    """``(label, key..., _idx)``: position 0..n-1 of each row in its class.

    Only label and key are read and moved.  The order is (hash, key), so the
    bucket (top hash bits) is a prefix of it: a row's number is its number in
    its bucket plus the rows of the class in earlier buckets.  A repeated key
    is an error, because two such rows cannot be told apart.
    """
    keys = as_columns(key)
    narrow = _narrow(df, label, keys, seed, bits)
    local = Window.partitionBy(label, "_b").orderBy("_h", *keys)
    repeated = F.lit(True)
    for k in keys:
        repeated = repeated & F.col(k).eqNullSafe(F.lag(k).over(local))
    first = F.row_number().over(local) == 1
    message = F.lit(f"row key ({', '.join(keys)}) is not unique")
    checked = F.when(repeated & ~first, F.raise_error(message).cast("int")).otherwise(
        F.row_number().over(local)
    )
    numbered = narrow.withColumn("_rn", checked.cast("bigint") - 1)
    if bits == 0:
        return numbered.select(label, *keys, F.col("_rn").alias("_idx"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        narrow.groupBy(label, "_b")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(label, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    return numbered.join(offsets, [label, "_b"]).select(
        label, *keys, (F.col("_before") + F.col("_rn")).alias("_idx")
    )


# ---- drawing ---------------------------------------------------------------


def _draws(
    df: DataFrame, label: str, plan: list[dict[str, Any]], seed: int, per_copy_task: int
) -> DataFrame:
    """``(label, _idx[, _salt], _copies)``: how often each position is drawn.

    Draw numbers are made in chunks on many tasks.  If few rows are drawn very
    often, ``_salt`` splits the copies of one row over several join tasks.
    """
    spark = df.sparkSession
    schema = T.StructType(
        [
            T.StructField(label, df.schema[label].dataType),
            T.StructField("_n", T.LongType()),
            T.StructField("_d", T.LongType()),
            T.StructField("_salts", T.LongType()),
        ]
    )
    chunks = sum(-(-p["draws"] // DRAWS_PER_CHUNK) for p in plan)
    todo = [(p[label], p["n"], p["draws"], _salts(p, per_copy_task)) for p in plan if p["draws"] > 0]
    table = spark.createDataFrame(todo, schema)
    size = F.lit(DRAWS_PER_CHUNK)
    table = table.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_d - 1) div {DRAWS_PER_CHUNK}")))
    )
    if chunks > len(todo):
        table = table.repartition(min(chunks, 50_000), label, "_chunk")
    table = table.withColumn(
        "_draw",
        F.explode(
            F.sequence(
                F.col("_chunk") * size, F.least(F.col("_d"), (F.col("_chunk") + 1) * size) - 1
            )
        ),
    )
    index = F.coalesce(F.pmod(uniform_hash(label, "_draw", seed=seed), F.col("_n")), F.lit(0))
    drawn = table.select(label, index.alias("_idx"), F.pmod("_draw", "_salts").alias("_salt"))
    by = [label, "_idx"]
    if any(_salts(p, per_copy_task) > 1 for p in plan):
        by.append("_salt")
    return drawn.groupBy(*by).agg(F.count(F.lit(1)).alias("_copies"))


def _salts(row: Mapping[str, Any], per_copy_task: int) -> int:
    return max(1, -(-row["draws"] // (row["n"] * per_copy_task)))


def draw_with_replacement(
    df: DataFrame,
    label: str,
    key: str | Sequence[str],
    plan: list[dict[str, Any]],
    seed: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    per_copy_task: int = DRAWS_PER_COPY_TASK,
) -> DataFrame:
    """Exactly ``draws`` rows of every class, with replacement.

    Draw d of class c takes position hash(c, d) mod n.  Full rows move once, in
    the last join; everything before it carries label and key only.
    """
    keys = as_columns(key)
    wanted = [p for p in plan if p["draws"] > 0]
    if not wanted:
        return df.limit(0)
    if any(p["n"] == 0 for p in wanted):
        raise ValueError("cannot draw from an empty class")
    if len(wanted) < len(plan):
        df_wanted = df.filter(F.col(label).isin([p[label] for p in wanted]))
    else:
        df_wanted = df
    bits = bucket_bits(max(p["n"] for p in wanted), rows_per_bucket)
    numbered = number_within_class(df_wanted, label, keys, seed, bits)
    picked = _draws(df, label, wanted, seed, per_copy_task).join(numbered, [label, "_idx"])
    salted = any(_salts(p, per_copy_task) > 1 for p in wanted)
    on = [label, *keys]
    if salted:
        salts = _class_table(df, label, "_salts", {p[label]: _salts(p, per_copy_task) for p in wanted})
        first = F.lit(0).cast("bigint")
        df_wanted = df_wanted.join(salts, label).withColumn(
            "_salt", F.explode(F.sequence(first, F.col("_salts") - 1))
        )
        on.append("_salt")
    picked = picked.select(*on, "_copies")
    return (
        df_wanted.join(picked, on)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
        .select(*df.columns)
    )


def keep_smallest_hashes(
    df: DataFrame,
    label: str,
    key: str | Sequence[str],
    plan: list[dict[str, Any]],
    seed: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exactly ``draws`` rows of every class, without replacement.

    The rows are those with the smallest (hash, key).  A histogram of hash
    buckets finds the bucket in which the last kept row lies, that bucket alone
    is numbered to find the row, and the full table is then filtered against
    one cut per class: it is never shuffled.
    """
    keys = as_columns(key)
    for p in plan:
        if p["draws"] > p["n"]:
            raise ValueError(
                f"class {p[label]} has {p['n']} rows, fewer than the {p['draws']} asked for; "
                "draw with replacement instead"
            )
    cut = [p for p in plan if 0 < p["draws"] < p["n"]]
    whole = [p[label] for p in plan if p["draws"] == p["n"]]
    kept = df.filter(F.col(label).isin(whole)) if whole else df.limit(0)
    if not cut:
        return kept
    bits = bucket_bits(max(p["n"] for p in cut), rows_per_bucket)
    hashed = uniform_hash(*keys, seed=seed)
    labels = [p[label] for p in cut]
    narrow = _narrow(df.filter(F.col(label).isin(labels)), label, keys, seed, bits)
    want = _class_table(df, label, "_want", {p[label]: p["draws"] for p in cut})
    if bits:
        upto = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        edges = (
            narrow.groupBy(label, "_b")
            .agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_upto", F.sum("_n").over(upto))
            .join(want, label)
            .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
            .select(label, "_b", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_left"))
        )
        # one bucket per class: at most MAX_CLASSES rows, checked when planning
        edge_rows = narrow.join(F.broadcast(edges), [label, "_b"])
    else:
        edge_rows = narrow.join(want.withColumnRenamed("_want", "_left"), label)
    order = Window.partitionBy(label, "_b").orderBy("_h", *keys)
    here, before = F.struct("_h", *keys), F.lag(F.struct("_h", *keys)).over(order)
    repeated = F.raise_error(F.lit(f"the key ({', '.join(keys)}) is not unique")).cast("int")
    cuts = (
        # a repeated key at the cut would let more rows through than asked for
        edge_rows.withColumn("_rn", F.when(before == here, repeated).otherwise(F.row_number().over(order)))
        .filter(F.col("_rn") == F.col("_left"))
        .select(label, F.struct("_h", *keys).alias("_cut"))
    )
    below_cut = (
        df.filter(F.col(label).isin(labels))
        # one row per class: at most MAX_CLASSES rows, checked when planning
        .join(F.broadcast(cuts), label)
        .filter(F.struct(hashed.alias("_h"), *keys) <= F.col("_cut"))
        .select(*df.columns)
    )
    return kept.unionByName(below_cut) if whole else below_cut


# ---- the operators users call ----------------------------------------------


def stratified_sample(
    df: DataFrame,
    label: str,
    key: str | Sequence[str],
    fractions: Mapping[Any, float],
    seed: int,
    replace: bool = True,
) -> DataFrame:
    """Exactly ceil(fraction * n) rows of each class; unnamed classes give none."""
    counts = class_counts(df, label)
    unknown = set(fractions) - set(counts)
    if unknown:
        raise ValueError(f"no rows with label {sorted(unknown)}")
    plan = [
        {label: c, "n": n, "draws": -int(-(n * float(fractions.get(c, 0.0))) // 1)}
        for c, n in counts.items()
    ]
    draw = draw_with_replacement if replace else keep_smallest_hashes
    return draw(df, label, key, plan, seed)


def oversample(
    df: DataFrame, label: str, key: str | Sequence[str], seed: int, mode: str = "rounds", **sizes: int
) -> DataFrame:
    """The table plus exact draws that bring every class up to the largest one."""
    plan = _plan_rows(oversample_plan(df, label, mode), label)
    return df.unionByName(draw_with_replacement(df, label, key, plan, seed, **sizes))


def undersample(
    df: DataFrame,
    label: str,
    key: str | Sequence[str],
    seed: int,
    target: int | float | None = None,
    replace: bool = False,
    **sizes: int,
) -> DataFrame:
    """Every class down to the same size, with or without replacement."""
    plan = _plan_rows(undersample_plan(df, label, target), label)
    draw = draw_with_replacement if replace else keep_smallest_hashes
    return draw(df, label, key, plan, seed, **sizes)
