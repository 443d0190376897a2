"""Queries over splits, folds and per-class sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample, split
from .base import LINE_KEY, LINE_KEY_SQL, SEED, below_sql, h60, query, table

ROUNDS, CELLS = 100, 4096


def _side_counts(rows, *by):
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


@query(
    "holdout_split",
    f"""SELECT CASE WHEN {h60(LINE_KEY_SQL)} < {below_sql(0.8)} THEN 'train' ELSE 'test' END AS side,
               l_returnflag AS label, count(*) AS n FROM lineitem GROUP BY 1, 2""",
)
def holdout_split(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", *LINE_KEY, "l_returnflag")
    marked = split.with_side(rows, LINE_KEY, SEED)
    return _side_counts(marked, "side", F.col("l_returnflag").alias("label"))


@query(
    "seeded_split",
    f"""SELECT (o_h >= {below_sql(0.7)})::int AS part, o_orderstatus AS label, count(*) AS n,
               sum(o_orderkey)::bigint AS keys
        FROM (SELECT *, {h60('o_orderkey', 11)} AS o_h FROM orders) GROUP BY 1, 2""",
)
def seeded_split(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus")
    parts = split.split_rows(orders, "o_orderkey", seed=11, weights=(0.7, 0.3))
    named = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    return (
        named[0]
        .unionByName(named[1])
        .groupBy("part", F.col("o_orderstatus").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
    )


@query(
    "kfold_assign",
    f"""SELECT ({h60('event_id')} % 10)::int AS fold, event_type AS label, count(*) AS n
        FROM events GROUP BY 1, 2""",
)
def kfold_assign(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type")
    folded = split.with_fold(events, "event_id", 10, SEED)
    return _side_counts(folded, "fold", F.col("event_type").alias("label"))


@query(
    "repeated_splits",
    f"""WITH c AS (SELECT ({h60(LINE_KEY_SQL)} % {CELLS})::int AS cell, l_returnflag AS label,
                          count(*) AS n FROM lineitem GROUP BY 1, 2),
             r AS (SELECT unnest(range({ROUNDS}))::int AS round)
        SELECT round, {h60('cell, round')} < {below_sql(0.2)} AS held_out, label, sum(n)::bigint AS n
        FROM c, r GROUP BY 1, 2, 3""",
)
def repeated_splits(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", *LINE_KEY, "l_returnflag")
    celled = split.with_cell(rows, LINE_KEY, CELLS, SEED)
    sizes = celled.groupBy("cell", F.col("l_returnflag").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    plan = split.holdout_plan(spark, ROUNDS, CELLS, 0.2, SEED)
    return (
        split.round_rows(sizes, plan)
        .groupBy("round", "held_out", "label")
        .agg(F.sum("n").alias("n"))
    )


# ---- SQL for the sampling plans and draws ----------------------------------

_SIZES = "s AS (SELECT {label} AS label, count(*) AS n FROM {t} GROUP BY 1)"
_ROUNDS_PLAN = """p AS (SELECT label, n, (t * ((m - n + t - 1) // t))::bigint AS draws FROM (
    SELECT label, n, max(n) OVER () AS m, max(n) OVER () // min(n) OVER () + 1 AS t FROM s))"""
_EXACT_PLAN = "p AS (SELECT label, n, (max(n) OVER () - n)::bigint AS draws FROM s)"
_MIN_PLAN = "p AS (SELECT label, n, (min(n) OVER ())::bigint AS draws FROM s)"


def _numbered(label: str, key: str, t: str) -> str:
    return f"""r AS (SELECT {label} AS label, {key} AS id,
        row_number() OVER (PARTITION BY {label} ORDER BY {h60(key)}, {key}) - 1 AS idx FROM {t})"""


_DRAWN = f"""d AS (SELECT label, {h60('label, draw')} % n AS idx FROM (
    SELECT label, n, unnest(range(draws)) AS draw FROM p))"""


def _summary_sql(source: str) -> str:
    return f"""SELECT label, count(*) AS n, sum(id)::bigint AS ids, count(DISTINCT id) AS distinct_ids
               FROM ({source}) GROUP BY label"""


def _oversample_sql(label: str, key: str, t: str, plan: str) -> str:
    source = f"SELECT label, id FROM r UNION ALL SELECT label, id FROM d JOIN r USING (label, idx)"
    return (
        f"WITH {_SIZES.format(label=label, t=t)}, {plan}, {_numbered(label, key, t)}, {_DRAWN} "
        + _summary_sql(source)
    )


def _draw_sql(label: str, key: str, t: str, plan: str) -> str:
    return (
        f"WITH {_SIZES.format(label=label, t=t)}, {plan}, {_numbered(label, key, t)}, {_DRAWN} "
        + _summary_sql("SELECT label, id FROM d JOIN r USING (label, idx)")
    )


def _keep_sql(label: str, key: str, t: str, plan: str) -> str:
    return (
        f"WITH {_SIZES.format(label=label, t=t)}, {plan}, {_numbered(label, key, t)} "
        + _summary_sql("SELECT r.label, id FROM r JOIN p ON r.label = p.label AND idx < draws")
    )


def _summary(rows, label: str, key: str):
    return rows.groupBy(F.col(label).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(key).alias("ids"),
        F.count_distinct(key).alias("distinct_ids"),
    )


# orders above a price form a class of about a tenth of the table
_LARGE_SQL = "(SELECT o_orderkey, (o_totalprice > 360000)::int AS large FROM orders)"


def _large_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey", (F.col("o_totalprice") > 360000).cast("int").alias("large"), "o_totalprice"
    )


@query(
    "oversample_plan",
    f"""WITH {_SIZES.format(label='quality', t='labels')}, {_ROUNDS_PLAN}
        SELECT label AS quality, n, draws FROM p""",
)
def oversample_plan(spark, sf_dir):
    return resample.oversample_plan(table(spark, sf_dir, "labels"), "quality")


@query("oversample", _oversample_sql("quality", "doc_id", "labels", _ROUNDS_PLAN))
def oversample(spark, sf_dir):
    rows = resample.oversample(table(spark, sf_dir, "labels"), "quality", "doc_id", SEED)
    return _summary(rows, "quality", "doc_id")


@query("oversample_exact", _oversample_sql("large", "o_orderkey", _LARGE_SQL, _EXACT_PLAN))
def oversample_exact(spark, sf_dir):
    rows = resample.oversample(_large_orders(spark, sf_dir), "large", "o_orderkey", SEED, "exact")
    return _summary(rows, "large", "o_orderkey")


@query("oversample_five_classes", _oversample_sql("event_type", "event_id", "events", _ROUNDS_PLAN))
def oversample_five_classes(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type", "value")
    rows = resample.oversample(events, "event_type", "event_id", SEED)
    return _summary(rows, "event_type", "event_id")


@query("undersample_replace", _draw_sql("toxic", "doc_id", "labels", _MIN_PLAN))
def undersample_replace(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return _summary(resample.undersample(labels, "toxic", "doc_id", SEED, replace=True), "toxic", "doc_id")


@query("undersample_exact", _keep_sql("large", "o_orderkey", _LARGE_SQL, _MIN_PLAN))
def undersample_exact(spark, sf_dir):
    rows = resample.undersample(_large_orders(spark, sf_dir), "large", "o_orderkey", SEED)
    return _summary(rows, "large", "o_orderkey")


@query(
    "undersample_target",
    _keep_sql(
        "toxic",
        "doc_id",
        "labels",
        "p AS (SELECT label, n, ceil((min(n) OVER ()) * 0.7::double)::bigint AS draws FROM s)",
    ),
)
def undersample_target(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return _summary(resample.undersample(labels, "toxic", "doc_id", SEED, 0.7), "toxic", "doc_id")


@query(
    "stratified_sample",
    _draw_sql(
        "event_type",
        "event_id",
        "events",
        """p AS (SELECT label, n, ceil(n * CASE label WHEN 'click' THEN 0.3::double WHEN 'error'
           THEN 1.5::double ELSE 0 END)::bigint AS draws FROM s)""",
    ),
)
def stratified_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "event_type")
    rows = resample.stratified_sample(
        events, "event_type", "event_id", {"click": 0.3, "error": 1.5}, SEED
    )
    return _summary(rows, "event_type", "event_id")
