"""Queries over confusion counts, class metrics, curves and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import below, uniform_hash
from ..functions.ranking import scratch_path
from ..operators import confusion as cm
from ..operators import curves
from ..operators.counts import class_counts, label_domain
from ..plans.learners import above_threshold, linear_score
from ..plans.report import evaluation_report, write_report
from .base import LINE_KEY, LINE_KEY_SQL, SEED, below_sql, h60, query, r6, table
from .bayes_queries import _AREA

# a stand-in classifier: right for about 70 % of rows, else one class further
_PRED = f"""z AS (SELECT l_returnflag AS label, l_linenumber % 3 AS round, l_quantity / 50 AS score,
    CASE WHEN {h60(LINE_KEY_SQL)} < {below_sql(0.7)} THEN l_returnflag
         WHEN l_returnflag = 'A' THEN 'N' WHEN l_returnflag = 'N' THEN 'R' ELSE 'A' END AS prediction
    FROM lineitem)"""
_TOTALS = """c AS (SELECT {by} label, prediction, count(*) AS n FROM z GROUP BY ALL),
    y AS (SELECT DISTINCT label AS y FROM z),
    t AS (SELECT {by} y AS label, sum(CASE WHEN label = y AND prediction = y THEN n ELSE 0 END)::bigint AS tp,
                 sum(CASE WHEN label <> y AND prediction = y THEN n ELSE 0 END)::bigint AS fp,
                 sum(CASE WHEN label = y AND prediction <> y THEN n ELSE 0 END)::bigint AS fn,
                 sum(CASE WHEN label <> y AND prediction <> y THEN n ELSE 0 END)::bigint AS tn
          FROM c, y GROUP BY ALL),
    k AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
                 CASE WHEN tp + fn = 0 THEN NULL ELSE tp / (tp + fn) END AS recall,
                 CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
                 CASE WHEN fp + tn = 0 THEN NULL ELSE fp / (fp + tn) END AS fpr, tp + fn AS support FROM t)"""


def _predictions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", *LINE_KEY, "l_returnflag", "l_quantity")
    flag = F.col("l_returnflag")
    wrong = F.when(flag == "A", "N").when(flag == "N", "R").otherwise("A")
    right = uniform_hash(*LINE_KEY, seed=SEED) < below(0.7)
    return rows.select(
        flag.alias("label"),
        (F.col("l_linenumber") % 3).alias("round"),
        (F.col("l_quantity") / 50).alias("score"),
        F.when(right, flag).otherwise(wrong).alias("prediction"),
    )


@query("confusion", f"WITH {_PRED} SELECT label, prediction, count(*) AS n FROM z GROUP BY 1, 2")
def confusion(spark, sf_dir):
    return cm.confusion(_predictions(spark, sf_dir))


@query(
    "class_totals",
    f"WITH {_PRED}, {_TOTALS.format(by='')} SELECT label, tp, fp, fn, tn FROM t",
)
def class_totals(spark, sf_dir):
    return cm.class_totals(cm.confusion(_predictions(spark, sf_dir)))


_CLASS_COLUMNS = ", ".join(f"round({m}, 6) AS {m}" for m in ("precision", "recall", "f1", "fpr"))


@query(
    "per_class_metrics",
    f"WITH {_PRED}, {_TOTALS.format(by='')} SELECT label, {_CLASS_COLUMNS}, support FROM k",
)
def per_class_metrics(spark, sf_dir):
    metrics = cm.class_metrics(cm.class_totals(cm.confusion(_predictions(spark, sf_dir))))
    return metrics.select("label", *[r6(m, m) for m in ("precision", "recall", "f1", "fpr")], "support")


_OVERALL = [
    "accuracy", "micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall",
    "macro_f1", "macro_fpr", "weighted_precision", "weighted_recall", "weighted_f1", "weighted_fpr",
]
_OVERALL_SQL = """SELECT {by} sum(tp) / sum(support) AS accuracy, sum(tp) / sum(support) AS micro_precision,
    sum(tp) / sum(support) AS micro_recall, sum(tp) / sum(support) AS micro_f1,
    avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1,
    avg(fpr) AS macro_fpr, sum(precision * support) / sum(support) AS weighted_precision,
    sum(recall * support) / sum(support) AS weighted_recall, sum(f1 * support) / sum(support) AS weighted_f1,
    sum(fpr * support) / sum(support) AS weighted_fpr FROM k GROUP BY ALL"""


@query(
    "micro_macro_weighted",
    f"""WITH {_PRED}, {_TOTALS.format(by='')}, o AS ({_OVERALL_SQL.format(by='')})
        SELECT {', '.join(f'round({m}, 6) AS {m}' for m in _OVERALL)} FROM o""",
)
def micro_macro_weighted(spark, sf_dir):
    metrics = cm.overall_metrics(cm.class_totals(cm.confusion(_predictions(spark, sf_dir))))
    return metrics.select(*[r6(m, m) for m in _OVERALL])


@query(
    "accuracy",
    f"""WITH {_PRED} SELECT round, count(*) AS rows, round(avg((label = prediction)::int), 6) AS accuracy
        FROM z GROUP BY 1""",
)
def accuracy(spark, sf_dir):
    counts = cm.confusion(_predictions(spark, sf_dir), ["round"])
    metrics = cm.overall_metrics(cm.class_totals(counts, ["round"]), ["round"])
    return metrics.select("round", "rows", r6("accuracy", "accuracy"))


@query(
    "absent_class",
    f"""WITH {_PRED}, r AS (SELECT label, prediction FROM z WHERE label <> 'N'),
        d AS (SELECT DISTINCT label AS y FROM z)
        SELECT y AS label,
               round(CASE WHEN sum((prediction = y)::int) = 0 THEN 0 ELSE
                     sum((label = y AND prediction = y)::int) / sum((prediction = y)::int) END, 6) AS precision,
               round(CASE WHEN sum((label = y)::int) = 0 THEN NULL ELSE
                     sum((label = y AND prediction = y)::int) / sum((label = y)::int) END, 6) AS recall,
               sum((label = y)::int)::bigint AS support
        FROM r, d GROUP BY y""",
)
def absent_class(spark, sf_dir):
    predictions = _predictions(spark, sf_dir)
    domain = label_domain(predictions)
    seen = predictions.filter(F.col("label") != "N")
    metrics = cm.class_metrics(cm.class_totals(cm.confusion(seen), domain=domain))
    return metrics.select("label", r6("precision", "precision"), r6("recall", "recall"), "support")


_EVENT_AREAS = """z AS (SELECT 'click' AS label, value AS score, event_type = 'click' AS hit FROM events),
    """ + _AREA.format(by="label")


@query("roc_auc", f"WITH {_EVENT_AREAS} SELECT positives, negatives, round(roc_auc, 6) AS roc_auc FROM areas")
def roc_auc(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_type", "value")
    areas = curves.binary_areas(events, "value", "event_type", "click")
    return areas.select("positives", "negatives", r6("roc_auc", "roc_auc"))


@query("pr_auc", f"WITH {_EVENT_AREAS} SELECT positives, negatives, round(pr_auc, 6) AS pr_auc FROM areas")
def pr_auc(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_type", "value")
    areas = curves.binary_areas(events, "value", "event_type", "click")
    return areas.select("positives", "negatives", r6("pr_auc", "pr_auc"))


@query(
    "ovr_auc",
    f"""WITH y AS (SELECT DISTINCT event_type AS label FROM events),
             z AS (SELECT label, value AS score, event_type = label AS hit FROM events, y),
             {_AREA.format(by='label')}
        SELECT label, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM areas""",
)
def ovr_auc(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_type", "value")
    classes = list(class_counts(events, "event_type"))
    areas = curves.one_vs_rest_areas(events, "value", "event_type", classes)
    return areas.select("label", r6("roc_auc", "roc_auc"), r6("pr_auc", "pr_auc"))


_SCORES_SQL = f"""z AS (SELECT unnest(['A', 'N', 'R']) AS label,
        unnest([l_discount, l_tax, l_quantity]) AS score,
        unnest([l_returnflag = 'A', l_returnflag = 'N', l_returnflag = 'R']) AS hit FROM lineitem),
    {_AREA.format(by='label')}"""


def _class_areas(spark, sf_dir):
    rows = table(
        spark, sf_dir, "lineitem", "l_returnflag", "l_discount", "l_tax", "l_quantity"
    ).withColumn("scores", F.array("l_discount", "l_tax", "l_quantity"))
    classes = list(class_counts(rows, "l_returnflag"))
    return curves.class_score_areas(rows, "scores", "l_returnflag", classes)


@query(
    "class_score_auc",
    f"WITH {_SCORES_SQL} SELECT label, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM areas",
)
def class_score_auc(spark, sf_dir):
    return _class_areas(spark, sf_dir).select(
        "label", r6("roc_auc", "roc_auc"), r6("pr_auc", "pr_auc")
    )


@query(
    "macro_auc",
    f"""WITH {_SCORES_SQL} SELECT round(avg(roc_auc), 6) AS roc_auc, round(avg(pr_auc), 6) AS pr_auc
        FROM areas""",
)
def macro_auc(spark, sf_dir):
    return curves.macro_areas(_class_areas(spark, sf_dir)).select(
        r6("roc_auc", "roc_auc"), r6("pr_auc", "pr_auc")
    )


@query(
    "ovr_auc_by_round",
    f"""WITH {_PRED}, yy AS (SELECT DISTINCT label AS c FROM z), zz AS (SELECT round, c AS label, score, z.label = c AS hit FROM z, yy),
        {_AREA.format(by='round, label').replace('FROM z ', 'FROM zz ')}
        SELECT round, label, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM areas""",
)
def ovr_auc_by_round(spark, sf_dir):
    """Each class against the others, round by round."""
    rows = _predictions(spark, sf_dir)
    areas = curves.one_vs_rest_areas(rows, "score", "label", list(class_counts(rows)), ["round"])
    return areas.select("round", "label", r6("roc_auc", "roc_auc"), r6("pr_auc", "pr_auc"))


_REPORT_SQL = f"""WITH {_PRED}, {_TOTALS.format(by='round,')},
    o AS ({_OVERALL_SQL.format(by='round,')}),
    zz AS (SELECT round, score, label = 'R' AS hit FROM z),
    {_AREA.format(by='round').replace('FROM z ', 'FROM zz ').replace('k AS', 'kk AS').replace('FROM k)', 'FROM kk)')}
    SELECT round, label, unnest(['precision', 'recall', 'f1', 'fpr']) AS metric,
           unnest([round(precision, 6), round(recall, 6), round(f1, 6), round(fpr, 6)]) AS value FROM k
    UNION ALL SELECT round, NULL, unnest([{', '.join(f"'{m}'" for m in _OVERALL)}]),
           unnest([{', '.join(f'round({m}, 6)' for m in _OVERALL)}]) FROM o
    UNION ALL SELECT round, NULL, unnest(['roc_auc', 'pr_auc']),
           unnest([round(roc_auc, 6), round(pr_auc, 6)]) FROM areas"""


@query("evaluation_report", _REPORT_SQL)
def evaluation_report_query(spark, sf_dir):
    report = evaluation_report(
        _predictions(spark, sf_dir), ["round"], score="score", positive="R"
    )
    path = scratch_path(spark, "reports")
    write_report(report, path, "lineitem")
    stored = spark.read.parquet(path)
    return stored.select("round", "label", "metric", r6("value", "value"))


# ---- a stored linear model --------------------------------------------------

WEIGHTS, INTERCEPT = (0.0002, 0.35, -0.4), 0.6
_LINEAR_SQL = """z AS (SELECT quality AS label, 1 / (1 + exp(-(0.6 + 0.0002::double * n_chars
        + 0.35::double * (lang = 'en')::int - 0.4::double * (source = 'src0')::int))) AS p
    FROM documents JOIN labels USING (doc_id))"""


def _linear_scores(spark, sf_dir):
    documents = table(spark, sf_dir, "documents", "doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality")
    values = [
        F.col("n_chars").cast("double"),
        (F.col("lang") == "en").cast("double"),
        (F.col("source") == "src0").cast("double"),
    ]
    score = linear_score(WEIGHTS, INTERCEPT, values)
    return documents.join(labels, "doc_id").select(F.col("quality").alias("label"), score.alias("p"))


@query(
    "lr_score_fixed",
    f"""WITH {_LINEAR_SQL} SELECT label, CASE WHEN p > 0.7 THEN 1.0::double ELSE 0.0::double END AS prediction,
        count(*) AS n, round(sum(p), 6) AS total FROM z GROUP BY 1, 2""",
)
def lr_score_fixed(spark, sf_dir):
    scored = _linear_scores(spark, sf_dir)
    return scored.groupBy("label", above_threshold(F.col("p"), 0.7).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("p"), "total")
    )


@query(
    "threshold_sweep",
    f"""WITH {_LINEAR_SQL}, t AS (SELECT unnest([0.11, 0.5, 0.7, 0.8, 0.9])::double AS t)
        SELECT t, sum((p > t AND label = 1)::int)::bigint AS tp, sum((p > t AND label = 0)::int)::bigint AS fp,
               sum((p <= t AND label = 0)::int)::bigint AS tn, sum((p <= t AND label = 1)::int)::bigint AS fn
        FROM z, t GROUP BY t""",
)
def threshold_sweep(spark, sf_dir):
    thresholds = F.explode(F.array(*[F.lit(t) for t in (0.11, 0.5, 0.7, 0.8, 0.9)])).alias("t")
    swept = _linear_scores(spark, sf_dir).select("label", "p", thresholds)
    hit, real = F.col("p") > F.col("t"), F.col("label") == 1
    return swept.groupBy("t").agg(
        F.count_if(hit & real).alias("tp"),
        F.count_if(hit & ~real).alias("fp"),
        F.count_if(~hit & ~real).alias("tn"),
        F.count_if(~hit & real).alias("fn"),
    )
