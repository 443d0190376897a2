"""Queries that train ``pyspark.ml`` learners.  Iterative fits have no SQL form."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.features import Features
from ..functions.ranking import ensure_checkpoint_dir, scratch_path
from ..operators import confusion as cm
from ..operators import forest, regression
from ..operators.counts import class_counts
from ..operators.curves import binary_areas, class_score_areas
from ..operators.encode import assemble, fit_vocabulary
from ..operators.resample import oversample
from ..operators.split import with_cell, with_fold, with_side
from ..plans import forests, learners, regressions, tuning
from ..plans.report import evaluation_report
from ..plans.selection import TopChiSquare
from ..sources.tables import dataset_path, spread
from .base import LINE_KEY, LINE_KEY_SQL, SEED, below_sql, h60, query, r6, table
from .bayes_queries import _AREA

WIDTH = 64
DOCUMENT_NAMES = ["n_chars", "lang", "source"]
_CV_FOLDS = 10


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("features")
    )


def _documents(spark, sf_dir, label="quality"):
    documents = table(spark, sf_dir, "documents", "doc_id", "n_chars", "lang", "source")
    labels = table(spark, sf_dir, "labels", "doc_id", label)
    rows = documents.join(labels, "doc_id")
    encoded = fit_vocabulary(rows, ["lang", "source"]).transform(rows)
    return assemble(encoded, DOCUMENT_NAMES, label, keep=["doc_id"])


def assemble_text(rows, names, label, keep):
    """``(keep..., label, features)`` with the label as text."""
    features = array_to_vector(F.array(*[F.col(n).cast("double") for n in names])).alias("features")
    return rows.select(*keep, F.col(label).cast("string").alias("label"), features)


def _sides(rows, key):
    marked = with_side(rows, key, SEED)
    return (marked.filter(F.col("side") == s).drop("side") for s in ("train", "test"))


_DOCUMENT_FEATURES = Features.of_vector("features", len(DOCUMENT_NAMES))
_LABELLED_SQL = f"""j AS (SELECT doc_id, quality, n_chars, lang, source FROM documents JOIN labels USING (doc_id)),
    li AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, lang) - 1 AS x2 FROM j GROUP BY lang),
    si AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS x3 FROM j GROUP BY source),
    d AS (SELECT doc_id, quality::double AS y, n_chars::double AS x1, x2::double AS x2, x3::double AS x3, {h60('doc_id')} AS h, {h60('doc_id', SEED + 1)} AS g
          FROM j JOIN li USING (lang) JOIN si USING (source))"""


def _newton_sql(steps: int = 10) -> str:
    """``w(model, b, w1, w2, w3)`` from training rows ``t(model, penalty, y, x1, x2, x3)``: Newton's steps written out.

    Each step solves its four equations by a Cholesky factor, column by column.
    """
    z, k = ["1.0", "z1", "z2", "z3"], range(4)
    ctes = [
        "m AS MATERIALIZED (SELECT model, any_value(penalty) AS penalty, count(*)::double AS n, avg(y) AS r, "
        + ", ".join(f"avg(x{j}) AS m{j}, stddev_samp(x{j}) AS s{j}" for j in (1, 2, 3)) + " FROM t GROUP BY 1)",
        "zs AS MATERIALIZED (SELECT model, penalty, n, y, " + ", ".join(f"(x{j} - m{j}) / s{j} AS z{j}" for j in (1, 2, 3)) + " FROM t JOIN m USING (model, penalty))",
        "n0 AS (SELECT model, ln(r / (1 - r)) AS b0, 0::double AS b1, 0::double AS b2, 0::double AS b3 FROM m)",
    ]
    for i in range(steps):
        ridge = lambda j: f" + penalty * b{j}" if j else ""
        sums = [f"sum((p - y) * {z[j]}) / any_value(n) AS g{j}" for j in k] + [f"sum(p * (1 - p) * {z[a]} * {z[b]}) / any_value(n) AS a{a}{b}" for a in k for b in range(a + 1)]
        ctes.append(f"e{i} AS MATERIALIZED (SELECT model, penalty, b0, b1, b2, b3, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2 + b3 * z3))) AS p FROM zs JOIN n{i} USING (model)) GROUP BY ALL)")
        inner = f"SELECT *, {', '.join(f'g{j}{ridge(j)} AS q{j}' for j in k)}, {', '.join(f'a{j}{j}' + (' + penalty' if j else '') + f' AS d{j}' for j in k)} FROM e{i}"
        for c in k:
            inner = f"SELECT *, sqrt(d{c}{''.join(f' - l{c}{e} * l{c}{e}' for e in range(c))}) AS l{c}{c} FROM ({inner})"
            below = [f"(a{r}{c}{''.join(f' - l{r}{e} * l{c}{e}' for e in range(c))}) / l{c}{c} AS l{r}{c}" for r in k if r > c]
            inner = f"SELECT *, {', '.join([*below, f'0 AS u{c}'])} FROM ({inner})"
        for c in k:
            inner = f"SELECT *, (q{c}{''.join(f' - l{c}{e} * v{e}' for e in range(c))}) / l{c}{c} AS v{c} FROM ({inner})"
        for c in reversed(k):
            inner = f"SELECT *, (v{c}{''.join(f' - l{e}{c} * o{e}' for e in k if e > c)}) / l{c}{c} AS o{c} FROM ({inner})"
        ctes.append(f"n{i + 1} AS MATERIALIZED (SELECT model, {', '.join(f'b{j} - o{j} AS b{j}' for j in k)} FROM ({inner}))")
    ctes.append(f"w AS (SELECT model, b0 - b1 * m1 / s1 - b2 * m2 / s2 - b3 * m3 / s3 AS b, b1 / s1 AS w1, b2 / s2 AS w2, b3 / s3 AS w3 FROM n{steps} JOIN m USING (model))")
    return ", ".join(ctes)


_MARGIN_SQL = "1 / (1 + exp(-(b + w1 * x1 + w2 * x2 + w3 * x3)))"
_HOLDOUT_SQL = f"""{_LABELLED_SQL}, t AS (SELECT 0 AS model, 1.0::double AS penalty, y, x1, x2, x3 FROM d WHERE h < {below_sql(0.8)}),
    {_newton_sql()}, held AS (SELECT doc_id, y, {_MARGIN_SQL} AS p FROM d, w WHERE h >= {below_sql(0.8)})"""


def _one_regression(df, key):
    """Fitted on all rows of ``df``; (weights, rows)."""
    rows = regression.labelled_cells(df.withColumn("_cell", F.lit(0)), _DOCUMENT_FEATURES, "label", "_cell", [key])
    with learners.held_in_memory(rows) as held:
        return regression.fit_many(held, len(DOCUMENT_NAMES), np.ones((1, 1), bool), [1.0])


def _scored(df, fits, key="doc_id"):
    rows = regression.labelled_cells(df.withColumn("_cell", F.lit(0)), _DOCUMENT_FEATURES, "label", "_cell", [key])
    return regression.score_many(rows, len(DOCUMENT_NAMES), fits.weights, np.ones((1, 1), bool), [key])


_TWO_CLASS_SQL = """cc AS (SELECT count(*)::double AS rows, {tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn FROM held),
    kc AS (SELECT 1.0::double AS label, tp, fp, fn, tn FROM cc UNION ALL SELECT 0.0, tn, fn, fp, tp FROM cc),
    rc AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, tp / nullif(tp + fn, 0) AS recall, fp / nullif(fp + tn, 0) AS fpr FROM kc),
    fc AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rc)"""


@query(
    "lr_fit",
    f"""WITH {_HOLDOUT_SQL}, z AS (SELECT 0 AS one, round(p, 9) AS score, y = 1 AS hit FROM held), {_AREA.format(by='one')},
        {_TWO_CLASS_SQL.format(**{n: f"count(*) FILTER (WHERE (p > 0.11) = {hit} AND y = {y})" for n, hit, y in (('tp', 'true', 1), ('fp', 'true', 0), ('fn', 'false', 1), ('tn', 'false', 0))})}
        SELECT label::varchar AS label, unnest(['precision', 'recall', 'f1', 'fpr']) AS metric, unnest([round(precision, 6), round(recall, 6), round(f1, 6), round(fpr, 6)]) AS value FROM fc
        UNION ALL SELECT NULL, 'accuracy', round((tp + tn) / rows, 6) FROM cc
        UNION ALL SELECT NULL, unnest(['roc_auc', 'pr_auc']), unnest([round(roc_auc, 6), round(pr_auc, 6)]) FROM areas""",
)
def lr_fit(spark, sf_dir):
    """Two-class regression with a low threshold: its report on held-out rows."""
    train, test = _sides(_documents(spark, sf_dir), "doc_id")
    scored = _scored(test, _one_regression(train, "doc_id")).withColumn("prediction", learners.above_threshold(F.col("score"), 0.11))
    report = evaluation_report(scored.withColumn("score", F.round("score", 9)), label="y", score="score", positive=1.0)
    shown = report.where("label is not null or metric in ('accuracy', 'roc_auc', 'pr_auc')")
    return shown.select("label", "metric", r6("value", "value"))


@query(
    "lr_coefficients",
    f"""WITH {_LABELLED_SQL}, t AS (SELECT 0 AS model, 1.0::double AS penalty, y, x1, x2, x3 FROM d), {_newton_sql()}
        SELECT 1 AS class, unnest([-1, 0, 1, 2]) AS pos, unnest(['intercept', 'n_chars', 'lang', 'source']) AS name,
               unnest([round(b, 9), round(w1, 9), round(w2, 9), round(w3, 9)]) AS weight, 0.0::double AS library_gap FROM w""",
)
def lr_coefficients(spark, sf_dir):
    """Weights at the optimum, and how far those of the library's fit are from them, in standard deviations of a feature."""
    rows = _documents(spark, sf_dir)
    fits = _one_regression(rows, "doc_id")
    with learners.held_in_memory(rows) as held:
        model = learners.logistic_regression(tol=1e-10, maxIter=500).fit(held)
    spread = Features.of_vector("features", len(DOCUMENT_NAMES)).long(rows, []).groupBy("pos").agg(F.stddev_samp("value").alias("spread"))
    theirs = learners.coefficient_table(spark, model, DOCUMENT_NAMES).select("pos", F.col("weight").alias("theirs"))
    gap = F.when(F.col("pos") < 0, 0.0).otherwise(F.round(F.abs(F.col("weight") - F.col("theirs")) * F.col("spread"), 4))
    # a few rows a side
    weighed = fits.table(spark, DOCUMENT_NAMES).join(theirs, "pos", "left").join(spread, "pos", "left")
    return weighed.select(F.lit(1).alias("class"), "pos", "name", F.round("weight", 9).alias("weight"), gap.alias("library_gap"))


@query("lr_multinomial")
def lr_multinomial(spark, sf_dir):
    """Ten-class regression: class metrics and areas from its probabilities."""
    rows = _vectors(spark, sf_dir)
    classes = list(class_counts(rows))
    train, test = _sides(rows, "vec_id")
    with learners.held_in_memory(train) as held:
        model = learners.multinomial_regression().fit(held)
    scored = learners.scored_rows(model.transform(test), ["vec_id"])
    metrics = cm.class_metrics(cm.class_totals(cm.confusion(scored)))
    areas = class_score_areas(scored, "probability", "label", classes)
    return metrics.join(areas, "label")


_MOMENT_TOLERANCE = 1e-2


@query(
    "lr_multinomial_moments",
    """SELECT label::double AS label, i::int AS pos, count(*) AS rows, round(sum(embedding[i + 1]::double), 6) AS moment
       FROM embeddings, range(64) r(i) GROUP BY 1, 2""",
)
def lr_multinomial_moments(spark, sf_dir):
    """First-order optimality: of each class and feature, the sum over its rows equals the sum weighted by its probability.

    ``moment`` is the observed sum where the model's agrees with it to ``_MOMENT_TOLERANCE``, else the model's.
    """
    rows = _vectors(spark, sf_dir)
    classes = list(class_counts(rows))
    with learners.held_in_memory(rows) as held:
        model = learners.multinomial_regression(tol=1e-9, maxIter=1000).fit(held)
    x, p = vector_to_array("features"), vector_to_array("probability")
    each = F.array(*[F.struct(F.lit(float(c)).alias("class"), F.get("p", F.lit(int(c))).alias("share")) for c in classes])
    scored = model.transform(rows).select("label", x.alias("x"), p.alias("p")).select("label", "x", F.inline(each))
    long = scored.select("class", "share", (F.col("label") == F.col("class")).alias("own"), F.posexplode("x").alias("pos", "value"))
    sums = long.groupBy(F.col("class").alias("label"), "pos").agg(
        F.count_if("own").alias("rows"), F.sum(F.when(F.col("own"), F.col("value"))).alias("seen"), F.sum(F.col("share") * F.col("value")).alias("model")
    )
    agreed = F.when(F.abs(F.col("seen") - F.col("model")) <= _MOMENT_TOLERANCE, F.col("seen")).otherwise(F.col("model"))
    return sums.select("label", "pos", "rows", r6(agreed, "moment"))


@query("lr_multinomial_coefficients")
def lr_multinomial_coefficients(spark, sf_dir):
    with learners.held_in_memory(_vectors(spark, sf_dir)) as rows:
        model = learners.multinomial_regression().fit(rows)
    names = Features.of_vector("x", WIDTH).names
    return learners.coefficient_table(spark, model, names, pivot=True)


@query(
    "lr_scored_rows",
    f"""WITH {_HOLDOUT_SQL} SELECT doc_id, y AS label, CASE WHEN p > 0.9 THEN 1.0::double ELSE 0.0::double END AS prediction,
        round(1 - p, 9) AS probability_0, round(p, 9) AS probability_1 FROM held""",
)
def lr_scored_rows(spark, sf_dir):
    """Every held-out row with its label, class and probabilities."""
    train, test = _sides(_documents(spark, sf_dir), "doc_id")
    scored = _scored(test, _one_regression(train, "doc_id"))
    return scored.select(
        "doc_id", F.col("y").alias("label"), learners.above_threshold(F.col("score"), 0.9).alias("prediction"),
        F.round(1 - F.col("score"), 9).alias("probability_0"), F.round("score", 9).alias("probability_1"),
    )


def _forest(spark, sf_dir, trees=20):
    rows = _vectors(spark, sf_dir)
    index = learners.fit_label_index(rows.withColumn("label", F.col("label").cast("string")))
    rows = rows.withColumn("label", F.col("label").cast("string"))
    train, test = _sides(rows, "vec_id")
    with learners.held_in_memory(train) as held:
        model = learners.forest_pipeline(index.labels, SEED, trees).fit(held)
    return model, test


@query("rf_fit")
def rf_fit(spark, sf_dir):
    """Random forest, judged on decoded labels."""
    model, test = _forest(spark, sf_dir)
    scored = model.transform(test)
    return evaluation_report(scored, label="label", prediction="predictedLabel")


@query("rf_importances")
def rf_importances(spark, sf_dir):
    model, _ = _forest(spark, sf_dir)
    return learners.importance_table(spark, model.stages[2], Features.of_vector("x", WIDTH).names)


@query("rf_trees")
def rf_trees(spark, sf_dir):
    model, _ = _forest(spark, sf_dir)
    return learners.forest_table(spark, model.stages[2])


@query(
    "rf_votes",
    f"""SELECT label::double::varchar AS label, count(*) AS rows, 0::bigint AS changed FROM embeddings
        WHERE {h60('vec_id')} >= {below_sql(0.8)} GROUP BY 1""",
)
def rf_votes(spark, sf_dir):
    """Votes of a forest by joins of rows with its nodes: the classes must be the library's."""
    model, test = _forest(spark, sf_dir)
    scored = model.transform(test)
    nodes = forest.node_table(spark, model.stages[2])
    ours = forest.votes(scored.select("vec_id", "indexedFeatures"), nodes, ["vec_id"], "indexedFeatures")
    theirs = scored.select("vec_id", "label", F.col("prediction").alias("_theirs"), vector_to_array("rawPrediction").alias("_raw"))
    off = (F.col("prediction") != F.col("_theirs")) | F.exists(F.zip_with("votes", "_raw", lambda a, b: F.abs(a - b)), lambda d: d > 1e-9)
    return theirs.join(ours, "vec_id").groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.count_if(off).alias("changed"))


@query("rf_node_sums", f"SELECT i::int AS pos, 'x_' || i AS name, 0.0::double AS library_gap, 0::bigint AS unsound_nodes FROM range({WIDTH}) r(i)")
def rf_node_sums(spark, sf_dir):
    """Importances from the node table against the library's, and nodes whose children do not add up."""
    model, _ = _forest(spark, sf_dir)
    nodes = forest.node_table(spark, model.stages[2])
    theirs = learners.importance_table(spark, model.stages[2], Features.of_vector("x", WIDTH).names)
    both = theirs.withColumnRenamed("importance", "theirs").join(forest.importances(nodes, WIDTH), "pos")
    unsound = forest.unsound_nodes(nodes).agg(F.count(F.lit(1)).alias("unsound_nodes"))
    return both.select("pos", "name", F.round(F.abs(F.col("importance") - F.col("theirs")), 9).alias("library_gap")).join(F.broadcast(unsound))


_TREE_FEATURES = ["l_discount", "l_tax", "l_linenumber"]


def _tree_sql() -> str:
    """``nodes``: a tree of two levels grown on four fifths of ``lineitem``, every split the best of all by the Gini impurity.

    As in the library, candidate thresholds lie between neighbouring values of the
    whole training side, and children that predict the same class are merged.
    """
    counted = lambda c, p: ", ".join(f"coalesce(sum(n) FILTER (WHERE {c} AND label = '{y}'), 0)::double AS {p}{y.lower()}" for y in "ANR")
    size = lambda p: f"({p}a + {p}n + {p}r)"
    gini = lambda p: f"(1 - ({p}a / {size(p)}) * ({p}a / {size(p)}) - ({p}n / {size(p)}) * ({p}n / {size(p)}) - ({p}r / {size(p)}) * ({p}r / {size(p)}))"

    def best(name: str, rows: str) -> str:
        return f"""{name}u AS MATERIALIZED (SELECT path, label, unnest([0, 1, 2]) AS feature, unnest([x0, x1, x2]) AS x, n FROM {rows}),
        {name}s AS (SELECT path, u.feature, t.threshold, {counted('x <= threshold', 'l')}, {counted('x > threshold', 'r')} FROM {name}u u JOIN cuts t ON t.feature = u.feature GROUP BY 1, 2, 3),
        {name} AS MATERIALIZED (SELECT * FROM (SELECT *, {gini('t')} - {size('l')} / {size('t')} * {gini('l')} - {size('r')} / {size('t')} * {gini('r')} AS gain
             FROM (SELECT *, la + ra AS ta, ln + rn AS tn, lr + rr AS tr FROM {name}s) WHERE {size('l')} > 0 AND {size('r')} > 0)
             WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY path ORDER BY gain DESC, feature, threshold) = 1)"""

    # the class of a node: the first of the largest in order of the label's frequency
    top = lambda p: f"(SELECT label FROM o WHERE CASE label WHEN 'A' THEN {p}a WHEN 'N' THEN {p}n ELSE {p}r END = greatest({p}a, {p}n, {p}r) ORDER BY k LIMIT 1)"
    return f"""y AS (SELECT l_returnflag AS label, l_discount::double AS x0, l_tax::double AS x1, l_linenumber::double AS x2, {h60(LINE_KEY_SQL)} < {below_sql(0.8)} AS train FROM lineitem),
    o AS (SELECT label, row_number() OVER (ORDER BY count(*) DESC, label) AS k FROM y GROUP BY 1),
    g AS MATERIALIZED (SELECT '' AS path, label, x0, x1, x2, count(*) AS n FROM y WHERE train GROUP BY ALL),
    vals AS (SELECT DISTINCT unnest([0, 1, 2]) AS feature, unnest([x0, x1, x2]) AS x FROM g),
    cuts AS MATERIALIZED (SELECT feature, (x + lead(x) OVER (PARTITION BY feature ORDER BY x)) / 2 AS threshold FROM vals QUALIFY threshold IS NOT NULL),
    {best('b0', 'g')},
    g1 AS MATERIALIZED (SELECT CASE WHEN [x0, x1, x2][feature + 1] <= threshold THEN 'L' ELSE 'R' END AS path, label, x0, x1, x2, n FROM g, b0),
    {best('b1', 'g1')},
    c1 AS (SELECT *, {top('l')} AS lc, {top('r')} AS rc FROM b1),
    k1 AS (SELECT * FROM c1 WHERE lc <> rc),
    c0 AS (SELECT *, {top('l')} AS lc, {top('r')} AS rc FROM b0),
    k0 AS (SELECT * FROM c0 WHERE lc <> rc OR EXISTS (SELECT 1 FROM k1)),
    nodes AS (SELECT '' AS path, feature, threshold, ta AS a, tn AS n, tr AS r, {top('t')} AS prediction FROM k0
        UNION ALL SELECT 'L', k1.feature, k1.threshold, c0.la, c0.ln, c0.lr, c0.lc FROM (SELECT la, ln, lr, lc FROM c0 WHERE EXISTS (SELECT 1 FROM k0)) c0 LEFT JOIN k1 ON k1.path = 'L'
        UNION ALL SELECT 'R', k1.feature, k1.threshold, c0.ra, c0.rn, c0.rr, c0.rc FROM (SELECT ra, rn, rr, rc FROM c0 WHERE EXISTS (SELECT 1 FROM k0)) c0 LEFT JOIN k1 ON k1.path = 'R'
        UNION ALL SELECT path || 'L', NULL, NULL, la, ln, lr, lc FROM k1 UNION ALL SELECT path || 'R', NULL, NULL, ra, rn, rr, rc FROM k1)"""


def _small_tree(spark, sf_dir):
    """A tree that is fully determined: all rows, all features, two levels."""
    rows = spread(table(spark, sf_dir, "lineitem", *LINE_KEY, *[f for f in _TREE_FEATURES if f not in LINE_KEY], "l_returnflag"), LINE_KEY)
    rows = assemble_text(rows, _TREE_FEATURES, "l_returnflag", LINE_KEY)
    labels = learners.fit_label_index(rows).labels
    train, test = _sides(rows, LINE_KEY)
    with learners.held_in_memory(train) as held:
        model = learners.forest_pipeline(labels, SEED, 1, 2, bootstrap=False, featureSubsetStrategy="all", maxDepth=2).fit(held)
    return labels, model, test


@query("tree_nodes", f"""WITH {_tree_sql()} SELECT path, feature, round(threshold, 6) AS threshold, a::bigint AS n_a, n::bigint AS n_n, r::bigint AS n_r, prediction FROM nodes""")
def tree_nodes(spark, sf_dir):
    """The learned tree, node by node."""
    labels, model, _ = _small_tree(spark, sf_dir)
    nodes = forest.node_table(spark, model.stages[2])
    named = F.array(*[F.lit(x) for x in labels])
    counts = [F.element_at("counts", labels.index(y) + 1).cast("bigint").alias(f"n_{y.lower()}") for y in "ANR"]
    return nodes.select("path", "feature", r6("threshold", "threshold"), *counts, F.element_at(named, F.col("prediction").cast("int") + 1).alias("prediction"))


@query(
    "tree_confusion",
    f"""WITH {_tree_sql()}, way AS (SELECT label, [x0, x1, x2] AS x FROM y WHERE NOT train),
        one AS (SELECT label, x, CASE WHEN r.path IS NULL THEN '' WHEN x[r.feature + 1] <= r.threshold THEN 'L' ELSE 'R' END AS path FROM way LEFT JOIN nodes r ON r.path = ''),
        two AS (SELECT label, CASE WHEN m.feature IS NULL THEN one.path WHEN x[m.feature + 1] <= m.threshold THEN one.path || 'L' ELSE one.path || 'R' END AS path FROM one LEFT JOIN nodes m ON m.path = one.path AND one.path <> '')
        SELECT label, prediction, count(*) AS n FROM two JOIN nodes USING (path) GROUP BY 1, 2""",
)
def tree_confusion(spark, sf_dir):
    """Held-out rows by true class and by the class that joins with the nodes give."""
    labels, model, test = _small_tree(spark, sf_dir)
    nodes = forest.node_table(spark, model.stages[2])
    indexed = PipelineModel(model.stages[:2]).transform(test)
    judged = forest.votes(indexed.select(*LINE_KEY, "label", "indexedFeatures"), nodes, [*LINE_KEY, "label"], "indexedFeatures")
    named = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    return cm.confusion(judged.withColumn("prediction", named))


@query("mlp_fit")
def mlp_fit(spark, sf_dir):
    """Perceptron trained on an oversampled training side."""
    train, test = _sides(_vectors(spark, sf_dir), "vec_id")
    classes = list(class_counts(train))
    with learners.held_in_memory(oversample(train, "label", "vec_id", SEED)) as held:
        model = learners.perceptron([WIDTH, 20, len(classes)]).fit(held)
    return evaluation_report(model.transform(test))


@query(
    "model_roundtrip",
    """SELECT count(*) AS rows, 0::bigint AS changed FROM documents JOIN labels USING (doc_id)""",
)
def model_roundtrip(spark, sf_dir):
    """A stored and reloaded model must score every row as before."""
    rows = _documents(spark, sf_dir)
    model = Pipeline(stages=[learners.logistic_regression()]).fit(rows)
    path = dataset_path(scratch_path(spark, "models"), "documents", "model")
    learners.save_model(model, path)
    score = learners.class_probability().alias("p")
    before = model.transform(rows).select("doc_id", score)
    after = learners.load_model(path).transform(rows).select("doc_id", score.alias("q"))
    return before.join(after, "doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("p") != F.col("q")).alias("changed")
    )


@query(
    "cv_lr",
    f"""WITH {_LABELLED_SQL}, own AS (SELECT *, (g % {_CV_FOLDS})::int AS fold FROM d WHERE h < {below_sql(0.8)}),
        t AS (SELECT model, 1.0::double AS penalty, y, x1, x2, x3 FROM own, range({_CV_FOLDS + 1}) r(model) WHERE fold <> model), {_newton_sql()},
        z AS (SELECT model, round({_MARGIN_SQL}, 9) AS score, y = 1 AS hit FROM own JOIN w ON model = fold
              UNION ALL SELECT model, round({_MARGIN_SQL}, 9), y = 1 FROM d, w WHERE model = {_CV_FOLDS} AND h >= {below_sql(0.8)}), {_AREA.format(by='model')}
        SELECT a.positives, a.negatives, round(a.roc_auc, 6) AS roc_auc, round(a.pr_auc, 6) AS pr_auc,
               (SELECT round(avg(roc_auc), 6) FROM areas WHERE model < {_CV_FOLDS} AND negatives > 0 AND positives > 0) AS cv_roc_auc
        FROM areas a WHERE model = {_CV_FOLDS}""",
)
def cv_lr(spark, sf_dir):
    """Cross-validation on four fifths of the rows; the fit on all of them judged on the other fifth."""
    train, test = _sides(_documents(spark, sf_dir), "doc_id")
    # folds are drawn by another seed than sides
    areas, fits = regressions.regression_folds(train, _DOCUMENT_FEATURES, "label", "doc_id", _CV_FOLDS, SEED + 1)
    held_out = _scored(test, fits).withColumn("score", F.round("score", 9))
    mean = areas.where("fold is not null").agg(F.avg("roc_auc").alias("cv_roc_auc"))
    found = binary_areas(held_out, "score", "y", 1.0)
    # one row each
    return found.select("positives", "negatives", r6("roc_auc", "roc_auc"), r6("pr_auc", "pr_auc")).join(F.broadcast(mean.select(r6("cv_roc_auc", "cv_roc_auc"))))


@query("cv_rf_grid")
def cv_rf_grid(spark, sf_dir):
    """Forest sizes and category limits, resampling the training side of each fold only."""
    rows = _vectors(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    labels = learners.fit_label_index(rows).labels
    return forests.forest_sizes(
        with_fold(rows, "vec_id", _CV_FOLDS, SEED), labels, "vec_id", [1, 3, 5, 10, 20], [5, 20], _CV_FOLDS, SEED,
        resample=lambda train: oversample(train, "label", "vec_id", SEED),
    )


@query("cv_selection_grid")
def cv_selection_grid(spark, sf_dir):
    """How many chi-square columns to keep, selected anew inside every fold."""
    stages = [
        TopChiSquare(outputCol="selected"),
        learners.logistic_regression(featuresCol="selected"),
    ]
    return tuning.cross_validate(
        with_fold(_documents(spark, sf_dir), "doc_id", 10, SEED),
        Pipeline(stages=stages),
        BinaryClassificationEvaluator(rawPredictionCol="probability", numBins=0),
        tuning.param_grid({stages[0].k: [1, 2]}),
        folds=10,
    )


def _network_grid(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    net = learners.perceptron([WIDTH, 10])
    shapes = [[WIDTH, 18, 10, 10], [WIDTH, 20, 14, 8, 10]]
    grid = tuning.param_grid({net.layers: shapes, net.maxIter: [5]})
    rows = with_fold(_vectors(spark, sf_dir), "vec_id", _CV_FOLDS, SEED)
    return rows, net, grid, tuning.cross_validate(rows, net, MulticlassClassificationEvaluator(metricName="f1"), grid, folds=_CV_FOLDS)


@query("cv_mlp_grid")
def cv_mlp_grid(spark, sf_dir):
    return _network_grid(spark, sf_dir)[3]


@query("mlp_layers")
def mlp_layers(spark, sf_dir):
    """Layers of the network that cross-validation chose, with its rank among all candidates."""
    model, ranked = tuning.refit_best(*_network_grid(spark, sf_dir))
    rows = [(i, int(n)) for i, n in enumerate(model.getLayers())]
    # one row
    return spark.createDataFrame(rows, "layer int, nodes int").join(F.broadcast(ranked.where("rank = 1")))


_LR_ROUNDS, _LR_CELLS, _NESTED_ROUNDS, _PENALTIES = 100, regressions.CELLS, 10, (0.1, 1.0)
_ROUND_CELLS_SQL = f"""own AS (SELECT *, (h % {_LR_CELLS})::int AS cell FROM d),
    q AS (SELECT cell::int AS cell, round::int AS round, {h60('cell, round')} < {below_sql(0.2)} AS test, ({h60('cell, round', SEED + 1)} % {_CV_FOLDS})::int AS fold
          FROM range({_LR_CELLS}) c(cell), range({{rounds}}) r(round))"""


@query(
    "lr_repeated_holdout",
    f"""WITH {_LABELLED_SQL}, {_ROUND_CELLS_SQL.format(rounds=_LR_ROUNDS)},
        t AS (SELECT round AS model, 1.0::double AS penalty, y, x1, x2, x3 FROM own JOIN q USING (cell) WHERE NOT test), {_newton_sql(8)},
        z AS (SELECT round, round({_MARGIN_SQL}, 9) AS score, y = 1 AS hit FROM own JOIN q USING (cell) JOIN w ON model = round WHERE test), {_AREA.format(by='round')},
        v AS (SELECT unnest(['roc_auc', 'pr_auc']) AS metric, unnest([CASE WHEN positives > 0 AND negatives > 0 THEN roc_auc END, CASE WHEN positives > 0 THEN pr_auc END]) AS v FROM areas)
        SELECT metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS stddev,
               round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75 FROM v GROUP BY 1""",
)
def lr_repeated_holdout(spark, sf_dir):
    """Areas over repeated hold-outs of a regression, with their spread."""
    areas = regressions.regression_rounds(_documents(spark, sf_dir), _DOCUMENT_FEATURES, "label", "doc_id", _LR_ROUNDS, SEED)
    both = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in ("roc_auc", "pr_auc")])
    found = tuning.summarize(areas.select(F.inline(both)), ["metric"])
    return found.select("metric", "n", *[r6(c, c) for c in ("mean", "stddev", "q25", "median", "q75")])


@query(
    "lr_repeated_cv",
    f"""WITH {_LABELLED_SQL}, {_ROUND_CELLS_SQL.format(rounds=_NESTED_ROUNDS)},
        v AS (SELECT row_number() OVER (ORDER BY round, penalty, fold) AS model, * FROM range({_NESTED_ROUNDS}) a(round), range({_CV_FOLDS + 1}) b(fold), (SELECT unnest([{', '.join(f'{p}::double' for p in _PENALTIES)}]) AS penalty)),
        t AS (SELECT model, penalty, y, x1, x2, x3 FROM own JOIN q USING (cell) JOIN v ON v.round = q.round AND v.fold <> q.fold WHERE NOT test), {_newton_sql(8)},
        z AS (SELECT model, round({_MARGIN_SQL}, 9) AS score, y = 1 AS hit FROM own JOIN q USING (cell) JOIN v ON v.round = q.round JOIN w USING (model)
              WHERE CASE WHEN v.fold = {_CV_FOLDS} THEN test ELSE NOT test AND v.fold = q.fold END), {_AREA.format(by='model')},
        j2 AS (SELECT round, penalty, avg(roc_auc) AS cv FROM areas JOIN v USING (model) WHERE fold < {_CV_FOLDS} AND positives > 0 AND negatives > 0 GROUP BY 1, 2),
        best AS (SELECT * FROM j2 QUALIFY row_number() OVER (PARTITION BY round ORDER BY round(cv, 12) DESC, penalty) = 1)
        SELECT round::int AS round, penalty, round(cv, 6) AS cv_roc_auc, round(CASE WHEN positives > 0 AND negatives > 0 THEN roc_auc END, 6) AS roc_auc
        FROM best JOIN v USING (round, penalty) JOIN areas USING (model) WHERE fold = {_CV_FOLDS}""",
)
def lr_repeated_cv(spark, sf_dir):
    """Cross-validation inside every hold-out: the penalty is chosen on training rows."""
    found = regressions.regression_nested(_documents(spark, sf_dir), _DOCUMENT_FEATURES, "label", "doc_id", _NESTED_ROUNDS, _CV_FOLDS, SEED, _PENALTIES)
    return found.select("round", "penalty", r6("cv_roc_auc", "cv_roc_auc"), r6("roc_auc", "roc_auc"))


@query("multinomial_repeated_holdout")
def multinomial_repeated_holdout(spark, sf_dir):
    rows = with_cell(_vectors(spark, sf_dir), "vec_id", 256, SEED)
    results = tuning.repeated_holdout(
        rows,
        learners.multinomial_regression(),
        {"accuracy": MulticlassClassificationEvaluator(metricName="accuracy")},
        rounds=100,
        seed=SEED,
    )
    return tuning.summarize(results, ["metric"])


@query("rf_repeated_holdout")
def rf_repeated_holdout(spark, sf_dir):
    """Forests on oversampled training sides, judged against the label index."""
    rows = _vectors(spark, sf_dir).withColumn("label", F.col("label").cast("string"))
    labels = learners.fit_label_index(rows).labels
    return tuning.repeated_holdout(
        with_cell(rows, "vec_id", 256, SEED),
        learners.forest_pipeline(labels, SEED, trees=20),
        {"f1": MulticlassClassificationEvaluator(labelCol="indexedLabel", metricName="f1")},
        rounds=20,
        seed=SEED,
        resample=lambda train: oversample(train, "label", "vec_id", SEED),
    )
