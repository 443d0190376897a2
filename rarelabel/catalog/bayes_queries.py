"""Queries over naive Bayes: fitted weights, scores, repeated hold-outs, folds."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.features import Features
from ..functions.ranking import ensure_checkpoint_dir
from ..operators import naive_bayes as nb
from ..operators import sparse_bayes
from ..operators.confusion import class_totals, confusion, overall_metrics
from ..operators.counts import class_counts
from ..operators.curves import binary_areas
from ..operators.split import with_side
from ..plans.holdout import naive_bayes_folds, naive_bayes_rounds
from ..plans import learners
from ..plans.tuning import best_params, ranked_candidates
from ..sources.tables import spread
from .base import LINE_KEY, LINE_KEY_SQL, SEED, below_sql, h60, query, r6, table

NAMES = ["l_quantity", "l_discount", "l_tax", "late"]
FEATURES = Features.columns(NAMES)
ROUNDS, CELLS, FOLDS, LAMBDAS = 100, 4096, 10, (0.5, 1.0, 2.0)


def _rows(spark, sf_dir):
    rows = table(
        spark, sf_dir, "lineitem", *LINE_KEY, "l_quantity", "l_discount", "l_tax", "l_linestatus",
        "l_returnflag",
    )
    return spread(rows, LINE_KEY).withColumn("late", (F.col("l_linestatus") == "F").cast("double"))


_BASE = f"""SELECT {h60(LINE_KEY_SQL)} AS h, l_returnflag AS label, l_quantity AS x0, l_discount AS x1,
                   l_tax AS x2, (l_linestatus = 'F')::int::double AS x3 FROM lineitem"""
_SUMS = "count(*)::double AS n, sum(x0) AS s0, sum(x1) AS s1, sum(x2) AS s2, sum(x3) AS s3"
_RESUM = "sum(n) AS n, sum(s0) AS s0, sum(s1) AS s1, sum(s2) AS s2, sum(s3) AS s3"


def _model_sql(sums: str, by: str, lam: str) -> str:
    over = f"OVER (PARTITION BY {by})" if by else "OVER ()"
    keys = f"{by}, " if by else ""
    thetas = ", ".join(f"ln(s{i} + {lam}) - ln(s0 + s1 + s2 + s3 + 4 * {lam}) AS t{i}" for i in range(4))
    return f"""SELECT {keys}label, n, ln(n + {lam}) - ln(sum(n) {over} + {lam} * count(*) {over}) AS pi,
                      {thetas} FROM {sums}"""


_SCORE = "pi + t0 * x0 + t1 * x1 + t2 * x2 + t3 * x3"


@query(
    "nb_fit",
    f"""WITH x AS ({_BASE}), s AS (SELECT label, {_SUMS} FROM x GROUP BY 1), m AS ({_model_sql('s', '', '1.0')})
        SELECT label, round(pi, 6) AS pi, unnest(range(4))::int AS pos,
               unnest([round(t0, 6), round(t1, 6), round(t2, 6), round(t3, 6)]) AS theta FROM m""",
)
def nb_fit(spark, sf_dir):
    model = nb.fit(_rows(spark, sf_dir), FEATURES, "l_returnflag")
    return nb.weights(model).select("label", r6("pi", "pi"), "pos", r6("theta", "theta"))


@query(
    "nb_score",
    f"""WITH x AS ({_BASE}), tr AS (SELECT * FROM x WHERE h < {below_sql(0.8)}),
             s AS (SELECT label, {_SUMS} FROM tr GROUP BY 1), m AS ({_model_sql('s', '', '1.0')}),
             z AS (SELECT x.h, x.label, arg_max(m.label, ({_SCORE})) AS prediction
                   FROM x, m WHERE x.h >= {below_sql(0.8)}
                   GROUP BY x.h, x.label, x0, x1, x2, x3)
        SELECT label, prediction, count(*) AS n FROM z GROUP BY 1, 2""",
)
def nb_score(spark, sf_dir):
    from ..operators.split import with_side

    rows = with_side(_rows(spark, sf_dir), LINE_KEY, SEED)
    labels = list(class_counts(rows, "l_returnflag"))
    model = nb.fit(rows.filter(F.col("side") == "train"), FEATURES, "l_returnflag")
    test = rows.filter(F.col("side") == "test").withColumn("label", F.col("l_returnflag"))
    return confusion(nb.score(test, model, FEATURES, labels, keep=["label"]))


_CELLS = f"""x AS (SELECT (h % {CELLS})::int AS cell, * FROM ({_BASE})),
    c AS (SELECT cell, label, {_SUMS} FROM x GROUP BY 1, 2),
    r AS (SELECT unnest(range({ROUNDS}))::int AS round),
    s AS (SELECT round, label, {_RESUM} FROM c, r
          WHERE {h60('cell, round')} >= {below_sql(0.2)} GROUP BY 1, 2),
    m AS ({_model_sql('s', 'round', '1.0')}),
    w AS (SELECT round,
                 max(CASE label WHEN 'A' THEN [pi, t0, t1, t2, t3] END) AS a,
                 max(CASE label WHEN 'N' THEN [pi, t0, t1, t2, t3] END) AS b,
                 max(CASE label WHEN 'R' THEN [pi, t0, t1, t2, t3] END) AS c FROM m GROUP BY 1),
    q AS (SELECT DISTINCT cell, round FROM (SELECT DISTINCT cell FROM x), r
          WHERE {h60('cell, round')} < {below_sql(0.2)})"""


def _dot(w: str) -> str:
    return f"({w}[1] + {w}[2] * x0 + {w}[3] * x1 + {w}[4] * x2 + {w}[5] * x3)"


_PICK = f"""CASE WHEN {_dot('a')} >= {_dot('b')} AND {_dot('a')} >= {_dot('c')} THEN 'A'
                 WHEN {_dot('b')} >= {_dot('c')} THEN 'N' ELSE 'R' END"""


@query(
    "nb_repeated_holdout",
    f"""WITH {_CELLS}, z AS (SELECT round, label, {_PICK} AS prediction
             FROM x JOIN q USING (cell) JOIN w USING (round))
        SELECT round, count(*) AS rows, round(avg((label = prediction)::int), 6) AS accuracy
        FROM z GROUP BY 1""",
)
def nb_repeated_holdout(spark, sf_dir):
    predictions = naive_bayes_rounds(
        _rows(spark, sf_dir), FEATURES, "l_returnflag", LINE_KEY, ROUNDS, SEED, cells=CELLS
    )
    totals = class_totals(confusion(predictions, ["round"]), ["round"])
    return overall_metrics(totals, ["round"]).select("round", "rows", r6("accuracy", "accuracy"))


_AREA = """p AS (SELECT {by}, score, count(*) FILTER (WHERE hit) AS p, count(*) FILTER (WHERE NOT hit) AS n
              FROM z GROUP BY ALL),
    k AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp FROM p
          WINDOW w AS (PARTITION BY {by} ORDER BY score DESC)),
    g AS (SELECT {by}, p, n, tp, fp, tp / (tp + fp) AS here,
                 CASE WHEN tp + fp > p + n THEN (tp - p) / (tp + fp - p - n) ELSE tp / (tp + fp) END AS before
          FROM k),
    areas AS (SELECT {by}, sum(p)::bigint AS positives, sum(n)::bigint AS negatives,
                     sum(n * (tp - p + tp) / 2) / (sum(p)::double * sum(n)) AS roc_auc,
                     sum(p * (before + here) / 2) / sum(p) AS pr_auc FROM g GROUP BY {by})"""


@query(
    "nb_areas_by_round",
    f"""WITH {_CELLS}, z AS (SELECT round, label = 'R' AS hit,
                 round(exp({_dot('c')} - greatest({_dot('a')}, {_dot('b')}, {_dot('c')})) / (
                     exp({_dot('a')} - greatest({_dot('a')}, {_dot('b')}, {_dot('c')}))
                     + exp({_dot('b')} - greatest({_dot('a')}, {_dot('b')}, {_dot('c')}))
                     + exp({_dot('c')} - greatest({_dot('a')}, {_dot('b')}, {_dot('c')}))), 9) AS score
             FROM x JOIN q USING (cell) JOIN w USING (round)), {_AREA.format(by='round')}
        SELECT round, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM areas""",
)
def nb_areas_by_round(spark, sf_dir):
    scored = naive_bayes_rounds(
        _rows(spark, sf_dir), FEATURES, "l_returnflag", LINE_KEY, ROUNDS, SEED, cells=CELLS,
        probability_of="R",
    ).withColumn("probability", F.round("probability", 9))
    areas = binary_areas(scored, "probability", "label", "R", ["round"])
    return areas.select("round", r6("roc_auc", "roc_auc"), r6("pr_auc", "pr_auc"))


_FOLDED = f"""x AS (SELECT (h % {FOLDS})::int AS fold, * FROM ({_BASE})),
    c AS (SELECT fold, label, {_SUMS} FROM x GROUP BY 1, 2),
    f AS (SELECT unnest(range({FOLDS}))::int AS held),
    l AS (SELECT unnest([{', '.join(f'{v}::double' for v in LAMBDAS)}]) AS smoothing),
    s AS (SELECT smoothing, held AS fold, label, {_RESUM} FROM c, f, l WHERE fold <> held GROUP BY 1, 2, 3),
    m AS ({_model_sql('s', 'smoothing, fold', 'smoothing')}),
    w AS (SELECT smoothing, fold,
                 max(CASE label WHEN 'A' THEN [pi, t0, t1, t2, t3] END) AS a,
                 max(CASE label WHEN 'N' THEN [pi, t0, t1, t2, t3] END) AS b,
                 max(CASE label WHEN 'R' THEN [pi, t0, t1, t2, t3] END) AS c FROM m GROUP BY 1, 2),
    z AS (SELECT smoothing, fold, label, {_PICK} AS prediction FROM x JOIN w USING (fold)),
    acc AS (SELECT smoothing, fold, avg((label = prediction)::int) AS accuracy FROM z GROUP BY 1, 2)"""


def _fold_accuracy(spark, sf_dir):
    predictions = naive_bayes_folds(
        _rows(spark, sf_dir), FEATURES, "l_returnflag", LINE_KEY, FOLDS, SEED, LAMBDAS
    )
    by = ["smoothing", "fold"]
    return overall_metrics(class_totals(confusion(predictions, by), by), by).select(*by, "accuracy")


@query("nb_cv", f"WITH {_FOLDED} SELECT smoothing, fold, round(accuracy, 6) AS accuracy FROM acc")
def nb_cv(spark, sf_dir):
    return _fold_accuracy(spark, sf_dir).select("smoothing", "fold", r6("accuracy", "accuracy"))


@query(
    "best_params",
    f"""WITH {_FOLDED} SELECT 'smoothing=' || smoothing AS params, round(avg(accuracy), 6) AS avg_metric
        FROM acc GROUP BY smoothing ORDER BY round(avg(accuracy), 12) DESC, 1 LIMIT 1""",
)
def best_params_query(spark, sf_dir):
    named = F.concat(F.lit("smoothing="), F.col("smoothing").cast("string")).alias("params")
    results = _fold_accuracy(spark, sf_dir).select(named, "fold", F.col("accuracy").alias("metric"))
    return best_params(results).select("params", r6("avg_metric", "avg_metric"))


_SHARE = f"""round(exp({_dot('c')} - greatest({_dot('a')}, {_dot('b')}, {_dot('c')})) / (
                     exp({_dot('a')} - greatest({_dot('a')}, {_dot('b')}, {_dot('c')}))
                     + exp({_dot('b')} - greatest({_dot('a')}, {_dot('b')}, {_dot('c')}))
                     + exp({_dot('c')} - greatest({_dot('a')}, {_dot('b')}, {_dot('c')}))), 9)"""
_FOLD_AREAS = f"""{_FOLDED}, z2 AS (SELECT smoothing, fold, label = 'R' AS hit, {_SHARE} AS score FROM x JOIN w USING (fold)),
    {_AREA.format(by='smoothing, fold').replace('FROM z ', 'FROM z2 ')}"""


def _fold_areas(spark, sf_dir):
    scored = naive_bayes_folds(
        _rows(spark, sf_dir), FEATURES, "l_returnflag", LINE_KEY, FOLDS, SEED, LAMBDAS, probability_of="R"
    ).withColumn("probability", F.round("probability", 9))
    return binary_areas(scored, "probability", "label", "R", ["smoothing", "fold"])


@query("nb_cv_areas", f"WITH {_FOLD_AREAS} SELECT smoothing, fold, round(roc_auc, 6) AS roc_auc FROM areas")
def nb_cv_areas(spark, sf_dir):
    """Cross-validation judged by the area under the ROC curve, fold by fold."""
    return _fold_areas(spark, sf_dir).select("smoothing", "fold", r6("roc_auc", "roc_auc"))


@query(
    "nb_best_by_area",
    f"""WITH {_FOLD_AREAS} SELECT 'smoothing=' || smoothing AS params, count(*) AS folds, round(avg(roc_auc), 6) AS avg_metric,
        (row_number() OVER (ORDER BY round(avg(roc_auc), 12) DESC, 'smoothing=' || smoothing))::int AS rank FROM areas GROUP BY smoothing""",
)
def nb_best_by_area(spark, sf_dir):
    """All candidates in order of their mean area."""
    named = F.concat(F.lit("smoothing="), F.col("smoothing").cast("string")).alias("params")
    results = _fold_areas(spark, sf_dir).select(named, "fold", F.col("roc_auc").alias("metric"))
    return ranked_candidates(results).select("params", "folds", r6("avg_metric", "avg_metric"), "rank")


_PARAMETERS_SQL = "VALUES ('featuresCol', 'features'), ('labelCol', 'label'), ('modelType', 'multinomial'), ('predictionCol', 'prediction'), ('probabilityCol', 'probability'), ('rawPredictionCol', 'rawPrediction')"


@query(
    "model_parameters",
    f"""WITH {_FOLDED}, best AS (SELECT smoothing FROM acc GROUP BY smoothing ORDER BY round(avg(accuracy), 12) DESC, 'smoothing=' || smoothing LIMIT 1)
        SELECT 0 AS stage, * FROM ({_PARAMETERS_SQL}) v(param, value) UNION ALL SELECT 0, 'smoothing', smoothing::varchar FROM best""",
)
def model_parameters(spark, sf_dir):
    """Settings of the model that cross-validation chose, fitted on all rows."""
    named = F.concat(F.lit("smoothing="), F.col("smoothing").cast("string")).alias("params")
    ranked = ranked_candidates(_fold_accuracy(spark, sf_dir).select(named, "fold", F.col("accuracy").alias("metric")))
    chosen = float(ranked.where("rank = 1").first()["params"].removeprefix("smoothing="))
    rows = _rows(spark, sf_dir).select(array_to_vector(F.array(*NAMES)).alias("features"), F.col("late").alias("label"))
    return learners.parameter_table(spark, learners.naive_bayes(chosen).fit(rows))


# ---- wide, sparse features: words of documents in 100,000 positions -----------

WORD_WIDTH = 100_000
_WORDS_SQL = f"""d AS (SELECT doc_id, lang, {h60('doc_id')} < {below_sql(0.8)} AS train,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+') AS words FROM documents),
    e AS (SELECT doc_id, lang, train, ('0x' || substr(md5(word), 1, 15))::bigint % {WORD_WIDTH} AS pos, count(*)::double AS value FROM (SELECT *, unnest(words) AS word FROM d) GROUP BY ALL),
    s AS (SELECT lang AS label, pos, sum(value) AS s FROM e WHERE train GROUP BY 1, 2),
    m AS (SELECT label, sum(s) + {WORD_WIDTH} AS total FROM s GROUP BY 1),
    c AS (SELECT lang AS label, count(*) AS n FROM d WHERE train GROUP BY 1),
    k AS (SELECT label, ln(n + 1) - ln(sum(n) OVER () + count(*) OVER ()) AS pi, -ln(coalesce(total, {WORD_WIDTH})) AS unseen FROM c LEFT JOIN m USING (label)),
    t AS (SELECT label, pos, ln(s + 1) - ln(total) AS theta FROM s JOIN m USING (label))"""


_REPEATED_ROWS = 500_000
_ENTRIES = "doc_id bigint, lang string, side string, words array<struct<pos:int,value:double>>"


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's words by position and number; places of words are kept for a while, as most words come again."""
    places: dict[bytes, int] = {}
    for batch in batches:
        ends, positions, values = [0], [], []
        for text in batch.column("text").to_pylist():
            found = Counter(re.findall(b"[a-z]+", text.encode().lower()) if text else ())  # bytes: only A-Z change
            counts: dict[int, int] = {}
            for word, n in found.items():
                place = places.get(word)
                if place is None:
                    if len(places) >= 200_000:
                        places.clear()
                    place = places[word] = int(hashlib.md5(word).hexdigest()[:15], 16) % WORD_WIDTH
                counts[place] = counts.get(place, 0) + n
            positions.extend(counts)
            values.extend(counts.values())
            ends.append(len(positions))
        each = pa.StructArray.from_arrays([pa.array(positions, pa.int32()), pa.array(values, pa.float64())], names=["pos", "value"])
        words = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "side")), words], names=["doc_id", "lang", "side", "words"])


def _word_entries(spark, sf_dir):
    """One row for each ``doc_id, lang``: rows that share both are one document."""
    read = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    each = with_side(read, "doc_id", SEED).select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "side", "text").mapInArrow(_counted_words, _ENTRIES)
    ensure_checkpoint_dir(spark)
    again = read.groupBy(F.col("doc_id").cast("bigint").alias("_id"), F.col("lang").alias("_lang")).count().where("count > 1").drop("count").checkpoint()
    several = again.count()
    if not several:
        return each
    again = F.broadcast(again) if several <= _REPEATED_ROWS else again
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("lang").eqNullSafe(F.col("_lang"))
    long = each.join(again, same, "left_semi").select("doc_id", "lang", "side", F.inline_outer("words"))
    summed = long.groupBy("doc_id", "lang", "side", "pos").agg(F.sum("value").alias("value"))
    held = F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "value")))
    return each.join(again, same, "left_anti").unionByName(summed.groupBy("doc_id", "lang", "side").agg(held.alias("words")))


def _word_model(spark, sf_dir):
    rows = _word_entries(spark, sf_dir).checkpoint()
    return rows, sparse_bayes.fit(rows.where("side = 'train'"), "words", WORD_WIDTH, "lang")


@query("nb_sparse_fit", f"WITH {_WORDS_SQL} SELECT label, pos::int AS pos, round(theta, 6) AS theta FROM t")
def nb_sparse_fit(spark, sf_dir):
    """Weights of the words of each language in 100,000 positions."""
    return _word_model(spark, sf_dir)[1].weights.select("label", "pos", r6("theta", "theta"))


@query(
    "nb_sparse_score",
    f"""WITH {_WORDS_SQL}, z AS (SELECT doc_id, k.label, any_value(d.lang) AS lang, any_value(pi) + coalesce(sum(value * coalesce(theta, unseen)), 0) AS score
             FROM d JOIN k ON true LEFT JOIN e USING (doc_id) LEFT JOIN t ON t.label = k.label AND t.pos = e.pos WHERE NOT d.train GROUP BY 1, 2),
        b AS (SELECT doc_id, any_value(lang) AS lang, min_by(label, (-round(score, 9), label)) AS prediction FROM z GROUP BY 1)
        SELECT lang AS label, prediction, count(*) AS n FROM b GROUP BY 1, 2""",
)
def nb_sparse_score(spark, sf_dir):
    """Languages of held-out documents by their words."""
    rows, model = _word_model(spark, sf_dir)
    test = rows.where("side = 'test'")
    guessed = sparse_bayes.predict(sparse_bayes.scores(test, model, "words", ["doc_id", "lang"]), ["doc_id", "lang"])
    return confusion(guessed.select(F.col("lang").alias("label"), "prediction"))
