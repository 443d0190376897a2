"""Queries over chi-square selection and principal components."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from ..functions.features import Features
from ..functions.ranking import ensure_checkpoint_dir, scratch_path
from ..operators import chisq, impute, pca
from ..operators.resample import oversample
from ..operators.split import with_side
from ..sources import variants
from .base import LINE_KEY, LINE_KEY_SQL, SEED, below_sql, h60, query, r6, table

NAMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "late"]
FEATURES = Features.columns(NAMES)


def _rows(spark, sf_dir):
    return table(
        spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_linestatus", "l_returnflag",
    ).withColumn("late", (F.col("l_linestatus") == "F").cast("double"))


_SCORES = """
    x AS (SELECT l_returnflag AS label, unnest(range(5))::int AS pos,
                 unnest([l_quantity, l_extendedprice, l_discount, l_tax,
                         (l_linestatus = 'F')::int::double]) AS value FROM lineitem),
    o AS (SELECT pos, value, label, count(*) AS n FROM x GROUP BY ALL),
    c AS (SELECT l_returnflag AS label, count(*)::double AS n FROM lineitem GROUP BY 1),
    r AS (SELECT pos, value, sum(n)::double AS n FROM o GROUP BY ALL),
    t AS (SELECT count(*)::double AS n FROM lineitem),
    e AS (SELECT o.pos, o.value, o.n AS seen, r.n * c.n / t.n AS fit
          FROM o JOIN r USING (pos, value) JOIN c USING (label), t),
    a AS (SELECT pos, sum((seen - fit) * (seen - fit) / fit - fit) AS s FROM e GROUP BY pos),
    b AS (SELECT pos, sum(n) AS rows, count(*) AS vals FROM r GROUP BY pos),
    scores AS (SELECT pos, s + rows AS statistic,
                      (vals - 1) * ((SELECT count(*) FROM c) - 1) AS degrees,
                      vals / (SELECT n FROM t) AS value_share
               FROM a JOIN b USING (pos)),
    ranked AS (SELECT *, (row_number() OVER (ORDER BY statistic DESC, pos))::int AS rank FROM scores)"""
_NAME = "(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax', 'late'])[pos + 1]"


def _scores(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    return chisq.chi_square_scores(_rows(spark, sf_dir), FEATURES, "l_returnflag")


@query(
    "chisq_scores",
    f"""WITH {_SCORES} SELECT pos, {_NAME} AS name, round(statistic, 4) AS statistic, degrees,
        round(value_share, 6) AS value_share FROM scores""",
)
def chisq_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select(
        "pos", "name", F.round("statistic", 4).alias("statistic"), "degrees", r6("value_share", "value_share")
    )


@query(
    "chisq_p_values",
    f"""WITH {_SCORES} SELECT pos, round(list_sum(list_transform(range(degrees // 2),
            lambda i: exp(i * ln(statistic / 2) - lgamma(i + 1) - statistic / 2))), 6) AS p_value
        FROM scores""",
)
def chisq_p_values(spark, sf_dir):
    # three classes make every number of degrees even, where the tail is a finite sum
    return chisq.with_p_value(_scores(spark, sf_dir)).select("pos", r6("p_value", "p_value"))


@query("chisq_topk", f"WITH {_SCORES} SELECT rank, pos, {_NAME} AS name FROM ranked WHERE rank <= 3")
def chisq_topk(spark, sf_dir):
    ranked = chisq.rank_features(_scores(spark, sf_dir))
    return chisq.top_features(ranked, 3).select("rank", "pos", "name")


@query(
    "chisq_project",
    f"""WITH {_SCORES}, p AS (SELECT pos, value FROM x WHERE pos IN (SELECT pos FROM ranked WHERE rank <= 3))
        SELECT {_NAME} AS name, count(*) AS n, round(sum(value), 2) AS total FROM p GROUP BY 1""",
)
def chisq_project(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    ranked = chisq.rank_features(chisq.chi_square_scores(rows, FEATURES, "l_returnflag"))
    positions = chisq.selected_positions(ranked, 3)
    kept = chisq.project(rows, FEATURES, positions, [])
    names = F.array(*[F.lit(n) for n in kept.columns])
    long = Features.columns(kept.columns).long(kept, [])
    return (
        long.groupBy(names[F.col("pos")].alias("name"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    )


@query(
    "chisq_sweep",
    f"""WITH {_SCORES}, k AS (SELECT unnest([1, 2, 3, 4])::int AS k)
        SELECT k, rank, pos FROM ranked, k WHERE rank <= k""",
)
def chisq_sweep(spark, sf_dir):
    ranked = chisq.rank_features(_scores(spark, sf_dir))
    return chisq.sweep(ranked, chisq.sweep_sizes(FEATURES.width))


_EMB = """v AS (SELECT vec_id, unnest(range(64))::int AS pos, unnest(embedding)::double AS value
               FROM embeddings)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), array_to_vector("embedding").alias("features")
    )


@query(
    "covariance",
    f"""WITH {_EMB} SELECT a.pos AS i, b.pos AS j, round(covar_samp(a.value, b.value), 6) + 0.0::double AS cov
        FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.pos <= b.pos GROUP BY 1, 2""",
)
def covariance(spark, sf_dir):
    return pca.covariance(_vectors(spark, sf_dir)).select("i", "j", (F.round("cov", 6) + 0.0).alias("cov"))


@query(
    "pca_rotation",
    f"WITH {_EMB} SELECT vec_id, round(sum(value * value), 6) AS length2 FROM v GROUP BY 1",
)
def pca_rotation(spark, sf_dir):
    """Projecting on all components only rotates: each row keeps its length."""
    rows = _vectors(spark, sf_dir)
    turned = pca.pca_project(rows, pca.fit_pca(rows, 64))
    length = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x)
    return turned.select("vec_id", r6(length, "length2"))


@query("pca_project")
def pca_project(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    small = pca.pca_project(rows, pca.fit_pca(rows, 5))
    return Features.of_vector("features", 5).long(small, ["vec_id"])


@query("pca_components")
def pca_components(spark, sf_dir):
    rows = _vectors(spark, sf_dir)
    return pca.component_table(rows, pca.fit_pca(rows, 5))


@query(
    "pca_spectrum",
    f"""WITH {_EMB}, c AS (SELECT a.pos AS i, b.pos AS j, covar_samp(a.value, b.value) AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id GROUP BY 1, 2)
        SELECT 64::bigint AS components, round(sum(cov) FILTER (WHERE i = j), 6) AS total, round(sum(cov * cov), 6) AS squares,
               0.0::double AS largest_residual, 0.0::double AS length_gap FROM c""",
)
def pca_spectrum(spark, sf_dir):
    """All components solve C v = lambda v: eigenvalues add up to the variance, their squares to that of the whole matrix."""
    rows = _vectors(spark, sf_dir)
    ensure_checkpoint_dir(spark)
    found = pca.spectrum(rows, pca.fit_pca(rows, 64))
    return found.agg(
        F.count(F.lit(1)).alias("components"), r6(F.sum("eigenvalue"), "total"), r6(F.sum(F.col("eigenvalue") * F.col("eigenvalue")), "squares"),
        r6(F.max("residual"), "largest_residual"), r6(F.max(F.abs(F.col("length") - 1)), "length_gap"),
    )


# ---- published variants ------------------------------------------------------

def _label():
    flag = F.col("l_returnflag")
    return F.when(flag == "A", 0.0).when(flag == "N", 1.0).otherwise(2.0).alias("label")


def _sums_by_position(back, width):
    long = Features.of_vector("features", width).long(back, ["label"])
    return long.groupBy("label", "pos").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "variant_chisq",
    f"""WITH {_SCORES}, p AS (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS np FROM ranked WHERE rank <= 3)
        SELECT CASE label WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::double AS label, np::int AS pos, count(*) AS n, round(sum(value), 2) AS total
        FROM x JOIN p USING (pos) GROUP BY 1, 2""",
)
def variant_chisq(spark, sf_dir):
    """The best three columns by chi-square, published and read back."""
    rows = _rows(spark, sf_dir)
    ranked = chisq.rank_features(chisq.chi_square_scores(rows, FEATURES, "l_returnflag"))
    kept = chisq.project(rows, FEATURES, chisq.selected_positions(ranked, 3), ["l_returnflag"])
    names = [c for c in kept.columns if c != "l_returnflag"]
    made = kept.select(_label(), array_to_vector(F.array(*[F.col(c).cast("double") for c in names])).alias("features"))
    root = scratch_path(spark, "variants")
    variants.publish(made, len(names), root, "lineitem", "chisq", 3)
    return _sums_by_position(variants.read_variant(spark, root, "lineitem", "chisq", 3), 3)


@query(
    "variant_pca",
    """SELECT label::double AS label, count(*) AS n, round(sum(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 4) AS squares FROM embeddings GROUP BY 1""",
)
def variant_pca(spark, sf_dir):
    """All components published and read back: a rotation keeps the squares of every class."""
    rows = _vectors(spark, sf_dir)
    root = scratch_path(spark, "variants")
    variants.publish(pca.pca_project(rows, pca.fit_pca(rows, 64)), 64, root, "embeddings", "pca", 64)
    back = variants.read_variant(spark, root, "embeddings", "pca", 64)
    squares = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x)
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(squares), 4).alias("squares"))


@query(
    "variant_oversampled",
    """WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1), e AS (SELECT max(n) AS hi, max(n) // min(n) + 1 AS t FROM c)
       SELECT label::double AS label, (n + t * ((hi - n + t - 1) // t))::bigint AS n, 1::bigint AS versions FROM c, e""",
)
def variant_oversampled(spark, sf_dir):
    """Classes of a variant that was published twice: the second version is read, the first is gone."""
    rows = _vectors(spark, sf_dir)
    root = scratch_path(spark, "variants")
    variants.publish(rows, 64, root, "embeddings", "oversampling")
    variants.publish(oversample(rows, "label", "vec_id", SEED), 64, root, "embeddings", "oversampling")
    back = variants.read_variant(spark, root, "embeddings", "oversampling")
    versions = F.lit(len(variants.versions(spark, root, "embeddings", "oversampling"))).cast("bigint")
    return back.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", "n", versions.alias("versions"))


# ---- missing values ----------------------------------------------------------

_SENTINELS = {"l_quantity": [50.0], "l_discount": [0.0], "l_linenumber": [1]}
_POLICIES = {"l_quantity": "mean", "l_discount": "median", "l_linenumber": "mode"}
_IMPUTE_SQL = f"""t AS (SELECT CASE WHEN l_quantity <> 50 THEN l_quantity END AS q, CASE WHEN l_discount <> 0 THEN l_discount END AS d,
        CASE WHEN l_linenumber <> 1 THEN l_linenumber END AS n, {h60(LINE_KEY_SQL)} < {below_sql(0.8)} AS train FROM lineitem),
    f AS (SELECT avg(q) AS q, quantile_disc(d, 0.5) AS d, (SELECT n FROM t WHERE train AND n IS NOT NULL GROUP BY n ORDER BY count(*) DESC, n::varchar LIMIT 1) AS n,
        count(q) AS qp, count(*) - count(q) AS qm, count(d) AS dp, count(*) - count(d) AS dm, count(n) AS np, count(*) - count(n) AS nm FROM t WHERE train)"""


def _imputed(spark, sf_dir):
    rows = with_side(table(spark, sf_dir, "lineitem", *LINE_KEY, "l_quantity", "l_discount"), LINE_KEY, SEED)
    ensure_checkpoint_dir(spark)
    rows = impute.without_sentinels(rows, _SENTINELS)
    return rows, impute.fit_fillings(rows.where("side = 'train'"), _POLICIES)


@query(
    "impute_fit",
    f"""WITH {_IMPUTE_SQL} SELECT unnest(['l_quantity', 'l_discount', 'l_linenumber']) AS "column", unnest(['mean', 'median', 'mode']) AS policy,
        unnest([round(q, 6), round(d, 6), n::double]) AS value, unnest([qp, dp, np]) AS present, unnest([qm, dm, nm]) AS missing FROM f""",
)
def impute_fit(spark, sf_dir):
    """Fillings of three columns whose sentinels stand for missing values, from the training side."""
    _, found = _imputed(spark, sf_dir)
    return found.table.select("column", "policy", F.round(F.col("value").cast("double"), 6).alias("value"), "present", "missing")


@query(
    "impute_apply",
    f"""WITH {_IMPUTE_SQL} SELECT count(*) AS rows, round(sum(coalesce(t.q, f.q)), 2) AS quantity, round(sum(coalesce(t.d, f.d)), 2) AS discount,
        sum(coalesce(t.n, f.n))::bigint AS lines, count(*) - count(t.q) AS filled FROM t, f WHERE NOT train""",
)
def impute_apply(spark, sf_dir):
    """The other side filled with what the training side gave."""
    rows, found = _imputed(spark, sf_dir)
    done = found.transform(rows.where("side = 'test'"), flag="_filled")
    return done.agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_discount"), 2).alias("discount"),
        F.sum("l_linenumber").cast("bigint").alias("lines"), F.sum("l_quantity_filled").cast("bigint").alias("filled"),
    )
