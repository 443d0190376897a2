"""Queries over encoders, feature building and class counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.features import Features, feature_names, vector_width
from ..operators import counts, encode
from ..plans.learners import decode_labels, fit_label_index
from .base import query, table

_INDEX = """SELECT '{c}' AS "column", {c} AS value, count(*) AS n,
                   row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS idx
            FROM part GROUP BY {c}"""


@query("string_index", " UNION ALL ".join(_INDEX.format(c=c) for c in ("p_brand", "p_name", "p_type")))
def string_index(spark, sf_dir):
    columns = ["p_brand", "p_name", "p_type"]
    vocabulary = encode.fit_vocabulary(table(spark, sf_dir, "part", *columns), columns)
    return vocabulary.table.select("column", "value", "n", "idx")


_ORDER_INDEX = """SELECT {c} AS v, (row_number() OVER (ORDER BY count(*) DESC, {c}) - 1)::double AS idx
                  FROM orders GROUP BY {c}"""


@query(
    "indexed_rows",
    f"""SELECT o_orderkey, s.idx AS o_orderstatus, p.idx AS o_orderpriority
        FROM orders JOIN ({_ORDER_INDEX.format(c='o_orderstatus')}) s ON o_orderstatus = s.v
                    JOIN ({_ORDER_INDEX.format(c='o_orderpriority')}) p ON o_orderpriority = p.v""",
)
def indexed_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return encode.fit_vocabulary(orders, ["o_orderstatus", "o_orderpriority"]).transform(orders)


@query(
    "missing_as_category",
    """SELECT category, row_number() OVER (ORDER BY n DESC, category) - 1 AS idx, n FROM (
           SELECT CASE WHEN o_orderstatus = 'P' THEN '__missing__' ELSE o_orderstatus END AS category,
                  count(*) AS n FROM orders GROUP BY 1)""",
)
def missing_as_category(spark, sf_dir):
    category = encode.missing_as_category(F.col("o_orderstatus"), ["P"])
    rows = table(spark, sf_dir, "orders", "o_orderstatus").select(category.alias("category"))
    found = encode.fit_vocabulary(rows, ["category"]).values("category")
    return found.select(F.col("value").alias("category"), "idx", "n")


@query(
    "boolean_index",
    """SELECT value, row_number() OVER (ORDER BY n DESC, value) - 1 AS idx, n FROM (
           SELECT CASE WHEN o_totalprice > 150000 THEN 'true' ELSE 'false' END AS value,
                  count(*) AS n FROM orders GROUP BY 1)""",
)
def boolean_index(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_totalprice").select(
        (F.col("o_totalprice") > 150000).alias("large")
    )
    return encode.fit_vocabulary(rows, ["large"]).values("large").select("value", "idx", "n")


@query(
    "combined_flags",
    """SELECT greatest((l_returnflag = 'R')::int, (l_linestatus = 'F')::int, (l_tax > 0.06)::int) AS flag,
              count(*) AS n FROM lineitem GROUP BY 1""",
)
def combined_flags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_tax").select(
        (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        (F.col("l_linestatus") == "F").cast("int").alias("late"),
        (F.col("l_tax") > 0.06).cast("int").alias("taxed"),
    )
    flag = encode.combine_flags("returned", "late", "taxed").alias("flag")
    return rows.groupBy(flag).agg(F.count(F.lit(1)).alias("n"))


def _vectors(spark, sf_dir):
    rows = table(
        spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_linestatus", "l_returnflag",
    ).select(
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_linestatus") == "F").cast("double").alias("late"),
    )
    return encode.assemble(rows, feature_names(rows, "label"))


_LONG_SQL = """SELECT unnest(range(5)) AS pos, unnest([l_quantity, l_extendedprice, l_discount, l_tax,
                      (l_linestatus = 'F')::int::double]) AS value FROM lineitem"""


@query(
    "assemble_long",
    f"""SELECT pos::int AS pos, count(*) AS n, round(sum(value), 2) AS total
        FROM ({_LONG_SQL}) GROUP BY 1""",
)
def assemble_long(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    long = Features.of_vector("features", vector_width(vectors, "features")).long(vectors, [])
    return long.groupBy("pos").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "categorical_positions",
    f"""WITH v AS (SELECT DISTINCT pos::int AS pos, value FROM ({_LONG_SQL})),
             c AS (SELECT pos FROM v GROUP BY pos HAVING count(*) <= 20)
        SELECT pos, value, (row_number() OVER (PARTITION BY pos ORDER BY value) - 1)::int AS idx
        FROM v JOIN c USING (pos)""",
)
def categorical_positions(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return encode.category_table(vectors, encode.fit_categories(vectors))


@query(
    "label_index_decode",
    """WITH i AS (SELECT event_type, count(*) AS n,
                         (row_number() OVER (ORDER BY count(*) DESC, event_type) - 1)::double AS idx
                  FROM events GROUP BY event_type)
       SELECT event_type AS label, idx, event_type AS decoded, n FROM i""",
)
def label_index_decode(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_type")
    model = fit_label_index(events, "event_type", "idx")
    decoded = decode_labels(model.transform(events), model.labels, "idx", "decoded")
    return decoded.groupBy(F.col("event_type").alias("label"), "idx", "decoded").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("class_histogram", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def class_histogram(spark, sf_dir):
    return counts.class_histogram(table(spark, sf_dir, "events", "event_type"), "event_type")


@query(
    "class_extremes",
    """SELECT max(n) AS max_n, min(n) AS min_n, count(*) AS classes, sum(n)::bigint AS rows
       FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1)""",
)
def class_extremes(spark, sf_dir):
    return counts.class_extremes(table(spark, sf_dir, "lineitem", "l_returnflag"), "l_returnflag")


@query("label_domain", "SELECT DISTINCT o_orderpriority FROM orders")
def label_domain(spark, sf_dir):
    return counts.label_domain(table(spark, sf_dir, "orders", "o_orderpriority"), "o_orderpriority")
