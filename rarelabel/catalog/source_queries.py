"""Queries over text, Parquet and LIBSVM sources and sinks."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions.features import Features, vector_width
from ..functions.ranking import scratch_path
from ..plans.importer import export_vectors, import_text
from ..sources import libsvm, tables, text
from ..sources.schemas import TableSchema
from .base import LINE_KEY, query, r6, table

ORDERS = TableSchema.parse(
    "orders", "o_orderkey o_orderstatus:s o_totalprice o_orderpriority:s", "o_orderpriority"
)
PARTS = TableSchema.parse("part", "p_partkey p_brand:s p_size p_type:s p_retailprice", "p_type")


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders", *ORDERS.names)


@query(
    "text_scan",
    """SELECT o_orderkey::double AS o_orderkey, o_orderstatus, o_totalprice,
              replace(o_orderpriority, ' ', '_') AS o_orderpriority FROM orders""",
)
def text_scan(spark, sf_dir):
    path = scratch_path(spark, "orders-text")
    text.write_table(_orders(spark, sf_dir), path, blanks="underscore")
    return text.read_table(spark, path, ORDERS)


@query(
    "text_rejects",
    """SELECT CASE o_orderkey % 7 WHEN 0 THEN 'too_few_fields' WHEN 1 THEN 'too_many_fields'
                                  ELSE 'bad_number' END AS reason, count(*) AS n
       FROM orders WHERE o_orderkey % 7 IN (0, 1, 2) GROUP BY 1""",
)
def text_rejects(spark, sf_dir):
    damage = F.col("o_orderkey") % 7
    price = F.when(damage == 2, "12,5").otherwise(F.col("o_totalprice").cast("string"))
    cells = F.concat_ws("\t ", F.lit(" "), "o_orderkey", "o_orderstatus", price)
    last = F.regexp_replace("o_orderpriority", " ", "_")
    line = (
        F.when(damage == 0, cells)
        .when(damage == 1, F.concat_ws("  ", cells, last, F.lit("extra")))
        .otherwise(F.concat_ws("  ", cells, last))
    )
    path = scratch_path(spark, "damaged-text")
    _orders(spark, sf_dir).select(line.alias("value")).write.text(path)
    found = text.rejected_rows(spark, path, ORDERS)
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_missing_dropped",
    """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total
       FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY 1""",
)
def text_missing_dropped(spark, sf_dir):
    price = F.when(F.col("o_orderkey") % 5 == 0, "-9").otherwise(F.col("o_totalprice").cast("string"))
    path = scratch_path(spark, "missing-text")
    text.write_table(_orders(spark, sf_dir).withColumn("o_totalprice", price), path, blanks="underscore")
    kept = text.read_table(spark, path, ORDERS, missing=["-9"], require=["o_totalprice"])
    return kept.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


_PART_INDEX = """
    SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS idx FROM (
        SELECT replace({c}, ' ', '_') AS {c} FROM part) GROUP BY {c}"""


@query(
    "import_table",
    f"""SELECT p_partkey::double AS p_partkey, p_size::double AS p_size, p_retailprice,
               b.idx::double AS p_brand, t.idx::double AS p_type
        FROM part JOIN ({_PART_INDEX.format(c='p_brand')}) b ON replace(p_brand, ' ', '_') = b.v
                  JOIN ({_PART_INDEX.format(c='p_type')}) t ON replace(p_type, ' ', '_') = t.v""",
)
def import_table(spark, sf_dir):
    source = scratch_path(spark, "part-text")
    text.write_table(table(spark, sf_dir, "part", *PARTS.names), source, blanks="underscore")
    return import_text(spark, source, PARTS, scratch_path(spark, "part-table")).table


@query(
    "import_histogram",
    f"""SELECT t.idx::double AS p_type, count(*) AS n
        FROM part JOIN ({_PART_INDEX.format(c='p_type')}) t ON replace(p_type, ' ', '_') = t.v
        GROUP BY 1""",
)
def import_histogram(spark, sf_dir):
    source = scratch_path(spark, "part-text")
    text.write_table(table(spark, sf_dir, "part", *PARTS.names), source, blanks="underscore")
    return import_text(spark, source, PARTS, scratch_path(spark, "part-table")).histogram


@query(
    "parquet_roundtrip",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_quantity,
              l_extendedprice FROM lineitem""",
)
def parquet_roundtrip(spark, sf_dir):
    wanted = [*LINE_KEY, "l_returnflag", "l_quantity", "l_extendedprice"]
    path = scratch_path(spark, "lineitem-table")
    tables.write_parquet(table(spark, sf_dir, "lineitem", *wanted), path, ["l_returnflag"])
    return tables.read_parquet(spark, path, wanted)


@query(
    "libsvm_roundtrip",
    """SELECT label::double AS label, pos::int AS pos, count(*) AS n, round(sum(value), 6) AS total
       FROM (SELECT label, unnest(range(64)) AS pos, unnest(embedding)::double AS value
             FROM embeddings) GROUP BY 1, 2""",
)
def libsvm_roundtrip(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        "label", array_to_vector("embedding").alias("features")
    )
    width = vector_width(vectors, "features")
    path = tables.dataset_path(scratch_path(spark, "vectors"), "embeddings")
    libsvm.write_libsvm(libsvm.to_dense(vectors), path)
    back = libsvm.read_libsvm(spark, path, width)
    long = Features.of_vector("features", width).long(back, ["label"])
    return long.groupBy("label", "pos").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("value"), "total")
    )


@query(
    "table_to_vectors",
    """SELECT label, pos::int AS pos, count(*) AS n, round(sum(value), 2) AS total FROM (
           SELECT (l_returnflag = 'R')::int::double AS label, unnest(range(5)) AS pos,
                  unnest([l_quantity, l_extendedprice, l_discount, l_tax,
                          (l_linestatus = 'F')::int::double]) AS value FROM lineitem)
       GROUP BY 1, 2""",
)
def table_to_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_linestatus") == "F").cast("double").alias("late"),
    )
    path = tables.dataset_path(scratch_path(spark, "lineitem-vectors"), "lineitem")
    names = export_vectors(rows, path, exclude=["l_orderkey"])
    back = libsvm.read_libsvm(spark, path, len(names))
    long = Features.of_vector("features", len(names)).long(back, ["label"])
    return long.groupBy("label", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")
    )


@query(
    "profile",
    """SELECT 'event_id' AS "column", count(*) - count(event_id) AS nulls,
              count(DISTINCT event_id) AS n_distinct, min(event_id)::double AS min_value,
              max(event_id)::double AS max_value FROM events
       UNION ALL SELECT 'user_id', count(*) - count(user_id), count(DISTINCT user_id),
              min(user_id)::double, max(user_id)::double FROM events
       UNION ALL SELECT 'event_type', count(*) - count(event_type), count(DISTINCT event_type),
              NULL, NULL FROM events
       UNION ALL SELECT 'value', count(*) - count(value), count(DISTINCT value),
              min(value), max(value) FROM events""",
)
def profile(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return tables.profile(events, distinct="exact").drop("type")


@query(
    "first_rows",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20""",
)
def first_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    return tables.first_rows(orders, ["o_orderkey"], 20)
