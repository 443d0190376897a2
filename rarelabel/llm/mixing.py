"""Mix sources to target weights by systematic sampling.

Each source gets a target number of words; each document of a source has the
same expected number of copies, target over size.  Documents are put in order of
length within their source, expected copies are summed up in that order, one
random offset per source is added, and a document is taken once for each whole
number its interval crosses.  Order by length spreads the sample evenly over
short and long documents, so the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rarelabel.functions.hashing import HASH_SPACE, uniform_hash
from rarelabel.functions.ranking import number_in_order

from .common import WORD, bounded, fresh, numbered, row_number, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
SEED = 20_24


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from one row per source.

    Sources are ordered by code point, null last, and weigh ``weights`` in turn.
    All sizes together are shared by weight; a target stops at ``most`` times
    its source's size, and the excess is shared by weight among the others until
    none is above.  A source without words has target 0.  Each turn is one
    aggregation over sources; a turn that stops no further source is the last.
    """
    ordered = number_in_order(sizes, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    weighed = stored(ordered.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(most)))
    level, stopped = 0.0, -1
    while True:
        at_most = F.col("weight") * level >= F.col("most")
        if stopped < 0:
            at_most = F.lit(False)
        total, held, free, n = weighed.agg(
            F.sum("source_size"), F.sum(F.when(at_most, F.col("most"))), F.sum(F.when(~at_most, F.col("weight"))), F.count_if(at_most)
        ).first()
        if n == stopped or not free:
            break
        level, stopped = (float(total) - (held or 0.0)) / free, n
    return weighed.select("source", "source_size", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, number: str | None = None) -> DataFrame:
    """One row per input row: ``row, doc_id, size, source_size, target, copies, taken``.

    ``row`` is the column ``number`` of ``docs``, see ``common.numbered``, or a
    number of this pass only.
    Equal lengths are ordered by a hash of the id, then by row, so repeated rows
    are separate documents and reruns agree.  Null texts and empty texts have size 0
    and are taken as often as others of their source, at no words; a null source
    is a source of its own; an empty table gives no rows.
    """
    sized = stored(
        docs.select(
            row_number(number), F.col(id_col).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size")
        )
    )
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = source_targets(by_source.select("source", "source_size"), weights, most)
    # the number of a row among all sources, and that of the first row of its source
    placed = number_in_order(sized, [F.col("source").asc_nulls_last(), F.col("size"), uniform_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), seed=seed), F.col("row")], "_number")
    goals = targets.withColumnRenamed("source", "_source")
    firsts = stored(placed.groupBy("source").agg(F.min("_number").alias("_first")))
    firsts = stored(firsts.join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("source"))
    rows = placed.join(bounded(firsts), F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = uniform_hash(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")), seed=seed) / float(HASH_SPACE)
    place = F.col("_number") - F.col("_first")
    crossed = F.floor(rate * (place + 1) + offset) - F.floor(rate * place + offset)
    # rounding must not add a copy beyond the next whole number above the rate
    copies = F.least(crossed, F.ceil(rate)).cast("bigint")
    return rows.select("row", "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns kept.

    Only (row, copies) travels, and only for rows taken other than once.
    """
    counted, number = numbered(docs)
    copies = fresh(docs, "_copies")
    changed = stored(mix(counted, number=number, **options).where("copies <> 1").select(F.col("row").alias(number), F.col("copies").alias(copies)))
    joined = counted.join(bounded(changed), number, "left").withColumn(copies, F.coalesce(copies, F.lit(1)))
    each = F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copies)
    return joined.where(F.col(copies) > 0).select(*docs.columns, each).drop(copies)
