"""Registry of runnable queries and the SQL that states the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_KEY_SQL = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
SEED = 7


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def r6(column: Column | str, name: str) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, 6).alias(name)


def h60(key: str, seed: int = SEED) -> str:
    """SQL for ``uniform_hash``."""
    return f"(('0x' || substr(md5(concat_ws(':', {key}, '{seed}')), 1, 15))::bigint)"


def below_sql(fraction: float) -> int:
    return int(fraction * (1 << 60))
