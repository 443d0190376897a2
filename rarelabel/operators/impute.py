"""Missing values filled from the training side.

Every column has a policy: ``mean``, ``median`` or ``mode``.  Fillings are fitted
in passes that merge (sums, a quantile sketch, counts by value), kept as a small table
and applied to any other side, so nothing of a test row reaches its own filling.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ensure_checkpoint_dir

POLICIES = ("mean", "median", "mode")
ACCURACY = 100_000  # a median is off by at most a share of 1 / ACCURACY of the rows


def without_sentinels(df: DataFrame, sentinels: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Null in place of the values that stand for missing ones, column by column."""
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(list(v)), F.col(f"`{c}`")) for c, v in sentinels.items() if v})


def _number(df: DataFrame, name: str) -> Column:
    value = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(value), value)


@dataclass(frozen=True)
class Fillings:
    """``table`` has ``(column, policy, value, present, missing)``, the value as text; null if no row has one."""

    table: DataFrame
    policies: Mapping[str, str]

    def transform(self, df: DataFrame, flag: str | None = None) -> DataFrame:
        """Fill nulls (and NaN) of the fitted columns; ``flag`` adds a column ``<name><flag>``, 1.0 where a value was filled.

        A column without any training value stays null.
        """
        values = {r["column"]: r["value"] for r in self.table.select("column", "value").collect()}  # one row per column
        filled, flags = {}, {}
        for name, policy in self.policies.items():
            kind = df.schema[name].dataType
            own = F.col(f"`{name}`")
            gone = own.isNull() | (F.isnan(own) if kind.typeName() in ("double", "float") else F.lit(False))
            # a mean or median of whole numbers need not be one
            target = kind if policy == "mode" else "double"
            filled[name] = F.when(gone, F.lit(values[name]).cast(target)).otherwise(own.cast(target))
            if flag is not None:
                flags[f"{name}{flag}"] = gone.cast("double")
        return df.withColumns({**filled, **flags})


def fit_fillings(train: DataFrame, policies: Mapping[str, str]) -> Fillings:
    """Fit the policy of each column on ``train``.

    The mode is the most frequent value, the smallest one (as text) on ties; its
    counts are made in each task before they travel.  Means and medians come from one
    aggregation over the table; the median is that of a mergeable sketch.
    """
    wrong = {c: p for c, p in policies.items() if p not in POLICIES}
    if wrong or not policies:
        raise ValueError(f"policies must be of {POLICIES}: {wrong or 'none given'}")
    numeric = [c for c, p in policies.items() if p != "mode"]
    modes = [c for c, p in policies.items() if p == "mode"]
    total = F.count(F.lit(1))
    cells = []
    for name in numeric:
        value = _number(train, name)
        found = F.avg(value) if policies[name] == "mean" else F.percentile_approx(value, 0.5, ACCURACY)
        cells.append(F.struct(F.lit(name).alias("column"), F.lit(policies[name]).alias("policy"), found.cast("string").alias("value"), F.count(value).alias("present"), (total - F.count(value)).alias("missing")))
    parts = []
    if cells:
        parts.append(train.agg(F.array(*cells).alias("c")).select(F.inline("c")))
    if modes:
        long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in modes])).alias("c")).select("c.*")
        counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        here = F.col("value").isNotNull() & ~F.col("value").isin("NaN")
        # the largest count, and of those the smallest value: the first of the order (-n, value)
        best = F.min(F.when(here, F.struct((-F.col("n")).alias("n"), "value")))["value"]
        sums = [F.coalesce(F.sum(F.when(w, F.col("n"))), F.lit(0)) for w in (here, ~here)]
        parts.append(counts.groupBy("column").agg(best.alias("value"), sums[0].alias("present"), sums[1].alias("missing")).select("column", F.lit("mode").alias("policy"), "value", "present", "missing"))
    table = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ensure_checkpoint_dir(train.sparkSession)
    return Fillings(table.checkpoint(), dict(policies))
