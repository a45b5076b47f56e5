"""Comparisons with ALL or ANY row of a subquery, with SQL's three values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the values of a group say: how many there are, how many are null, the smallest and the largest.
FACTS = ("n", "nulls", "low", "high")


def facts(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """One row a group: a partial aggregate, whatever the number of values."""
    v = F.col(value)
    return values.groupBy(*keys).agg(F.struct(F.count("*").alias("n"), F.count_if(v.isNull()).alias("nulls"), F.min(v).alias("low"), F.max(v).alias("high")).alias("facts"))


def compare_all(x: Column, op: str, f: Column) -> Column:
    """x op ALL (values): true for no values; false if one differs; else null if x or a value is null."""
    n = F.coalesce(f["n"], F.lit(0))
    holds = {"<": x < f["low"], "<=": x <= f["low"], ">": x > f["high"], ">=": x >= f["high"], "=": (x == f["low"]) & (x == f["high"])}[op]
    return F.when(n == 0, True).when(~F.coalesce(holds, F.lit(True)), False).when(x.isNull() | (f["nulls"] > 0), F.lit(None)).otherwise(holds)


def compare_any(x: Column, op: str, f: Column) -> Column:
    """x op ANY (values): false for no values; true if one agrees; else null if x or a value is null."""
    n = F.coalesce(f["n"], F.lit(0))
    holds = {"<": x < f["high"], "<=": x <= f["high"], ">": x > f["low"], ">=": x >= f["low"]}[op]
    return F.when(n == 0, False).when(F.coalesce(holds, F.lit(False)), True).when(x.isNull() | (f["nulls"] > 0), F.lit(None)).otherwise(F.lit(False))
