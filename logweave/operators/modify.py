"""INSERT, UPDATE, DELETE, MERGE and upserts as new table versions (copy on write), with RETURNING rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge(target: DataFrame, source: DataFrame, keys: list[str], delete_when: Column | None = None, insert: bool = True) -> DataFrame:
    """Target after MERGE with its action: update, delete (dropped by ``result``), insert or keep.

    Columns of source other than keys replace those of target; delete_when is a
    condition over source's columns.  One full join on the keys.
    """
    new = [c for c in source.columns if c not in keys]
    packed = source.select(*keys, F.struct(*new, F.coalesce(delete_when if delete_when is not None else F.lit(False), F.lit(False)).alias("_gone")).alias("_s"))
    joined = target.withColumn("_t", F.lit(True)).join(packed, keys, "full" if insert else "left")
    action = F.when(F.col("_s").isNull(), "keep").when(F.col("_t").isNull(), F.when(F.col("_s._gone"), "skip").otherwise("insert")).when(F.col("_s._gone"), "delete").otherwise("update")
    values = [F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in target.columns]
    return joined.select(*values, action.alias("action")).where("action <> 'skip'")


def result(merged: DataFrame) -> DataFrame:
    """The table after the merge."""
    return merged.where("action <> 'delete'").drop("action")


def returning(merged: DataFrame) -> DataFrame:
    """The rows that the merge touched."""
    return merged.where("action <> 'keep'")


def update_where(target: DataFrame, condition: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return target.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns])


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; null conditions keep their rows."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def insert_or_nothing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: source rows with new keys, one a key, are added."""
    fresh = source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def changes(old: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Row changes between two versions of a table: keys, op (I, U or D), old and new value; rows that stayed alike have none."""
    a, b = old.select(*keys, F.struct(value).alias("_o")), new.select(*keys, F.struct(value).alias("_n"))
    joined = a.join(b, keys, "full")
    op = F.when(F.col("_o").isNull(), "I").when(F.col("_n").isNull(), "D").otherwise("U")
    out = joined.select(*keys, op.alias("op"), F.col(f"_o.{value}").alias("old"), F.col(f"_n.{value}").alias("new"))
    return out.where(~F.col("old").eqNullSafe(F.col("new")))
