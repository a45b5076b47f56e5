"""Range and as-of joins by equal buckets, and joins with hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, point: str, ranges: DataFrame, low: str, high: str, width: int, salts: int = 16) -> DataFrame:
    """Rows of points with the ranges that hold them (both ends included), as an equi-join on buckets of the given width.

    Rows of ranges with equal ends are packed, by their number in their task
    into so many rows at most; points meet the packs' ends first, so only true
    pairs are laid out, and those of one range in several tasks.  A pack is
    repeated once for each bucket it touches; choose width near the ranges'
    usual length.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint")
    ends, others = ["_low", "_high", "_pack"], [c for c in ranges.columns if c not in (low, high)]
    held = ranges.where(F.col(low) <= F.col(high)).withColumns({"_low": F.col(low), "_high": F.col(high), "_pack": F.pmod(F.monotonically_increasing_id(), F.lit(salts))})
    spread = held.select(*ends).distinct().withColumn("_bucket", F.explode(F.sequence(bucket("_low"), bucket("_high"))))
    packed = held.groupBy(*ends).agg(F.collect_list(F.struct(*others, F.lit(True).alias("_is"))).alias("_rows"))
    met = points.withColumn("_bucket", bucket(point)).join(spread, "_bucket").where(F.col(point).between(F.col("_low"), F.col("_high"))).drop("_bucket")
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = met.repartition(parts, *ends).join(packed, ends)
    laid = both.select(*points.columns, F.col("_low").alias(low), F.col("_high").alias(high), F.inline("_rows"))
    return laid.select(*points.columns, *ranges.columns)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Left rows with the values of the right row of the same keys that is latest at or before them; nulls where there is none.

    One union and one window instead of a theta join: linear in both sides.
    """
    side = lambda df, n: df.withColumn("_side", F.lit(n))
    packed = F.struct(*values)
    both = side(left, 1).withColumn("_v", F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType)).unionByName(side(right.select(*keys, order, packed.alias("_v")), 0), allowMissingColumns=True)
    line = Window.partitionBy(*keys).orderBy(order, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_v", F.last("_v", ignorenulls=True).over(line)).where("_side = 1")
    return seen.select(*left.columns, *[F.col(f"_v.{v}").alias(v) for v in values])


def salted_join(big: DataFrame, other: DataFrame, keys: list[str], salts: int, how: str = "inner") -> DataFrame:
    """Join in which each key of big is dealt over so many tasks; other is repeated that often.

    Rows are dealt by their number in their task, so equal rows part as well.
    Modes that give rows of other without a partner are refused, as each copy
    would be such a row.
    """
    if how not in ("inner", "left", "left_outer", "leftouter", "left_semi", "left_anti", "semi", "anti"):
        raise ValueError(f"salted_join keeps no unmatched rows of the repeated side: {how}")
    salt = next(f"_salt{i}" for i in range(len(big.columns) + len(other.columns) + 1) if f"_salt{i}" not in {*big.columns, *other.columns})
    dealt = big.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(salts)))
    spread = other.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))))
    return dealt.join(spread, [*keys, salt], how).drop(salt)


def hot_keys(big: DataFrame, keys: list[str], share: float = 0.01) -> DataFrame:
    """The keys that hold at least that share of all rows: no more than 1 / share of them, so they may be broadcast."""
    counts = big.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = big.agg(F.count("*").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("_n") >= share * F.col("_all")).select(*keys)


def skewed_join(big: DataFrame, other: DataFrame, keys: list[str], salts: int = 16, share: float = 0.01) -> DataFrame:
    """Inner join that salts only the keys that are seen to be hot; the rest is joined as it is."""
    hot = F.broadcast(hot_keys(big, keys, share))
    plain = big.join(hot, keys, "left_anti").join(other.join(hot, keys, "left_anti"), keys)
    return plain.unionByName(salted_join(big.join(hot, keys, "left_semi"), other.join(hot, keys, "left_semi"), keys, salts))
