"""Sharding by balanced label propagation.

Documents with equal texts are linked.  The members of a linked group start in
shards by a salt of their id and form cells, at most 64 small rows a group, so
a group with a third of all rows is no larger than any other.  In rounds, each
cell asks for the shard that holds most of its group (a join of the cells with
their groups' counts) and is let in as far as that shard's quota allows; in the
last round groups that are still parted move together.  A group larger than a
shard is dealt to as few shards as can hold it.  Documents without links then
fill up each shard to the mean, and all are ranked by (shard, place, group,
doc_id) and the ranks cut into equal parts: counts differ by one at most (law
``rows``).  Documents without links stand at both ends of a shard, so the cuts
fall on them.

Defined results: a null text has size 1 and the crc32 of an empty text; rows
with equal ids and texts are ranked next to each other in any order; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import or_empty, read_table, shuffle_parts, written

SALTS = 64
ROUNDS = 3


def propagate(cells: DataFrame, shards: int, capacity: float, rounds: int = ROUNDS) -> tuple[DataFrame, dict[int, int]]:
    """Move cells (group, salt, rows, all, shard) towards the shard with most rows of their group, under quotas.

    Returns the cells and each shard's rows.  One row for each pair of shards
    comes to the driver in a round.
    """
    load: dict[int, int] = {}
    for turn in range(rounds + 1):
        held = cells.groupBy("group", "shard").agg(F.sum("rows").alias("n"))
        best = held.groupBy("group").agg(F.max(F.struct("n", F.xxhash64("group", "shard").alias("tie"), "shard")).alias("b"))
        asked = cells.join(best.select("group", F.col("b.shard").alias("wanted")), "group")
        asked = asked.withColumn("wanted", F.when(F.col("all") <= capacity, F.col("wanted")).otherwise(F.col("shard")))
        flows = {(r["shard"], r["wanted"]): r["n"] for r in asked.groupBy("shard", "wanted").agg(F.sum("rows").alias("n")).collect()}
        load, wish, leave = ({s: sum(n for k, n in flows.items() if f(k, s)) for s in range(shards)} for f in (lambda k, s: k[0] == s, lambda k, s: k[1] == s != k[0], lambda k, s: k[0] == s != k[1]))
        if not any(wish.values()):
            break
        if turn == rounds:
            share = {s: 1.0 for s in range(shards)}
            load = {s: load[s] + wish[s] - leave[s] for s in range(shards)}
        else:  # the quota: the room left to the capacity, with half of those who want to leave
            share = {s: min(1.0, max(0.0, capacity - load[s] + leave[s] / 2) / wish[s]) if wish[s] else 0.0 for s in range(shards)}
        admitted = F.element_at(F.array(*[F.lit(share[s]) for s in range(shards)]), F.col("wanted") + 1)
        chance = F.pmod(F.xxhash64("group", F.lit(turn)), F.lit(1 << 20)) / float(1 << 20)  # one draw a group: its cells move together
        moved = asked.withColumn("shard", F.when((F.col("wanted") != F.col("shard")) & (chance < admitted), F.col("wanted")).otherwise(F.col("shard")))
        cells = written(moved.select(*cells.columns), "cells")
    return cells, load


def ranked(df: DataFrame, order: list[str], parts: int) -> tuple[DataFrame, int]:
    """Rows with their rank (from 0) in the order, and their number; no window over all rows."""
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = written(placed, "ranked").withColumn("part", F.shiftright("at", 33))
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect()}
    ahead, total = [], 0
    for part in range(max(counts, default=-1) + 1):
        ahead.append(total)
        total += counts.get(part, 0)
    before = F.element_at(F.array(*map(F.lit, ahead or [0])), (F.col("part") + 1).cast("int"))
    return placed.withColumn("rank", (F.col("at").bitwiseAND((1 << 33) - 1) + before).cast("long")).drop("at", "part"), total


def shard_documents(docs: DataFrame, shards: int, parts: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document."""
    text = or_empty("text")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.md5(F.encode(text, "utf-8")).alias("group"),
    )
    rows = written(rows.withColumn("salt", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1))), F.lit(SALTS)).cast("int")), "shard-rows")
    cells = rows.groupBy("group", "salt").agg(F.count("*").alias("rows"))
    linked = cells.groupBy("group").agg(F.sum("rows").alias("all")).where("all > 1")
    total = rows.count()
    mean = max(1.0, total / shards)
    parts_of = F.ceil(F.col("all") / mean)  # shards that a group needs, if it is larger than one
    start = F.when(F.col("all") > mean, F.pmod(F.pmod(F.xxhash64("group"), F.lit(shards)) + F.pmod(F.col("salt"), parts_of), F.lit(shards))).otherwise(F.pmod(F.col("salt"), F.lit(shards)))
    moved, load = propagate(written(cells.join(linked, "group").withColumn("shard", start.cast("int")), "cells"), shards, mean)

    room = [max(0.0, mean - load.get(s, 0)) for s in range(shards)]
    if not sum(room):
        room = [1.0] * shards
    steps = [sum(room[: s + 1]) / sum(room) for s in range(shards - 1)]
    draw = F.pmod(F.xxhash64("group", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    filled = F.size(F.filter(F.array(*map(F.lit, steps)), lambda x: x <= draw)).cast("int")
    placed = rows.join(moved.select("group", "salt", F.col("shard").alias("moved")), ["group", "salt"], "left")
    place = F.when(F.col("moved").isNotNull(), 1).otherwise(2 * F.pmod(F.xxhash64("group"), F.lit(2)))
    placed = placed.withColumn("label", F.coalesce("moved", filled)).withColumn("place", place)
    numbered, total = ranked(placed.select("doc_id", "size", "text_crc32", "group", "label", "place"), ["label", "place", "group", "doc_id"], parts)
    shard = F.expr(f"int((rank * {shards}L) div {max(1, total)}L)")
    start = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return numbered.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - start).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"])
    return shard_documents(docs, shards=8, parts=shuffle_parts(spark))
