"""Log positions and segments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Layout of the log.
SEGMENT_BYTES = 16 * 1024 * 1024
SEGMENTS_PER_ID = 0x100000000 // SEGMENT_BYTES
SEGMENT_NAME = r"^[0-9A-F]{24}$"
MAGIC = 0x50415254
DATA, SKIP, CHECKPOINT = 1, 2, 4
RECORD_BYTES = 32


def lsn_text(lsn: Column) -> Column:
    """hi/lo hexadecimal form of a position."""
    big = lsn.cast("decimal(20,0)")
    high = F.floor(big / F.lit(4294967296).cast("decimal(20,0)")).cast("bigint")
    low = (big % F.lit(4294967296).cast("decimal(20,0)")).cast("bigint")
    return F.concat(F.hex(high), F.lit("/"), F.hex(low))


def segment_number(lsn: Column, segment_bytes: int = SEGMENT_BYTES) -> Column:
    """The segment that holds a position; position 0 belongs to segment 1."""
    return F.greatest(F.floor(lsn / F.lit(segment_bytes)).cast("bigint"), F.lit(1).cast("bigint"))


def segment_name(segment: Column, timeline: int = 1) -> Column:
    number = F.floor(segment / F.lit(SEGMENTS_PER_ID)).cast("bigint")
    return F.format_string("%08X%08X%08X", F.lit(timeline), number, F.pmod(segment, F.lit(SEGMENTS_PER_ID)).cast("bigint"))


def segment_path(partition_id: Column, segment: Column) -> Column:
    return F.concat(F.lit("pg_parwal/"), partition_id.cast("string"), F.lit("/"), segment_name(segment))


def record_text(partition_id: Column, partition_lsn: Column, orig_lsn: Column, flags: Column) -> Column:
    """One line of description of a record."""
    high, low = F.floor(orig_lsn / F.lit(4294967296)).cast("bigint"), F.pmod(orig_lsn, F.lit(4294967296)).cast("bigint")
    return F.format_string("partition_id=%d partition_lsn=%d orig_lsn=%X/%08X flags=0x%02X", partition_id, partition_lsn, high, low, flags)


def record_kind(info: Column) -> Column:
    return F.when(info == 0x00, "PARTWAL_DATA").when(info == 0x10, "PARTWAL_SKIP")
