"""The binary partition log: 32-byte little-endian records in segment files, root/<partition>/<24 hex digits>.

``scan`` and ``counts`` read it with built-in functions; format("partlog")
reads and writes it as a Python data source.  Bytes after the last whole record
of a file (a torn tail) are passed over.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..lsn import MAGIC, RECORD_BYTES, SEGMENT_BYTES, SEGMENT_NAME
from ..schema import RECORD

LAYOUT = struct.Struct("<IIQQB7x")


def pack(partition_id: int, orig_node_lsn: int, partition_lsn: int, flags: int, magic: int = MAGIC) -> bytes:
    return LAYOUT.pack(magic, partition_id, orig_node_lsn, partition_lsn, flags & 255)


def unpack(data: bytes) -> list[tuple[int, int, int, int, int]]:
    """(magic, partition_id, orig_node_lsn, partition_lsn, flags) of each whole record."""
    return list(LAYOUT.iter_unpack(data[: len(data) // RECORD_BYTES * RECORD_BYTES]))


def segment_file(orig_node_lsn: int, segment_bytes: int = SEGMENT_BYTES) -> str:
    number = max(1, orig_node_lsn // segment_bytes)
    return f"{1:08X}{number // 256:08X}{number % 256:08X}"


def exists(root: str) -> bool:
    """Whether there is a segment file under root."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(root)
    return any(f.is_file and re.match(SEGMENT_NAME, f.base_name) for f in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)))


# Scans with built-in functions


def files(spark: SparkSession, root: str) -> DataFrame:
    """Segment files with directory and name; content is read only if a query asks for it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    part = F.split("path", "/")
    named = found.select(F.element_at(part, -2).alias("dir"), F.element_at(part, -1).alias("segname"), "length", "content")
    return named.where(F.col("segname").rlike(SEGMENT_NAME) & F.col("dir").rlike("^[0-9]+$")).withColumn("dir_partition_id", F.col("dir").cast("bigint"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All whole records in the form of schema.RECORD."""
    rows = files(spark, root).where(F.col("length") >= RECORD_BYTES)
    rows = rows.withColumn("rec_idx", F.explode(F.sequence(F.lit(0), F.expr(f"int(length div {RECORD_BYTES}) - 1"))))
    text = F.hex(F.expr(f"substring(content, rec_idx * {RECORD_BYTES} + 1, {RECORD_BYTES})"))
    rows = rows.select("dir_partition_id", "segname", "rec_idx", text.alias("h"))

    def number(at: int, size: int, kind: str) -> Column:
        digits = F.concat(*[F.substr("h", F.lit(2 * (at + k) + 1), F.lit(2)) for k in reversed(range(size))])
        return F.conv(digits, 16, 10).cast(kind)

    return rows.select(
        "dir_partition_id",
        "segname",
        "rec_idx",
        number(0, 4, "bigint").alias("magic"),
        number(4, 4, "bigint").alias("partition_id"),
        number(8, 8, "decimal(20,0)").alias("orig_node_lsn"),
        number(16, 8, "bigint").alias("partition_lsn"),
        number(24, 1, "int").alias("flags"),
    )


def torn(spark: SparkSession, root: str) -> DataFrame:
    """(dir_partition_id, segname) of segments whose last record is cut off, from file lengths alone."""
    return files(spark, root).where(F.col("length") % RECORD_BYTES != 0).select("dir_partition_id", "segname")


def counts(spark: SparkSession, root: str) -> DataFrame:
    """Records of each partition from file lengths alone."""
    return files(spark, root).groupBy("dir_partition_id").agg(F.sum(F.expr(f"length div {RECORD_BYTES}")).alias("n"))


# Python data source


class SegmentPartition(InputPartition):
    def __init__(self, partition_id: int, segname: str, path: str) -> None:
        self.partition_id, self.segname, self.path = partition_id, segname, path


class Reader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[SegmentPartition]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(self.root)
        out = []
        for info in system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)):
            folder, name = info.path.rsplit("/", 2)[-2:] if info.path.count("/") > 1 else ("", "")
            if info.is_file and re.match(SEGMENT_NAME, name) and folder.isdigit():
                out.append(SegmentPartition(int(folder), name, info.path))
        return sorted(out, key=lambda p: (p.partition_id, p.segname)) or [SegmentPartition(-1, "", "")]

    def read(self, partition: SegmentPartition) -> Iterator[tuple]:
        from decimal import Decimal

        from pyarrow import fs

        if not partition.path:
            return
        system, _ = fs.FileSystem.from_uri(self.root)
        with system.open_input_stream(partition.path) as stream:
            idx = 0
            while data := stream.read(RECORD_BYTES << 15):
                for magic, pid, orig, lsn, flags in unpack(data):
                    yield partition.partition_id, partition.segname, idx, magic, pid, Decimal(orig), lsn, flags
                    idx += 1


class Written(WriterCommitMessage):
    def __init__(self, moves: list[tuple[str, str]]) -> None:
        self.moves = moves


class Writer(DataSourceWriter):
    """Writes partition_id, orig_node_lsn, partition_lsn, flags; rows of a segment must come in one task, in order.

    Files are written under hidden names and renamed at commit.  A segment that
    exists is rewritten with its whole records first, so a torn tail never
    shifts what follows.
    """

    def __init__(self, root: str, names: list[str], segment_bytes: int) -> None:
        self.root, self.names, self.segment_bytes = root, names, segment_bytes

    def write(self, rows: Iterator) -> Written:
        import uuid

        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(self.root)
        out, target, moves = None, None, []
        try:
            for row in rows:
                r = row.asDict()
                place = f"{inner}/{r['partition_id']}/{segment_file(int(r['orig_node_lsn']), self.segment_bytes)}"
                if place != target:
                    if out is not None:
                        out.close()
                    target, hidden = place, f"{place.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
                    out = system.open_output_stream(hidden)
                    if system.get_file_info(place).is_file:
                        with system.open_input_stream(place) as old:
                            data = old.read()
                        out.write(data[: len(data) // RECORD_BYTES * RECORD_BYTES])
                    moves.append((hidden, place))
                out.write(pack(r["partition_id"], int(r["orig_node_lsn"]), r["partition_lsn"], r["flags"], r.get("magic", MAGIC)))
        finally:
            if out is not None:
                out.close()
        return Written(moves)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        for message in messages:
            for hidden, place in message.moves if message else []:
                if system.get_file_info(place).is_file:
                    system.delete_file(place)
                system.move(hidden, place)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(self.root)
        for message in messages:
            for hidden, _ in message.moves if message else []:
                system.delete_file(hidden)


class PartLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "partlog"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], schema.fieldNames(), int(self.options.get("segment_bytes", SEGMENT_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PartLog)


def write(log: DataFrame, root: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write records so that each segment is one task's, in order of partition_lsn."""
    register(log.sparkSession)
    number = F.greatest(F.expr(f"bigint(orig_node_lsn div {segment_bytes})"), F.lit(1).cast("bigint"))
    columns = [c for c in ("partition_id", "orig_node_lsn", "partition_lsn", "flags", "magic") if c in log.columns]
    dealt = log.withColumn("_seg", number).repartition("partition_id", "_seg").sortWithinPartitions("partition_id", "_seg", "partition_lsn")
    dealt.select(*columns).write.format("partlog").option("path", root).option("segment_bytes", str(segment_bytes)).mode("append").save()
