"""Retention, reset and registration of partition logs: on rows, and on the segment files of a folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lsn import SEGMENT_BYTES, SEGMENT_NAME, SEGMENTS_PER_ID


def cleanup(log: DataFrame, keep_lsn: int, segment_bytes: int = SEGMENT_BYTES, segment: str = "segno") -> DataFrame:
    """The records left after segments that end at or before keep_lsn are dropped."""
    return log.where((F.col(segment) + 1) * segment_bytes > keep_lsn)


def reset(log: DataFrame, partition_ids: list[int], key: str = "partition_id") -> DataFrame:
    """The records left after the named partitions are emptied; the partitions stay registered."""
    return log.where(~F.col(key).isin(partition_ids)) if partition_ids else log


# On files. A folder is a URI that pyarrow's file systems can open; null arguments give None, as the functions are strict.


def _folder(root: str, partition_id: int):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(root)
    return system, f"{inner.rstrip('/')}/{partition_id}"


def _segments(system, folder: str) -> list[tuple[str, int]]:
    """Path and number of each segment file; none if the folder is missing."""
    from pyarrow import fs

    found = []
    for info in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        name = info.path.rsplit("/", 1)[-1]
        if info.is_file and re.match(SEGMENT_NAME, name):
            found.append((info.path, int(name[8:16], 16) * SEGMENTS_PER_ID + int(name[16:24], 16)))
    return sorted(found)


def init_partition(root: str, partition_id: int | None) -> None:
    """Make a partition's folder; nothing happens if it is there."""
    if partition_id is not None:
        system, folder = _folder(root, partition_id)
        system.create_dir(folder, recursive=True)


def partition_exists(root: str, partition_id: int | None) -> bool | None:
    """Whether a partition has a folder."""
    from pyarrow import fs

    if partition_id is None:
        return None
    system, folder = _folder(root, partition_id)
    return system.get_file_info(folder).type == fs.FileType.Directory


def cleanup_files(root: str, partition_id: int | None, keep_lsn: int | None, segment_bytes: int = SEGMENT_BYTES) -> list[str] | None:
    """Delete a partition's segments that end at or before keep_lsn; returns their paths. A missing folder has none."""
    if partition_id is None or keep_lsn is None:
        return None
    system, folder = _folder(root, partition_id)
    gone = [path for path, number in _segments(system, folder) if (number + 1) * segment_bytes <= keep_lsn]
    for path in gone:
        system.delete_file(path)
    return gone


def reset_files(root: str, partition_id: int | None) -> list[str] | None:
    """Delete all of a partition's segments; its folder stays, and numbering starts again at 1."""
    if partition_id is None:
        return None
    system, folder = _folder(root, partition_id)
    gone = [path for path, _ in _segments(system, folder)]
    for path in gone:
        system.delete_file(path)
    return gone


def register_created(root: str, created: DataFrame, registered: DataFrame) -> DataFrame:
    """Make the folders of created relations that are named like shards (relid, rel_name): partition_id and warning, null where it went well.

    Each task makes its own partitions' folders; a folder that can't be made is a
    warning, not an error.
    """
    from .capture import registrations

    def make(batches):
        import pyarrow as pa

        for batch in batches:
            ids, warnings = batch.column("partition_id").to_pylist(), []
            for i in ids:
                try:
                    init_partition(root, i)
                    warnings.append(None)
                except OSError as error:
                    warnings.append(str(error))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(warnings, pa.string())], ["partition_id", "warning"])

    return registrations(created, registered).select(F.col("partition_id").cast("long")).mapInArrow(make, "partition_id long, warning string")
