"""Shared helpers: reading tables, the shared scratch folder, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
_LIVE: list[str] = []  # folders of scratch_path that have not been dropped
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of an Arrow batch, unless one row has more


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    """The named columns of a table; other columns, whatever their names, are left out."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Hand Python at most BATCH_BYTES, or one row, at once: the rows of long texts can be many.

    Spark reads the setting when a result is computed, so it stays in the session
    after operators whose rows are computed after the call; ``finished`` puts it back.
    """
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder of our own only where that is unset and the master is local."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIRS:
        _OWN_DIRS[app] = tempfile.mkdtemp(prefix="logweave-")
        atexit.register(_drop_dir, _OWN_DIRS[app])
    return f"file://{_OWN_DIRS[app]}"


def _drop_dir(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def scratch_path(spark: SparkSession, what: str) -> str:
    path = f"{scratch_root(spark)}/logweave/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
    _LIVE.append(path)
    return path


def written(df: DataFrame | Iterable[DataFrame], what: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts lineage in a way that survives lost executors and makes the rows
    of non-repeatable steps final.  The shuffle files of the step go when it
    ends; Spark by itself waits for the driver's garbage to be collected.
    Several frames are written one after another into one table, so the shuffle
    files of one are gone when the next begins.
    """
    path = None
    for part in [df] if isinstance(df, DataFrame) else df:
        spark, schema = part.sparkSession, part.schema
        path, before = path or scratch_path(spark, what), spark.conf.get(CLEAN_SETTING, "false")
        spark.conf.set(CLEAN_SETTING, "true")
        try:
            part.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(CLEAN_SETTING, before)
    return spark.read.schema(schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``scratch_path``."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def finished(spark: SparkSession, what: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of build(), written; all that build() wrote on the way is deleted and the batch size is as before."""
    mark, before = len(_LIVE), spark.conf.get(BATCH_SETTING)
    out = written(build(), what)
    spark.conf.set(BATCH_SETTING, before)
    for path in _LIVE[mark:-1]:
        drop_path(spark, path)
    del _LIVE[mark:-1]
    return out


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def or_empty(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z for word matching against ASCII words, on the JVM's fast path.

    ``lower`` also changes letters beyond ASCII; the two of them whose lower
    case holds an ASCII letter are set aside first, so no word turns into an
    ASCII word that it was not.
    """
    return F.lower(F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı")))


def text_key(text: str | Column = "text") -> Column:
    """A number that tells apart rows with one doc_id and unlike texts; computed in the JVM."""
    return F.xxhash64(or_empty(text), F.octet_length(or_empty(text)))


def one_text(docs: DataFrame) -> DataFrame:
    """Rows (id, key, text) with equal ids and keys made one; the first step runs before the shuffle, so copies of a row are not sent on."""
    return docs.groupBy("id", "key").agg(F.first("text").alias("text"))
