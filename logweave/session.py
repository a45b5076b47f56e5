"""Session factory with the settings that the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; on a cluster leave master to spark-submit."""
    builder = SparkSession.builder.appName("logweave")
    if master:
        cores = os.cpu_count() or 8
        builder = builder.master(master).config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "8g")
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
