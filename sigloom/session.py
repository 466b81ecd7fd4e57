"""Session settings the compilers rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Label maps are merged right-over-left, and text is compared in UTC.
REQUIRED = {
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cpus: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    cpus = cpus or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sigloom")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in REQUIRED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Apply REQUIRED to a session someone else made."""
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark
