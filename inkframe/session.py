"""Session helper for local runs; on a cluster the caller brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "inkframe", cores: int | str | None = None, **extra: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    } | extra
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
