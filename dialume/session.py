"""The session that the examples, the bench and the tests use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cores: str | None = None, partitions: int | None = None) -> SparkSession:
    """A local session unless one is active; on a cluster, set these when submitting."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName("dialume")
        .config("spark.sql.shuffle.partitions", str(partitions or n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
