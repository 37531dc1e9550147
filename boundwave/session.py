"""Session settings that results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the command line; on a cluster use your own."""
    n = "8" if cores == "*" else str(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
