"""Session settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "panelforge", **conf: str) -> SparkSession:
    """A session with UTC dates, AQE with skew handling, and Arrow transfer."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
