"""Session settings that suit these operators."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "clauseloom", master: str | None = None, **settings: str) -> SparkSession:
    """Adaptive execution with skew handling, UTC, and bounded Arrow batches; everything else is the cluster's."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    } | settings
    return builder.config(map=conf).getOrCreate()
