"""The corpus pipeline: quality rules, near-dedup, secret scan, mixing, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauseloom.llm.common import documents, written
from clauseloom.llm.pipeline import STAGES

#: SQL can't express the fingerprint plan, the weighted draw or the encoder; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one stage returns is written, and read again as the next one's documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
