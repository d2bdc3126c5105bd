"""Counts of near fingerprints where most documents have one fingerprint."""

from collections import Counter

import pytest
from clauseloom.llm import doc_fingerprints
from pyspark.sql import functions as F

DEALT = {
    "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "20",
    "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@pytest.fixture
def dealt(spark):
    before = {k: spark.conf.get(k, None) for k in DEALT}
    for k, v in DEALT.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_one_fingerprint_is_dealt_over_tasks(dealt, monkeypatch):
    fp = F.when(F.col("id") % 4 == 1, F.xxhash64("id")).when(F.col("id") == 100, F.lit(6)).otherwise(F.lit(7))
    rows = dealt.range(0, 40_000, 1, 8).select(F.when(F.col("id") != 2, F.col("id")).alias("doc_id"), fp.alias("fp"))
    rows = rows.select("doc_id", F.lit(1).cast("long").alias("n_chars"), F.sha2(F.col("doc_id").cast("string"), 256).alias("edited_sha256"), "fp", F.lit(1).cast("long").alias("edited_fp"), F.lit(1).cast("long").alias("next_fp"))
    monkeypatch.setattr(doc_fingerprints, "edited_fingerprints", lambda docs: rows)
    monkeypatch.setattr(doc_fingerprints, "documents", lambda spark, folder: None)
    out = doc_fingerprints.op7_doc_fingerprints(dealt, "")
    got = out.collect()
    assert "SortMergeJoin(skew=true)" in out._jdf.queryExecution().executedPlan().toString()
    assert Counter(r.doc_id for r in got) == Counter([*(i for i in range(40_000) if i != 2), None])
    assert all((r.n_near is None) == (r.doc_id is None or r.doc_id % 50 > 0) for r in got)
    # 6 and 7 differ in one bit; the other fingerprints are far from each other
    assert all(r.n_near == 30_000 for r in got if r.n_near is not None and r.doc_id % 4 != 1)
    assert all(r.n_near == 1 for r in got if r.n_near is not None and r.doc_id % 4 == 1)
