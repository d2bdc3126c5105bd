"""Shards as files, and ranges that one key fills."""

from collections import Counter

from pyspark.sql import functions as F

from clauseloom.llm import sharding


def test_every_row_is_written_once(spark, odd_folder, odd_rows, tmp_path):
    df = spark.read.parquet(f"{odd_folder}/documents.parquet")
    placed = sharding.shard(sharding.shard_records(df), 5).cache()
    sharding.write_shards(df, placed, str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.source) for r in found.collect()) == Counter((r[0], r[1], r[3]) for r in odd_rows)
    assert {r.shard: r["count"] for r in found.groupBy("shard").count().collect()} == {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}


def test_ranges_of_a_hot_text_are_divided(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("one hot text")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    records = sharding.shard_records(df)
    _, ranges = sharding.splitters(records, sample=200, ranges=64)
    total = records.agg(F.sum("size")).first()[0]
    assert sum(n for _, n in ranges) == 6000 and max(b for b, _ in ranges) <= 2 * total / 64 + 40
