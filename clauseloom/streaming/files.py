"""Extension: agreement files as a stream. Every file is whole, so the stateless path works on it unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clauseloom.operators import clauses


def stream_texts(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    rows = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).load(folder)
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def stream_clauses(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Clauses of each new file appended to a Parquet folder; runs until what is there has been read."""
    found = clauses.split(stream_texts(spark, folder), keep=["file"], clean=True)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_agreements(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Agreement files: windows by file need whole micro-batches."""
    from clauseloom.sources.agreements import parse_agreements

    def each(batch: DataFrame, _: int) -> None:
        docs = parse_agreements(batch)
        clauses.split(docs, keep=["file", "company", "collected", "doc_idx", "title", "source"], clean=True).write.mode("append").parquet(out)

    return stream_texts(spark, folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
