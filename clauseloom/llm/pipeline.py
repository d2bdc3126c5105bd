"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import bpe, mixing, near_dedup, quality, secrets
from clauseloom.llm.common import whole_text, words, written

#: Near copies: five-word shingles with a Jaccard similarity of at least 0.8; candidates by two-word fingerprints and bands.
SHINGLE, SIMILARITY, PROBE_SHINGLE, PROBE_RADIUS = 5, 0.8, 2, 4


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text fails them; repeated rows fare alike; null ids and columns
    are carried along; an empty table gives an empty one."""
    judged = quality.quality_rules(docs, keep=tuple(docs.columns))
    return judged.where("kept").select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id, null last. Of rows with equal id and text one
    stays. A null text counts as empty, and all empty texts as copies; an empty table gives an empty one."""
    sha = F.sha2(whole_text("text"), 256)
    drop = near_dedup.near_copies(docs, SHINGLE, SIMILARITY, PROBE_SHINGLE, PROBE_RADIUS)
    kept = docs.join(drop, docs["doc_id"].eqNullSafe(drop["_copy"]) & (sha == drop["_sha"]), "left_anti")
    # repeated rows are found by their keys; texts move for them only where there are any
    many = docs.select(F.col("doc_id").alias("_d"), sha.alias("_m")).groupBy("_d", "_m").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_d", "_m")
    many = written(many, "repeated-rows")
    if many.isEmpty():
        return kept.select(*docs.columns)
    keyed = kept.withColumn("_s", sha)
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_s") == F.col("_m"))
    once = keyed.join(many, same, "left_semi").dropDuplicates(["doc_id", "_s"])
    return keyed.join(many, same, "left_anti").union(once).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with each reported secret in its text replaced by a mark, and n_chars to match. A null text stays null;
    ids may be null or repeat, as spans are kept by id and text; an empty table gives an empty one."""
    sha = F.sha2(whole_text("text"), 256)
    spans = secrets.secret_spans(docs.withColumn("_sha", sha), keep=("_sha",)).where(F.size("spans") > 0)
    spans = written(spans.dropDuplicates(["doc_id", "_sha"]).select(F.col("doc_id").alias("_id"), "_sha", "spans"), "secret-spans")
    met = docs.join(spans, docs["doc_id"].eqNullSafe(spans["_id"]) & (sha == spans["_sha"]), "left")
    found = F.col("spans").isNotNull()
    clean = met.withColumn("text", F.when(found, secrets.redacted(whole_text("text"), F.col("spans"))).otherwise(F.col("text")))
    clean = clean.withColumn("n_chars", F.when(found, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole copy, and the first words of the document on which a source's target falls.

    Rows of equal id and text are each taken as far as the one that is taken furthest (near-dedup leaves none). A text without
    words isn't taken; null sources are one source; an empty table gives an empty one.
    """
    key = F.struct("doc_id", F.sha2(whole_text("text"), 256).alias("sha"))
    sizes = written(mixing.word_sizes(docs.withColumn("_key", key), "_key"), "mix-sizes")
    taken = mixing.draw(sizes).where("taken > 0").groupBy(F.col("doc_id").alias("_id")).agg(F.max("epochs").alias("epochs"), F.max("part").alias("part"), F.max("size").alias("_size"))
    taken = written(taken, "mix-taken")
    rows = docs.withColumn("_key", key).join(taken, F.col("_key.doc_id").eqNullSafe(F.col("_id.doc_id")) & (F.col("_key.sha") == F.col("_id.sha")))
    copies = (F.col("epochs") + (F.col("part") > 0).cast("long")).cast("int")
    rows = rows.select(*docs.columns, "part", "_size", "epochs", F.explode(F.sequence(F.lit(1), copies)).alias("_copy"))
    cut = (F.col("_copy") > F.col("epochs")) & (F.col("part") < F.col("_size"))
    text = F.when(cut, F.array_join(F.slice(words(whole_text("text")), F.lit(1), F.col("part").cast("int")), " ")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text decoded from them, beside the id and the source. A null or empty text has no tokens; every row
    gives one; an empty table gives an empty one."""
    return bpe.encode_decode(docs, bpe.public_path(), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secret_stage),
    ("mixing", mixing_stage),
    ("encode", encode_stage),
]
