"""What the operators of this subpackage share: words, shared storage, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words; a word is a run of anything else.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(text: str | Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text that isn't null."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_RUN))


def bind(value: Column, body) -> Column:
    """body(value) with the value computed once, not once for each element of a lambda in the body."""
    return F.get(F.transform(F.array(value), body), 0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none and everything runs
    on one machine, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.conf.get("spark.master", "") + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="clauseloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read again: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clear() -> None:
    for spark, path in _written:
        with contextlib.suppress(Exception):  # the session may have ended before
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until the edges are stars: every node points to one
    root that points nowhere. Every step is a partially aggregated minimum and an equi-join; no component is ever gathered
    in one task.
    """

    def stars(pairs: DataFrame) -> bool:
        ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("out")), F.struct(F.col("b").alias("x"), F.lit(0).alias("out")))).alias("e"))
        nodes = ends.groupBy("e.x").agg(F.sum("e.out").alias("out"), F.min("e.out").alias("root"))
        return nodes.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("root") == 0))).isEmpty()

    def star(pairs: DataFrame, least: Column, keep: Column) -> DataFrame:
        centre = pairs.groupBy("a").agg(least.alias("m"))
        return pairs.where(keep).join(centre, "a").select(F.col("b").alias("u"), "m", "a")

    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    while not stars(now):
        both = now.union(now.select("b", "a"))
        large = star(both, F.least("a", F.min("b")), F.col("b") > F.col("a")).select(F.col("u").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        small = star(large, F.min("b"), F.lit(True))
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        now = written(small.where("a <> b").distinct(), name)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
