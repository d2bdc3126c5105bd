"""Sinks: agreement files, result files, failures, and reports. Executors write; nothing large goes to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.functions import text as T


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def agreement_files(docs: DataFrame, collected: str | None = None) -> DataFrame:
    """(file, text) for (company, ord, doc_type, url, text): header, date, and each document with its source and a rule."""
    date = F.lit(collected) if collected else today()
    part = F.concat(F.lit("## "), "doc_type", F.lit("\nSource: "), "url", F.lit("\n\n"), "text", F.lit("\n\n---\n"))
    rows = F.array_sort(F.collect_list(F.struct("ord", part.alias("p"))))
    made = docs.groupBy("company").agg(F.array_join(F.transform(rows, lambda x: x["p"]), "\n").alias("_b"))
    return made.select(F.concat(T.slugify(F.col("company")), F.lit(".md")).alias("file"), F.concat(F.lit("# "), "company", F.lit("\n*Collected on "), date, F.lit("*\n\n"), "_b").alias("text"))


def write_files(files: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """Writes each row's text to folder/file through the cluster's file system; gives (file, bytes) once read. An existing file is replaced."""
    jvm_conf = {"folder": folder.rstrip("/")}

    def run(batches):
        import os

        import pyarrow as pa
        import pyarrow.fs as pafs

        base = jvm_conf["folder"]
        fs, root = pafs.FileSystem.from_uri(base) if "://" in base or base.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(base))
        fs.create_dir(root, recursive=True)
        for b in batches:
            names, sizes = b.column(0).to_pylist(), []
            for name, t in zip(names, b.column(1).to_pylist(), strict=True):
                raw = (t or "").encode()
                part = f"{root}/.{name}.{os.getpid()}.part"
                with fs.open_output_stream(part) as out:
                    out.write(raw)
                fs.move(part, f"{root}/{name}")  # a task that runs again writes the same file
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64())], ["file", "bytes"])

    return files.select("file", text).mapInArrow(run, "file string, bytes long")


def changed_only(new: DataFrame, old: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Rows of new whose text differs from old's, or that old hasn't: compares hashes, so texts of old aren't carried along."""
    known = old.select(key, F.sha2(text, 256).alias("_sha"))
    return new.join(known, key, "left").where(F.col("_sha").isNull() | (F.col("_sha") != F.sha2(text, 256))).drop("_sha")


def write_failures(failures: DataFrame, path: str, collected: str | None = None) -> bool:
    """'company | url | reason' lines under a dated header, replacing what was there; nothing is written without failures."""
    rows = failures.select(F.concat_ws(" | ", "company", "url", "reason").alias("value"))
    spark = failures.sparkSession
    _remove(spark, path)
    if rows.isEmpty():
        return False
    head = spark.range(1).select(F.explode(F.array(F.concat(F.lit("Failures on "), F.lit(collected) if collected else today()), F.lit("=" * 60))).alias("value"))
    ordered = head.select(F.lit(0).alias("o"), F.monotonically_increasing_id().alias("k"), "value").union(rows.select(F.lit(1), F.monotonically_increasing_id(), "value"))
    ordered.repartitionByRange(1, "o", "k").sortWithinPartitions("o", "k").select("value").write.text(path)
    return True


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def report_lines(violations: DataFrame) -> DataFrame:
    """(file, place, line) of the report: a heading for each file, two lines for each violation and a total for each file.
    A table to be written or shown in the order of file and place; nothing is gathered."""
    own = Window.partitionBy("file").orderBy(F.col("doc_idx").asc_nulls_first(), F.col("id").asc_nulls_first(), "bug", "rule", "message")
    rows = violations.withColumn("_n", F.row_number().over(own)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("file")))
    place = F.format_string("  [Bug %s] clause %s | document %s", F.rpad("bug", 6, " "), F.lpad(F.coalesce(F.col("id").cast("string"), F.lit("?")), 5, " "), F.coalesce(F.col("doc_idx").cast("string"), F.lit("?")))
    first = F.when(F.col("_n") == 1, F.concat(F.lit("-- "), "file", F.lit(" "), F.lit("-" * 16)))
    last = F.when(F.col("_n") == F.col("_all"), F.format_string("Total: %d", "_all"))
    lines = F.filter(F.array(first, place, F.concat(F.lit(" " * 13), "message"), last), lambda x: x.isNotNull())
    return rows.select("file", F.col("_n").cast("long").alias("_n"), F.posexplode(lines).alias("k", "line")).select("file", F.struct("_n", "k").alias("place"), "line")


def report(violations: DataFrame) -> int:
    """Prints the whole report file by file, a partition at a time, and gives the exit code: 1 if there is any violation."""
    total = 0
    for r in report_lines(violations).orderBy("file", "place").toLocalIterator():
        print(r["line"])
        total += r["line"].startswith("  [Bug ")
    print(f"Total: {total} violations" if total else "All files pass.")
    return int(total > 0)
