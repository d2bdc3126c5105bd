"""The flagship path: agreement files to result files, and its checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import patterns as P
from clauseloom.operators import clauses, rules
from clauseloom.operators.repair import base_heading
from clauseloom.sources import agreements, results


def split_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each clause of the agreement files in a folder; a file that fails gives a row with ``error``."""
    docs = agreements.parse_agreements(agreements.read_files(spark, folder))
    return clauses.split(docs, keep=["file", "company", "collected", "doc_idx", "title", "source"], clean=True)


def result_files(found: DataFrame) -> DataFrame:
    """(file, json): one result file for each agreement file."""
    rows = found.where("error is null").withColumn("source_file", F.col("file"))
    made = results.assemble(rows)
    return made.select(F.regexp_replace("file", r"\.[^.]*$", ".json").alias("file"), "json")


def file_stats(found: DataFrame) -> DataFrame:
    """Documents, clauses, their middle length and problem counts by file."""
    n = F.length("text")
    sizes = found.groupBy("file").agg(F.countDistinct("doc_idx").alias("documents"), F.count("id").alias("clauses"), F.floor(F.median(n)).alias("middle"), F.first("error", ignorenulls=True).alias("error"))
    return sizes.join(rules.counters(found.where("error is null"), ["file"]).select("file", "problems"), "file", "left")


def validate_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Violations (file, doc_idx, id, bug, rule, message) of result files: of their JSON and keys, their ids in order, their
    clauses, their parts. A clause without an id, heading or text counts as one with null id and empty texts."""
    raw = agreements.read_files(spark, folder, "*.json").select("file", F.col("text").alias("raw"))
    read = results.read_results(raw)
    keys = raw.select("file", rules.key_problems(F.col("raw"), rules.FILE_KEYS).alias("k"))
    none = F.lit(None)
    bad = read.where("corrupt").select("file", none.cast("int").alias("doc_idx"), none.cast("long").alias("id"), F.lit("FORMAT").alias("bug"), F.lit("invalid_json").alias("rule"), F.lit("Not a JSON object of the expected kind").alias("message"))
    lacking = keys.where("k.valid and size(k.missing) > 0").select("file", none.cast("int"), none.cast("long"), F.lit("FORMAT"), F.concat(F.lit("missing: "), F.array_join("k.missing", ", ")), F.lit("The file lacks keys"))
    flat = results.flatten(read.where("not corrupt")).where("pos is not null").withColumn("doc_id", F.struct("file", "doc_idx"))
    flat = flat.withColumns({c: F.coalesce(c, F.lit("")) for c in ("heading", "text")})
    broken = rules.violations(flat, "doc_id", "pos").select("doc_id.file", "doc_id.doc_idx", F.col("id").cast("long"), "bug", "rule", "message")
    gaps = rules.id_gaps(flat, "doc_id", "id", "pos").select("doc_id.file", "doc_id.doc_idx", none.cast("long"), F.lit("11"), F.lit("ids_not_1_to_n"), F.concat(F.lit("Ids not 1 to N: "), "got"))
    inner = key_violations(raw.join(read.where("not corrupt").select("file"), "file", "left_semi"))
    return bad.union(lacking).union(broken).union(gaps).union(inner).union(part_violations(flat))


def key_violations(raw: DataFrame) -> DataFrame:
    """Documents that lack keys, and clauses that lack keys or have others, from (file, raw)."""
    parts = lambda x, path: F.from_json(F.get_json_object(x, path), "array<string>")
    docs = raw.select("file", F.posexplode(parts("raw", "$.documents")).alias("doc_idx", "d"))
    own = docs.select("file", "doc_idx", F.lit(None).cast("long").alias("id"), rules.key_problems(F.col("d"), rules.DOC_KEYS).alias("k"))
    items = docs.select("file", "doc_idx", F.explode(parts("d", "$.clauses")).alias("c"))
    items = items.select("file", "doc_idx", F.get_json_object("c", "$.id").try_cast("long").alias("id"), rules.key_problems(F.col("c"), rules.CLAUSE_KEYS, exact=True).alias("k"))
    both = own.union(items)
    rows = [both.where(F.size(f"k.{x}") > 0).select("file", "doc_idx", "id", F.lit("FORMAT").alias("bug"), F.concat(F.lit(f"{x}: "), F.array_join(f"k.{x}", ", ")).alias("rule"), F.when(F.col("id").isNull(), "A document or clause has keys amiss").otherwise("A clause has keys amiss").alias("message")) for x in ("missing", "extra")]
    return rows[0].union(rows[1])


def part_violations(flat: DataFrame) -> DataFrame:
    """Groups of part labels with one base heading whose count varies or whose parts aren't 1 to n."""
    n = [F.regexp_extract("heading", P.PART_LABEL, i).try_cast("long") for i in (1, 2)]
    parts = flat.where(F.col("heading").rlike(P.PART_LABEL)).select("file", "doc_idx", base_heading(F.col("heading")).alias("base"), "id", n[0].alias("k"), n[1].alias("n"))
    found = rules.part_groups(parts, ["file", "doc_idx", "base"])
    row = lambda c, rule, said: found.where(c).select("file", "doc_idx", F.lit(None).cast("long").alias("id"), F.lit("8").alias("bug"), F.lit(rule).alias("rule"), F.format_string(f"{said}: %s", "base").alias("message"))
    return row("mixed", "parts_of_different_n", "Parts of different n").union(row("broken", "parts_not_1_to_n", "Parts aren't 1 to n"))
