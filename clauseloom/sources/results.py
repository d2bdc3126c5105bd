"""Result files (JSON): documents with their clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "company string, collected string, source_file string, documents array<struct<title:string, source:string, clauses:array<struct<id:int, heading:string, text:string>>>>"


def read_results(raw: DataFrame) -> DataFrame:
    """(file, raw) with ``result`` (null if the JSON can't be read) and ``corrupt``."""
    return raw.withColumn("result", F.from_json("raw", SCHEMA + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})).withColumn("corrupt", F.coalesce(F.col("result._corrupt").isNotNull(), F.lit(True))).withColumn("result", F.when(~F.col("corrupt"), F.col("result")))


def flatten(results: DataFrame) -> DataFrame:
    """A row for each clause, with doc_idx and the clause's place ``pos`` from 0; documents without clauses give a row with null pos."""
    docs = results.select("file", F.col("result.company").alias("company"), F.posexplode_outer("result.documents").alias("doc_idx", "d"))
    return docs.select("file", "company", "doc_idx", "d.title", "d.source", F.posexplode_outer("d.clauses").alias("pos", "c")).select("file", "company", "doc_idx", "title", "source", "pos", "c.*")


def assemble(clauses: DataFrame) -> DataFrame:
    """(file, json): the inverse of flatten, clauses by id and documents by doc_idx, pretty-printed."""
    own = F.filter(F.array_sort(F.collect_list(F.struct("id", "heading", "text"))), lambda c: c["id"].isNotNull())
    docs = clauses.groupBy("file", "company", "collected", "source_file", "doc_idx", "title", "source").agg(own.alias("clauses"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("doc_idx", "title", "source", "clauses"))), lambda d: F.struct(d["title"].alias("title"), d["source"].alias("source"), d["clauses"].alias("clauses")))
    files = docs.groupBy("file", "company", "collected", "source_file").agg(rows.alias("documents"))
    return files.select("file", F.to_json(F.struct("company", "collected", "source_file", "documents"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))
