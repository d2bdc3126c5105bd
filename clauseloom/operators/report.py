"""Reports and the lookups of the front end: counts, totals, labels in other languages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import text as T

MISSING = "Translation unavailable"

# Extension: words by which a clause is flagged, by category.
RISK_PATTERNS = {
    "Data collection": r"(?i)\b(?:personal (?:data|information)|collect|cookies?|location)\b",
    "Third-party sharing": r"(?i)\b(?:third[- ]part(?:y|ies)|affiliates|partners|share)\b",
    "Auto-renewal": r"(?i)\b(?:auto(?:matic(?:ally)?)?[- ]renew(?:s|al)?|recurring)\b",
    "Cancellation": r"(?i)\b(?:cancel(?:lation)?|refund|terminate)\b",
    "Liability": r"(?i)\b(?:liab(?:le|ility)|arbitration|indemnif(?:y|ication)|waive)\b",
}


def risk_counts(clauses: DataFrame, level: str | Column = "risk_level", by: list[str] | None = None) -> DataFrame:
    c = F.col(level) if isinstance(level, str) else level
    found = clauses.groupBy(*(by or [])).agg(*(F.count_if(c == x).alias(x) for x in ("high", "medium", "low")), F.count(F.lit(1)).alias("total"))
    return found.withColumn("summary", F.format_string("%d high-risk clauses found", "high"))


def simplify(clauses: DataFrame) -> DataFrame:
    """One row: all clauses as an array, the summary sentence and the counts. For a result shown to one reader."""
    rows = F.array_sort(F.collect_list(F.struct(*clauses.columns)))
    counts = risk_counts(clauses).select(F.struct("high", "medium", "low", "total").alias("counts"), "summary")
    return clauses.agg(rows.alias("clauses")).join(counts)


def translate(clauses: DataFrame, translations: DataFrame, lang: str, id_: str = "id") -> DataFrame:
    """``heading`` and ``summary`` in the language, a fixed text where there is none; Spark broadcasts a small dictionary."""
    own = translations.where(F.col("lang") == lang).select(F.col("id").alias(id_), F.col("heading").alias("_h"), F.col("summary").alias("_s"))
    found = clauses.join(own, id_, "left")
    return found.withColumn("heading", F.coalesce("_h", F.lit(MISSING))).withColumn("summary", F.coalesce("_s", F.lit(MISSING))).drop("_h", "_s")


def localised(clauses: DataFrame, labels: DataFrame, lang: str, column: str) -> DataFrame:
    """``label``: the value of the column in the language, from labels (lang, key, label); the value itself where there is none."""
    own = labels.where(F.col("lang") == lang).select(F.col("key").alias(column), F.col("label"))
    return clauses.join(own, column, "left").withColumn("label", F.coalesce("label", column))


def risk_filter(clauses: DataFrame, shown: str, level: str = "risk_level") -> DataFrame:
    """Clauses of the level that a reader has chosen: All, High, Medium or Low."""
    return clauses if shown == "All" else clauses.where(F.col(level) == shown.lower())


def clause_dump(clauses: DataFrame) -> DataFrame:
    """Length and beginnings of each clause, to look at."""
    return clauses.select("doc_id", "id", F.length("text").cast("long").alias("length"), F.left("heading", F.lit(50)).alias("heading"), F.left("text", F.lit(50)).alias("text"))


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, state) of what was found before, after or both times: fixed, appeared, remains."""
    a, b = before.select(*key).distinct().withColumn("_a", F.lit(1)), after.select(*key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").select(*key, F.when(F.col("_b").isNull(), "fixed").when(F.col("_a").isNull(), "appeared").otherwise("remains").alias("state"))


def triage(changed: DataFrame, by: str) -> DataFrame:
    """Found before, fixed and left for review by file, with a total row (null)."""
    s = F.col("state")
    by_file = changed.groupBy(by).agg(F.count_if(s != "appeared").alias("before"), F.count_if(s == "fixed").alias("fixed"), F.count_if(s != "fixed").alias("review"))
    return by_file.rollup(by).agg(*(F.sum(c).alias(c) for c in ("before", "fixed", "review")))


def change_lines(log: DataFrame) -> DataFrame:
    """(doc_id, line) of a repair log, details cut to 80 characters."""
    line = F.concat(F.lit("[Bug "), "bug", F.lit("] "), F.coalesce("old_id", F.lit("?")), F.lit(" -> "), F.coalesce("new_id", F.lit("None")), F.lit(": "), F.left("detail", F.lit(80)))
    return log.select("doc_id", line.alias("line"))


def flag_risks(clauses: DataFrame, text: str = "text") -> DataFrame:
    """Extension: ``categories``, the risk categories whose pattern the text matches."""
    rows = [F.when(F.col(text).rlike(p), F.lit(name)) for name, p in RISK_PATTERNS.items()]
    return clauses.withColumn("categories", F.filter(F.array(*rows), lambda x: x.isNotNull()))


def evaluate(labelled: DataFrame, truth: str, flag: str) -> DataFrame:
    """Catches and false alarms of a flag against labels."""
    t, f = F.col(truth), F.col(flag)
    hit, alarm, miss = F.count_if(t & f), F.count_if(~t & f), F.count_if(t & ~f)
    return labelled.agg(hit.alias("hits"), alarm.alias("false_alarms"), miss.alias("misses"), F.round(hit / F.greatest(hit + alarm, F.lit(1)), 6).alias("precision"), F.round(hit / F.greatest(hit + miss, F.lit(1)), 6).alias("recall"))


def status_summary(runs: DataFrame, by: str, status: str = "status") -> DataFrame:
    """Saved, skipped and failed by words in the status, with a total row (null)."""
    s = F.lower(status)
    return runs.rollup(by).agg(*(F.count_if(F.contains(s, F.lit(x))).alias(x) for x in ("saved", "skipped", "failed")), F.count(F.lit(1)).alias("files"))


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One column ``row``: each value cut and padded to its width."""
    return df.select(F.concat_ws(" ", *(F.rpad(F.substring(F.coalesce(F.col(c).cast("string"), F.lit("-")), 1, w), w, " ") for c, w in widths.items())).alias("row"))


def overlap(paragraphs: DataFrame, clauses: DataFrame, by: list[str]) -> DataFrame:
    """Extension: clauses whose heading shares a word of four letters or more with a paragraph of the same document, by equi-join on words."""
    w = lambda c: F.explode(F.array_distinct(F.filter(T.tokens(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}\s]", ""))), lambda x: F.length(x) > 3)))
    a = paragraphs.select(*by, "pos", w(F.col("line")).alias("w"))
    b = clauses.select(*by, "id", w(F.col("heading")).alias("w"))
    return a.join(b, [*by, "w"]).groupBy(*by, "pos", "id").agg(F.count(F.lit(1)).alias("shared"))


def vectors_near(vectors: DataFrame, query: list[float], k: int, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Extension: the k vectors nearest to a query by cosine; a top-k needs no full sort."""
    q = F.array(*map(F.lit, map(float, query)))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    return vectors.select(id_, (dot(v, q) / F.sqrt(dot(v, v) * dot(q, q))).alias("cosine")).orderBy(F.desc("cosine"), id_).limit(k)


def register_views(spark: SparkSession, sf_dir: str, tables: list[str]) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
