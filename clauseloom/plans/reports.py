"""Queries of the reports on clauses, violations and repairs, and of the small literal tables of the front end."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from clauseloom.functions import text as T
from clauseloom.operators import lines as L
from clauseloom.operators import repair, rules
from clauseloom.operators import report as R
from clauseloom.plans.rules import CL, REPAIR_LOG, VIOLATIONS, _moji, made_clauses
from clauseloom.plans.structured import BLOCK_IDS, SECTIONED, SL, structured_lines
from clauseloom.sources import catalogue, sinks

LEVELS = ["high", "medium", "low"]
LABELS = [("de", "Liability", "Haftung"), ("de", "Other", "Sonstiges"), ("fr", "Liability", "Responsabilité"), ("fr", "Cancellation", "Résiliation"), ("es", "Other", "Otro")]
KINDS = ["Liability", "Cancellation", "Other"]


def clause_dump(spark, sf_dir):
    return R.clause_dump(made_clauses(spark, sf_dir))


DUMP = f"{CL} SELECT doc_id, id, len(text) AS length, left(heading, 50) AS heading, left(text, 50) AS text FROM cl"


def enriched(spark, sf_dir):
    """Clauses with a risk level and a category by place."""
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), ((F.col("doc_id") + n * F.col("id")) % 3).cast("int"))
    return made_clauses(spark, sf_dir).select("doc_id", "id", pick(LEVELS, 1).alias("risk_level"), pick(KINDS, 2).alias("category"))


ENRICHED = f"{CL}, en AS (SELECT doc_id, id, ({LEVELS!r})[(doc_id + id) % 3 + 1] AS risk_level, ({KINDS!r})[(doc_id + 2 * id) % 3 + 1] AS category FROM cl)"


def risk_filter(spark, sf_dir):
    """Clauses of one level, beside the number that the filter 'All' leaves."""
    rows = enriched(spark, sf_dir)
    one = R.risk_filter(rows, "High").groupBy("doc_id").agg(F.count(F.lit(1)).alias("high"), F.min("id").alias("first"))
    every = R.risk_filter(rows, "All").groupBy("doc_id").agg(F.count(F.lit(1)).alias("every"))
    return every.join(one, "doc_id", "left")


RISK_FILTER = f"{ENRICHED} SELECT doc_id, count(*) AS every, nullif(count(*) FILTER (risk_level = 'high'), 0) AS high, min(id) FILTER (risk_level = 'high') AS first FROM en GROUP BY doc_id"


def category_labels(spark, sf_dir):
    labels = spark.createDataFrame(LABELS, "lang string, key string, label string")
    return R.localised(enriched(spark, sf_dir), labels, "fr", "category").select("doc_id", "id", "category", "label")


CATEGORY_LABELS = f"{ENRICHED} SELECT doc_id, id, category, CASE category WHEN 'Liability' THEN 'Responsabilité' WHEN 'Cancellation' THEN 'Résiliation' ELSE category END AS label FROM en"


def compared(spark, sf_dir):
    """Violations before and after the repair of encoding debris."""
    return rules.compared(made_clauses(spark, sf_dir), repair.without_mojibake(F.col("heading")), repair.without_mojibake(F.col("text")))


_AFTER = VIOLATIONS.replace("FROM cl)", f"FROM (SELECT doc_id, id, {_moji('heading')} AS heading, {_moji('text')} AS text FROM cl))")
BOTH = f"before AS ({VIOLATIONS}), after AS ({_AFTER})"


def violation_diff(spark, sf_dir):
    """What the repair of encoding debris does to violations, one by one."""
    return compared(spark, sf_dir).where("state <> 'remains'")


DIFF = f"""WITH {BOTH}, j AS (SELECT doc_id, id, bug, rule, a.message AS x, b.message AS y FROM before a FULL JOIN after b USING (doc_id, id, bug, rule))
SELECT doc_id, id, bug, rule, CASE WHEN y IS NULL THEN 'fixed' ELSE 'appeared' END AS state FROM j WHERE x IS NULL OR y IS NULL"""


def triage_table(spark, sf_dir):
    """Violations before, fixed and left for review by document, with a total row."""
    return R.triage(compared(spark, sf_dir), "doc_id")


TRIAGE = f"""WITH {BOTH}, j AS (SELECT doc_id, a.message AS x, b.message AS y FROM before a FULL JOIN after b USING (doc_id, id, bug, rule))
SELECT doc_id, count(x) AS before, count(*) FILTER (y IS NULL) AS fixed, count(y) AS review FROM j GROUP BY ROLLUP (doc_id)"""


def violation_report(spark, sf_dir):
    """The printed report: a heading for each file, two lines for each violation, a total."""
    found = rules.violations(made_clauses(spark, sf_dir)).select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file"), F.lit(0).alias("doc_idx"), "id", "bug", "rule", "message")
    return sinks.report_lines(found).select("file", F.col("place._n").alias("n"), F.col("place.k").alias("k"), "line")


REPORT = f"""WITH v AS ({VIOLATIONS}), r AS (SELECT 'f' || doc_id AS file, *, row_number() OVER w AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY id, bug, rule, message)),
l AS (SELECT file, n, list_filter([CASE WHEN n = 1 THEN '-- ' || file || ' ' || repeat('-', 16) END, '  [Bug ' || rpad(bug, 6, ' ') || '] clause ' || lpad(id::VARCHAR, 5, ' ') || ' | document 0',
  repeat(' ', 13) || message, CASE WHEN n = c THEN 'Total: ' || c END], lambda x: x IS NOT NULL) AS l FROM r)
SELECT file, n, generate_subscripts(l, 1) - 1 AS k, unnest(l) AS line FROM l"""


def change_lines(spark, sf_dir):
    return R.change_lines(repair.repair_log(made_clauses(spark, sf_dir)))


CHANGE_LINES = f"SELECT doc_id, '[Bug ' || bug || '] ' || coalesce(old_id, '?') || ' -> ' || coalesce(new_id, 'None') || ': ' || left(detail, 80) AS line FROM ({REPAIR_LOG})"

MOCK = [{"id": i, "heading": f"Heading {i}", "risk_level": LEVELS[i % 3], "category": KINDS[i % 3], "company": "Acme"} for i in range(1, 6)]


def literal_table(spark, sf_dir):
    """Clauses given as JSON in the program, and texts by company."""
    rows = catalogue.literal_json(spark, json.dumps(MOCK), "id int, heading string, risk_level string, category string, company string")
    texts = catalogue.inline_texts(spark, {"Acme": "TERMS\n1. USE\nBe kind.", "Other": "NOTHING"})
    return rows.join(texts, "company").withColumn("chars", F.length("text").cast("long")).drop("text")


LITERAL = "SELECT * FROM (VALUES " + ", ".join(f"({r['id']}, '{r['heading']}', '{r['risk_level']}', '{r['category']}', 'Acme', 21)" for r in MOCK) + ") t(id, heading, risk_level, category, company, chars)"


def compose_headings(spark, sf_dir):
    found = L.block_starts(L.sections(structured_lines(spark, sf_dir))).where("start.level = 'sub'")
    return found.select("doc_id", "pos", T.compose(F.col("parent"), F.col("start.heading")).alias("heading"))


_WITH, _, _LAST = BLOCK_IDS.rpartition("SELECT a.doc_id, a.pos, a.section_id,")
COMPOSE = f"""{_WITH.rstrip()}, p AS (SELECT a.doc_id, a.pos, a.st.h AS h, coalesce(o.st.h, a.section) AS p FROM c5 a LEFT JOIN c3 o ON a.doc_id = o.doc_id AND a.top = o.pos WHERE a.st.l = 'sub')
SELECT doc_id, pos, CASE WHEN p = '' THEN h ELSE CASE WHEN len(p) <= 40 THEN p ELSE rtrim(CASE WHEN contains(left(p, 40), ' ') THEN regexp_replace(left(p, 40), ' [^ ]*$', '') ELSE left(p, 40) END, ' ,;:.-') || '…' END || ' > ' || h END AS heading FROM p"""


def paragraph_overlap(spark, sf_dir):
    """Paragraphs and headings of one document that share words."""
    s = L.sections(structured_lines(spark, sf_dir))
    heads = s.select("doc_id", F.col("section_id").alias("id"), F.col("section").alias("heading")).distinct()
    return R.overlap(s.where(L.nonblank()).select("doc_id", "pos", "line"), heads, ["doc_id"])


def _long_words(c: str) -> str:
    return f"unnest(list_filter(string_split_regex(lower(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')), '\\s+'), lambda x: len(x) > 3))"


OVERLAP = f"""{SL}, {SECTIONED}, a AS (SELECT DISTINCT doc_id, pos, w FROM (SELECT doc_id, pos, {_long_words('line')} AS w FROM body WHERE trim(line) <> '')),
b AS (SELECT DISTINCT doc_id, id, w FROM (SELECT doc_id, section_id AS id, {_long_words('section')} AS w FROM body))
SELECT doc_id, pos, id, count(*) AS shared FROM a JOIN b USING (doc_id, w) GROUP BY doc_id, pos, id"""

QUERIES = {
    "clause_dump": clause_dump, "risk_filter": risk_filter, "category_labels": category_labels, "violation_diff": violation_diff, "triage_table": triage_table,
    "violation_report": violation_report, "change_lines": change_lines, "literal_table": literal_table, "compose_headings": compose_headings, "paragraph_overlap": paragraph_overlap,
}
ORACLES = {
    "clause_dump": DUMP, "risk_filter": RISK_FILTER, "category_labels": CATEGORY_LABELS, "violation_diff": DIFF, "triage_table": TRIAGE, "violation_report": REPORT,
    "change_lines": CHANGE_LINES, "literal_table": LITERAL, "compose_headings": COMPOSE, "paragraph_overlap": OVERLAP,
}
