"""Steps that judge a clause by itself shuffle no text and join nothing; what they find is as by the general way."""

from pyspark.sql import functions as F

from clauseloom.operators import repair, report, rules
from clauseloom.plans import reports
from clauseloom.plans import rules as plans
from tests.oracle import rows

DATA = "/root/testdata/sf0.001"
CLAUSES = [
    (1, 1, "**A**.", "- x"), (1, 2, "B &amp; c", "- y\nb. Zed here"), (1, 3, "C (part 2/2)", "* z:"), (1, 4, "", "- a  b"), (1, 5, "E", None), (1, 6, "F", "- after null"),
    (None, 1, "<br>", "- n â€™"), (None, 2, "g. > x", "Alpha + Beta + Gamma"), (2, 1, "- h", "- first"), (2, 2, "&lt;", "&lt;"), (2, 3, None, "bullet Ã©  �"),
]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_text_is_shuffled(spark):
    made = spark.createDataFrame(CLAUSES, "doc_id long, id long, heading string, text string")
    assert "first(text" not in plan(rules.violations(made)) and "lag(text" not in plan(rules.violations(made))
    for found in (reports.violation_diff(spark, DATA), reports.triage_table(spark, DATA), plans.change_log(spark, DATA)):
        assert "Join" not in plan(found)


def test_compared_equals_two_lists_of_violations(spark):
    made = spark.createDataFrame(CLAUSES, "doc_id long, id long, heading string, text string")
    h, t = (repair.without_mojibake(F.col(c)) for c in ("heading", "text"))
    found = rules.compared(made, h, t)
    wanted = report.changes(rules.violations(made), rules.violations(made.select("doc_id", "id", h.alias("heading"), t.alias("text"))), ["doc_id", "id", "bug", "rule"])
    assert rows(found.columns, found.collect()) == rows(wanted.columns, wanted.collect())


def test_mended_log_equals_change_log(spark):
    made = spark.createDataFrame(CLAUSES, "doc_id long, id long, heading string, text string")
    now = {c: repair.without_mojibake(F.col(c)) for c in ("heading", "text")}
    found = repair.mended_log(made, ["doc_id", "id"], now, F.col("id") % 3 != 0)
    wanted = repair.change_log(made, made.select("doc_id", "id", *(x.alias(c) for c, x in now.items())).where(F.col("id") % 3 != 0), ["doc_id", "id"], ["heading", "text"])
    assert rows(found.columns, found.collect()) == rows(wanted.columns, wanted.collect())


def test_a_repair_log_shuffles_labelled_headings_only(spark):
    made = spark.createDataFrame(CLAUSES, "doc_id long, id long, heading string, text string")
    exchanges = plan(repair.repair_log(made)).count("Exchange hashpartitioning")
    assert "REPARTITION" not in plan(repair.repair_log(made)) and exchanges <= 1
