"""Sources and sinks: read, written, and read again."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import clauses, repair
from clauseloom.plans import pipeline
from clauseloom.sources import agreements, catalogue, results, sinks
from clauseloom.streaming import files as streaming

PARA = "We keep what you give us for as long as the law asks us to keep it, and not longer than that. " * 3


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "acme.md").write_bytes(("﻿# Acme Corp\r\n*Collected on 2024-01-02*\n\n## Terms\n\nSource: https://a.example/t\n\n## Scope\n" + PARA + "\n\n1. Your Data\n\n" + PARA + "\n---\n## Privacy\nSource: https://a.example/p\n\n" + PARA).encode())
    (tmp_path / "plain.md").write_text(PARA)
    return tmp_path


def test_agreements(spark, folder):
    rows = {(r.file, r.doc_idx): r for r in agreements.parse_agreements(agreements.read_files(spark, str(folder))).collect()}
    assert {k: (r.company, r.collected, r.title, r.source) for k, r in rows.items()} == {
        ("acme.md", 1): ("Acme Corp", "2024-01-02", "Terms", "https://a.example/t"),
        ("acme.md", 2): ("Acme Corp", "2024-01-02", "Privacy", "https://a.example/p"),
        ("plain.md", 1): ("plain", None, "plain", ""),
    }
    with pytest.raises(FileNotFoundError):
        agreements.read_files(spark, str(folder), "*.none")


def test_folder_to_results_and_back(spark, folder):
    found = pipeline.split_folder(spark, str(folder))
    written = sinks.write_files(pipeline.result_files(found), str(folder / "out"), "json").collect()
    assert {r.file for r in written} == {"acme.json", "plain.json"}
    made = json.loads((folder / "out/acme.json").read_text())
    assert [d["title"] for d in made["documents"]] == ["Terms", "Privacy"] and [c["id"] for c in made["documents"][0]["clauses"]] == [1, 2]
    assert made["documents"][0]["clauses"][1]["heading"] == "Your Data"
    (folder / "out/broken.json").write_text('{"company": ')
    (folder / "out/short.json").write_text('{"company": "x", "documents": []}')
    bad = {(r.file, r.rule) for r in pipeline.validate_folder(spark, str(folder / "out")).collect()}
    assert ("broken.json", "invalid_json") in bad and ("short.json", "missing: collected, source_file") in bad
    assert {r.file: r.documents for r in pipeline.file_stats(found).collect()} == {"acme.md": 2, "plain.md": 1}


def test_catalogue(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes('﻿company, document_type ,url,notes\n Acme ,Terms of Use,https://a.example/t,"a ""b"""\nBeta,Privacy Policy,https://B.example:80/p,\nGamma,EULA,,\n'.encode())
    rows = catalogue.read_catalogue(spark, str(tmp_path / "c.csv"))
    assert rows.columns == ["company", "document_type", "url", "notes"] and rows.first().asDict() == {"company": "Acme", "document_type": "Terms of Use", "url": "https://a.example/t", "notes": 'a "b"'}
    assert [r.company for r in catalogue.wanted(rows).collect()] == ["Acme"]
    assert [r.company for r in catalogue.wanted(rows, include_privacy=True).orderBy("company").collect()] == ["Acme", "Beta"]
    existing = spark.createDataFrame([("acme.md",)], "file string")
    assert [r.company for r in catalogue.not_yet_built(rows, existing).orderBy("company").collect()] == ["Beta", "Gamma"]
    robots = spark.createDataFrame([("a.example", False), ("b.example", False)], "host string, allowed boolean")
    assert {r.company: r.allowed for r in catalogue.gate(rows, robots, ["b.example"]).collect()} == {"Acme": False, "Beta": True, "Gamma": True}


def test_fetch(spark):
    rows = spark.createDataFrame([("u1",), ("u2.pdf",), ("bad",)], "url string")

    def reader(url):
        if url == "bad":
            raise ValueError("HTTP 404")
        return (b"%PDF", "pdf", None) if url.endswith("pdf") else ("<p>x</p>", "html", None)

    got = {r.url: (r.html, r.pdf, r.ctype, r.err) for r in catalogue.fetch(rows, reader).collect()}
    assert got == {"u1": ("<p>x</p>", None, "html", None), "u2.pdf": (None, bytearray(b"%PDF"), "pdf", None), "bad": (None, None, None, "HTTP 404")}
    kinds = catalogue.dispatch(spark.createDataFrame([("https://x.y/z",), ("a.pdf",), ("b.md",), ("some\ntext",)], "source string"))
    assert [r.kind for r in kinds.collect()] == ["url", "pdf", "file", "text"]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("Acme Co", 2, "Privacy", "u2", "two"), ("Acme Co", 1, "Terms", "u1", "one")], "company string, ord int, doc_type string, url string, text string")
    made = sinks.agreement_files(docs, "2024-05-06")
    assert made.first().file == "acme_co.md" and made.first().text.startswith("# Acme Co\n*Collected on 2024-05-06*\n\n## Terms\nSource: u1\n\none\n\n---\n\n## Privacy")
    back = agreements.parse_agreements(made)
    assert [(r.title, r.source) for r in back.orderBy("doc_idx").collect()] == [("Terms", "u1"), ("Privacy", "u2")]
    old = spark.createDataFrame([("a", "x"), ("b", "y")], "file string, text string")
    new = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "w")], "file string, text string")
    assert sorted(r.file for r in sinks.changed_only(new, old).collect()) == ["b", "c"]
    path = str(tmp_path / "failed")
    bad = spark.createDataFrame([("A", "u", "HTTP 500")], "company string, url string, reason string")
    assert sinks.write_failures(bad, path, "2024-05-06") and "A | u | HTTP 500" in "".join(p.read_text() for p in Path(path).glob("part-*"))
    assert not sinks.write_failures(bad.limit(0), path) and not Path(path).exists()


def test_results_round_trip(spark):
    raw = spark.createDataFrame([("f", json.dumps({"company": "c", "collected": None, "source_file": "s", "documents": [{"title": "t", "source": "u", "clauses": [{"id": 2, "heading": "h2", "text": "x"}, {"id": 1, "heading": "h1", "text": "y"}]}]}))], "file string, raw string")
    flat = results.flatten(results.read_results(raw)).withColumn("collected", F.lit(None).cast("string")).withColumn("source_file", F.lit("s"))
    made = json.loads(results.assemble(flat).first().json)
    assert [c["id"] for c in made["documents"][0]["clauses"]] == [1, 2]


def test_repairs(spark):
    rows = [(1, 1, "**Bold** Terms", "Privacy + Center + Rights"), (1, 2, "g. (part 1/3)", "Your rights. More text."), (1, 3, "Item 4", "one two three four five six seven eight nine"), (1, 4, "Data (part 2/3)", "cafÃ© &amp; bar"), (1, 5, "Data (part 3/3)", "x")]
    got = repair.repair(spark.createDataFrame(rows, "doc_id int, id int, heading string, text string")).orderBy("id").collect()
    assert [(r.old_id, r.id, r.heading) for r in got] == [(2, 1, "Your rights (part 1/3)"), (3, 2, "one two three four five six seven eight..."), (4, 3, "Data (part 1/2)"), (5, 4, "Data (part 2/2)")]
    assert got[2].text == "café & bar"


def test_bad_text_does_not_stop_the_rest(spark):
    from pyspark.sql import types as T

    def kernel(t):
        if t == "bad":
            raise ValueError("no")
        return [(t.upper(),)]

    got = clauses.flat_map(spark.createDataFrame([("a",), ("bad",), (None,)], "text string"), "text", [], [T.StructField("out", T.StringType())], kernel).collect()
    assert [(r.out, r.error) for r in got] == [("A", None), (None, "ValueError: no"), ("", None)]


def test_stream(spark, folder, tmp_path):
    out, state = str(tmp_path / "clauses"), str(tmp_path / "state")
    streaming.stream_agreements(spark, str(folder), out, state).awaitTermination()
    first = spark.read.parquet(out).count()
    (folder / "new.md").write_text(PARA)
    streaming.stream_agreements(spark, str(folder), out, state).awaitTermination()
    assert first == 4 and spark.read.parquet(out).count() == 5


def test_simplify_and_translate(spark):
    from clauseloom.operators import report

    rows = spark.createDataFrame([(1, "h", "high"), (2, "k", "low")], "id int, heading string, risk_level string")
    got = report.simplify(rows).first()
    assert got.counts.asDict() == {"high": 1, "medium": 0, "low": 1, "total": 2} and got.summary == "1 high-risk clauses found" and len(got.clauses) == 2
    words = spark.createDataFrame([("hi", 1, "H", "S")], "lang string, id int, heading string, summary string")
    assert {r.id: (r.heading, r.summary) for r in report.translate(rows, words, "hi").collect()} == {1: ("H", "S"), 2: (report.MISSING, report.MISSING)}


def test_sources_of_every_kind(spark, tmp_path):
    from clauseloom.sources import catalogue

    (tmp_path / "a.md").write_text("from a file")
    pages = {"https://x.example/a": ("<html><script>no</script><p>One</p>\n<p>Two &amp; three</p></html>", "html", None), "https://x.example/b": (None, None, "HTTP 404")}
    given = [*pages, str(tmp_path / "a.md"), "missing.txt", "several\nlines"]
    rows = spark.createDataFrame([(x,) for x in given], "source string")
    found = {r.source: (r.kind, r.text, r.err) for r in catalogue.load_sources(rows, lambda url: pages[url]).collect()}
    assert found["https://x.example/a"] == ("url", "One\n\nTwo & three", None) and found["https://x.example/b"] == ("url", "", "HTTP 404")
    assert found[given[2]] == ("file", "from a file", None) and found["missing.txt"] == ("file", "missing.txt", None)
    assert found["several\nlines"] == ("text", "several\nlines", None)


def test_slugs_decompose_by_compatibility(spark):
    from pyspark.sql import functions as F

    from clauseloom.functions import text as T

    names = ["Ő ﬁrm Ā", "Ünï™ ½", "Straße 日本", "plain_name"]
    found = [r.s for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i").select(T.slugify(F.col("n")).alias("s")).collect()]
    assert found == ["o_firm_a", "unitm_12", "strae", "plain_name"]
