import json

from clauseloom.plans import pipeline


def test_keys_and_parts_of_result_files(spark, tmp_path):
    c = lambda i, h, **more: {"id": i, "heading": h, "text": "Some words. " * 20, **more}
    docs = [
        {"title": "t", "source": "s", "clauses": [c(1, "A (part 1/2)"), c(2, "A (part 2/3)"), c(3, "B (part 2/2)"), c(4, "C (part 1/1)")]},
        {"title": "t", "clauses": [c(1, "D", note="x"), {"id": 2, "heading": "E"}]},
    ]
    (tmp_path / "a.json").write_text(json.dumps({"company": "c", "collected": "d", "source_file": "f", "documents": docs}))
    found = {(r.doc_idx, r.id, r.bug, r.rule) for r in pipeline.validate_folder(spark, str(tmp_path)).collect()}
    want = {(0, None, "8", "parts_of_different_n"), (0, None, "8", "parts_not_1_to_n"), (1, None, "FORMAT", "missing: source"), (1, 1, "FORMAT", "extra: note"), (1, 2, "FORMAT", "missing: text"), (1, 2, "FORMAT", "short_text")}
    assert want <= found and {x for x in found if x[2] in ("8", "FORMAT")} == want


def test_ids_count_in_the_order_in_which_they_stand(spark, tmp_path):
    c = lambda i: {"id": i, "heading": "A heading", "text": "Some words. " * 20}
    docs = [{"title": "t", "source": "s", "clauses": [c(2), c(1)]}, {"title": "t", "source": "s", "clauses": [c(1), c(2)]}, {"title": "t", "source": "s", "clauses": [c(1), {"heading": "H", "text": "Some words. " * 20}]}]
    (tmp_path / "a.json").write_text(json.dumps({"company": "c", "collected": "d", "source_file": "f", "documents": docs}))
    found = {(r.doc_idx, r.message) for r in pipeline.validate_folder(spark, str(tmp_path)).collect() if r.bug == "11"}
    assert found == {(0, "Ids not 1 to N: 2, 1"), (2, "Ids not 1 to N: 1, ?")}
