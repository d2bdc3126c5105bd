"""Licenses inside paragraphs and comments, and templates against themselves."""

import pytest

from clauseloom.llm.licenses import TEMPLATES, license_scan

PROSE = "some prose of a line that goes on and on about other things entirely"


def scan(spark, texts):
    found = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: (r.license, r.dice) for r in found}


def test_a_template_scores_one_against_itself(spark):
    names = sorted(TEMPLATES)
    found = scan(spark, [TEMPLATES[n] for n in names])
    assert found == {i: (n, pytest.approx(1.0)) for i, n in enumerate(names)}


def test_sentence_inside_a_paragraph(spark):
    found = scan(spark, [f"Some intro prose here. {TEMPLATES['mit-line']} And after it more.", f"{PROSE} {TEMPLATES['bsd-line']} {PROSE}", PROSE])
    assert [found[i][0] for i in range(3)] == ["mit-line", "bsd-line", None]


@pytest.mark.parametrize("name", ["mit-full", "bsd-3-full", "zlib-full", "mpl-2.0"])
def test_notice_in_a_comment_between_prose_lines(spark, name):
    w = TEMPLATES[name].split(" ")
    notice = [" * " + " ".join(w[i : i + 9]) for i in range(0, len(w), 9)]
    assert scan(spark, ["\n".join([PROSE] * 20 + notice + [PROSE] * 20)])[0][0] == name
