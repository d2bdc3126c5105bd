"""Licences over several lines between blank lines of any kind."""

import pytest

from clauseloom.llm.licenses import TEMPLATES, license_scan


@pytest.mark.parametrize("end, blank", [("\n", ""), ("\r\n", ""), ("\n", " "), ("\n", "\t "), ("\r\n", " ")])
def test_licence_over_lines_between_blank_lines(spark, end, blank):
    prose = end.join(f"some prose of line {i} goes on and on" for i in range(40))
    rows = []
    for i, name in enumerate(["mit-grant", "mpl-2.0", "isc", "unlicense"]):
        w = TEMPLATES[name].split(" ")
        notice = end.join(" ".join(w[j : j + 9]) for j in range(0, len(w), 9))
        rows.append((i, name, (end + blank + end).join([prose, notice, prose])))
    found = license_scan(spark.createDataFrame(rows, "doc_id long, name string, text string")).collect()
    assert {r.doc_id: r.license for r in found} == {i: name for i, name, _ in rows}
