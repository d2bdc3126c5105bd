"""Queries against their SQL on documents that are hard for them."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from clauseloom.catalog import ORACLES, QUERIES
from tests.oracle import compare

TEXTS = [
    "", " ", " ", "\t", "\n\n", "...", None, "12345678901234567890. Next", "中文" * 10, "=" * 20 + " ", "Éﬁ" + "A" * 20, "ß" * 20, "ONEWORDOFMANYLETTERS ",
    "Foo etc.  and more. Then", "Viſco. ſays vſ. A", "E.G.\tA! B", "Say. Not. \"Quote", "x.\x0bY. Z", "a + b + c + d + ", "  + a + b + ", "One etc.\nTwo. Three",
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    made = tmp_path_factory.mktemp("odd")
    rows = [(i, t) for i, t in enumerate(t for t in TEXTS for _ in range(13))]  # each text as each kind of line
    columns = {"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": pa.array([t for _, t in rows], pa.string()), "lang": ["en"] * len(rows), "source": ["web"] * len(rows)}
    pq.write_table(pa.table(columns), made / "documents.parquet")
    return str(made)


@pytest.mark.parametrize("name", ["chrome_filter", "sentence_split"])
def test_equals_sql_on_odd_texts(spark, folder, name):
    assert compare(spark, folder, QUERIES[name], ORACLES[name]) == ""
