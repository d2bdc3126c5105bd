"""Groups of near copies that are judged in blocks, against the same rule by brute force."""

import random

import pytest

from clauseloom.llm import near_dedup
from tests.llm.test_near_copies import jaccard, plain_kept, prose, shingles


@pytest.mark.parametrize("block", [1, 3, 16])
def test_blocks_judge_as_one_task_does(spark, block):
    rng = random.Random(21)
    w, rows = prose(rng, 400), []
    for i in range(60):
        for j in rng.sample(range(400), 4):
            w[j] = f"r{i}x{j}"
        rows.append((i * 7 % 61, " ".join(w)))
    rows += [(100 + i, rows[i][1]) for i in range(0, 60, 6)] + [(200, "alone here"), (200, "alone here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {(r._copy) for r in near_dedup.near_copies(df, 5, 0.8, 2, 4, block=block).collect()}
    assert sorted(set(i for i, _ in rows) - gone) == sorted(set(plain_kept(rows)))


def test_copies_without_an_id_go(spark):
    rng = random.Random(22)
    w = prose(rng, 300)
    near = [*w[:150], "changed", *w[151:]]
    assert jaccard(shingles(" ".join(w)), shingles(" ".join(near))) >= 0.8
    rows = [(None, " ".join(near)), (5, " ".join(w)), (None, " ".join(w)), (None, "another text"), (None, None)]
    found = near_dedup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), 5, 0.8, 2, 4).collect()
    assert len(found) == 2 and all(r._copy is None for r in found)


def test_chains_end_in_their_smallest_node(spark):
    from clauseloom.llm.common import components

    rng = random.Random(23)
    order = list(range(300))
    rng.shuffle(order)
    edges = list(zip(order[:200], order[1:200], strict=False)) + list(zip(order[200:], order[201:], strict=False))
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: min(part) for part in (order[:200], order[200:]) for x in part}
