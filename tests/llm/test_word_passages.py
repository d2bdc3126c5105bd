"""Passages of over 50 words that stand elsewhere too, against a brute-force count."""

import random
from collections import Counter

import pytest

from clauseloom.llm.suffix_dedup import Unit, repeated_passages
from tests.llm.test_contracts import WORD


def plain_words(texts, depth):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + depth]) for w in words for i in range(len(w) - depth + 1))
    out = []
    for w in words:
        hit = set()
        for i in range(len(w) - depth + 1):
            if seen[tuple(w[i : i + depth])] > 1:
                hit |= set(range(i, i + depth))
        out.append(len(hit))
    return out


@pytest.mark.parametrize("unit", [Unit(51, 12, 12), Unit(6, 2, 2), Unit(20, 5, 7)])
def test_words_of_passages(spark, rows, unit):
    rng = random.Random(7)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    passages = [prose(n) for n in (50, 51, 52, 60, 75)]
    texts = [r[1] for r in rows]
    for p in passages:
        texts += [f"{prose(40)} {p}\t\n{prose(rng.randint(0, 90))}" for _ in range(3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = {r.doc_id: r.n_repeat_words for r in repeated_passages(df, words=unit).collect()}
    assert [found[i] for i in range(len(texts))] == plain_words(texts, unit.depth)
