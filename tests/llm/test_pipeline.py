"""The corpus pipeline, stage by stage against plain versions, each on what the stage before kept."""

import re
from collections import Counter

import corpus_pipeline
from clauseloom.llm import mixing, near_dedup, quality, secrets
from clauseloom.llm import pipeline as P
from clauseloom.llm.common import written
from tests.llm.test_contracts import WORD, plain_components, plain_simhash

STAGE = dict(corpus_pipeline.STAGES)


def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def plain_near_dedup(rows):
    """[(id, text)] with distinct ids."""
    shingles = lambda t: (lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t)))
    root = plain_components({i: plain_simhash(t or "", 2) for i, t in rows}, P.PROBE_RADIUS)
    gone, groups = set(), {}
    for i, t in sorted(rows):
        own = groups.setdefault(root[i], {})
        if (t or "") in own:
            gone.add(i)
        else:
            own[t or ""] = i
    left = [[(i, shingles(t)) for t, i in own.items()] for own in groups.values()]
    for _ in range(near_dedup.ROUNDS):
        copies = set()
        for k, ((_, head), *rest) in enumerate(left):
            copies |= {i for i, s in rest if len(s & head) >= P.SIMILARITY * len(s | head)}
            left[k] = [x for x in rest if x[0] not in copies]
        left = [g for g in left if g]
        gone |= copies
        if not copies:
            break
    return Counter(x for x in rows if x[0] not in gone)


def test_quality_stage(spark, folder):
    kept = {r.doc_id for r in quality.quality_rules(docs(spark, folder)).where("kept").collect()}
    out = STAGE["quality"](spark, docs(spark, folder), folder)
    assert out.columns == docs(spark, folder).columns and {r.doc_id for r in out.collect()} == kept


def test_near_dedup_stage(spark, folder, rows):
    assert texts(STAGE["near_dedup"](spark, docs(spark, folder), folder)) == plain_near_dedup([(r[0], r[1]) for r in rows])


def test_near_copies_of_0_8_go_and_others_stay(spark, folder):
    import random

    rng = random.Random(3)
    w = [f"w{rng.randrange(4000)}" for _ in range(600)]
    near = [*w[:100], "x", *w[101:300], "y", *w[301:500], "z", *w[501:]]
    far = [x if rng.random() > 0.15 else f"n{i}" for i, x in enumerate(w)]
    rows = [(9, " ".join(w)), (3, " ".join(near)), (5, " ".join(far)), (7, " ".join(w)), (8, " ".join(reversed(w)))]
    out = STAGE["near_dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), folder)
    assert sorted(r.doc_id for r in out.collect()) == [3, 5, 8]


def test_secret_stage(spark, folder, rows):
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.secret_spans(docs(spark, folder)).collect()}
    want = Counter()
    for r in rows:
        out, at, t = "", 0, r[1]
        for a, b in spans[r[0]]:
            if a >= at:
                out += t[at:a] + "[secret]"
            at = max(at, b)
        want[r[0], out + t[at:] if spans[r[0]] else t] += 1
    assert texts(STAGE["secrets"](spark, docs(spark, folder), folder)) == want
    assert any("[secret]" in (t or "") for _, t in want)


def test_mixing_stage(spark, folder, rows):
    out = STAGE["mixing"](spark, docs(spark, folder), folder).collect()
    size = lambda t: len(WORD.findall(t or ""))
    taken, by = Counter(), Counter()
    for r in out:
        taken[r.source] += size(r.text)
    for r in rows:
        by[r[3]] += size(r[1])
    sums = spark.createDataFrame(list(by.items()), "source string, source_size long")
    for r in mixing.source_targets(sums).collect():
        assert abs(taken[r.source] - r.target) <= 1
    copies = Counter(r.doc_id for r in out)
    assert max(copies.values()) <= 2


def test_run_ends_in_ids_and_texts(spark, folder):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    now = docs(spark, folder)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, folder), "test")
        assert now.columns == docs(spark, folder).columns, name
    want = Counter((r.doc_id, np.array(t.encode(r.text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()) for r in now.collect())
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == want and got


def test_odd_and_empty(spark, odd_folder, empty_folder):
    assert corpus_pipeline.run(spark, empty_folder).collect() == []
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, docs(spark, odd_folder), odd_folder).count()
        assert n > 0, name
