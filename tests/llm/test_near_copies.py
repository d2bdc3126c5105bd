"""The near-dedup stage against all pairs by brute force, where groups have many members that stay."""

import random
import re

import corpus_pipeline
from clauseloom.llm import near_dedup
from clauseloom.llm import pipeline as P
from tests.llm.test_contracts import WORD

STAGE = dict(corpus_pipeline.STAGES)["near_dedup"]


def shingles(t):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain_kept(rows):
    kept = []
    for i, t in sorted(rows):
        s = shingles(t)
        if not any(jaccard(s, x) >= P.SIMILARITY for _, x in kept):
            kept.append((i, s))
    return [i for i, _ in kept]


def stage_kept(spark, folder, rows):
    return sorted(r.doc_id for r in STAGE(spark, spark.createDataFrame(rows, "doc_id long, text string"), folder).collect())


def prose(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def test_copies_behind_a_head_that_is_like_none_go(spark, folder):
    rng = random.Random(11)
    b = prose(rng, 600)
    a = list(b)
    for i in rng.sample(range(600), 17):
        a[i] = f"a{i}"
    c = [*b[:300], "changed", *b[301:]]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))]
    assert plain_kept(rows) == [1, 2]
    assert stage_kept(spark, folder, rows) == [1, 2]


def test_first_come_against_all_pairs():
    rng = random.Random(12)
    for n in (1, 4, 5, 30, 500):
        w, rows = prose(rng, n), []
        for i in range(60):
            for j in rng.sample(range(n), min(n, 6)):
                w[j] = f"r{i}x{j}" if rng.random() < 0.5 else w[j]
            rows.append((i, " ".join(w)))
        group = near_dedup.FirstCome(P.SIMILARITY)
        assert [i for i, t in rows if not group.copy(near_dedup.shingle_hashes(t.encode(), 5))] == plain_kept(rows)


def test_shingle_hashes_tell_apart_what_words_do(rows):
    texts = sorted({r[1] or "" for r in rows})
    made = [({*near_dedup.shingle_hashes(t.encode(), 5).tolist()}, shingles(t)) for t in texts]
    for a, x in made:
        assert len(a) == len(x)
    for (a, x), (b, y) in zip(made, made[1:], strict=False):
        assert len(a & b) == len(x & y)


def appended_and_cut(rng, n):
    """n pairs (longer, shorter) of random texts, with words at the end of the one only, at a similarity of 0.8 to 0.91."""
    out = []
    for _ in range(n):
        w = prose(rng, rng.randrange(60, 600))
        keep = rng.choice([0.81, 0.83, 0.86, 0.91])
        out.append((" ".join(w), " ".join(w[: int(len(w) * keep) + 1])))
    return out


def test_bands_reach_appended_and_cut_texts():
    rng = random.Random(13)
    pairs = [(a, b) for a, b in appended_and_cut(rng, 1500) if jaccard(shingles(a), shingles(b)) >= P.SIMILARITY]
    keys = lambda t: near_dedup.band_keys(near_dedup.shingle_hashes(t.encode(), P.SHINGLE))
    assert len(pairs) > 1000
    assert sum((keys(a) == keys(b)).any() for a, b in pairs) >= 0.999 * len(pairs)


def test_appended_and_cut_texts_go(spark, folder):
    rng = random.Random(14)
    rows = [(i, t) for i, t in enumerate(t for pair in appended_and_cut(rng, 150) for t in pair)]
    assert stage_kept(spark, folder, rows) == plain_kept(rows)


def test_many_revisions_of_a_text(spark, folder):
    rng = random.Random(12)
    w, rows = prose(rng, 500), []
    for i in range(60):
        for j in rng.sample(range(500), 6):
            w[j] = f"r{i}x{j}"
        rows.append((i, " ".join(w)))
    want = plain_kept(rows)
    assert len(want) > near_dedup.ROUNDS + 1
    assert stage_kept(spark, folder, rows) == want
