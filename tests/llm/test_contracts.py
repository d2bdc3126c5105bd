"""Every query of the ten against a plain version, over texts that are hard for it."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from clauseloom.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALL = sorted(QUERIES)


def sha(x) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def got(spark, name, folder):
    return {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}


@pytest.mark.parametrize("name", ALL)
def test_odd_rows_do_no_harm(spark, odd_folder, odd_rows, name):
    found = QUERIES[name](spark, odd_folder).collect()
    ids = Counter(r.doc_id for r in found)
    if name == "op8_token_counts":
        assert set(ids) == {r[0] for r in odd_rows}
    else:
        assert ids == Counter(r[0] for r in odd_rows)


@pytest.mark.parametrize("name", ALL)
def test_empty_table(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).collect() == []


def test_mix(spark, folder, rows):
    found = got(spark, "op1_mix_sources", folder)
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    by = defaultdict(int)
    for r in rows:
        by[r[3]] += size[r[0]]
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, budget = {}, set(names), 1.5 * sum(by.values())
    while free:
        share = {s: budget * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * by[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * by[s]
            budget -= target[s]
        free -= over
    taken = defaultdict(int)
    for r in rows:
        x = found[r[0]]
        assert (x["size"], x.source_size) == (size[r[0]], by[r[3]]) and x.target == pytest.approx(target[r[3]])
        assert 0 <= x.taken <= 2 * x["size"] and x.taken == x.epochs * x["size"] + x.part
        taken[r[3]] += x.taken
    for s in names:
        assert abs(taken[s] - target[s]) <= 1
    assert {k: v.taken for k, v in got(spark, "op1_mix_sources", folder).items()} == {k: v.taken for k, v in found.items()}


KINDS = [
    ("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
]


def base_spans(t):
    out = []
    for k, (name, p) in enumerate(KINDS):
        for m in p.finditer(t):
            if (len(m[2]) if k == 0 else len(m[0])) >= (6, 20, 24)[k]:
                out.append((m.start(), k, m.end(), name))
    return sorted(out)


def test_secrets(spark, folder, rows):
    found = got(spark, "op2_secret_scan", folder)
    for r in rows:
        x, base = found[r[0]], base_spans(r[1] or "")
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(s[1] == k for s in base) for k in range(3)]
        assert x.base_sha256 == sha(",".join(f"{n}:{a}:{b}" for a, _, b, n in base))
        assert {f"{n}:{a}:{b}" for a, _, b, n in base} <= set(x.spans.split(","))
    more = [x.n_key + x.n_endpoint for x in found.values()]
    assert sum(more) == 2  # the key and the endpoint beside the access identifier, and neither where it stands alone


def test_bpe(spark, folder, rows):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = got(spark, "op4_bpe_tree", folder)
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        assert found[r[0]].n_tokens == len(ids), r[1]
        assert found[r[0]].ids_sha256 == sha(np.array(ids, dtype="<u4").tobytes()), r[1]
        assert found[r[0]].decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))


def plain_passages(texts, depth):
    seen = Counter(t[i : i + depth] for t in texts for i in range(len(t) - depth + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        yield len(t), sum(gone), sum(1 for k, _ in itertools.groupby(gone) if k), sha(kept)


@pytest.mark.parametrize("odd", [False, True])
def test_passages(spark, folder, odd_folder, rows, odd_rows, odd):
    rows = odd_rows if odd else rows
    found = Counter(tuple(r)[:5] for r in QUERIES["op5_repeated_passages"](spark, odd_folder if odd else folder).collect())
    assert found == Counter((r[0], *x) for r, x in zip(rows, plain_passages([(r[1] or "").encode() for r in rows], 400), strict=True))


def test_passages_of_other_depths(spark, rows):
    from clauseloom.llm.suffix_dedup import repeated_passages

    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    for depth, gram, bundle in ((40, 9, 7), (70, 16, 4), (100, 64, 20)):
        found = {r.doc_id: tuple(r)[1:5] for r in repeated_passages(df, depth=depth, gram=gram, bundle=bundle).collect()}
        assert found == {r[0]: x for r, x in zip(rows, plain_passages([(r[1] or "").encode() for r in rows], depth), strict=True)}


def test_shards(spark, folder, rows):
    found = got(spark, "op6_shard_splitters", folder)
    for r in rows:
        raw = (r[1] or "").encode()
        x = found[r[0]]
        assert (x["size"], x.text_crc32, x.law, x.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
    by = defaultdict(list)
    for x in found.values():
        by[x.shard].append(x)
    assert set(by) <= set(range(24))
    for own in by.values():
        assert sorted(x.slot for x in own) == list(range(len(own)))
    total, largest = sum(x["size"] for x in found.values()), max(x["size"] for x in found.values())
    assert all(abs(sum(x["size"] for x in by[s]) - total / 24) <= largest for s in range(24))


def test_even_shards_with_a_hot_group(spark):
    from clauseloom.llm.sharding import shard, shard_records

    df = spark.createDataFrame([(i, "hot text" if i % 3 == 0 else f"text {i} " * (i % 17)) for i in range(30_000)], "doc_id long, text string")
    sums = shard(shard_records(df)).groupBy("shard").agg({"size": "sum", "slot": "max", "doc_id": "count"}).toPandas()
    assert len(sums) == 24 and sums["sum(size)"].max() - sums["sum(size)"].min() <= 400
    assert (sums["max(slot)"] + 1 == sums["count(doc_id)"]).all()


def test_fingerprints(spark, folder, rows):
    found = got(spark, "op7_doc_fingerprints", folder)
    ordered = sorted(rows)
    same = {}
    fp = {k: int(x.fingerprint, 16) for k, x in found.items()}
    for i, r in enumerate(ordered):
        t, following = r[1] or "", ordered[(i + 1) % len(ordered)]
        half = len(t) // 2
        x = found[r[0]]
        assert int(x.fingerprint, 16) == plain_votes(t, 2)
        assert int(x.edited_fingerprint, 16) == plain_votes(t[: len(t) - half] + (following[1] or "")[:half], 2)
        assert x.n_chars == len(t)
        assert x.edited_sha256 == sha(t[: len(t) - half] + (following[1] or "")[:half])
        assert same.setdefault(t, x.fingerprint) == x.fingerprint
        assert x.near_next == 1 - (fp[r[0]] ^ fp[following[0]]).bit_count() / 64
        assert x.near_edited == 1 - (fp[r[0]] ^ int(x.edited_fingerprint, 16)).bit_count() / 64
        near = sum((fp[r[0]] ^ y).bit_count() <= 3 for y in fp.values())
        assert x.n_near == (near if r[0] % 50 == 0 else None)


def plain_votes(t, k):
    """SimHash by signed votes of all terms, as in the books."""
    w = WORD.findall(t)
    terms = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    votes = [0] * 64
    for s in terms:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return sum(1 << b for b in range(64) if votes[b] > 0)


def plain_simhash(t, k=4):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    terms = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in terms]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(fps, radius):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= radius and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in fps}


def test_near_dedup(spark, folder, rows):
    found = got(spark, "op9_simhash_dedup", folder)
    fps = {r[0]: plain_simhash(r[1] or "") for r in rows}
    assert {k: int(x.fingerprint, 16) for k, x in found.items()} == fps
    assert {k: x.component_id for k, x in found.items()} == plain_components(fps, 4)


@pytest.mark.parametrize("radius", [1, 4, 7])
def test_links_of_dense_and_loose_fingerprints(spark, radius):
    import random

    from clauseloom.llm.near_dedup import near_components

    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(150)]
    fps = {i: rng.choice(centres[: 1 + i % 150]) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) & (2**64 - 1) for i in range(900)}
    df = spark.createDataFrame([(i, x - 2**64 if x >> 63 else x) for i, x in fps.items()], "doc_id long, fp long")
    assert {r.doc_id: r.component_id for r in near_components(df, radius).collect()} == plain_components(fps, radius)


def test_quality(spark, folder, rows):
    found = got(spark, "op10_quality_rules", folder)
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        x = found[r[0]]
        assert [x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)], t[:80]
        assert x.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (x.kept and x.base_failed)


def test_token_counts(spark, folder, rows):
    import base64

    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path("byte_bpe_50k.tiktoken"), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = defaultdict(list)
    for r in QUERIES["op8_token_counts"](spark, folder).collect():
        found[r.doc_id].append(r)
    for r in rows:
        t, own = r[1] or "", sorted(found[r[0]], key=lambda x: x.section)
        ids = encoding.encode_ordinary(t)
        assert sum(x.n_tokens for x in own) == len(ids) and own[0].start == 0 and own[-1].end == len(t)
        assert "".join(t[x.start : x.end] for x in own) == t and all(x.start == y.end for y, x in itertools.pairwise(own))
        ends, n = [len(t[: x.end].encode()) for x in own], Counter()
        at = 0
        for i in ids:
            n[next(k for k, e in enumerate(ends) if at < e)] += 1
            at += len(encoding.decode_single_token_bytes(i))
        assert [x.n_tokens for x in own] == [n[k] for k in range(len(own))]


def test_licenses(spark, folder, rows):
    from clauseloom.llm.licenses import GAP, SENTENCE_END, TEMPLATES

    pairs = lambda t: (lambda w: list(zip(w, w[1:], strict=False)))(re.sub(r"[^\w]|_", " ", t.lower()).split())
    templates = {name: Counter(pairs(t)) for name, t in TEMPLATES.items()}
    vocabulary = {x for g in templates.values() for x in g}

    def islands(t):
        w, p = re.sub(r"[^\w]|_", " ", t.lower()).split(), pairs(t)
        hits, out = [i for i, x in enumerate(p) if x in vocabulary], []
        for i in hits:
            if out and i - out[-1][1] <= GAP:
                out[-1][1] = i
            else:
                out.append([i, i])
        return [" ".join(w[a : b + 2]) for a, b in out]

    def best(t):
        lines = t.split("\n")
        units = [t, *(lines if len(lines) > 1 else []), *(x for x in re.split(r"\n[\x20\t\r]*\n", t) if "\n" in x and re.search(r"\n[\x20\t\r]*\n", t))]
        units += [x for line in lines for x in (re.split(SENTENCE_END, line) if re.search(SENTENCE_END, line) else [])] + islands(t)
        found = []
        for i, u in enumerate(units):
            own = Counter(pairs(u))
            for name, g in templates.items():
                dice = 2 * (own & g).total() / max(own.total() + g.total(), 1)
                found += [(-dice, -g.total(), name, i)] * (dice >= 0.8)
        return (-min(found)[0], *min(found)[2:]) if found else (0.0, None, None)

    found = got(spark, "op3_license_scan", folder)
    hits = 0
    for r in rows:
        dice, name, unit = best(r[1] or "")
        x = found[r[0]]
        assert (x.license, x.unit) == (name, unit) and x.dice == pytest.approx(dice, abs=1e-6)
        hits += name is not None
    assert hits
