"""SimHash near-dedup by the generalised pigeonhole principle (9).

Fingerprints within ``radius`` bits are linked; linked documents form components. For m partitions of the bits and
thresholds with sum radius - m + 1, any two such fingerprints differ in some partition by no more than its threshold
(Qin et al., GPH, 2018). Here

1. correlated bits are grouped into partitions (their co-occurrence over all distinct fingerprints),
2. thresholds are allocated by dynamic programming on candidate counts estimated over all distinct fingerprints, for
   several m; the cheapest plan wins, so the plan follows the size of the corpus,
3. each fingerprint emits, for a threshold t, one key for each choice of t bits of the partition left out; equal keys
   meet in one sorted run,
4. each run is verified on the whole fingerprints and gives a spanning forest of its links, never all its pairs,
5. components come from the forest edges by star contraction in DataFrames.

Equal texts have equal fingerprints and are represented once. The plan changes the cost only, never the result.
Nothing but 64 x 64 counts and one number for each partition goes to the driver.

Null or empty text: fingerprint zero, linked like any other. Null ids are ignored by the minimum; a component of null
ids only has id null. Repeated rows each get a row. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import components, documents, whole_text, words, written
from clauseloom.llm.simhash import as_hex, fingerprint, votes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Weights of the cost model: a key emitted and sorted against a candidate pair compared in memory.
KEY_COST, PAIR_COST = 1.0, 0.004
SMALL_RUN, LARGE_RUN = 24, 8192
#: Rounds of the plain replay in tests/llm/test_pipeline.py; near_copies() judges every member and has none.
ROUNDS = 4
#: Minimum hashes of near_copies(): at a Jaccard similarity of 0.8 a pair has a band in common but in 3 of a million cases.
BANDS, BAND_ROWS = 24, 4
#: Texts at a time of which one task of near_copies() emits bands, and members of a group that one task judges at first.
BAND_CHUNK, BLOCK = 20_000, 512
#: Tasks over which the copies of one text are dealt where they meet its first id.
SALTS = 64


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """(doc_id, fp) with the SimHash of the lower-cased (A-Z) text's shingles of k words."""
    rows = df.select(F.monotonically_increasing_id().alias("_uid"), F.col(doc_id).alias("doc_id"), words(ascii_lower(whole_text(text))).alias("_w"))
    return votes(rows, ["_uid", "doc_id"], "_w", k).select("doc_id", fingerprint().alias("fp"))


def ascii_lower(text):
    """A-Z to a-z and nothing else: lower() where the text is all ASCII, else letter by letter."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


# -- the plan ---------------------------------------------------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, list[list[float]]]:
    """Number of fingerprints and, for each pair of bits, how often both are set: a matrix for each task, then sums."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(x), 65536):
                bits = ((x[s : s + 65536, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
                total += bits.T @ bits
            n += len(x)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(4097), pa.int32()), "c": pa.array([*map(float, total.ravel()), float(n)], pa.float64())})

    rows = {r.i: r.c for r in fps.select("fp").mapInArrow(count, "i int, c double").groupBy("i").agg(F.sum("c").alias("c")).collect()}
    return int(rows.get(4096, 0)), [[rows.get(64 * a + b, 0.0) for b in range(64)] for a in range(64)]


def group_bits(n: int, both: list[list[float]], m: int) -> list[list[int]]:
    """m partitions of the 64 bits; each grows by the bit most correlated with those that it has."""
    import numpy as np

    c = np.array(both) / max(n, 1)
    p = np.diag(c)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((c - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(r, 0)
    left, parts = set(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        part = [max(sorted(left), key=lambda x: r[x, sorted(left)].sum())]
        left.discard(part[0])
        while len(part) < width:
            best = max(sorted(left), key=lambda x: r[x, part].sum())
            part.append(best)
            left.discard(best)
        parts.append(sorted(part))
    return parts


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def colliding_pairs(fps: DataFrame, masks: list[int]) -> list[float]:
    """For each mask, the pairs of fingerprints that agree on all its bits."""
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(x)).cast("long")).alias("v")) for i, x in enumerate(masks)))
    counts = fps.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count(F.lit(1)).cast("double").alias("c"))
    rows = counts.groupBy(F.col("k.i").alias("i")).agg(F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).collect()
    found = {r.i: r.pairs for r in rows}
    return [found.get(i, 0.0) for i in range(len(masks))]


def allocate(n: int, widths: list[int], pairs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """Thresholds (-1: partition not probed) with sum radius - m + 1 of least cost. pairs[i][t]: candidates at t."""
    m = len(widths)
    best = {0: (0.0, [])}  # sum of (threshold + 1) so far
    for i in range(m):
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for t in range(-1, min(len(pairs[i]), radius + 1 - used)):
                c = cost + (0 if t < 0 else KEY_COST * n * comb(widths[i], t) + PAIR_COST * comb(widths[i], t) * pairs[i][t])
                if used + t + 1 not in step or c < step[used + t + 1][0]:
                    step[used + t + 1] = (c, [*chosen, t])
        best = step
    return best.get(radius + 1, (float("inf"), []))


def plan(fps: DataFrame, radius: int, most: int = 3) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest plan over several numbers of partitions."""
    n, both = bit_statistics(fps)
    if n < 2:
        return []
    agree = [1 - 2 * (p := both[b][b] / n) * (1 - p) for b in range(64)]
    options = [group_bits(n, both, m) for m in range(max(1, (radius + 1) // 3), radius + 2)]
    flat = [part for parts in options for part in parts]
    exact = dict(zip(map(mask_of, flat), colliding_pairs(fps, [mask_of(x) for x in flat]), strict=True))
    found = []
    for parts in options:
        pairs = []
        for part in parts:
            e = [1.0] + [0.0] * most  # elementary symmetric sums of the odds that a bit differs
            for b in part:
                odds = (1 - agree[b]) / max(agree[b], 1e-9)
                e = [e[0], *(e[j] + odds * e[j - 1] for j in range(1, most + 1))]
            # pairs that meet under one choice of t left-out bits, summed over the choices by allocate()
            pairs.append([exact[mask_of(part)] * sum(e[: t + 1]) / comb(len(part), t) if t else exact[mask_of(part)] for t in range(most + 1)])
        found.append((*allocate(n, [len(x) for x in parts], pairs, radius), parts))
    cost, thresholds, parts = min(found, key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(parts, thresholds, strict=True) if t >= 0]


# -- probe and verify -------------------------------------------------------------------------------------------------


def keys_of(chosen: list[tuple[list[int], int]]) -> list[int]:
    """Masks of the bits that stay, one for each partition and choice of left-out bits."""
    return [mask_of(bits) & ~mask_of(out) for bits, t in chosen for out in combinations(bits, t)]


def emit_keys(masks: list[int]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        keep = np.array(masks, dtype=np.uint64)
        salt = np.arange(1, len(keep) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        size = max(1, 200_000 // max(1, len(keep)))
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for s in range(0, len(x), size):
                part = x[s : s + size]
                k = (part[:, None] & keep) + salt
                k ^= k >> np.uint64(32)
                k *= np.uint64(0xD6E8FEB86659FD93)
                k ^= k >> np.uint64(32)
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), pa.array(np.repeat(part, len(keep)).view(np.int64))], ["key", "fp"])

    return run


def forest(x, radius: int):
    """Edges (index pairs) of a spanning forest of the links within one run of distinct fingerprints."""
    import numpy as np

    left, a, b = np.arange(len(x)), [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(x[left] ^ x[at]) <= radius
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), at))
                b.append(hit)
                queue.extend(hit)
                left = left[~near]
    none = np.array([], dtype=np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def run_links(x, radius: int):
    """forest() of a run of any size: a large one is split once more by exact pigeonhole on radius + 1 pieces."""
    import numpy as np

    x = np.unique(x)
    if len(x) <= LARGE_RUN:
        i, j = forest(x, radius)
        return x[i], x[j]
    a, b, width = [], [], -(-64 // (radius + 1))
    for s in range(0, 64, width):
        piece = (x >> np.uint64(s)) & np.uint64((1 << width) - 1)
        order = np.argsort(piece, kind="stable")
        cuts = np.flatnonzero(np.diff(piece[order])) + 1
        for own in np.split(order, cuts):
            if len(own) > 1:
                i, j = forest(x[own], radius)
                a.append(x[own][i])
                b.append(x[own][j])
    return np.concatenate(a), np.concatenate(b)


def verify_runs(radius: int):
    """From rows (key, fp) sorted by key: links (a, b) that keep connected what a run of equal keys connects."""

    def links(k, x):
        import numpy as np

        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[starts, len(k)])
        run = np.repeat(np.arange(len(starts)), sizes)
        small = np.repeat(sizes, sizes) <= SMALL_RUN
        a, b = [], []
        for lag in range(1, min(SMALL_RUN, int(sizes.max(initial=1)))):
            hit = np.flatnonzero((run[lag:] == run[:-lag]) & small[lag:] & (np.bitwise_count(x[lag:] ^ x[:-lag]) <= radius))
            a.append(x[hit])
            b.append(x[hit + lag])
        for s, n in zip(starts[sizes > SMALL_RUN], sizes[sizes > SMALL_RUN], strict=True):
            i, j = run_links(x[s : s + n], radius)
            a.append(i)
            b.append(j)
        return (np.concatenate(a), np.concatenate(b)) if a else (x[:0], x[:0])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held: list = []  # pieces of the run that is still open

        def out(pieces):
            a, b = links(np.concatenate([p[0] for p in pieces]), np.concatenate([p[1] for p in pieces]))
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            k, x = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            if not len(k):
                continue
            cut = int(np.searchsorted(k.view(np.int64), k.view(np.int64)[-1]))
            if cut or (held and held[-1][0][-1] != k[0]):
                yield out([*held, (k[:cut], x[:cut])])
                held = []
            held.append((k[cut:], x[cut:]))
        if held:
            yield out(held)

    return run


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that connect exactly what links within radius connect."""
    chosen = plan(fps, radius)
    if not chosen:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    probes = fps.select("fp").mapInArrow(emit_keys(keys_of(chosen)), "key long, fp long")
    return probes.repartition("key").sortWithinPartitions("key").mapInArrow(verify_runs(radius), "a long, b long").distinct()


def near_components(found: DataFrame, radius: int = 4, more: DataFrame | None = None) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp): component_id is the smallest doc_id that links reach.

    more: further links (a, b) between ids, which are then unique in ``found``.
    """
    distinct = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fp")
    links = near_links(distinct, radius)
    if more is not None:
        ends = (found.select(F.col("doc_id").alias(x), F.col("fp").alias(f"fp_{x}")) for x in "ab")
        for end in ends:
            more = more.join(end, end.columns[0])
        links = links.union(more.select("fp_a", "fp_b"))
    roots = components(links, "fp-components").withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = named.select("fp", "root").join(least, "root").select("fp", "component_id")
    return found.join(ids, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(raw: bytes, k: int):
    """Sorted distinct hashes of the text's shingles of k words lower-cased (A-Z); of fewer words, of the whole sequence."""
    import numpy as np

    code, power, inverse = hash_tables(len(raw) + 1)
    x = np.frombuffer(raw, np.uint8)
    apart = np.r_[True, (x == 32) | ((x >= 9) & (x <= 13)), True]
    starts, ends = np.flatnonzero(apart[:-1] & ~apart[1:]), np.flatnonzero(~apart[:-1] & apart[1:])
    total = np.r_[np.uint64(0), np.cumsum(code[x] * power[: len(x)], dtype=np.uint64)]
    w = mixed((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    size = min(k, len(w))
    made = np.full(max(len(w) - size + 1, 1), size, dtype=np.uint64)
    for j in range(size):
        made = mixed(made + w[j : len(w) - size + 1 + j])
    return np.unique(made)


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_tables: list = []


def hash_tables(n: int):
    """A value for each byte (A-Z as a-z), and powers of an odd number and of its inverse modulo 2 ** 64, n at least."""
    import numpy as np

    if not _tables or len(_tables[1]) < n:
        base, size = 0x9E3779B97F4A7C15, max(1 << 16, 2 * n)
        code = mixed(np.arange(1, 257, dtype=np.uint64))
        code[65:91] = code[97:123]
        steps = (np.full(size, x, dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
        _tables[:] = [code, *(np.cumprod(np.r_[np.uint64(1), x[1:]], dtype=np.uint64) for x in steps)]
    return _tables


def band_keys(h):
    """A key for each of BANDS bands of BAND_ROWS minimum hashes of a set: two sets have one in common with probability
    1 - (1 - J ** BAND_ROWS) ** BANDS for a Jaccard similarity of J."""
    import numpy as np

    odd = mixed(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(len(odd), 2**64 - 1, dtype=np.uint64)
    for s in range(0, len(h), 4096):
        x = (h[s : s + 4096] ^ (h[s : s + 4096] >> np.uint64(29)))[None, :] * odd[:, None]
        least = np.minimum(least, (x ^ (x >> np.uint64(31))).min(axis=1))
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BAND_ROWS, BANDS):
        keys = mixed(keys + row)
    return keys


def emit_bands(k: int):
    """From rows (node, text): (key, a, b). What equal bands of a chunk's texts connect leaves the task as links (a, b)
    without a key; of each different key one row (key, a, a). However many texts have a band in common, its key is met
    once for each chunk."""

    def made(nodes: list, keys: list):
        import numpy as np
        import pyarrow as pa

        node, key = np.array(nodes, dtype=np.int64), np.concatenate(keys)
        owner = np.repeat(node, BANDS)
        order = np.lexsort((owner, key))
        owner, key = owner[order], key[order]
        new = np.r_[True, key[1:] != key[:-1]]
        first = owner[np.flatnonzero(new)[np.cumsum(new) - 1]]
        link = np.unique(np.stack([first[first != owner], owner[first != owner]]), axis=1)
        none = pa.nulls(link.shape[1], pa.int64())
        keyed = [pa.array(key[new].view(np.int64)), pa.array(owner[new]), pa.array(owner[new])]
        yield pa.RecordBatch.from_arrays(keyed, ["key", "a", "b"])
        yield pa.RecordBatch.from_arrays([none, pa.array(link[0]), pa.array(link[1])], ["key", "a", "b"])

    def run(batches):
        seen: dict = {}
        for b in batches:
            for n, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if n not in seen:  # of equal texts one
                    seen[n] = band_keys(shingle_hashes((t.as_py() or "").encode(), k))
                if len(seen) >= BAND_CHUNK:
                    yield from made(list(seen), list(seen.values()))
                    seen = {}
        if seen:
            yield from made(list(seen), list(seen.values()))

    return run


def band_stars(batches):
    """From rows (key, node) sorted by both: links of a key's other nodes with its first."""
    import numpy as np
    import pyarrow as pa

    key, first = None, None
    for b in batches:
        k, x = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(k):
            continue
        starts = np.flatnonzero(np.r_[k[0] != key, k[1:] != k[:-1]])
        centre = x[starts]
        if k[0] == key:
            starts, centre = np.r_[0, starts], np.r_[first, centre]
        centres = np.repeat(centre, np.diff(np.r_[starts, len(k)]))
        key, first = k[-1], centre[-1]
        hit = centres != x
        yield pa.RecordBatch.from_arrays([pa.array(centres[hit]), pa.array(x[hit])], ["a", "b"])


def band_links(rows: DataFrame, k: int) -> DataFrame:
    """Links (a, b) that connect the nodes of rows (node, text) which have a band in common."""
    found = written(rows.select("node", "text").mapInArrow(emit_bands(k), "key long, a long, b long"), "bands")
    keys = found.where("key is not null").select("key", F.col("a").alias("node"))
    stars = keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(band_stars, "a long, b long")
    return found.where("key is null").select("a", "b").union(stars).distinct()


class FirstCome:
    """Sets of one group in the order they come: each is kept unless it is like one kept before.

    Two sets with a Jaccard similarity of s or more share one of the n - ceil(s * n) + 1 smallest elements of each of
    them, so kept sets are looked up by those only and no similar one is missed.
    """

    def __init__(self, similarity: float):
        self.similarity, self.kept, self.by = similarity, [], {}

    def probe(self, x) -> list:
        # one element more than needed where similarity * n is whole, whatever its rounding
        return x[: len(x) - max(1, ceil(self.similarity * len(x) - 1e-6)) + 1].tolist()

    def like(self, x) -> bool:
        """Whether x is like one that is kept."""
        import numpy as np

        n = len(x)
        seen: set[int] = set()
        for h in self.probe(x):
            for i in self.by.get(h, ()):
                if i not in seen:
                    seen.add(i)
                    y = self.kept[i]
                    if self.similarity * max(n, len(y)) <= min(n, len(y)) + 1e-6:
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        both = int(np.count_nonzero(y[at] == x))
                        if both >= self.similarity * (n + len(y) - both):
                            return True
        return False

    def add(self, x) -> None:
        for h in self.probe(x):
            self.by.setdefault(h, []).append(len(self.kept))
        self.kept.append(x)

    def copy(self, x) -> bool:
        found = self.like(x)
        if not found:
            self.add(x)
        return found


def first_come(k: int, similarity: float):
    """From rows (group, doc_id, sha, head, text) sorted by group, heads first, then id and hash: (group, doc_id, sha, head,
    stays). A group's heads are known to stay; where it has any, its other members are judged against them only."""

    def run(batches):
        import pyarrow as pa

        at, last, stays, held, heads = None, None, False, None, False
        for b in batches:
            out = []
            for group, i, sha, head, text in zip(*(b.column(c).to_pylist() for c in range(4)), b.column(4), strict=True):
                if group != at:
                    at, last, held, heads = group, None, FirstCome(similarity), bool(head)
                if (i, sha) != last:  # a repeated row is no copy of itself
                    last, x = (i, sha), shingle_hashes((text.as_py() or "").encode(), k)
                    if head:
                        held.add(x)
                    stays = bool(head) or not (held.like(x) if heads else held.copy(x))
                out.append(stays)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(4)), pa.array(out, pa.bool_())], ["group", "doc_id", "sha", "head", "stays"])

    return run


def judged(own: DataFrame, parts: list, k: int, similarity: float) -> DataFrame:
    """first_come() for rows (group, doc_id, sha, head, text and the columns ``parts``, by which groups are divided)."""
    kind = {f.name: f.dataType.simpleString() for f in own.schema}
    rows = own.withColumn("_g", F.concat_ws(":", "group", *parts))
    dealt = rows.repartition("_g").sortWithinPartitions("_g", F.col("head").desc(), F.col("doc_id").asc_nulls_last(), "sha")
    made = dealt.select(F.col("_g").alias("group"), "doc_id", "sha", "head", "text")
    found = made.mapInArrow(first_come(k, similarity), f"group string, doc_id {kind['doc_id']}, sha string, head boolean, stays boolean")
    return found.withColumn("group", F.substring_index("group", ":", 1).cast(kind["group"]))


def near_copies(df: DataFrame, k: int, similarity: float, probe_k: int, radius: int, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(_copy, _sha): id and text hash of the documents to drop so that one of each group of near copies stays.

    Candidates are the components of two kinds of links together: near fingerprints (shingles of ``probe_k`` words,
    ``radius`` bits) and common bands of minimum hashes (shingles of ``k`` words), which alone find all pairs at the
    similarity but 3 in a million. Of equal texts the smallest id stays. Of a component's other texts, in the order of
    their ids (null last), each goes if the Jaccard similarity of its set of k-word shingles and that of one that stays
    is at least ``similarity``: every member is judged against all that stay, found by shared shingles.

    A component of more than ``block`` members is judged in rounds: about ``block`` of its smallest ids in one task, then
    all others against those that stay of them, dealt over as many tasks as there are blocks; what is like none goes on,
    in blocks of twice the size. A task holds the sets that stay of one block.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.sha2(whole_text(text), 256).alias("sha"))
    ids = written(rows.select("doc_id", "sha"), "near-ids")
    # null ids are last
    some_null = F.bool_or(F.col("doc_id").isNull())
    firsts = ids.groupBy("sha").agg(F.min("doc_id").alias("first"), F.when(~some_null, F.max("doc_id")).alias("last"))
    same = other_copies(ids, firsts)
    # a node is a text: texts whose nodes are equal by chance are candidates only
    nodes = rows.select(node_of("sha").alias("node"), "text")
    found = written(fingerprints(nodes, "node", k=probe_k).distinct(), "probe-fp")
    group = near_components(found, radius, band_links(nodes, k)).select(F.col("doc_id").alias("node"), F.col("component_id").alias("group"))
    sizes = group.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    members = group.join(sizes, "group", "left_semi")
    chosen = written(firsts.withColumn("node", node_of("sha")).join(members, "node").select(F.col("first").alias("doc_id"), "sha", "group"), "near-members")
    key = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["sha"] == b["sha"])
    own = written(rows.join(chosen, key(rows, chosen)).select("group", chosen["doc_id"], chosen["sha"], "text"), "near-texts")
    # null ids are last
    place, last = F.coalesce(F.col("doc_id").cast("double"), F.lit(float("inf"))), F.lit(float("inf"))
    halves = [0.5**i for i in range(1, 31)]
    drop, open_ = [same], own
    while True:
        n = open_.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(place, halves, 10_000).alias("q"))
        half = F.get("q", F.least(F.ceil(F.log2(F.col("n") / block)).cast("int"), F.lit(len(halves))) - 1)
        n = written(n.select("group", "n", F.when(F.col("n") <= block, last).otherwise(half).alias("cut")), "near-sizes")
        large = n.where("n > %d" % block)
        none = large.isEmpty()
        met = open_.join(n, "group")
        first = met.where(place <= F.col("cut")).select("group", "doc_id", "sha", F.lit(False).alias("head"), "text")
        verdict = written(judged(first, [], k, similarity), "near-verdict")
        drop.append(verdict.where("not stays").select("doc_id", "sha"))
        if none:
            break
        rest = met.where((F.col("n") > block) & (place > F.col("cut")))
        times = F.ceil(F.col("n") / block).cast("int")
        some = verdict.where("stays").join(large.select("group", "n"), "group")
        heads = open_.join(some, (open_["group"] == some["group"]) & key(open_, some)).select(some["group"], some["doc_id"], some["sha"], F.lit(True).alias("head"), "text", F.explode(F.sequence(F.lit(0), times - 1)).alias("salt"))
        dealt = rest.select("group", "doc_id", "sha", F.lit(False).alias("head"), "text", F.pmod(F.xxhash64("sha"), times).cast("int").alias("salt"))
        after = written(judged(dealt.union(heads), ["salt"], k, similarity).where("not head"), "near-verdict")
        drop.append(after.where("not stays").select("doc_id", "sha"))
        left = after.where("stays").select("doc_id", "sha").distinct()
        open_ = written(open_.join(left, key(open_, left), "left_semi"), "near-texts")
        block *= 2
    found = drop[0]
    for more in drop[1:]:
        found = found.union(more)
    return found.distinct().select(F.col("doc_id").alias("_copy"), F.col("sha").alias("_sha"))


def other_copies(ids: DataFrame, firsts: DataFrame) -> DataFrame:
    """(doc_id, sha) of rows whose text's first id is another: a text of many copies is dealt over SALTS tasks, where a
    text with one id has no row to meet."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    many = firsts.where(~F.col("first").eqNullSafe(F.col("last"))).select("sha", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    met = ids.withColumn("salt", salt).join(many, ["sha", "salt"])
    return met.where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "sha")


def node_of(sha: str):
    return F.xxhash64(sha)


def op9_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = written(fingerprints(documents(spark, sf_dir)), "fp")
    return near_components(found).select("doc_id", as_hex("fp").alias("fingerprint"), "component_id")
