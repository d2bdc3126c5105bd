"""Removal of repeated passages by depth-limited radix passes over suffixes (5).

A byte goes if a ``depth``-byte string that covers it starts in another place too, of any document. Suffixes are
grouped by ever longer stretches of their first ``depth`` tokens, a digit for each pass, and a suffix that is alone in
its group is left out of all later passes; suffixes that are still together at ``depth`` are the repeats. The same passes
run over two kinds of tokens: bytes, by which text is removed, and words, by which passages of over 50 words are counted.

A digit isn't the next bytes of a suffix, as it would be in memory: one row for each suffix and pass would be written,
some 27 GB for a GB of input. Suffixes travel in bundles instead. In every window of ``depth`` tokens the least hash of
the ``gram``-token strings marks an anchor; equal windows have equal anchors, and the windows of one anchor start side by
side. The digits are

1. the anchor's own gram (one row for each anchor, about one in 150 bytes or 20 words),
2. bundles of up to ``bundle`` window starts with the same anchor: the tokens common to all the bundle's windows. A bundle
   whose common tokens are found nowhere else can't hold a repeat; one whose whole stretch is found again, window for
   window, is repeated as a whole,
3. the single windows of the bundles that are left, which stand at the edges of repeated passages.

Groups are only ever counted, by partial aggregation, and joined to again; none is gathered. Equal texts are
represented by one of them and counted. What decides a removal is XXH3 with 128 bits of the window's own bytes.

Null or empty text: 0 bytes, nothing removed, the hash of the empty string. Repeated rows count as equal texts. Null
ids are allowed. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import BLANK_RUN, BLANKS, documents, whole_text, written

DEPTH = 400
GRAM = 100
BUNDLE = 64
SEGMENT = 1 << 20


class Unit(NamedTuple):
    """How windows of one kind of token are taken: tokens in a window, in an anchor, and window starts in a bundle."""

    depth: int
    gram: int
    bundle: int


#: Passages of over 50 words.
WORDS = Unit(51, 8, 12)
_POSITION = (1 << 24) - 1
#: Of a packed place: the unit's bit and the window starts of a bundle, below the first start.
_COUNT_BITS = 16
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _mixed(h):
    """In place."""
    import numpy as np

    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _doubled(tokens, seed: int, length: int):
    """Hashes of the ``length`` tokens (a power of 2) from each place, by doubling."""
    import numpy as np

    odd = np.uint64(2 * seed + 0x9E3779B97F4A7C15)
    if tokens.dtype == np.uint8:
        h = _mixed(np.arange(1, 257, dtype=np.uint64) * odd)[tokens]
    else:
        h = _mixed(tokens * odd)
    step = 1
    while step < length:
        if len(h) <= step:
            return h[:0]
        h = _mixed(h[:-step] * np.uint64(0x9FB21C651E98DF25) + h[step:])
        step *= 2
    return h


def word_tokens(text: bytes):
    """A hash of each word of a text, whatever stands between the words."""
    import numpy as np

    ends = [0]  # of parts of bounded size that end at a blank
    while len(text) - ends[-1] > 2 * SEGMENT and (m := _BLANK.search(text, ends[-1] + SEGMENT)):
        ends.append(m.end())
    return np.concatenate([_word_tokens(text[a:b]) for a, b in zip(ends, [*ends[1:], len(text)], strict=True)])


def _word_tokens(text: bytes):
    import numpy as np

    x = np.frombuffer(text, dtype=np.uint8)
    full = ~((x == 32) | ((x >= 9) & (x <= 13)))
    inner = np.flatnonzero(full)
    if not len(inner):
        return np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(np.r_[True, np.diff(inner) > 1])
    size = np.diff(np.r_[first, len(inner)])
    place = (np.arange(len(inner)) - np.repeat(first, size)) & 4095
    code = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    power = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, dtype=np.uint64))
    return _mixed(np.add.reduceat(code[x[inner]] * power[place], first) + size.astype(np.uint64))


def digests(tokens, start, end):
    """128 bits (two columns) of the tokens from each start to its end, by XXH3."""
    import numpy as np
    from xxhash import xxh3_128_digest

    view, w = memoryview(np.ascontiguousarray(tokens)).cast("B"), tokens.itemsize
    found = [xxh3_128_digest(view[a:b]) for a, b in zip((start * w).tolist(), (end * w).tolist(), strict=True)]
    return np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)


def _spread(h, length: int, at, size):
    """Hashes of the ``size`` bytes from ``at``, for length <= size <= 2 * length, from hashes of ``length`` bytes."""
    import numpy as np

    return _mixed(h[at] * np.uint64(0xA0761D6478BD642F) + h[at + size - length] + np.asarray(size).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def _pow2(n: int) -> int:
    return 1 << (n.bit_length() - 1)


def anchors(raw, starts, depth: int = DEPTH, gram: int = GRAM):
    """Anchors of all windows of one buffer. starts: valid window starts, ascending.

    Gives (first, last, place, gram hash): windows first..last have their anchor at place.
    """
    import numpy as np

    width = depth - gram + 1
    half = _pow2(gram)
    h = _doubled(raw, 1, half)
    at = np.arange(len(raw) - gram + 1)
    g = _spread(h, half, at, gram)
    low = (g & ~np.uint64(_POSITION)) | at.astype(np.uint64)
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    place = (np.minimum(low[starts], low[starts + width - step]) & np.uint64(_POSITION)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
    last = np.r_[new[1:], len(place)] - 1
    return starts[new], starts[last], place[new], g[place[new]]


def segments(texts: list, depth: int = DEPTH):
    """Buffers of bounded size that hold every window of the texts (arrays of tokens) once: (tokens, starts, text of each
    start, offset of the text in them)."""
    import numpy as np

    group, size = [], 0

    def made():
        raw = np.concatenate([t[a : b + depth - 1] for _, t, a, b in group])
        at, starts, owner, offset = 0, [], [], []
        for i, t, a, b in group:
            starts.append(np.arange(at, at + b - a))
            owner.append(np.full(b - a, i))
            offset.append(np.full(b - a, a - at))
            at += len(t[a : b + depth - 1])
        return raw, np.concatenate(starts), np.concatenate(owner), np.concatenate(offset)

    for i, t in enumerate(texts):
        for a in range(0, max(0, len(t) - depth + 1), SEGMENT):
            b = min(a + SEGMENT, len(t) - depth + 1)
            group.append((i, t, a, b))
            size += b - a + depth
            if size >= SEGMENT:
                yield made()
                group, size = [], 0
    if group:
        yield made()


def _tokens(column, unit: int) -> list:
    import numpy as np

    texts = [b or b"" for b in column.to_pylist()]
    return [word_tokens(t) if unit else np.frombuffer(t, dtype=np.uint8) for t in texts]


def _batches(batches, most: int = 4 << 20):
    """Record batches cut so that one holds a few MB of the last column."""
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.binary_length(b.column(b.num_columns - 1)).to_pylist()
        start = held = 0
        for i, x in enumerate(sizes):
            held += x or 0
            if held >= most:
                yield b.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < b.num_rows:
            yield b.slice(start)


def emit_grams(units: list[Unit]):
    """From (k1, text): (gram, k1, n) for each anchor gram of each text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in _batches(batches):
            k1 = b.column(0).to_numpy(zero_copy_only=False)
            for unit, (depth, gram, _) in enumerate(units):
                for raw, starts, owner, _ in segments(_tokens(b.column(1), unit), depth):
                    first, _, _, g = anchors(raw, starts, depth, gram)
                    own = owner[np.searchsorted(starts, first)]
                    found, n = np.unique(np.stack([own.astype(np.uint64), g]), axis=1, return_counts=True)
                    own = found[0].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(found[1].view(np.int64)), pa.array(k1[own]), pa.array(n.astype(np.int64))], ["gram", "k1", "n"])

    return run


def emit_bundles(units: list[Unit]):
    """From (k1, k2, n, grams, text): a row for each bundle of windows whose anchor is among the grams."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in _batches(batches):
            k = [b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)]
            known = np.unique(np.asarray(b.column(3).flatten())).astype(np.int64).view(np.uint64)
            for unit, (depth, gram, bundle) in enumerate(units):
                core = depth - bundle + 1
                for raw, starts, owner, offset in segments(_tokens(b.column(4), unit), depth):
                    first, last, place, g = anchors(raw, starts, depth, gram)
                    keep = np.isin(g, known)
                    first, last, place = first[keep], last[keep], place[keep]
                    if not len(first):
                        continue
                    near, far = (place - last) // bundle, (place - first) // bundle
                    times = far - near + 1
                    row = np.repeat(np.arange(len(first)), times)
                    j = near[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                    low = np.maximum(j * bundle, place[row] - last[row])
                    high = np.minimum(j * bundle + bundle - 1, place[row] - first[row])
                    start, count = place[row] - high, high - low + 1
                    half = _pow2(core)
                    kind = (j * 4096 * 4096 + low * 4096 + high).astype(np.uint64)
                    # the tokens that all windows of the bundle hold, clipped or not
                    common = _mixed(_spread(_doubled(raw, 2, half), half, place[row] - j * bundle, core) + j.astype(np.uint64))
                    whole = digests(raw, start, start + depth + count - 1) + (kind * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)[:, None]
                    at = np.searchsorted(starts, start)
                    own = owner[at]
                    place_ = ((start + offset[at]) << _COUNT_BITS) | (count << 1) | unit
                    columns = [common.view(np.int64), whole[:, 0], whole[:, 1], k[0][own], k[1][own], place_, k[2][own]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["core", "s1", "s2", "k1", "k2", "place", "n"])

    return run


def emit_windows(units: list[Unit]):
    """From (k1, k2, bundles, text): (w1, w2, k1, k2, unit, start, n) for each window of the bundles."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in _batches(batches):
            for k1, k2, bundles, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for unit, (depth, _, _) in enumerate(units):
                    rows = sorted((x["start"], x["count"], x["n"]) for x in bundles if x["unit"] == unit)
                    raw = (word_tokens(t) if unit else np.frombuffer(t, dtype=np.uint8)) if rows else None
                    for s in range(0, len(rows), 4096):
                        part = rows[s : s + 4096]
                        counts = np.array([x[1] for x in part])
                        at = np.repeat(np.array([x[0] for x in part]), counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                        w = digests(raw, at, at + depth)
                        n = np.repeat(np.array([x[2] for x in part]), counts)
                        columns = [w[:, 0], w[:, 1], np.full(len(at), k1), np.full(len(at), k2), np.full(len(at), unit), at, n]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["w1", "w2", "k1", "k2", "unit", "start", "n"])

    return run


def joined(spans: list, depth: int) -> list[list[int]]:
    """Runs (start, end) of tokens that the windows cover."""
    runs: list[list[int]] = []
    for a, e in sorted((x["start"], x["start"] + x["count"] - 1 + depth) for x in spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([a, e])
    return runs


def cut_out(depth: int, words: int):
    """From (k1, k2, spans of window starts, text): what is left of the text, and how many of its words repeat."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in _batches(batches):
            out = []
            for k1, k2, spans, t in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                runs = joined([x for x in spans if not x["unit"]], depth)
                left = b"".join(t[x:y] for x, y in zip([0, *(e for _, e in runs)], [*(a for a, _ in runs), len(t)], strict=True))
                many = sum(e - a for a, e in joined([x for x in spans if x["unit"]], words))
                out.append((k1, k2, len(t) - len(left), len(runs), many, hashlib.sha256(left).hexdigest(), [{"start": a, "end": e} for a, e in runs]))
            names = ["k1", "k2", "n_removed", "n_spans", "n_repeat_words", "kept_sha256", "spans"]
            types = [*[pa.int64()] * 5, pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], types[i]) for i in range(7)], names)

    return run


def repeated_passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = DEPTH, gram: int = GRAM, bundle: int = BUNDLE, words: Unit = WORDS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, n_repeat_words): spans are the removed runs in bytes, end
    exclusive; n_repeat_words are the words that passages of ``words.depth`` words cover which start elsewhere too."""
    units = [Unit(depth, gram, bundle), words]
    for u in units:
        if not (0 < u.gram and u.gram + u.bundle < u.depth and u.gram < 2 * _pow2(u.gram)):
            raise ValueError("gram, bundle and depth don't fit together")
    t = whole_text(text)
    keys = [F.xxhash64(t).alias("k1"), F.xxhash64(F.lit(13), t, F.lit(17)).alias("k2")]
    n_words = F.when(F.btrim(t, F.lit(BLANKS)) == "", 0).otherwise(F.size(F.split(F.btrim(t, F.lit(BLANKS)), BLANK_RUN))).cast("long")
    rows = df.select(F.col(doc_id).alias("doc_id"), *keys, F.octet_length(t).cast("long").alias("n_bytes"), n_words.alias("n_words"), F.sha2(t, 256).alias("whole"))
    # a shorter text holds no window of either kind
    least = min(depth, 2 * words.depth - 1)
    texts = df.select(*keys, F.encode(t, "UTF-8").alias("raw"), F.col(doc_id).alias("doc_id")).where(F.length("raw") >= least)
    k = ["k1", "k2"]
    copies = written(rows.groupBy(*k).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first")), "passages-texts")

    # pass 1
    # 64 bits name a text here: two texts of one name would only look at each other's grams as well
    grams = written(texts.select("k1", "raw").mapInArrow(emit_grams(units), "gram long, k1 long, n long"), "passages-grams")
    shared = grams.groupBy("gram").agg(F.sum("n").alias("t")).where("t > 1").select("gram")
    named = grams.join(shared, "gram", "left_semi").groupBy("k1").agg(F.collect_set("gram").alias("grams"))
    named = named.join(copies, "k1").withColumnRenamed("first", "doc_id")
    cases = texts.join(named, [*(texts[c] == named[c] for c in k), texts["doc_id"].eqNullSafe(named["doc_id"])])
    cases = written(cases.select(named["k1"], named["k2"], F.col("copies").alias("n"), "grams", "raw"), "passages-cases")

    # pass 2
    bundles = written(cases.mapInArrow(emit_bundles(units), "core long, s1 long, s2 long, k1 long, k2 long, place long, n long"), "passages-bundles")
    place = F.struct("k1", "k2", "place")
    spread = lambda c: F.struct(c.bitwiseAND(1).alias("unit"), F.shiftright(c, _COUNT_BITS).alias("start"), F.shiftright(c.bitwiseAND((1 << _COUNT_BITS) - 1), 1).alias("count"))
    classes = written(bundles.groupBy("core", "s1", "s2").agg(F.sum("n").alias("n"), F.min(place).alias("p")), "passages-classes")
    mixed = classes.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("core")
    whole = classes.where("n > 1").select("s1", "s2")
    repeated = bundles.select("s1", "s2", *k, "place").join(whole, ["s1", "s2"], "left_semi").select(*k, "place")

    # pass 3
    open_ = classes.join(mixed, "core", "left_semi").select("p.*", "n")
    open_ = open_.select(*k, "n", spread(F.col("place")).alias("_s")).select(*k, "_s.*", "n")
    open_ = open_.groupBy(*k).agg(F.collect_list(F.struct("unit", "start", "count", "n")).alias("bundles"))
    windows = written(open_.join(cases.select(*k, "raw"), k).select(*k, "bundles", "raw").mapInArrow(emit_windows(units), "w1 long, w2 long, k1 long, k2 long, unit long, start long, n long"), "passages-windows")
    again = windows.groupBy("w1", "w2").agg(F.sum("n").alias("t")).where("t > 1").select("w1", "w2")
    single = windows.where("n = 1").join(again, ["w1", "w2"], "left_semi").select(*k, (F.shiftleft("start", _COUNT_BITS) + F.lit(2) + F.col("unit")).alias("place"))

    # texts that stand once lose their repeated windows; those that stand twice or more lose everything
    spans = repeated.union(single).join(copies.where("copies = 1").select(*k), k, "left_semi")
    spans = spans.groupBy(*k).agg(F.collect_list("place").alias("spans")).withColumn("spans", F.transform("spans", spread))
    kinds = "array<struct<start:long,end:long>>"
    left = spans.join(cases.select(*k, "raw"), k).select(*k, "spans", "raw").mapInArrow(cut_out(depth, words.depth), f"k1 long, k2 long, n_removed long, n_spans long, n_repeat_words long, kept_sha256 string, spans {kinds}")
    none = F.lit(None)
    known = copies.where("copies > 1").select(*k, F.lit(True).alias("all"), *(none.cast("long").alias(c) for c in ("n_removed", "n_spans", "n_repeat_words")), none.cast("string").alias("kept_sha256"), none.cast(kinds).alias("spans"))
    known = known.union(left.select(*k, F.lit(False), "n_removed", "n_spans", "n_repeat_words", "kept_sha256", "spans"))
    out = rows.join(known, k, "left")
    all_ = F.coalesce("all", F.lit(False))
    gone = all_ & (F.col("n_bytes") >= depth)
    one = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(gone, one).otherwise(F.coalesce("spans", F.array().cast(kinds))).alias("spans"),
        F.when(all_ & (F.col("n_words") >= words.depth), F.col("n_words")).otherwise(F.coalesce("n_repeat_words", F.lit(0))).alias("n_repeat_words"),
    )


def op5_repeated_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_repeat_words")
