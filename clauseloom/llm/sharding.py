"""Sharding by sampled splitters (6).

Records are ordered by a key that puts equal texts side by side (high bits: the text's hash, low bits: the id's hash, so
that a hot group of equal texts can still be divided). Then

1. a size-weighted sample of keys is drawn by a hash, about ``SAMPLE`` of them whatever the size of the table,
2. its weighted quantiles split the keys into ``RANGES`` ranges,
3. the exact bytes of every range are summed; a range of more than twice its share is subdivided at quantiles of a
   sample of its own, again and again while its keys can be told apart,
4. a range that lies within one shard goes there whole; records of a range over which a shard boundary falls are placed
   by their exact running sum. Shards differ by about one record's size.

Only the samples and one number for each range reach the driver; both are bounded by parameters, not by the table.
Ordering happens within ranges, so no task sees more than a small part of a shard.

Sizes: UTF-8 bytes of the text plus 8. Null text: no bytes. Null ids are hashed like a value of their own. Rows of equal
id and text are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import documents, whole_text, written

SHARDS = 24
SAMPLE = 24_000
RANGES = 768
_LOW = (1 << 22) - 1


def shard_records(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, text_crc32, key) and the columns in ``keep``."""
    t = whole_text(text)
    high = F.xxhash64(t).bitwiseAND(~_LOW)
    low = F.xxhash64(F.lit(7), F.col(doc_id)).bitwiseAND(_LOW)
    return df.select(F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 8).cast("long").alias("size"), F.crc32(F.encode(t, "UTF-8")).alias("text_crc32"), high.bitwiseOR(low).alias("key"), *keep)


def _sampled(records: DataFrame, total: int, wanted: int) -> list[tuple[int, float]]:
    """About ``wanted`` keys with weights: a record is drawn with the chance size * wanted / total, at most 1."""
    chance = F.col("size") * (wanted / total)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(11), "key", "doc_id"), 11) / float(1 << 53)
    weight = F.when(chance >= 1, F.col("size").cast("double")).otherwise(F.lit(total / wanted))
    drawn = records.where(u < chance).select("key", weight.alias("w"))
    return sorted((r.key, r.w) for r in drawn.groupBy("key").agg(F.sum("w").alias("w")).collect())


def _quantiles(sample: list[tuple[int, float]], parts: int) -> list[int]:
    """Up to parts - 1 ascending keys that split the sample's weight evenly; a range holds keys up to its splitter."""
    total, at, run, cuts = sum(w for _, w in sample), 1, 0.0, []
    for key, w in sample:
        run += w
        if run >= total * at / parts and at < parts:
            cuts.append(key)
            at = int(run * parts / total) + 1
    return cuts


def _ranged(records: DataFrame, cuts: list[int]) -> DataFrame:
    """records with ``part``: the number of splitters below the key."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        edges = np.array(cuts, dtype=np.int64)
        for b in batches:
            keys = b.column(b.schema.get_field_index("key")).to_numpy(zero_copy_only=False)
            part = np.searchsorted(edges, keys, side="left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part)], [*b.schema.names, "part"])

    return records.mapInArrow(run, records.withColumn("part", F.lit(0)).schema)


def splitters(records: DataFrame, sample: int = SAMPLE, ranges: int = RANGES) -> tuple[list[int], list[tuple[int, int]]]:
    """Ascending splitters and, for each range, its exact (bytes, rows)."""
    total = records.agg(F.sum("size")).first()[0]
    if not total:
        return [], []
    cuts = sorted(set(_quantiles(_sampled(records, total, sample), ranges)))
    while True:
        found = {r.part: r for r in _ranged(records, cuts).groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), F.min("key").alias("low"), F.max("key").alias("high")).collect()}
        # fewer than ranges / 2 of them can have more than twice a range's share
        over = [r for r in found.values() if r.bytes > 2 * total / ranges and r.low < r.high]
        if not over:
            break
        mine = reduce(lambda x, y: x | y, [F.col("key").between(r.low, r.high) for r in over])
        inside = _sampled(records.where(mine), sum(r.bytes for r in over), sample)
        more: set[int] = set()
        for r in over:
            own = [(k, w) for k, w in inside if r.low <= k < r.high]
            # without a key of its own in the sample, a range is cut in the middle
            more |= set(_quantiles(own, 1 + int(2 * r.bytes * ranges / total))) or {own[-1][0] if own else (r.low + r.high) // 2}
        cuts = sorted({*cuts, *more})
    return cuts, [(found[p].bytes, found[p].rows) if p in found else (0, 0) for p in range(len(cuts) + 1)]


def shard(records: DataFrame, shards: int = SHARDS) -> DataFrame:
    """records with ``shard`` and ``slot`` (gapless from 0 in each shard, in key order). Give a table that is cheap to read."""
    cuts, ranges = splitters(records)
    if not ranges:
        return records.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long"))
    total = sum(b for b, _ in ranges)
    starts, b, n = [], 0, 0
    for size, rows in ranges:
        starts.append((b, n))
        b, n = b + size, n + rows
    order = Window.partitionBy("part").orderBy("key", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = lambda i: F.get(F.array(*(F.lit(s[i]).cast("long") for s in starts)), F.col("part"))
    middle = first(0) + before + F.col("size") / 2
    ranked = _ranged(records, cuts).select("*", middle.alias("_at"), (first(1) + F.row_number().over(order) - 1).alias("_rank"))
    placed = ranked.withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("_at") * shards / total)).cast("int"))
    # a shard's first rank: of the range that holds its boundary, or of the first range after it
    crossed = [p for p, (at, _) in enumerate(starts) if int(at * shards / total) != int((at + ranges[p][0]) * shards / total) or p == 0]
    firsts = {r.shard: r.rank for r in placed.where(F.col("part").isin(sorted({*crossed, *(p + 1 for p in crossed)}))).groupBy("shard").agg(F.min("_rank").alias("rank")).collect()}
    base = F.get(F.array(*(F.lit(firsts.get(s, 0)).cast("long") for s in range(shards))), F.col("shard"))
    return placed.select(*records.columns, "shard", (F.col("_rank") - base).cast("long").alias("slot"))


def write_shards(df: DataFrame, placed: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes df's rows as Parquet folders shard=0.. under path, each in slot order.

    A row meets its place by its id, key, size and checksum, and by number among rows that are equal in these: each row is
    written once, also where ids are null or repeated.
    """
    keys = ["doc_id", "key", "size", "text_crc32"]
    number = F.row_number().over(Window.partitionBy(*(f"_{k}" for k in keys)).orderBy("_o"))
    own = shard_records(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.struct(*df.columns).alias("_row")), keep=("_row",))
    rows = own.select("_row", *(F.col(k).alias(f"_{k}") for k in keys), F.lit(0).alias("_o")).withColumn("_n", number).drop("_o")
    spots = placed.select("shard", "slot", *(F.col(k).alias(f"_{k}") for k in keys), F.col("slot").alias("_o")).withColumn("_n", number).drop("_o")
    both = rows.alias("r").join(spots.alias("s"), reduce(lambda x, y: x & y, [F.col(f"r._{k}").eqNullSafe(F.col(f"s._{k}")) for k in (*keys, "n")]))
    made = both.select(*(F.col(f"r._row.{c}").alias(c) for c in df.columns if c != "shard"), F.col("s.shard").alias("shard"), F.col("s.slot").alias("_slot"))
    made.repartition("shard", F.floor(F.col("_slot") / 100_000)).sortWithinPartitions("shard", "_slot").drop("_slot").write.partitionBy("shard").parquet(path)


def op6_shard_splitters(spark, sf_dir: str) -> DataFrame:
    records = written(shard_records(documents(spark, sf_dir)), "shard-records")
    placed = shard(records)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
