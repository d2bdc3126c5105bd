"""Document fingerprints (7), DataFrame functions only.

SimHash: the hashes of a text's terms (shingles of ``k`` words) vote, each as often as it stands, on 64 signed bits.
``edited_fingerprints`` also fingerprints each text with its second half replaced by the beginning of the next one.
``near_search`` finds all fingerprints within a radius by permuted block tables (Manku et al., 2007): the 64 bits are cut
into blocks; for every choice of blocks that radius differing bits can't all spoil there is a table with those blocks in
front, and equal fronts meet in an equi-join that checks the whole distance.

The next document needs an order of all ids. Ids are dealt to ranges by splitters from an approximate quantile sketch
over all of them (at most ``MOST_RANGES``, found by a binary search over a literal), so texts move once, by range, and
each range is ordered on its own (all null ids, or all rows of one id, are in one); the first document of a range also goes to the range before as a guest. What is
broadcast has one row for each range.

Null or empty text: no terms, all bits 0. Equal ids follow each other in order of text; null ids come last. A single
document follows itself. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import documents, whole_text, words, written
from clauseloom.llm.simhash import as_hex, distance, fingerprint, votes

SHINGLE = 2
RADIUS = 3
BLOCKS, FREE = 6, 3
#: Documents in a range, while there are no more than MOST_RANGES; then ranges grow: what is broadcast has a row for each.
RANGE_ROWS, MOST_RANGES = 1000, 1 << 17
SEARCH_EVERY = 50


def text_fingerprints(df: DataFrame, keys: list[str], text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(keys, fp); the keys must tell the rows apart."""
    rows = df.select(*keys, words(whole_text(text)).alias("_w"))
    return votes(rows, keys, "_w", k).select(*keys, fingerprint().alias("fp"))


def _range_of(value: Column, cuts: list) -> Column:
    """Number of cuts at or below the value, by binary search."""
    if not cuts:
        return F.lit(0)
    # one literal once folded, however many cuts there are
    edges, steps = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>"), [1 << i for i in reversed(range(len(cuts).bit_length()))]
    found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda lo, s: F.when(F.coalesce(F.get(edges, lo + s - 1) <= value, F.lit(False)), lo + s).otherwise(lo))
    return F.when(value.isNull(), len(cuts)).otherwise(found)


def with_next(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_uid, doc_id, _t, _next, guest, range, place): each document beside the next one; guests are to be left out later."""
    ids = df.select(F.col(doc_id).alias("doc_id"))
    n = ids.count()
    parts = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    share = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("doc_id", share, 10 * parts)).first()[0] if share and n else []
    cuts = sorted(set(found or []))
    firsts = ids.groupBy(_range_of(F.col("doc_id"), cuts).alias("_r")).agg(F.min("doc_id").alias("_first"), F.count("doc_id").alias("_c"))
    # at most one row for each range: the range before it that has rows, the last one before the first
    order = Window.orderBy("_r")
    firsts = firsts.withColumn("_before", F.coalesce(F.lag("_r").over(order), F.max("_r").over(Window.partitionBy())))
    before = F.broadcast(written(firsts.select("_r", "_first", "_c", "_before"), "id-ranges"))
    rows = df.select(F.monotonically_increasing_id().alias("_uid"), F.col(doc_id).alias("doc_id"), whole_text(text).alias("_t")).withColumn("_r", _range_of(F.col("doc_id"), cuts))
    met = rows.join(before, "_r")
    is_first = F.col("doc_id").eqNullSafe(F.col("_first"))
    places = F.concat(F.array(F.struct(F.col("_r").alias("range"), F.lit(False).alias("guest"))), F.when(is_first, F.array(F.struct(F.col("_before").alias("range"), F.lit(True).alias("guest")))).otherwise(F.array().cast("array<struct<range:int,guest:boolean>>")))
    placed = met.select("_uid", "doc_id", "_t", F.inline(places)).repartition("range")
    following = Window.partitionBy("range").orderBy("guest", F.col("doc_id").asc_nulls_last(), "_t")
    return placed.withColumn("_next", F.lead("_t").over(following)).withColumn("place", F.row_number().over(following))


def edited(text: Column, following: Column) -> Column:
    """The last half (floor) of the code points replaced by the first as many, or all, of the following text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def edited_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp), one row for each of df's."""
    pairs = with_next(df, doc_id, text).select("_uid", "doc_id", "range", "place", "guest", "_t", edited(F.col("_t"), F.coalesce("_next", F.lit(""))).alias("_e"))
    sides = pairs.select("range", "place", "_uid", "guest", "doc_id", F.length("_t").cast("long").alias("n_chars"), F.sha2("_e", 256).alias("edited_sha256"), F.inline(F.array(F.struct(F.lit(0).alias("side"), F.col("_t").alias("_s")), F.struct(F.lit(1).alias("side"), F.col("_e").alias("_s")))))
    keys = ["range", "place", "_uid", "guest", "doc_id", "n_chars", "edited_sha256", "side"]
    found = text_fingerprints(sides, keys, "_s", k)
    both = found.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("side") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("side") == 1, F.col("fp"))).alias("edited_fp"))
    following = Window.partitionBy("range").orderBy("place")
    return both.withColumn("next_fp", F.lead("fp").over(following)).where("not guest").select("doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp")


# -- permuted block tables -------------------------------------------------------------------------------------------


def _front_masks(blocks: int, free: int) -> list[int]:
    """Masks of the blocks in front, one for each table."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) & ~((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(own) for own in combinations(parts, blocks - free)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _fronts(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).alias("table"), fp.bitwiseAND(F.lit(m).cast("long")).alias("front")) for i, m in enumerate(masks))))


def near_search(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance): for every distinct query (column fp) all distinct corpus fingerprints within the radius.

    radius blocks at most are spoiled, so some choice of the other blocks - radius is equal in both.
    """
    masks = _front_masks(blocks, radius)
    probe = queries.select("fp").distinct().select(F.col("fp").alias("query"), _fronts(F.col("fp"), masks).alias("f")).select("query", "f.*")
    table = corpus.select("fp").distinct().select("fp", _fronts(F.col("fp"), masks).alias("f")).select("fp", "f.*")
    near = probe.join(table.hint("merge"), (probe["table"] == table["table"]) & (probe["front"] == table["front"]) & (distance(F.col("query"), F.col("fp")) <= radius))
    return near.select("query", "fp").distinct().withColumn("distance", distance(F.col("query"), F.col("fp")))


def likeness(a: str, b: str) -> Column:
    """1 for equal fingerprints, about 0.5 for unrelated ones, 0 for opposite ones."""
    return 1 - distance(F.col(a), F.col(b)) / F.lit(64.0)


def near_counts(found: DataFrame, radius: int = RADIUS, every: int = SEARCH_EVERY) -> DataFrame:
    """found and n_near: rows whose fp is within the radius, itself included, for each row whose id is divisible by ``every``.

    Only those rows are joined, and to counts that are written before, so that rows of one fingerprint may be dealt over tasks.
    """
    asked = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    sizes = found.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    hits = near_search(found.where(asked), found, radius).join(sizes.hint("merge"), "fp").groupBy("query").agg(F.sum("n").alias("n_near"))
    hits = written(hits, "near-counts")
    counted = found.where(asked).join(hits.hint("merge"), found["fp"] == hits["query"], "left").select(*found.columns, "n_near")
    return counted.union(found.where(~asked).withColumn("n_near", F.lit(None).cast("long")))


def op7_doc_fingerprints(spark, sf_dir: str) -> DataFrame:
    found = written(edited_fingerprints(documents(spark, sf_dir)), "fingerprints")
    return near_counts(found).select(
        "doc_id", "n_chars", "edited_sha256", as_hex("fp").alias("fingerprint"), as_hex("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "n_near",
    )
