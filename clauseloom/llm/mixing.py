"""Mixing sources to target weights (1), DataFrame functions only.

Efraimidis-Spirakis sampling: a document's key is -ln(u) / quality with u from a hash of its id, so sorting by the key
is a weighted draw without replacement. Within a source, documents in key order are prefix-summed to the source's word
target. Complete epochs come first: a source whose target is above its size gives every document once, and only the
rest of the target is drawn. The document on which a target falls is taken in part, so that targets are met to a word.

Targets: sources by code point, null last, have the weights in turn and share ``share`` times all sizes; a target
stops at ``most`` times its source's size and the excess goes to the others by weight. In order of size by weight the
stopped sources are a prefix, so two running sums over the sources give the targets.

A source may hold most rows: its keys are never sorted. Sizes are summed by key octave steps (a histogram of at most
some hundred rows a source), the step on which the target falls is summed again in ``FINE`` equal parts, and only the
documents of one part are ordered. Documents meet the small result of each step in an equi-join, which Spark broadcasts
if its measured size allows and splits where skewed if not. The number of sources is taken to be moderate: one row for
each is ordered in one task.

Null text: size 0. Null ids draw like any id. Rows of equal id and size share a key; which of them is taken is then
the same to any reader. A source of size 0 has target 0. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import documents, whole_text, words, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
STEPS, FINE = 16, 4096
LEAST_QUALITY = 0.05


def text_quality(text: Column) -> Column:
    """Quality weight in (0, 1]: the share of characters other than digits and symbols, squared."""
    odd = F.length(F.regexp_replace(text, r"[\p{L}\p{M}\x20\x09-\x0D.,;:!?'\"()-]+", ""))
    plain = 1 - odd / F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(LEAST_QUALITY), plain * plain)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row a source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.get(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(by_name) - 1) % len(weights))
    named = sizes.withColumn("weight", turn)
    cap = F.col("source_size") * F.lit(float(most))
    order = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levelled = named.withColumn("level", level).withColumn("stopped", F.col("level") * F.col("weight") >= cap)
    # the first source that isn't stopped has the level of all that follow
    common = F.min(F.when(~F.col("stopped"), F.struct(cap / F.col("weight"), F.col("level")))).over(everything)["level"]
    target = F.when(F.col("stopped"), cap).otherwise(F.least(cap, common * F.col("weight")))
    return levelled.select("source", "source_size", target.alias("target"))


def _first_over(sums: DataFrame, keys: list[str], at: str, room: Column) -> DataFrame:
    """For each group of ``keys`` the first ``at`` at which the running sum of ``n`` exceeds the room, and the sum before it."""
    order = Window.partitionBy(*keys).orderBy(at)
    run = sums.withColumn("_over", F.sum("n").over(order)).where(F.col("_over") > room)
    return run.groupBy(*keys).agg(F.min(F.struct(F.col(at), (F.col("_over") - F.col("n")).alias("before"))).alias("_m"))


def draw(df: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str | Column = "size", quality: str | Column = "quality", seed: int = 1, **targets) -> DataFrame:
    """One row for each of df's: doc_id, source, size, source_size, target, epochs (whole copies), part (words of one more, partial, copy), taken.

    df is read several times; give a table that is cheap to read.
    """
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (F.col(size) if isinstance(size, str) else size).cast("long").alias("size"), (-F.log(u) / (F.col(quality) if isinstance(quality, str) else quality)).alias("_key"))
    rows = rows.withColumn("_step", F.floor(F.log2("_key") * STEPS))
    sums = written(rows.groupBy("source", "_step").agg(F.sum("size").alias("n"), F.min("_key").alias("low"), F.max("_key").alias("high")), "mix-steps")
    aims = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), **targets)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("epochs", full).withColumn("room", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")))
    aims = written(aims.withColumnRenamed("source", "_source"), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("_source"))
    step = _first_over(sums.join(aims, same), ["source"], "_step", F.col("room"))
    step = step.select("source", F.col("_m._step").alias("_step"), F.col("_m.before").alias("before"))
    bounds = sums.select(F.col("source").alias("_s2"), F.col("_step").alias("_step2"), "low", "high")
    step = step.join(bounds, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_step") == F.col("_step2"))).select(F.col("source").alias("_s3"), F.col("_step").alias("at_step"), "before", "low", "high")
    aims = written(aims.join(step, F.col("_source").eqNullSafe(F.col("_s3")), "left").drop("_s3"), "mix-steps-met")
    met = rows.join(aims, same, "left")
    part = F.least(F.lit(FINE - 1), F.floor((F.col("_key") - F.col("low")) / F.greatest(F.col("high") - F.col("low"), F.lit(1e-300)) * FINE))
    inside = met.where(F.col("_step") == F.col("at_step")).withColumn("_fine", part)
    fine = inside.groupBy("source", "_fine", "room", "before").agg(F.sum("size").alias("n"))
    fine = _first_over(fine, ["source"], "_fine", F.col("room") - F.col("before")).select(F.col("source").alias("_s4"), F.col("_m._fine").alias("at_fine"), F.col("_m.before").alias("before_fine"))
    aims = written(aims.join(fine, F.col("_source").eqNullSafe(F.col("_s4")), "left").drop("_s4"), "mix-parts-met")
    met = rows.join(aims, same, "left").withColumn("_fine", F.when(F.col("_step") == F.col("at_step"), part))
    # no step met: the room is at or above all sizes
    whole = F.coalesce((F.col("_step") < F.col("at_step")) | ((F.col("_step") == F.col("at_step")) & (F.col("_fine") < F.col("at_fine"))), F.col("at_step").isNull())
    edge = (F.col("_step") == F.col("at_step")) & (F.col("_fine") == F.col("at_fine"))
    out = ["doc_id", "source", "size", "source_size", "target", "epochs"]
    others = met.where(~F.coalesce(edge, F.lit(False))).select(*out, F.when(whole & (F.col("room") > 0), F.col("size")).otherwise(0).alias("part"))
    order = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("room") - F.col("before") - F.col("before_fine") - F.coalesce(F.sum("size").over(order), F.lit(0))
    edged = met.where(edge).select(*out, F.greatest(F.lit(0), F.least(F.col("size"), left)).alias("part"))
    taken = F.col("epochs") * F.col("size") + F.col("part")
    return others.union(edged).withColumn("taken", taken)


def word_sizes(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    t = whole_text(text)
    return df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.size(words(t)).cast("long").alias("size"), text_quality(t).alias("quality"))


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    sizes = written(word_sizes(documents(spark, sf_dir)), "mix-sizes")
    return draw(sizes).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), F.col("epochs").cast("long").alias("epochs"), F.col("part").cast("long").alias("part"))
