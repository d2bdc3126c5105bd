"""Ordered repairs of clauses (doc_id, id, heading, text), with a log of what each changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions import patterns as P
from clauseloom.functions import text as T

SEGMENT_MIN, ITEM_LINE_MIN, CHILD_MAX = 50, 20, 60


def is_junk(text: Column) -> Column:
    """Every line is navigation, or every line is a footer word or rule, or all of at most three lines hold glued words."""

    def judged(lines: Column) -> Column:
        nav = F.forall(lines, lambda x: x.rlike(P.NAV_LINE))
        footer = F.forall(lines, lambda x: x.isin(P.FOOTER_WORDS) | x.startswith("---"))
        glued = (F.size(lines) <= 3) & F.forall(lines, lambda x: x.rlike(P.GLUED_WORD))
        return (F.size(lines) > 0) & (nav | footer | glued)

    # what any such text holds or begins with: the others aren't cut into lines
    start = F.ltrim(text, F.lit(T.SPACES))
    may = F.contains(text, F.lit(" + ")) | text.rlike("[A-Z](?<=[a-z]{2}[A-Z])[a-z]{2}")
    for word in P.FOOTER_WORDS:
        may = may | start.startswith(word)
    return F.when(may, T.bind(F.filter(F.transform(F.split(text, "\n"), lambda x: T.strip(x)), lambda x: x != ""), judged)).when(text.isNotNull(), False)


def without_debris(h: Column) -> Column:
    bare = h
    for pattern, by in ((r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"^[-=]{4,}\s*", ""), (r"\s*[-=]{4,}$", "")):
        bare = F.regexp_replace(bare, pattern, by)
    return T.strip(F.when(h.rlike(r"\*|[-=]{4}"), bare).otherwise(h))


def without_mojibake(c: Column) -> Column:
    """Every replacement in turn, only where one of them, or of blanks, has something to begin at."""
    mended = c
    for bad, good in P.MOJIBAKE_FIXES:
        mended = F.replace(mended, F.lit(bad), F.lit(good))
    return F.when(c.rlike("[âÃ&<]") | T.holds(c, "�", "  "), F.regexp_replace(mended, "  +", " ")).otherwise(c)


def named_label(h: Column, text: Column) -> Column:
    """'g. (part 1/3)' takes its name from the text, 'g. > X' becomes X."""
    s, line = T.strip(h), T.strip(F.substring_index(text, "\n", 1))
    bare, stale = P.BARE_PART, P.STALE_PART
    label = F.concat(F.lit(" (part "), F.regexp_extract(s, bare, 2), F.lit("/"), F.regexp_extract(s, bare, 3), F.lit(")"))
    name = F.when(line.rlike(P.FIRST_NAME), T.strip(F.regexp_extract(line, P.FIRST_NAME, 1))).otherwise(T.first_words(line, 6))
    made, sub = F.concat(name, label), F.regexp_extract(s, stale, 2)
    made = F.when(F.length(made) > P.HEADING_MAX, F.concat(T.first_words(text, 8), label)).otherwise(made)
    sub = F.when(F.length(sub) > P.HEADING_MAX, T.first_words(sub, 8)).otherwise(sub)
    return F.when(s.rlike(bare), made).when(s.rlike(stale), sub).otherwise(h)


def capped(h: Column) -> Column:
    parts = F.split(h, " > ")
    parent, child = F.get(parts, 0), F.get(parts, 1)
    both = F.concat(parent, F.lit(" > "), F.when(F.length(child) > CHILD_MAX, T.first_words(child, 6)).otherwise(child))
    cut = lambda c: F.concat(F.substring(c, 1, 97), F.lit("..."))
    short = F.when(F.size(parts) > 1, F.when(F.length(both) > P.HEADING_MAX, cut(parent)).otherwise(both)).otherwise(cut(h))
    return F.when(F.length(h) > P.HEADING_MAX, short).otherwise(h)


def without_period(h: Column) -> Column:
    s = T.rstrip(h)
    less = T.strip(F.substring(s, F.lit(1), F.length(s) - 1))
    good = ~h.rlike(P.NUMBERED_HEADING) & s.endswith(".") & ~s.endswith("...") & (F.length(less) <= P.HEADING_MAX) & (less != "")
    return F.when(good, less).otherwise(h)


def named_item(h: Column, text: Column) -> Column:
    return F.when(h.rlike(P.GENERIC_HEADING), T.first_words(text, 8)).otherwise(h)


def base_heading(h: Column) -> Column:
    return T.strip(F.rtrim(T.strip(F.regexp_replace(h, P.PART_LABEL, "")), F.lit(">")))


def item_pieces(heading: Column, text: Column) -> Column:
    """array<struct(seg, heading, text)>: the text cut before later lines that begin a lettered item, if it gives two pieces
    or more and every one has 50 characters or more; otherwise the clause as it is. Within the row: no explode, no join."""
    long_item = lambda x: x.rlike(P.ITEM_LINE) & (F.length(x) > ITEM_LINE_MIN)
    title = lambda x: F.when(long_item(x), F.regexp_extract(x, P.ITEM_LINE, 2)).when(x.rlike(P.SHORT_ITEM), F.regexp_extract(x, P.SHORT_ITEM, 2))
    base = T.strip(F.regexp_replace(heading, P.PART_LABEL, ""))

    def cut(lines: Column) -> Column:
        starts = F.filter(F.transform(lines, lambda x, i: F.when(i > 0, T.bind(title(T.strip(x)), lambda n: F.when(n.isNotNull(), F.struct(i.alias("i"), n.alias("n")))))), lambda x: x.isNotNull())

        def pieces(s: Column) -> Column:
            first = F.struct(F.lit(0).alias("i"), F.lit(None).cast("string").alias("n"))
            last = lambda k: F.coalesce(F.get(s, k)["i"], F.size(lines))
            made = lambda x, k: F.struct(
                k.alias("seg"),
                F.when(k > 0, F.concat(base, F.lit(" > "), F.rtrim(T.strip(x["n"]), F.lit(".")))).otherwise(heading).alias("heading"),
                T.strip(F.array_join(F.slice(lines, x["i"] + 1, last(k) - x["i"]), "\n")).alias("text"),
            )
            return F.filter(F.transform(F.concat(F.array(first), s), made), lambda x: x["text"] != "")

        whole = F.array(F.struct(F.lit(0).alias("seg"), heading.alias("heading"), text.alias("text")))
        good = lambda p: (F.size(p) > 1) & F.forall(p, lambda x: F.length(x["text"]) >= SEGMENT_MIN)
        return T.bind(starts, lambda s: F.when(F.size(s) == 0, whole).otherwise(T.bind(pieces(s), lambda p: F.when(good(p), p).otherwise(whole))))

    whole = F.array(F.struct(F.lit(0).alias("seg"), heading.alias("heading"), text.alias("text")))
    may = F.contains(text, F.lit("\n")) & text.rlike(r"\. [A-Z]")
    return F.when(may, T.bind(F.split(text, "\n"), cut)).otherwise(whole)


def split_items(clauses: DataFrame) -> DataFrame:
    """(doc_id, id, seg, heading, text): ``seg`` orders the pieces of a clause from 0."""
    made = clauses.select("doc_id", "id", item_pieces(F.col("heading"), F.col("text")).alias("_p"))
    return made.select("doc_id", "id", F.inline_outer("_p"))  # outer: never empty, and inline() would cut twice


def _is_two_to_n(own) -> Column:
    """The parts are exactly 2..n, each once or more."""
    k, n = F.col("_k"), F.col("_n")
    return (F.min(k).over(own) == 2) & (F.max(k).over(own) == n) & (F.size(F.collect_set(k).over(own)) == n - 1)


def renumber_parts(clauses: DataFrame, order: list[str], among: Column | None = None) -> DataFrame:
    """Groups of equal base whose parts are 2..n get labels 1..size, if all agree on n and the parts are 2..n, or fewer
    than n; among: which rows take part."""
    h = F.col("heading")
    has = h.rlike(P.PART_LABEL) if among is None else h.rlike(P.PART_LABEL) & among
    k, n = F.regexp_extract(h, P.PART_LABEL, 1).try_cast("int"), F.regexp_extract(h, P.PART_LABEL, 2).try_cast("int")
    marked = clauses.select("*", F.when(has, base_heading(h)).alias("_b"), F.when(has, k).alias("_k"), F.when(has, n).alias("_n"))
    own = Window.partitionBy("doc_id", "_b")
    rank = F.row_number().over(own.orderBy("_k", *order))
    fix = has & (F.min("_n").over(own) == F.max("_n").over(own)) & (_is_two_to_n(own) | (~F.bool_or(F.col("_k") == 1).over(own) & (F.count(F.lit(1)).over(own) < F.col("_n"))))
    label = F.concat(F.lit("(part "), F.col("_r").cast("string"), F.lit("/"), F.col("_c").cast("string"), F.lit(")"))
    # the ordered window first: its sort serves the others
    ranked = marked.withColumn("_r", rank).withColumn("_fix", fix).withColumn("_c", F.count(F.lit(1)).over(own))
    pieces = F.split(h, r"\(part \d+/\d+\)")
    return ranked.withColumn("heading", F.when(F.col("_fix"), F.array_join(pieces, "\x01")).otherwise(h)).withColumn("heading", F.when(F.col("_fix"), F.replace("heading", F.lit("\x01"), label)).otherwise(F.col("heading"))).drop("_b", "_k", "_n", "_fix", "_r", "_c")


#: (bug, detail) of the repairs of a heading in order: before the split of items, and after it.
EARLY, LATE = (("7", "Debris removed from heading"), ("10", "Encoding or markup mended in heading")), (("2", "Label named"), ("3", "Heading shortened"), ("3", "Full stop removed"), ("4", "Generic heading replaced"))


def named(clauses: DataFrame, junk_too: bool) -> DataFrame:
    """(doc_id, old_id, junk, old_heading, old_text, h1, h2, mended, seg, text, n0..n4): a row for each piece, headings as each
    repair within a clause leaves them; ``junk`` tells which clauses pass through as they are, if they aren't left out. No
    shuffle. Junk goes after the cut: a filter before it would be moved below the steps that make the text, and repeat them."""
    h, t = F.col("old_heading"), F.col("text")
    rows = clauses.select("doc_id", F.col("id").alias("old_id"), F.col("heading").alias("old_heading"), F.col("text").alias("old_text"), is_junk(F.col("text")).alias("junk"))
    early = rows.withColumn("h1", without_debris(h)).withColumn("h2", without_mojibake(F.col("h1"))).withColumn("mended", without_mojibake(F.col("old_text")))
    whole = F.array(F.struct(F.lit(0).alias("seg"), F.col("h2").alias("heading"), F.col("mended").alias("text")))
    cut = early.withColumn("_p", F.when(F.col("junk"), whole if junk_too else F.lit(None)).otherwise(item_pieces(F.col("h2"), F.col("mended"))))
    # outer: inline() would cut twice
    pieces = cut.select(*early.columns, F.inline_outer("_p")).where("seg is not null").withColumnRenamed("heading", "n0")
    for i, step in enumerate((lambda x: named_label(x, t), capped, without_period, lambda x: named_item(x, t))):
        pieces = pieces.withColumn(f"n{i + 1}", step(F.col(f"n{i}")))
    return pieces


def repair(clauses: DataFrame) -> DataFrame:
    """(doc_id, old_id, id, heading, text): junk out; headings and texts mended; items split; headings named and capped;
    parts and ids numbered anew."""
    pieces = named(clauses, False).select("doc_id", "old_id", "seg", F.col("n4").alias("heading"), "text")
    # one exchange serves all windows
    own = Window.partitionBy("doc_id").orderBy("old_id", "seg")
    rows = pieces.repartition("doc_id").withColumn("id", F.row_number().over(own).cast("long"))
    return renumber_parts(rows, ["old_id", "seg"]).select("doc_id", "old_id", "id", "heading", "text")


def repair_log(clauses: DataFrame) -> DataFrame:
    """(doc_id, bug, old_id, new_id, old_heading, new_heading, detail): a row for each change that a repair makes; new ids
    are those before the last numbering, '(new)' for a piece cut off, null if deleted. Only headings with a part's label are
    shuffled, for their numbering anew."""
    same, cut = F.col("old_id").cast("string"), lambda c, n: F.left(c, F.lit(n))
    row = lambda bug, new, was, now, detail: F.struct(F.lit(bug).alias("bug"), new.alias("new_id"), was.alias("old_heading"), now.alias("new_heading"), detail.alias("detail"))
    none = F.lit(None).cast("string")
    first, kept = F.col("seg") == 0, ~F.col("junk")
    rows = named(clauses, True)

    def steps(names: list[str], guard: Column, which: tuple) -> list[Column]:
        c = [F.col(x) for x in names]
        return [F.when(guard & (a != b), row(bug, same, a, b, F.lit(detail))) for a, b, (bug, detail) in zip(c, c[1:], which, strict=False)]

    mended, text = F.col("mended"), F.col("old_text")
    found = [
        F.when(F.col("junk"), row("9", none, F.col("old_heading"), none, F.concat(F.lit("Deleted: "), cut(text, 120)))),
        *steps(["old_heading", "h1", "h2"], first & kept, EARLY),
        F.when(first & kept & (mended != text), row("10", same, cut(text, 50), cut(mended, 50), F.lit("Encoding or markup mended in text"))),
        F.when(kept & (F.col("seg") > 0), row("1", F.lit("(new)"), F.col("h2"), F.col("n0"), F.lit("Item cut off"))),
        *steps([f"n{i}" for i in range(5)], kept, LATE),
    ]
    told = ["bug", "new_id", "old_heading", "new_heading", "detail"]
    local = rows.select("doc_id", "old_id", F.array(*found).alias("_v")).select("doc_id", "old_id", F.explode_outer("_v").alias("v")).where("v is not null").select("doc_id", "old_id", *(f"v.{c}" for c in told))
    # through an array of one: a filter on the heading itself would be moved below the steps, each of them written out in it
    part = F.when(kept & F.col("n4").rlike(P.PART_LABEL), F.struct("seg", F.col("n4").alias("heading"), F.col("n4").alias("_was")))
    # no repair makes a slash, so clauses without any have no label
    labelled = named(clauses.where(F.contains("heading", F.lit("/")) | F.contains("text", F.lit("/"))), True)
    parts = labelled.select("doc_id", "old_id", F.array(part).alias("_v")).select("doc_id", "old_id", F.explode_outer("_v").alias("v")).where("v is not null").select("doc_id", "old_id", "v.*")
    anew = renumber_parts(parts, ["old_id", "seg"]).where(F.col("_was") != F.col("heading"))
    anew = anew.select("doc_id", "old_id", row("8", same, F.col("_was"), F.col("heading"), F.lit("Part numbered anew")).alias("v")).select("doc_id", "old_id", *(f"v.{c}" for c in told))
    return local.union(anew).select("doc_id", "bug", same.alias("old_id"), *told[1:])


def change_log(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, column, old, new) where the two differ, rows of one side only included."""
    a = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in columns), F.lit(True).alias("_in_old"))
    b = new.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in columns))
    both = a.join(b, keys, "full_outer")
    pairs = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"_old_{c}").alias("old"), F.col(f"_new_{c}").alias("new")) for c in columns))
    changed = F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))
    return both.select(*keys, F.explode(changed).alias("c")).select(*keys, "c.*")


def mended_log(rows: DataFrame, keys: list[str], now: dict[str, Column], kept: Column) -> DataFrame:
    """``change_log`` of rows against themselves with the columns of ``now`` mended, those that aren't ``kept`` missing: within
    the row, no join. A row without a key equals none, so both of its states are reported."""
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    stays = F.coalesce(kept, F.lit(False))
    both = rows.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in now), *(x.alias(f"_new_{c}") for c, x in now.items()), stays.alias("_kept"), keyed.alias("_keyed"))
    made = []
    for c in now:
        old, new = F.col(f"_old_{c}"), F.col(f"_new_{c}")
        row = lambda a, b, c=c: F.struct(F.lit(c).alias("column"), a.alias("old"), b.alias("new"))
        none = F.lit(None).cast("string")
        made.append(F.when(F.col("_keyed") & F.col("_kept"), F.when(~old.eqNullSafe(new), row(old, new))).when(old.isNotNull(), row(old, none)))
        made.append(F.when(~F.col("_keyed") & F.col("_kept") & new.isNotNull(), row(none, new)))
    return both.select(*keys, F.array(*made).alias("_v")).select(*keys, F.explode_outer("_v").alias("c")).where("c is not null").select(*keys, "c.*")
