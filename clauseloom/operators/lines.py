"""Ordered operators on lines: (doc_id, pos, line) in, more columns or fewer rows out.

All windows share one partitioning by document, so one exchange and one sort serve a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from clauseloom.functions import patterns as P
from clauseloom.functions import text as T

def doc(first: int | None = None, last: int | None = None) -> WindowSpec:
    """Lines of a document in order; with bounds, rows from first to last around the current one (None: without end)."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    if first is None and last is None:
        return order
    return order.rowsBetween(Window.unboundedPreceding if first is None else first, Window.unboundedFollowing if last is None else last)


def explode_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def assemble(lines: DataFrame) -> DataFrame:
    """(doc_id, text): the lines of each document joined in order."""
    kept = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return lines.groupBy("doc_id").agg(kept.alias("_l")).select("doc_id", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("text"))


def neighbours(lines: DataFrame) -> DataFrame:
    return lines.withColumn("before", F.lag("line", 1, "").over(doc())).withColumn("after", F.lead("line", 1, "").over(doc()))


def nonblank(c: str | Column = "line") -> Column:
    return T.strip(F.col(c) if isinstance(c, str) else c) != ""


def next_nonblank(lines: DataFrame) -> DataFrame:
    return lines.withColumn("next_line", F.first(F.when(nonblank(), F.col("line")), ignorenulls=True).over(doc(1, None)))


def setext(lines: DataFrame) -> DataFrame:
    """A short title right above a rule line becomes a heading; rule lines go. Of several rules below one another the first counts."""
    rule = T.has(F.col("line"), P.RULE)
    under = F.lead(rule, 1, False).over(doc())
    above = T.strip(F.col("line"))
    good = (above != "") & (F.length(above) <= P.HEADING_MAX) & ~above.endswith(".") & ~T.has(above, P.LIST_START)
    return lines.withColumn("_rule", rule).withColumn("line", F.when(under & ~rule & good, F.concat(F.lit("## "), above)).otherwise(F.col("line"))).where("not _rule").drop("_rule")


def mark_footer(lines: DataFrame) -> DataFrame:
    """``footer``: in the trailing run of link lines, if that has six or more that aren't blank."""
    run = F.sum((~T.is_link_line(F.col("line"))).cast("long")).over(doc(0, None)) == 0
    marked = lines.withColumn("_run", run)
    size = F.sum((F.col("_run") & nonblank()).cast("long")).over(Window.partitionBy("doc_id"))
    return marked.withColumn("footer", F.col("_run") & (size >= P.FOOTER_LINES)).drop("_run")


def contents_run(lines: DataFrame) -> DataFrame:
    """``in_run``: a bullet beside another bullet."""
    b = T.has(F.col("line"), P.BULLET)
    return lines.withColumn("in_run", b & (F.lag(b, 1, False).over(doc()) | F.lead(b, 1, False).over(doc())))


def titles(lines: DataFrame) -> DataFrame:
    """(doc_id, title) of headings and bold titles, normalised as a table of contents repeats them."""
    c = F.col("line")
    found = F.when(T.has(c, P.MD_HEADING), T.group(c, P.MD_HEADING, 1)).when(T.has(c, P.BOLD_TITLE), T.group(c, P.BOLD_TITLE, 1))
    return lines.select("doc_id", F.lower(F.rtrim(T.strip(found), F.lit(":"))).alias("title")).where("title is not null").distinct()


def drop_contents(lines: DataFrame) -> DataFrame:
    """Without bullets in a run that resemble a title of their document (similarity 0.8 or more).

    The bound 2 * min / (sum of lengths) on the similarity prunes pairs before the kernel sees them; a document's titles
    meet only its own bullets.
    """


    def close(batches):
        import difflib

        import pyarrow as pa

        for b in batches:
            keep = [bool(difflib.get_close_matches(x, [y], n=1, cutoff=P.FUZZY_CUTOFF)) for x, y in zip(b["word"].to_pylist(), b["title"].to_pylist(), strict=True)]
            yield b.select(["doc_id", "pos"]).filter(pa.array(keep, pa.bool_()))

    marked = contents_run(lines)
    wanted = marked.where("in_run").select("doc_id", "pos", F.lower(T.group(F.col("line"), P.BULLET, 1)).alias("word"))
    a, b = F.length("word"), F.length("title")
    pairs = wanted.join(titles(lines), "doc_id").where(2 * F.least(a, b) >= P.FUZZY_CUTOFF * (a + b))
    exact = F.col("word") == F.col("title")
    gone = pairs.where(exact).select("doc_id", "pos")
    near = pairs.where(~exact).select("doc_id", "pos", "word", "title")
    gone = gone.union(near.mapInArrow(close, near.select("doc_id", "pos").schema)).distinct()
    return lines.join(gone, ["doc_id", "pos"], "left_anti")


def caps_titles(lines: DataFrame) -> DataFrame:
    """``title``: an all-capitals line that the next line doesn't go on."""
    c, after = F.col("line"), F.lead("line", 1, "").over(doc())
    return lines.withColumn("title", T.has(c, P.ALL_CAPS) & ~T.has(after, P.ALL_CAPS) & ~T.caps_like(after))


def unwrap(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, line): hard-wrapped paragraphs joined, pos that of their first line.

    Islands of lines that go on. Equal to the kernel except where a bold span itself is wrapped over lines, which only
    the kernel sees as joined so far.
    """
    c = F.col("line")
    blank, bold, heading = ~nonblank(), T.has(c, P.BOLD_ONLY), T.has(T.strip(c), P.MD_HEADING)
    starts = T.has(c, P.LIST_START)
    marked = caps_titles(lines).select("*", blank.alias("_b"), bold.alias("_o"), heading.alias("_h"), starts.alias("_s"))
    closed = F.lag(F.col("_b") | F.col("title") | F.col("_o"), 1, True).over(doc())
    # only the island's first line can be a heading; a line that goes on a heading starts an island, so the line above decides
    marked = marked.withColumn("_new", closed | F.lag("_h", 1, False).over(doc()) | F.col("_b") | F.col("title") | F.col("_o") | F.col("_s"))
    islands = marked.withColumn("_id", F.sum(F.col("_new").cast("long")).over(doc(None, 0)))
    part = F.array_sort(F.collect_list(F.struct("pos", "line")))
    joined = islands.groupBy("doc_id", "_id").agg(F.min("pos").alias("pos"), part.alias("_p"))
    text = F.concat(F.col("_p")[0]["line"], F.array_join(F.transform(F.slice("_p", 2, F.greatest(F.size("_p") - 1, F.lit(0))), lambda x: F.concat(F.lit(" "), T.strip(x["line"]))), ""))
    return joined.select("doc_id", "pos", text.alias("line"))


def sections(lines: DataFrame) -> DataFrame:
    """``section_id`` and ``section``; headings go, sentences set as headings become lines, blank sections vanish."""
    inner = T.strip(T.group(F.col("line"), P.MD_HEADING, 1))
    is_md = T.has(F.col("line"), P.MD_HEADING)
    head = is_md & T.is_title(inner)
    marked = lines.withColumn("_head", F.when(head, inner)).withColumn("line", F.when(is_md & ~head, inner).otherwise(F.col("line")))
    carried = marked.withColumn("section_id", F.count("_head").over(doc(None, 0))).withColumn("section", F.coalesce(F.last("_head", ignorenulls=True).over(doc(None, 0)), F.lit("")))
    body = carried.where("_head is null").drop("_head")
    return body.withColumn("_full", F.max(nonblank()).over(Window.partitionBy("doc_id", "section_id"))).where("_full").drop("_full")


def classify(lines: DataFrame, line: str = "line", before: str = "before", after: str = "after") -> DataFrame:
    """``start``: what begins at the line (heading, body, level, real), null if it goes on; first rule that applies."""
    null = F.lit(None).cast("struct<heading:string,body:string,level:string,real:boolean>")

    def made(heading: Column, body: Column | str, level: Column | str, real: bool) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(heading.alias("heading"), lit(body).alias("body"), lit(level).alias("level"), F.lit(real).alias("real"))

    raw = F.col(line)
    indent = F.length(raw) - F.length(F.regexp_replace(raw, r"(?U)^\s+", ""))
    s = T.strip(raw)
    labelled = F.when(T.has(s, P.BOLD_LABEL), F.concat(T.group(s, P.BOLD_LABEL, 1), F.lit(". "), T.group(s, P.BOLD_LABEL, 2))).otherwise(s)
    step = lines.select("*", indent.alias("_in"), T.has(s, P.BULLET_LINE).alias("_bu"), labelled.alias("_s"))
    s = F.col("_s")
    numbered, lettered = T.has(s, P.NUMBERED), T.has(s, P.LETTERED)
    step = step.withColumn("_rest", F.when(numbered, T.group(s, P.NUMBERED, 2)).when(lettered, T.group(s, P.LETTERED, 2)))
    step = step.withColumn("_level", F.when(numbered, "top").when(lettered, "sub"))
    rest, level = F.col("_rest"), F.col("_level")
    lead = T.group(rest, P.FIRST_SENTENCE, 1)
    short = (F.length(rest) <= P.TITLE_CHARS) & (T.word_count(rest) <= P.TITLE_WORDS) & ~F.contains(rest, F.lit(",")) & ~rest.rlike("[.:;]$")
    item = (
        F.when(T.has(rest, P.BOLD_START), made(T.trim_of(T.strip(T.group(rest, P.BOLD_START, 1)), ".:", left=False), T.strip(T.group(rest, P.BOLD_START, 2)), level, True))
        .when(T.has(rest, P.FIRST_SENTENCE) & T.looks_like_title(lead), made(T.strip(lead), T.strip(T.group(rest, P.FIRST_SENTENCE, 2)), level, True))
        .when(short, made(T.strip(rest), "", level, True))
        .otherwise(made(T.snippet(rest), rest, "sub", False))
    )
    title, body = T.strip(T.group(s, P.BOLD_START, 1)), T.strip(T.group(s, P.BOLD_START, 2))
    bold = F.when(
        T.has(title, P.LABEL_PREFIX),
        made(T.trim_of(T.strip(F.regexp_replace(title, P.LABEL_PREFIX, "")), ".:", left=False), body, F.when(title.rlike("^[0-9]"), "top").otherwise("sub"), True),
    ).otherwise(made(F.rtrim(title, F.lit(":")), body, "top", True))
    named = T.strip(F.regexp_replace(s, ":$", ""))
    colon = named.rlike(r"^\p{Lu}") & (T.word_count(named) <= P.COLON_WORDS) & ~named.rlike(r"[,|]|https?://")
    start = (
        F.when((F.col("_in") >= 2) | F.col("_bu"), null)
        .when(rest.isNotNull(), item)
        .when(T.has(s, P.BOLD_START), bold)
        .when(T.has(s, P.ALL_CAPS), made(s, "", "top", True))
        .when(T.strip(F.col(before)).endswith(":") | (T.strip(F.col(after)) == ""), null)
        .when(s.endswith(":"), F.when(colon, made(named, "", "top", True)).otherwise(null))
        .when(T.looks_like_title(s), made(s, "", "top", True))
        .otherwise(null)
    )
    return step.withColumn("start", start).drop("_in", "_bu", "_s", "_rest", "_level")


def block_starts(lines: DataFrame) -> DataFrame:
    """Lines of sections (blank ones left out) with ``start``, ``parent`` and ``block_id``, numbered within the document."""
    full = neighbours_in_section(lines.where(nonblank()))
    found = classify(full)
    order = Window.partitionBy("doc_id", "section_id").orderBy("pos")
    up_to, above = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    top = F.when(F.col("start.level") == "top", F.col("start.heading"))
    parent = F.coalesce(F.last(top, ignorenulls=True).over(up_to), F.col("section"))
    headed = F.coalesce(F.max(F.col("start").isNotNull()).over(above), F.lit(False))
    goes_on = T.has(T.strip(F.col("line")), P.BULLET_LINE) | T.strip(F.col("before")).endswith(":")
    first = F.row_number().over(order) == 1
    new = F.col("start").isNotNull() | first | (~headed & ~goes_on)
    marked = found.withColumn("parent", parent).withColumn("_new", new)
    return marked.withColumn("block_id", F.sum(F.col("_new").cast("long")).over(doc(None, 0))).drop("_new")


def neighbours_in_section(lines: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id", "section_id").orderBy("pos")
    return lines.withColumn("before", F.lag("line", 1, "").over(order)).withColumn("after", F.lead("line", 1, "").over(order))


def first_seen(lines: DataFrame, key: str = "line") -> DataFrame:
    """The first row, by pos, of each value of the key within its document."""
    rest = [c for c in lines.columns if c not in ("doc_id", key)]
    first = lines.groupBy("doc_id", key).agg(F.min(F.struct("pos", *(c for c in rest if c != "pos"))).alias("_f"))
    return first.select(*(f"_f.{c}" if c in rest else c for c in lines.columns))
