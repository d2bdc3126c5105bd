"""Queries on structured lines: sentences of ``documents``, each set as a heading, bullet, item, title, ... by its place.

The raw documents have no structure, so it is derived from (doc_id, pos) by an expression that both engines evaluate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import patterns as P
from clauseloom.functions import text as T
from clauseloom.operators import lines as L

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def structured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # outer: the array is never empty, and posexplode() would cut the text once more to see that
    u = docs.select("doc_id", F.posexplode_outer(F.split("text", "[.\n] *")).alias("pos", "u"))
    c, pos = F.col("u"), F.col("pos")
    kinds = [
        F.concat(F.lit("## "), c), F.concat(F.lit("- "), c), F.concat(F.lit("- "), c), F.concat(pos.cast("string"), F.lit(". "), c),
        F.regexp_replace(F.translate(c, _LOW, _UP), "[^A-Z ]", ""), F.concat(c, F.lit(":")), F.lit(""), F.concat(F.lit("**"), c, F.lit("** "), c),
        F.concat(F.lit("a. "), c), F.lit("-----"), F.concat(F.lit("  "), c),
        F.when(pos % 3 == 0, F.concat(F.lit("Notice "), F.regexp_extract(c, "^[^ ]+", 0))).otherwise(c),
        F.when(pos % 2 == 0, F.lit("Privacy + Center + Rights + Help")).otherwise(F.concat(c, F.lit("."))),
    ]
    k = (F.col("doc_id") + pos) % 13
    line = F.when(k == 0, kinds[0])
    for i, x in enumerate(kinds[1:], 1):
        line = line.when(k == i, x)
    return u.select("doc_id", "pos", line.alias("line"))


SL = f"""
WITH raw AS (SELECT doc_id, unnest(generate_series(0, len(a) - 1)) AS pos, unnest(a) AS u
  FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '[.\\n] *') AS a FROM documents)),
sl AS (SELECT doc_id, pos::INT AS pos, CASE (doc_id + pos) % 13
  WHEN 0 THEN '## ' || u WHEN 1 THEN '- ' || u WHEN 2 THEN '- ' || u WHEN 3 THEN pos || '. ' || u
  WHEN 4 THEN regexp_replace(translate(u, '{_LOW}', '{_UP}'), '[^A-Z ]', '', 'g')
  WHEN 5 THEN u || ':' WHEN 6 THEN '' WHEN 7 THEN '**' || u || '** ' || u WHEN 8 THEN 'a. ' || u WHEN 9 THEN '-----' WHEN 10 THEN '  ' || u
  WHEN 11 THEN CASE WHEN pos % 3 = 0 THEN 'Notice ' || regexp_extract(u, '^[^ ]+', 0) ELSE u END
  ELSE CASE WHEN pos % 2 = 0 THEN 'Privacy + Center + Rights + Help' ELSE u || '.' END END AS line FROM raw)"""


def q(pattern: str) -> str:
    """A pattern as a SQL literal in RE2's flavour."""
    return "'" + pattern.replace("'", "''") + "'"


def m(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


KINDS = {"heading": P.MD_HEADING, "list_start": P.LIST_START, "bold_only": P.BOLD_ONLY, "all_caps": P.ALL_CAPS, "bold_title": P.BOLD_TITLE, "rule": P.RULE, "bullet": P.BULLET, "bullet_line": P.BULLET_LINE, "numbered": P.NUMBERED, "lettered": P.LETTERED, "bold_start": P.BOLD_START, "bold_label": P.BOLD_LABEL, "label_prefix": P.LABEL_PREFIX, "first_sentence": P.FIRST_SENTENCE, "year": P.YEAR, "not_title": P.NOT_TITLE}


def line_kinds(spark, sf_dir):
    sl = structured_lines(spark, sf_dir)
    return sl.groupBy("doc_id").agg(*(F.count_if(T.has(F.col("line"), p)).alias(f"n_{n}") for n, p in KINDS.items()))


LINE_KINDS = f"{SL} SELECT doc_id, {', '.join(f'count(*) FILTER ({m("line", p)}) AS n_{n}' for n, p in KINDS.items())} FROM sl GROUP BY doc_id"

_CHROME = f"((len(line) - len(replace(line, ' + ', ''))) >= 9 OR len(regexp_extract_all(trim(line), {q(P.GLUE)})) >= 2 OR ({m('line', P.MD_HEADING)} AND NOT contains(trim(regexp_extract(line, {q(P.MD_HEADING)}, 1)), ' ') AND len(regexp_extract(line, {q(P.MD_HEADING)}, 1)) >= 18 AND upper(regexp_extract(line, {q(P.MD_HEADING)}, 1)) = regexp_extract(line, {q(P.MD_HEADING)}, 1)))"


def chrome_filter(spark, sf_dir):
    return structured_lines(spark, sf_dir).where(~T.is_chrome(F.col("line")))


CHROME_FILTER = f"{SL} SELECT * FROM sl WHERE NOT {_CHROME}"

# words of a SQL expression
_W = lambda x: f"len(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''))"
_ITEM = f"regexp_extract(trim(line), {q(P.BULLET)}, 1)"
_LINK = f"""CASE WHEN trim(line) = '' OR {m('line', P.RULE)} THEN true
  WHEN {m('trim(line)', P.MD_HEADING)} THEN {_W(f"regexp_extract(trim(line), {q(P.MD_HEADING)}, 1)")} <= 3
  WHEN {m('line', P.BULLET)} THEN {_W(_ITEM)} <= 6 AND ({_W(_ITEM)} <= 3 OR NOT ends_with({_ITEM}, '.')) AND NOT ends_with({_ITEM}, ':')
  WHEN {m('trim(line)', P.FOOTER_LABEL)} THEN true
  ELSE {_W('line')} <= 3 AND NOT ends_with(trim(line), '.') END"""


def link_lines(spark, sf_dir):
    return structured_lines(spark, sf_dir).select("doc_id", "pos", T.is_link_line(F.col("line")).alias("is_link"))


LINK_LINES = f"{SL} SELECT doc_id, pos, {_LINK} AS is_link FROM sl"


def footer_lines(spark, sf_dir):
    """The lines with a footer set below each document: its last words, one a line."""
    sl = structured_lines(spark, sf_dir)
    tail = sl.groupBy("doc_id").agg(F.max("pos").alias("last"))
    foot = tail.select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 9 + 1).cast("int"))).alias("k"), "last")
    foot = foot.select("doc_id", (F.col("last") + F.col("k")).alias("pos"), F.concat(F.lit("Help "), F.col("k").cast("string")).alias("line"))
    return sl.unionByName(foot)


def footer_strip(spark, sf_dir):
    return L.mark_footer(footer_lines(spark, sf_dir)).where("not footer").select("doc_id", "pos", "line")


FOOTER_STRIP = f"""{SL}, fl AS (SELECT * FROM sl UNION ALL
  SELECT doc_id, (last + k)::INT, 'Help ' || k FROM (SELECT doc_id, max(pos) AS last, unnest(generate_series(1, doc_id % 9 + 1)) AS k FROM sl GROUP BY doc_id)),
k AS (SELECT *, {_LINK} AS link FROM fl),
r AS (SELECT *, coalesce((SELECT max(pos) FROM k o WHERE o.doc_id = k.doc_id AND NOT o.link), -1) AS last FROM k),
n AS (SELECT *, count(*) FILTER (pos > last AND trim(line) <> '') OVER (PARTITION BY doc_id) AS c FROM r)
SELECT doc_id, pos, line FROM n WHERE pos <= last OR c < 6"""


def caps_ratio(spark, sf_dir):
    return structured_lines(spark, sf_dir).select("doc_id", "pos", T.caps_like(F.col("line")).alias("caps_like"))


CAPS_RATIO = f"""{SL}, l AS (SELECT *, len(regexp_replace(line, '\\P{{L}}', '', 'g')) AS n, len(regexp_replace(line, '\\P{{Lu}}', '', 'g')) AS u FROM sl)
SELECT doc_id, pos, n >= 10 AND 10 * u >= 9 * n AS caps_like FROM l"""


def _title_sql(x: str) -> str:
    content = f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '' AND NOT list_contains({P.STOPWORDS!r}, lower(w)) AND regexp_matches(w, '[\\p{{L}}\\p{{N}}]'))"
    first = f"list_transform({content}, lambda w: left(ltrim(w, '(\"''“‘'), 1))"
    return f"""({x} <> '' AND len({x}) <= 80 AND NOT regexp_matches({x}, '[.!?;,:]$') AND NOT {m(x, P.NOT_TITLE)} AND NOT {m(x, P.YEAR)}
  AND {_W(x)} <= 12 AND regexp_matches({x}, '\\p{{L}}') AND len({content}) > 0 AND regexp_matches({first}[1], '^\\p{{Lu}}')
  AND len(list_filter({first}, lambda c: NOT regexp_matches(c, '^[\\p{{Lu}}\\p{{Nd}}]'))) = 0)"""


def title_predicate(spark, sf_dir):
    return structured_lines(spark, sf_dir).select("doc_id", "pos", T.looks_like_title(F.col("line")).alias("is_title"))


TITLE_PREDICATE = f"{SL} SELECT doc_id, pos, {_title_sql('trim(line)')} AS is_title FROM sl"


def boundary_classify(spark, sf_dir):
    found = L.classify(L.neighbours(structured_lines(spark, sf_dir)))
    return found.where("start is not null").select("doc_id", "pos", "start.*")


_SNIP = lambda x: f"rtrim(array_to_string(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')[1:8], ' '), ' ,;:.-') || CASE WHEN {_W(x)} > 8 THEN '…' ELSE '' END"
_FS = f"trim(regexp_extract(rest, {q(P.FIRST_SENTENCE)}, 1))"
_BT = f"trim(regexp_extract(s, {q(P.BOLD_START)}, 1))"
CLASSIFIED = f"""
c1 AS (SELECT *, len(line) - len(ltrim(line)) AS ind, CASE WHEN {m('trim(line)', P.BOLD_LABEL)}
    THEN regexp_extract(trim(line), {q(P.BOLD_LABEL)}, 1) || '. ' || regexp_extract(trim(line), {q(P.BOLD_LABEL)}, 2) ELSE trim(line) END AS s FROM c0),
c2 AS (SELECT *, CASE WHEN {m('s', P.NUMBERED)} THEN regexp_extract(s, {q(P.NUMBERED)}, 2) WHEN {m('s', P.LETTERED)} THEN regexp_extract(s, {q(P.LETTERED)}, 2) END AS rest,
  CASE WHEN {m('s', P.NUMBERED)} THEN 'top' ELSE 'sub' END AS lv FROM c1),
c3 AS (SELECT *, CASE WHEN ind >= 2 OR {m('trim(line)', P.BULLET_LINE)} THEN NULL
  WHEN rest IS NOT NULL AND {m('rest', P.BOLD_START)} THEN {{'h': rtrim(trim(regexp_extract(rest, {q(P.BOLD_START)}, 1)), '.:'), 'b': trim(regexp_extract(rest, {q(P.BOLD_START)}, 2)), 'l': lv, 'r': true}}
  WHEN rest IS NOT NULL AND {m('rest', P.FIRST_SENTENCE)} AND {_title_sql(_FS)} THEN {{'h': {_FS}, 'b': trim(regexp_extract(rest, {q(P.FIRST_SENTENCE)}, 2)), 'l': lv, 'r': true}}
  WHEN rest IS NOT NULL AND len(rest) <= 80 AND {_W('rest')} <= 12 AND NOT contains(rest, ',') AND NOT regexp_matches(rest, '[.:;]$') THEN {{'h': trim(rest), 'b': '', 'l': lv, 'r': true}}
  WHEN rest IS NOT NULL THEN {{'h': {_SNIP('rest')}, 'b': rest, 'l': 'sub', 'r': false}}
  WHEN {m('s', P.BOLD_START)} AND {m(_BT, P.LABEL_PREFIX)} THEN {{'h': rtrim(trim(regexp_replace({_BT}, {q(P.LABEL_PREFIX)}, '')), '.:'), 'b': trim(regexp_extract(s, {q(P.BOLD_START)}, 2)), 'l': CASE WHEN regexp_matches({_BT}, '^[0-9]') THEN 'top' ELSE 'sub' END, 'r': true}}
  WHEN {m('s', P.BOLD_START)} THEN {{'h': rtrim({_BT}, ':'), 'b': trim(regexp_extract(s, {q(P.BOLD_START)}, 2)), 'l': 'top', 'r': true}}
  WHEN {m('s', P.ALL_CAPS)} THEN {{'h': s, 'b': '', 'l': 'top', 'r': true}}
  WHEN ends_with(trim(before), ':') OR trim(after) = '' THEN NULL
  WHEN ends_with(s, ':') THEN CASE WHEN regexp_matches(trim(s[:-2]), '^\\p{{Lu}}') AND {_W('s[:-2]')} <= 6 AND NOT regexp_matches(s[:-2], '[,|]|https?://') THEN {{'h': trim(s[:-2]), 'b': '', 'l': 'top', 'r': true}} END
  WHEN {_title_sql('s')} THEN {{'h': s, 'b': '', 'l': 'top', 'r': true}} END AS st FROM c2)"""
BOUNDARY_CLASSIFY = f"""{SL}, c0 AS (SELECT *, lag(line, 1, '') OVER w AS before, lead(line, 1, '') OVER w AS after FROM sl WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
{CLASSIFIED} SELECT doc_id, pos, st.h AS heading, st.b AS body, st.l AS level, st.r AS real FROM c3 WHERE st IS NOT NULL"""


def setext_rewrite(spark, sf_dir):
    return L.setext(structured_lines(spark, sf_dir))


SETEXT_REWRITE = f"""{SL}, w AS (SELECT *, {m('line', P.RULE)} AS rule, lead({m('line', P.RULE)}, 1, false) OVER (PARTITION BY doc_id ORDER BY pos) AS under FROM sl)
SELECT doc_id, pos, CASE WHEN under AND trim(line) <> '' AND len(trim(line)) <= 100 AND NOT ends_with(trim(line), '.') AND NOT {m('trim(line)', P.LIST_START)}
  THEN '## ' || trim(line) ELSE line END AS line FROM w WHERE NOT rule"""


def toc_run_detection(spark, sf_dir):
    return L.contents_run(structured_lines(spark, sf_dir)).where("in_run").select("doc_id", "pos")


TOC_RUN = f"""{SL}, b AS (SELECT doc_id, pos FROM sl WHERE {m('line', P.BULLET)})
SELECT doc_id, pos FROM b WHERE EXISTS (SELECT 1 FROM b o WHERE o.doc_id = b.doc_id AND abs(o.pos - b.pos) = 1)"""


def toc_fuzzy_drop(spark, sf_dir):
    return L.drop_contents(structured_lines(spark, sf_dir))


def line_unwrap(spark, sf_dir):
    return L.unwrap(structured_lines(spark, sf_dir))


LINE_UNWRAP = f"""{SL}, a AS (SELECT *, lead(line, 1, '') OVER w AS after FROM sl WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
t AS (SELECT *, {m('line', P.ALL_CAPS)} AND NOT {m('after', P.ALL_CAPS)} AND NOT (len(regexp_replace(after, '\\P{{L}}', '', 'g')) >= 10
  AND 10 * len(regexp_replace(after, '\\P{{Lu}}', '', 'g')) >= 9 * len(regexp_replace(after, '\\P{{L}}', '', 'g'))) AS title FROM a),
s AS (SELECT *, trim(line) = '' OR title OR {m('line', P.BOLD_ONLY)} AS closes, {m('trim(line)', P.MD_HEADING)} AS head,
  trim(line) = '' OR title OR {m('line', P.BOLD_ONLY)} OR {m('line', P.LIST_START)} AS opens FROM t),
i AS (SELECT *, sum((opens OR lag(closes OR head, 1, true) OVER w)::INT) OVER w AS id FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) AS n FROM i)
SELECT doc_id, min(pos) AS pos, string_agg(CASE WHEN n = 1 THEN line ELSE trim(line) END, ' ' ORDER BY pos) AS line FROM f GROUP BY doc_id, id"""
# window functions can't be nested
LINE_UNWRAP = LINE_UNWRAP.replace("i AS (SELECT *, sum((opens OR lag(closes OR head, 1, true) OVER w)::INT) OVER w AS id FROM s WINDOW w", "s2 AS (SELECT *, (opens OR lag(closes OR head, 1, true) OVER w)::INT AS new FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),\ni AS (SELECT *, sum(new) OVER w AS id FROM s2 WINDOW w")


def next_nonblank(spark, sf_dir):
    return L.next_nonblank(structured_lines(spark, sf_dir)).select("doc_id", "pos", "next_line")


NEXT_NONBLANK = f"""{SL}, b AS (SELECT * FROM sl WHERE trim(line) <> '')
SELECT sl.doc_id, sl.pos, b.line AS next_line FROM (SELECT doc_id, pos, pos + 1 AS at FROM sl) sl ASOF LEFT JOIN b ON sl.doc_id = b.doc_id AND sl.at <= b.pos"""


def section_carry(spark, sf_dir):
    return L.sections(structured_lines(spark, sf_dir)).select("doc_id", "pos", "section_id", "section", "line")


_HEAD = f"({m('line', P.MD_HEADING)} AND len(trim(regexp_extract(line, {q(P.MD_HEADING)}, 1))) <= 100 AND NOT ends_with(trim(regexp_extract(line, {q(P.MD_HEADING)}, 1)), '.'))"
SECTIONED = f"""h AS (SELECT *, {_HEAD} AS head, trim(regexp_extract(line, {q(P.MD_HEADING)}, 1)) AS name, {m('line', P.MD_HEADING)} AS md FROM sl),
g AS (SELECT doc_id, pos, head, name, CASE WHEN md THEN name ELSE line END AS line, count(*) FILTER (head) OVER (PARTITION BY doc_id ORDER BY pos) AS section_id FROM h),
sec AS (SELECT doc_id, section_id, coalesce(max(name) FILTER (head), '') AS section, bool_or(NOT head AND trim(line) <> '') AS filled FROM g GROUP BY doc_id, section_id),
body AS (SELECT g.doc_id, g.pos, g.section_id, section, line FROM g JOIN sec USING (doc_id, section_id) WHERE NOT head AND filled)"""
SECTION_CARRY = f"{SL}, {SECTIONED} SELECT * FROM body"


def block_ids(spark, sf_dir):
    return L.block_starts(L.sections(structured_lines(spark, sf_dir))).select("doc_id", "pos", "section_id", "parent", "block_id")


BLOCK_IDS = f"""{SL}, {SECTIONED},
c0 AS (SELECT *, lag(line, 1, '') OVER w AS before, lead(line, 1, '') OVER w AS after, row_number() OVER w AS n FROM body WHERE trim(line) <> '' WINDOW w AS (PARTITION BY doc_id, section_id ORDER BY pos)),
{CLASSIFIED},
c4 AS (SELECT *, count(*) FILTER (st IS NOT NULL) OVER w - (st IS NOT NULL)::INT > 0 AS headed, max(pos) FILTER (st.l = 'top') OVER w AS top FROM c3 WINDOW w AS (PARTITION BY doc_id, section_id ORDER BY pos)),
c5 AS (SELECT *, (st IS NOT NULL OR n = 1 OR (NOT headed AND NOT ({m('trim(line)', P.BULLET_LINE)} OR ends_with(trim(before), ':'))))::INT AS new FROM c4)
SELECT a.doc_id, a.pos, a.section_id, coalesce(o.st.h, a.section) AS parent, sum(a.new) OVER (PARTITION BY a.doc_id ORDER BY a.pos)::BIGINT AS block_id
FROM c5 a LEFT JOIN c3 o ON a.doc_id = o.doc_id AND a.top = o.pos"""


def prev_clause_colon(spark, sf_dir):
    """Lines that start like a bullet though the line before doesn't introduce a list."""
    n = L.neighbours(structured_lines(spark, sf_dir))
    return n.where((F.col("pos") > 0) & F.col("line").rlike("^[-*]") & ~T.rstrip(F.col("before")).endswith(":")).select("doc_id", "pos")


PREV_COLON = f"{SL} SELECT a.doc_id, a.pos FROM sl a JOIN sl b ON a.doc_id = b.doc_id AND b.pos = a.pos - 1 WHERE regexp_matches(a.line, '^[-*]') AND NOT ends_with(rtrim(b.line), ':')"


def seen_dedup(spark, sf_dir):
    return L.first_seen(structured_lines(spark, sf_dir))


SEEN_DEDUP = f"{SL} SELECT doc_id, min(pos) AS pos, line FROM sl GROUP BY doc_id, line"

QUERIES = {
    "line_kinds": line_kinds, "chrome_filter": chrome_filter, "link_lines": link_lines, "footer_strip": footer_strip, "caps_ratio": caps_ratio,
    "title_predicate": title_predicate, "boundary_classify": boundary_classify, "setext_rewrite": setext_rewrite, "toc_run_detection": toc_run_detection,
    "toc_fuzzy_drop": toc_fuzzy_drop, "line_unwrap": line_unwrap, "next_nonblank": next_nonblank, "section_carry": section_carry, "block_ids": block_ids,
    "prev_clause_colon": prev_clause_colon, "seen_dedup": seen_dedup,
}

ORACLES = {
    "line_kinds": LINE_KINDS, "chrome_filter": CHROME_FILTER, "link_lines": LINK_LINES, "footer_strip": FOOTER_STRIP, "caps_ratio": CAPS_RATIO,
    "title_predicate": TITLE_PREDICATE, "boundary_classify": BOUNDARY_CLASSIFY, "setext_rewrite": SETEXT_REWRITE, "toc_run_detection": TOC_RUN,
    "line_unwrap": LINE_UNWRAP, "next_nonblank": NEXT_NONBLANK, "section_carry": SECTION_CARRY, "block_ids": BLOCK_IDS,
    "prev_clause_colon": PREV_COLON, "seen_dedup": SEEN_DEDUP,
}
