"""Queries on whole texts: packing and splitting, sentences, names, web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauseloom.functions import patterns as P
from clauseloom.functions import text as T
from clauseloom.operators import clauses, html
from clauseloom.plans.structured import q, structured_lines
from clauseloom.sources import catalogue as sources


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clause_pack_stats(spark, sf_dir):
    """The flagship: documents in parts of at most 1,500 characters, counted and measured by language."""
    parts = clauses.pack(table(spark, sf_dir, "documents"), keep=["doc_id", "lang"])
    n = F.length("text")
    return parts.groupBy("lang").agg(
        F.count(F.lit(1)).alias("clauses"), F.min(n).cast("long").alias("shortest"), F.floor(F.median(n)).cast("long").alias("middle"), F.max(n).cast("long").alias("longest"),
        F.count_if(n < P.MIN_LEN).alias("n_short"), F.count_if(n > P.MAX_LEN).alias("n_long"), F.countDistinct("doc_id").alias("docs"),
    )


# Lines, sentences of lines that are too long (a gap after an abbreviation is masked), words of sentences that are too
# long, packed by recursion. Documents have no bullets, lead-ins or semicolons.
_ABBR = "(?i)((?:" + "|".join(a[:-1].replace(".", r"\.") for a in P.ABBREVIATIONS) + r")\.)\s+"
_SENT = f"""list_transform(string_split(regexp_replace(regexp_replace(line, '{_ABBR}', '\\1' || chr(2), 'g'), '([.!?])\\s+(["“''(\\[]?[A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: replace(s, chr(2), ' '))"""
PACK = f"""
WITH RECURSIVE lines AS MATERIALIZED (SELECT doc_id, li, trim(line) AS line FROM (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS li FROM
    (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE len(text) > 1500)) WHERE trim(line) <> ''),
sent AS MATERIALIZED (SELECT doc_id, li, unnest(s) AS t, generate_subscripts(s, 1) AS k FROM (SELECT doc_id, li, {_SENT} AS s FROM lines WHERE len(line) > 1500)),
words AS MATERIALIZED (SELECT doc_id, li, k, string_split(t, ' ') AS w FROM sent WHERE len(t) > 1500),
hw AS (SELECT doc_id, li, k, w, 1 AS i, 1 AS j, len(w[1]) AS n FROM words UNION ALL
  SELECT doc_id, li, k, w, i + 1, CASE WHEN n > 0 AND n + 1 + len(w[i + 1]) > 1500 THEN j + 1 ELSE j END,
    CASE WHEN n > 0 AND n + 1 + len(w[i + 1]) > 1500 THEN len(w[i + 1]) WHEN n > 0 THEN n + 1 + len(w[i + 1]) ELSE len(w[i + 1]) END FROM hw WHERE i < len(w)),
units AS (SELECT doc_id, li, 0 AS k, 0 AS j, len(line) AS n FROM lines WHERE len(line) <= 1500
  UNION ALL SELECT doc_id, li, k, 0, len(t) FROM sent WHERE len(t) <= 1500 AND trim(t) <> ''
  UNION ALL SELECT doc_id, li, k, j, max(n) FROM hw GROUP BY doc_id, li, k, j),
docs AS MATERIALIZED (SELECT doc_id, list(n ORDER BY li, k, j) AS u, sum(n) / ceil(sum(n) / 1500.0) AS mean FROM units GROUP BY doc_id),
pk AS (SELECT doc_id, u, mean, 1 AS i, 1 AS part, u[1] AS cur FROM docs UNION ALL
  SELECT doc_id, u, mean, i + 1, CASE WHEN cur + 1 + u[i + 1] > 1500 OR cur >= mean THEN part + 1 ELSE part END,
    CASE WHEN cur + 1 + u[i + 1] > 1500 OR cur >= mean THEN u[i + 1] ELSE cur + 1 + u[i + 1] END FROM pk WHERE i < len(u)),
parts AS (SELECT doc_id, max(cur) AS n FROM pk GROUP BY doc_id, part UNION ALL SELECT doc_id, len(text) FROM documents WHERE len(text) <= 1500 AND trim(text) <> '')
SELECT lang, count(*) AS clauses, min(n)::BIGINT AS shortest, floor(median(n))::BIGINT AS middle, max(n)::BIGINT AS longest,
  count(*) FILTER (n < 150) AS n_short, count(*) FILTER (n > 1500) AS n_long, count(DISTINCT doc_id) AS docs FROM parts JOIN documents USING (doc_id) GROUP BY lang"""


def sentence_split(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    per_line = lines.select("doc_id", T.sentences(F.col("line")).alias("s"))
    chars = F.when(F.size("s") > 0, F.aggregate("s", F.lit(0), lambda a, x: a + F.length(x)))  # null for a document without sentences
    return per_line.groupBy("doc_id").agg(F.sum(F.size("s")).cast("long").alias("sentences"), F.sum(chars).cast("long").alias("chars"))


SENTENCES = f"""SELECT doc_id, sum(len(s)) AS sentences, sum(list_sum(list_transform(s, lambda x: len(x)))) AS chars FROM
(SELECT doc_id, list_filter({_SENT}, lambda s: trim(s) <> '') AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) GROUP BY doc_id"""


def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"), T.first_words(F.col("text"), 6).alias("first_words"), T.ascii_safe(T.snippet(F.col("text"), 3)).alias("ascii"))


SNIPPETS = """WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
SELECT doc_id, rtrim(array_to_string(w[1:8], ' '), ' ,;:.-') || CASE WHEN len(w) > 8 THEN '…' ELSE '' END AS snippet,
CASE WHEN len(w) > 6 THEN array_to_string(w[1:6], ' ') || '...' ELSE text END AS first_words,
regexp_replace(rtrim(array_to_string(w[1:3], ' '), ' ,;:.-') || CASE WHEN len(w) > 3 THEN '…' ELSE '' END, '[^\\x00-\\x7F]', '?', 'g') AS ascii FROM w"""


def slugs(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")).union(table(spark, sf_dir, "customer").select(F.concat(F.lit(" Mr. "), "c_name", F.lit(" & Söns -- "), "c_mktsegment")))
    return names.select("name", T.slugify(F.col("name")).alias("slug"))


SLUGS = """SELECT name, regexp_replace(lower(trim(regexp_replace(replace(name, 'ö', 'o'), '[^\\w\\s-]', '', 'g'))), '[\\s_-]+', '_', 'g') AS slug FROM
(SELECT n_name AS name FROM nation UNION ALL SELECT ' Mr. ' || c_name || ' & Söns -- ' || c_mktsegment FROM customer)"""


def cleaned_whole(spark, sf_dir):
    """Line ends, tags, runs of blanks and blank lines of web pages, in the JVM."""
    c = T.collapse_blank_lines(T.strip_tags(T.normalise_ends(F.col("html"))))
    return table(spark, sf_dir, "pages").select("page_id", T.collapse_inner(c).alias("text"))


CLEANED = r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(html, '\r\n?', chr(10), 'g'), chr(160), ' '), '</?[A-Za-z][^>]*>', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
 '\s+$', ''), '(\S)[ \t]{2,}', '\1 ', 'g') AS text FROM pages"""


def html_entities(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.unescape(T.strip_tags(F.col("html"))).alias("text"))


def _entities_sql(x: str) -> str:
    for name, char in T.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


ENTITIES = f"SELECT page_id, {_entities_sql(f'regexp_replace(html, {q(P.TAG)}, {chr(39) * 2}, {chr(39)}g{chr(39)})')} AS text FROM pages"


def html_flat(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.flat_text(F.col("html")).alias("text"))


def _flat_sql() -> str:
    x = "html"
    for tag in html.FLAT_DROPPED:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b.*?</{tag}>', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', chr(10), 'g'), '</?[A-Za-z][^>]*>', chr(10), 'g')"
    return f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({_entities_sql(x)}, chr(10)), lambda l: regexp_replace(l, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')), lambda l: l <> ''), chr(10) || chr(10)) AS text FROM pages"


def html_to_markdown(spark, sf_dir):
    return html.html_markdown(table(spark, sf_dir, "pages")).select("page_id", "text")


def extract_fallback(spark, sf_dir):
    """Of each page a short, a middle and a long candidate, by its id, and the one that is chosen."""
    flat = html_flat(spark, sf_dir).select("page_id", "text")
    sized = flat.select("page_id", *(F.array_join(F.slice(F.split("text", " "), 1, (F.col("page_id") * k % m).cast("int")), " ").alias(a) for a, k, m in (("one", 7, 61), ("two", 11, 97), ("three", 13, 400))))
    chosen = html.choose(F.col("one"), F.col("two"), F.col("three"), F.col("page_id") % 5 == 0)
    return sized.select("page_id", F.inline(F.array(chosen))).select("page_id", F.length("text").cast("long").alias("chars"), "tier", F.col("reason").isNotNull().alias("failed"))


EXTRACT = f"""WITH f AS ({_flat_sql()}), s AS (SELECT page_id, {", ".join(f"array_to_string(string_split(text, ' ')[1:page_id * {k} % {m}], ' ') AS {a}" for a, k, m in (("one", 7, 61), ("two", 11, 97), ("three", 13, 400)))} FROM f),
b AS (SELECT *, CASE WHEN len(one) < 200 THEN two ELSE one END AS base, CASE WHEN len(one) < 200 THEN 'walk' ELSE 'article' END AS bt FROM s),
c AS (SELECT *, page_id % 5 <> 0 AND len(base) < 2000 AND len(three) > len(base) AS br FROM b)
SELECT page_id, len(CASE WHEN br THEN three ELSE base END) AS chars, CASE WHEN br THEN 'browser' ELSE bt END AS tier, len(CASE WHEN br THEN three ELSE base END) < 100 AS failed FROM c"""


def host_allowlist(spark, sf_dir):
    """Pages whose host is on a list, taken from the pages of even id; a broadcast semi-join for a list, here the same table."""
    p = table(spark, sf_dir, "pages").select("page_id", "url")
    some = p.where(F.col("page_id") % 7 == 0).select(T.host(F.col("url")).alias("host")).distinct().withColumn("allowed", F.lit(True))
    verdicts = p.select(T.host(F.col("url")).alias("host")).distinct().join(some, "host", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))
    return sources.gate(p, verdicts).where("allowed").select("page_id", "host")


HOSTS = r"""WITH p AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1)) AS host FROM pages)
SELECT page_id, host FROM p WHERE host IN (SELECT host FROM p WHERE page_id % 7 = 0)"""


def clause_split_full(spark, sf_dir):
    """Structured lines assembled to texts, cleaned and split: the whole path from document to clauses."""
    from clauseloom.operators.lines import assemble

    texts = assemble(structured_lines(spark, sf_dir))
    return clauses.split(texts, clean=True).select("doc_id", "id", "heading", "text", "error")


def clause_merge(spark, sf_dir):
    """Turns of a conversation, short ones merged with their neighbours."""
    return clauses.merge_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def clause_sql(spark, sf_dir):
    """split_clauses() as a table function in SQL."""
    clauses.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("_documents")
    return spark.sql("SELECT d.doc_id, c.id, length(c.text) AS chars FROM _documents d, LATERAL split_clauses(d.text, 150, 1500, d.source) c")


QUERIES = {
    "clause_pack_stats": clause_pack_stats, "sentence_split": sentence_split, "snippets": snippets, "slugify": slugs, "page_cleaning": cleaned_whole,
    "html_entities": html_entities, "html_flat": html_flat, "html_to_markdown": html_to_markdown, "extract_fallback": extract_fallback,
    "host_allowlist": host_allowlist, "clause_split_full": clause_split_full, "clause_merge": clause_merge, "clause_sql": clause_sql,
}

ORACLES = {
    "clause_pack_stats": PACK, "sentence_split": SENTENCES, "snippets": SNIPPETS, "slugify": SLUGS, "page_cleaning": CLEANED,
    "html_entities": ENTITIES, "html_flat": _flat_sql(), "extract_fallback": EXTRACT, "host_allowlist": HOSTS,
}
