"""Secret scans with multipart credential linking (2), DataFrame functions only.

Strong kinds are reported wherever they stand: ``assign`` (a named secret and its value), ``access`` (an access
identifier) and ``hex`` (a long hexadecimal run). Weak kinds are reported only if a complementary part starts within
``scope`` code points of them in the same text:

- ``key``: a mixed-case token of 40 or more characters, beside an access identifier or an endpoint,
- ``endpoint``: a URL or connection string, beside an access identifier, an assigned secret or a ``key``.

The interval join of the parts is a pair of range-framed windows over a document's spans, so it sorts spans instead of
pairing them. Texts don't leave the scan: a span is five numbers, and the one exchange carries spans and one row for
each document.

Null or empty text: no spans. Equal spans of one kind can't occur; repeated rows each get a row. An empty table gives
an empty result. Only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.llm.common import documents, whole_text

# The patterns of the kinds, in the order in which spans of equal start are listed.
ASSIGN = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEY = r"[A-Za-z0-9+/]{40,}"
ENDPOINT = r"[a-z][a-z0-9+]{1,15}://[^\x20\x09-\x0D\"'<>]{4,}"
KINDS = ["assign", "access", "hex", "key", "endpoint"]
STRONG = 3
SCOPE = 400
MIN_ASSIGN = 6


def _matches(text: Column, kind: int, pattern: str, present: Column, long_enough) -> Column:
    """Array of (kind, gap to the match before, length, whether it counts) of all leftmost matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    rows = F.zip_with(found, F.slice(gaps, 1, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda m, g: F.struct(F.lit(kind).alias("kind"), F.length(g).alias("gap"), F.length(m).alias("len"), long_enough(m).alias("ok")))
    none = F.array().cast("array<struct<kind:int,gap:int,len:int,ok:boolean>>")
    return F.when(present & F.regexp_like(text, F.lit(pattern)), rows).otherwise(none)


def _always(m: Column) -> Column:
    return F.lit(True)


def secret_spans(df: DataFrame, doc_id: str = "doc_id", text: str = "text", scope: int = SCOPE, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each of df's: doc_id, the columns in ``keep`` and ``spans``, an array of (start, kind number, end), in code points, end exclusive."""
    t = F.col("_t")
    base = df.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("_t"), F.monotonically_increasing_id().alias("_uid"), *keep)
    mixed = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    kinds = [
        _matches(t, 0, ASSIGN, F.contains(t, F.lit("=")) | F.contains(t, F.lit(":")), lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= MIN_ASSIGN),
        _matches(t, 1, ACCESS, F.contains(t, F.lit("AKIA")), _always),
        _matches(t, 2, HEX, F.lit(True), _always),
        _matches(t, 3, KEY, F.lit(True), mixed),
        _matches(t, 4, ENDPOINT, F.contains(t, F.lit("://")), _always),
    ]
    document = F.array(F.struct(F.lit(-1).alias("kind"), F.lit(0).alias("gap"), F.lit(0).alias("len"), F.lit(False).alias("ok")))
    rows = base.select("_uid", "doc_id", *keep, F.posexplode(F.concat(document, *kinds)).alias("_i", "_m")).select("_uid", "doc_id", *keep, "_i", "_m.*")
    order = Window.partitionBy("_uid", "doc_id", "kind").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("len")).over(order)).withColumn("start", F.col("end") - F.col("len"))
    near = Window.partitionBy("_uid", "doc_id").orderBy("start").rangeBetween(-scope, scope)
    has = lambda *k: F.coalesce(F.max(F.col("ok") & F.col("kind").isin(*k)).over(near), F.lit(False))
    linked = ends.withColumn("access_near", has(1)).withColumn("secret_near", has(0, 3)).withColumn("endpoint_near", has(4))
    reported = F.col("ok") & (F.col("kind").between(0, STRONG - 1) | ((F.col("kind") == 3) & (F.col("access_near") | F.col("endpoint_near"))) | ((F.col("kind") == 4) & (F.col("access_near") | F.col("secret_near"))))
    span = F.struct("start", "kind", "end")
    return linked.groupBy("_uid", "doc_id", *keep).agg(F.array_sort(F.collect_list(F.when(reported, span))).alias("spans")).select("doc_id", *keep, "spans")


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every reported span, or run of overlapping ones, replaced by the mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a, s):
        text_between = F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise(a["out"])
        return F.struct(text_between.alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    whole = F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def op2_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))
    strong = F.filter("spans", lambda s: s["kind"] < STRONG)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(strong), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        count(3).alias("n_key"), count(4).alias("n_endpoint"),
    )


# The same in SQL: positions by counting through matches and gaps.
_SQL_KIND = """
SELECT u, {k} AS kind, generate_subscripts(m, 1) AS i, unnest(m) AS hit, unnest(g[1:len(m)]) AS gap
FROM (SELECT u, regexp_extract_all(t, {p}) AS m, string_split_regex(t, {p}) AS g FROM d)"""


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents),
h AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY u, kind ORDER BY i) AS e FROM (
{" UNION ALL ".join(_SQL_KIND.format(k=k, p=_quoted(p)) for k, p in enumerate([ASSIGN, ACCESS, HEX, KEY, ENDPOINT]))})),
s AS MATERIALIZED (SELECT u, kind, e - length(hit) AS a, e FROM h
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(hit, {_quoted(ASSIGN)}, 2)) >= {MIN_ASSIGN}
    WHEN 3 THEN regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]') ELSE true END),
r AS (SELECT * FROM s WHERE kind < 3
  OR kind = 3 AND EXISTS (SELECT 1 FROM s o WHERE o.u = s.u AND o.kind IN (1, 4) AND abs(o.a - s.a) <= {SCOPE})
  OR kind = 4 AND EXISTS (SELECT 1 FROM s o WHERE o.u = s.u AND o.kind IN (0, 1, 3) AND abs(o.a - s.a) <= {SCOPE})),
w AS (SELECT u, kind, a, e, (['assign', 'access', 'hex', 'key', 'endpoint'])[kind + 1] || ':' || a::BIGINT || ':' || e::BIGINT AS x FROM r)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(x, ',' ORDER BY a, kind) FILTER (kind < 3), '')) AS base_sha256,
  coalesce(string_agg(x, ',' ORDER BY a, kind), '') AS spans,
  count(*) FILTER (kind = 3) AS n_key, count(*) FILTER (kind = 4) AS n_endpoint
FROM d LEFT JOIN w USING (u) GROUP BY d.u, d.doc_id
"""
