"""Quality rules by distribution divergence (10), DataFrame functions only.

A document's histograms of character classes and of common words are compared with language references by the
Jensen-Shannon distance (base 2, 0 to 1); the nearest language counts. Words that are in no list of a language form one
class of their histogram. Guards: a text of fewer than ``min_words`` words isn't judged by its characters, one of fewer
than ``min_words_common`` words isn't judged by those.
Repetition and symbol counts stand beside these.

Everything is computed row by row: one scan, no shuffle, whatever the size of the table.

Null or empty text: no words, all counts 0, ``base_failed`` true. Repeated rows get equal results. An empty table
gives an empty result. Other columns of the input are kept out of the result unless named in ``keep``.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauseloom.llm.common import bind, documents, whole_text, words

# Shares of the character classes in running prose. Classes: lower-case letters and the rest,
# upper-case letters, digits, punctuation, symbols, white space.
CLASS_REFERENCE = {
    "en": [0.786, 0.025, 0.004, 0.025, 0.001, 0.159],
    "de": [0.800, 0.045, 0.004, 0.023, 0.001, 0.127],
    "fr": [0.785, 0.025, 0.004, 0.030, 0.001, 0.155],
    "es": [0.790, 0.025, 0.004, 0.026, 0.001, 0.154],
}

# The commonest words of running prose by language, the most frequent first.
WORD_REFERENCE = {
    "en": "the of and to in a is that for it as was with be by on not he i this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no out up into than them only other its time new some could these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine seiner worden will zwischen immer was sagte gibt alle seit muss doch jetzt drei".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son ses aux ou comme mais nous on sa cette leur deux fait été bien entre sans peut tout ces même faire après elle si dont était je être aussi ont encore vous y moins lui leurs premier quand temps où très sous contre avant avoir toujours autres années peu trois ans autre alors".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada e vida otro después te otros aunque esa eso hace otra tan durante siempre día tanto ella tres sí dijo sido gran país según menos".split(),
}
#: Share of running words that a language's list covers; the word of rank r has a share in proportion to 1 / (r + 2.7).
COVERED, RANK_SHIFT = 0.45, 2.7

MIN_WORDS, MIN_WORDS_COMMON = 40, 60
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.48
#: What is taken off a word's ends before it is looked up, in lower case.
WORD_ENDS = ".,;:!?"

_SYMBOLS = "[^#*$%&|<>]+"
_PUNCTUATION = r"[^.,;:!?'\"()\x{2018}-\x{201f}\x{2013}\x{2014}\x{ab}\x{bb}\x{a1}\x{bf}-]+"


def _plogp(x: Column) -> Column:
    return F.when(x > 0, x * F.log2(x)).otherwise(0.0)


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def jensen_shannon(p: list[Column], q: list[float]) -> Column:
    """Distance, 0 to 1, of shares p from a reference q: entropy of the mixture less the mean entropy."""
    q = [x / sum(q) for x in q]
    mixture = _sum([_plogp((x + F.lit(y)) / 2) for x, y in zip(p, q, strict=True)])
    own = _sum([_plogp(x) for x in p]) + F.lit(sum(y * math.log2(y) for y in q if y))
    return F.sqrt(F.greatest(F.lit(0.0), own / 2 - mixture))


def shares(counts: list[Column], total: Column) -> list[Column]:
    return [x / F.greatest(total, F.lit(1)) for x in counts]


def word_shares(words: list[str]) -> dict[str, float]:
    """Share of each word of a list in running prose, by its rank."""
    part = [1 / (r + RANK_SHIFT) for r in range(1, len(words) + 1)]
    return {w: COVERED * x / sum(part) for w, x in zip(words, part, strict=True)}


def word_distance(words: list[str]) -> Column:
    """Jensen-Shannon distance of a text's words from one language's, with one class for all words not in its list.

    Reads ``_kinds``, the text's common words with their counts, and ``n_words``. A word of the list that the text hasn't
    adds half its share, so only words that it has are looked at one by one.
    """
    total = sum(1 / (r + RANK_SHIFT) for r in range(1, len(words) + 1))
    share = lambda w: F.lit(COVERED / total) / (F.array_position(F.lit(words), w) + F.lit(RANK_SHIFT))
    half = lambda x, y: F.when(x > 0, x / 2 * F.log2(2 * x / (x + y))).otherwise(0.0)
    pairs = F.transform(F.filter("_kinds", lambda k: k["w"].isin(words)), lambda k: F.struct((k["c"] / F.col("n_words")).alias("p"), share(k["w"]).alias("q")))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in "dpq"))
    sums = F.aggregate(pairs, zero, lambda s, x: F.struct((s["d"] + half(x["p"], x["q"]) + half(x["q"], x["p"])).alias("d"), (s["p"] + x["p"]).alias("p"), (s["q"] + x["q"]).alias("q")))

    def distance(s: Column) -> Column:
        mine, theirs = F.greatest(1 - s["p"], F.lit(0.0)), F.lit(1 - COVERED)
        return F.sqrt(F.greatest(F.lit(0.0), s["d"] + (F.lit(COVERED) - s["q"]) / 2 + half(mine, theirs) + half(theirs, mine)))

    return bind(sums, distance)


def window_hashes(w: Column, n: Column, size: int) -> Column:
    """Hashes of all windows of ``size`` words, joined from hashes of shorter windows."""

    def join(a: Column, b: Column, skip: int) -> Column:
        tail = F.slice(b, skip + 1, F.greatest(F.size(b) - skip, F.lit(0)))
        return bind(tail, lambda y: F.zip_with(F.slice(a, 1, F.size(y)), y, lambda p, q: F.xxhash64(p, q)))

    def grow(one: Column) -> Column:
        def step(have: Column, k: int) -> Column:
            if k == size:
                return have
            return bind(join(have, have, k), lambda h: step(h, 2 * k)) if 2 * k <= size else bind(join(have, one, k), lambda h: step(h, k + 1))

        return step(one, 1)

    made = bind(F.transform(w, lambda x: F.xxhash64(x)), grow)
    return F.when(n >= size, made).otherwise(F.array().cast("array<bigint>"))


def repeated_starts(h: Column) -> Column:
    """Places, in order, of the hashes that stand twice or more in the array."""
    ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def equal(a: Column, b: Column) -> Column:
        return F.coalesce(a["h"] == b["h"], F.lit(False))

    def marked(o: Column) -> Column:
        # in hash order an equal one is a neighbour
        twice = F.filter(o, lambda x, i: equal(F.get(o, i - 1), x) | equal(F.get(o, i + 1), x))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    return bind(ordered, marked)


def _signals(df: DataFrame, text: str, keep: tuple[str, ...], window: int = 5, references: tuple[dict, dict] = (CLASS_REFERENCE, WORD_REFERENCE)) -> DataFrame:
    """The signals, and a row number that a verdict refers to: a filter on the verdict can't move below the row number, where it would spell out every step."""
    classes, common = references
    vocabulary = sorted({w for q in common.values() for w in q})
    bare = lambda x: F.lower(F.btrim(x, F.lit(WORD_ENDS)))
    kept = [F.col(c) for c in keep]
    step = df.select(*kept, whole_text(text).alias("_t"))
    step = step.select(*kept, "_t", words(F.col("_t")).alias("_w"))
    w, n = F.col("_w"), F.size("_w")
    step = step.select(
        *kept,
        F.length("_t").cast("long").alias("_chars"),
        n.cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("_lines"),
        F.length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("_upper"),
        F.regexp_replace("_t", r"[\p{L}\p{M}\x20\x09-\x0D]+", "").alias("_rest"),
        window_hashes(w, n, window).alias("_h"),
        F.filter(F.transform(w, bare), lambda x: x.isin(vocabulary)).alias("_common"),
    )
    step = step.select(
        "*",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("_rest", _SYMBOLS, "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_rest", r"\P{Nd}+", "")).cast("long").alias("_digits"),
        F.length(F.regexp_replace("_rest", _PUNCTUATION, "")).cast("long").alias("_points"),
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), repeated_starts(F.col("_h"))).otherwise(F.array().cast("array<int>")).alias("_starts"),
        F.size("_common").cast("long").alias("n_common"),
    )
    s = F.col("_starts")
    spread = F.transform(s, lambda p, k: F.least(F.lit(window), F.coalesce(F.get(s, k + 1) - p, F.lit(window))))
    other = F.length("_rest") - F.col("_digits") - F.col("_points")
    blank = F.col("_chars") - F.col("word_chars")
    plain = F.col("_chars") - F.col("_upper") - F.col("_digits") - F.col("_points") - other - blank
    step = step.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_common",
        F.aggregate(spread, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
        *(c.alias(f"_p{i}") for i, c in enumerate(shares([plain, F.col("_upper"), F.col("_digits"), F.col("_points"), other, blank], F.col("_chars")))),
        F.transform(F.array_distinct("_common"), lambda x: F.struct(x.alias("w"), (F.size("_common") - F.size(F.array_remove(F.col("_common"), x))).alias("c"))).alias("_kinds"),
    )
    return step.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common",
        reduce(F.least, [jensen_shannon([F.col(f"_p{i}") for i in range(6)], q) for q in classes.values()]).alias("class_distance"),
        reduce(F.least, [word_distance(q) for q in common.values()]).alias("word_distance"),
        F.monotonically_increasing_id().alias("_row"),
    )


def quality_signals(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), **more) -> DataFrame:
    """The columns in ``keep``, counts, the two distances and their guards' counts, one row for each of df's."""
    return _signals(df, text, keep, **more).drop("_row")


def quality_rules(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = MIN_WORDS, min_words_common: int = MIN_WORDS_COMMON, max_class: float = MAX_CLASS_DISTANCE, max_word: float = MAX_WORD_DISTANCE, **more) -> DataFrame:
    """``quality_signals`` with ``base_failed`` and ``kept``: false if a base rule fails or a distance is too large."""
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = ((F.col("n_words") >= min_words) & (F.col("class_distance") > max_class)) | ((F.col("n_words") >= min_words_common) & (F.col("word_distance") > max_word))
    found = _signals(df, text, keep, **more)
    return found.withColumn("base_failed", base).withColumn("kept", (F.col("_row") >= 0) & ~base & ~far).drop("_row")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


# The same in SQL, from the definitions: windows as rows, the distance as the mean divergence from the mixture.
def _sql_distance(p: list[str], q: list[float]) -> str:
    q = [x / sum(q) for x in q]
    terms = []
    for x, y in zip(p, q, strict=True):
        terms.append(f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({x} + {y!r})) ELSE 0 END")
        if y:
            terms.append(f"{y!r} * log2(2 * {y!r} / ({x} + {y!r}))")
    return f"sqrt(greatest(0, ({' + '.join(terms)}) / 2))"


_SHARES = ", ".join(f"('{lang}', '{w}', {q!r})" for lang, words in WORD_REFERENCE.items() for w, q in word_shares(words).items())


def _half(x: str, y: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} / 2 * log2(2 * {x} / ({x} + {y})) ELSE 0 END"


ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT u, doc_id, t, list_filter(string_split_regex(t, '[ 	-
]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS l, regexp_replace(t, '[\p{{L}}\p{{M}} 	-
]', '', 'g') AS r FROM d),
g AS (SELECT u, i, w[i:i + 4] AS g FROM (SELECT u, w, unnest(generate_series(1, len(w) - 4)) AS i FROM w WHERE len(w) >= 5)),
two AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT u, count(DISTINCT i + k) AS n FROM two, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY u),
c AS (SELECT u, doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(t) AS chars, len(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS up, len(regexp_replace(r, '\P{{Nd}}', '', 'g')) AS dg,
  len(regexp_replace(r, {"'" + _PUNCTUATION.replace("'", "''") + "'"}, '', 'g')) AS pt, len(r) AS rest FROM w LEFT JOIN cov USING (u)),
s AS (SELECT *, (word_chars - up - rest) / greatest(chars, 1.0) AS p0, up / greatest(chars, 1.0) AS p1, dg / greatest(chars, 1.0) AS p2, pt / greatest(chars, 1.0) AS p3,
  (rest - dg - pt) / greatest(chars, 1.0) AS p4, (chars - word_chars) / greatest(chars, 1.0) AS p5, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
q(lang, x, q) AS (VALUES {_SHARES}),
k AS (SELECT u, x, count(*) AS c FROM (SELECT u, lower(trim(unnest(w), '{WORD_ENDS}')) AS x FROM w) GROUP BY u, x),
f AS (SELECT u, lang, sum({_half('p', 'q')} + {_half('q', 'p')}) AS d, sum(p) AS p, sum(q) AS q FROM (SELECT u, lang, q, 1.0 * c / n_words AS p FROM k JOIN q USING (x) JOIN c USING (u)) GROUP BY u, lang),
e AS (SELECT u, lang, coalesce(d, 0) AS d, greatest(1 - coalesce(p, 0), 0) AS o, coalesce(q, 0) AS q FROM c CROSS JOIN (SELECT DISTINCT lang FROM q) LEFT JOIN f USING (u, lang)),
v AS (SELECT u, min(sqrt(greatest(0, d + ({COVERED} - q) / 2 + {_half('o', repr(1 - COVERED))} + {_half(repr(1 - COVERED), 'o')}))) AS word_d FROM e GROUP BY u),
j AS (SELECT *, least({", ".join(_sql_distance([f"p{i}" for i in range(6)], q) for q in CLASS_REFERENCE.values())}) AS class_d FROM s JOIN v USING (u))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words >= {MIN_WORDS} AND class_d > {MAX_CLASS_DISTANCE} OR n_words >= {MIN_WORDS_COMMON} AND word_d > {MAX_WORD_DISTANCE}) AS kept FROM j
"""
