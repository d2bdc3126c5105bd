"""Text of web pages: an element walk for Markdown-like lines, a flat variant, and their choice by length."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.functions import text as X
from clauseloom.operators.clauses import flat_map

# Subtrees that hold no text of interest, and the mark before the text of an element.
DROPPED = frozenset("script style nav header footer aside form noscript iframe svg".split())
FLAT_DROPPED = "script style nav footer header noscript".split()
MARKS = {"h1": "# ", "h2": "## ", "h3": "### ", "h4": "#### ", "h5": "#### ", "h6": "#### ", "li": "- "}
CONTAINERS = frozenset("p div section article".split())
LEAST_CONTAINER = 20
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An open paragraph ends where one of these begins.
CLOSES_P = CONTAINERS | frozenset("h1 h2 h3 h4 h5 h6 ul ol li table blockquote pre".split())


class _Walk(HTMLParser):
    """Elements in the order of their start, each with all the text below it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, list[str]]] = []
        self.open: list[tuple[str, list[str] | None]] = []
        self.dropped = 0

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and self.open and any(t == "p" for t, _ in self.open):
            self.handle_endtag("p")
        if tag in VOID:
            return
        self.dropped += tag in DROPPED
        texts: list[str] | None = None
        if not self.dropped and (tag in MARKS or tag in CONTAINERS):
            texts = []
            self.found.append((tag, texts))
        self.open.append((tag, texts))

    def handle_endtag(self, tag):
        if any(t == tag for t, _ in self.open):
            while True:
                name, _ = self.open.pop()
                self.dropped -= name in DROPPED
                if name == tag:
                    break

    def handle_data(self, data):
        if not self.dropped and (s := data.strip()):
            for _, texts in self.open:
                if texts is not None:
                    texts.append(s)


def markdown(html: str) -> str:
    """Headings, items and paragraphs as marked lines; a container repeats the text of those inside it."""
    walk = _Walk()
    walk.feed(html)
    walk.close()
    out = []
    for tag, texts in walk.found:
        text = " ".join(texts)
        if tag in MARKS and text:
            out.append(MARKS[tag] + text)
        elif tag in CONTAINERS and len(text) > LEAST_CONTAINER:
            out.append(text)
    return "\n\n".join(out)


def html_markdown(df: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    return flat_map(df, html, keep or ["page_id"], [T.StructField("text", T.StringType())], lambda h: [(markdown(h),)])


def flat_text(html: Column) -> Column:
    """Tags and dropped subtrees out, named entities decoded, one line for each run of text; in the JVM."""
    c = html
    for tag in FLAT_DROPPED:
        c = F.regexp_replace(c, rf"(?is)<{tag}\b.*?</{tag}>", "\n")
    c = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", "\n"), r"</?[A-Za-z][^>]*>", "\n")
    lines = F.filter(F.transform(F.split(X.unescape(c), "\n"), lambda x: X.strip(x)), lambda x: x != "")
    return F.array_join(lines, "\n\n")


def choose(first: Column, second: Column, third: Column, is_pdf: Column, error: Column | None = None, short: int = 200, wanted: int = 2000, least: int = 100) -> Column:
    """struct(text, tier, reason): the article text, below ``short`` the walk, below ``wanted`` the longer of that and the browser's.

    Write each costly candidate only for the rows that need it: filter, then union.
    """
    base = F.when(F.length(first) < short, second).otherwise(first)
    tier = F.when(F.length(first) < short, F.lit("walk")).otherwise(F.lit("article"))
    browser = ~is_pdf & (F.length(base) < wanted) & (F.length(third) > F.length(base))
    text = F.when(browser, third).otherwise(base)
    reason = F.when(F.length(text) < least, F.coalesce(error if error is not None else F.lit(None).cast("string"), F.lit(f"Extraction yielded < {least} chars")))
    return F.struct(text.alias("text"), F.when(browser, "browser").otherwise(tier).alias("tier"), reason.alias("reason"))
