"""The source catalogue (CSV) and the fetching of what it lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions import text as T

FETCHED = "url string, html string, pdf binary, ctype string, err string"
# Hosts that are read whatever their robots file says, by default none; a parameter of gate().
ALLOWED_HOSTS: list[str] = []


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: names and values stripped, null as empty, a byte order mark dropped, doubled quotes read as quotes."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    return raw.select(*(F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c.replace("﻿", "").strip()) for c in raw.columns))


def wanted(catalogue: DataFrame, include_privacy: bool = False) -> DataFrame:
    return catalogue.where((F.col("url") != "") & T.is_terms_row(F.col("document_type"), include_privacy))


def not_yet_built(companies: DataFrame, existing: DataFrame, company: str = "company", file: str = "file") -> DataFrame:
    """Rows whose company has no output file yet."""
    built = existing.select(F.regexp_replace(file, r"\.[^.]*$", "").alias("_slug")).distinct()
    return companies.join(built, T.slugify(F.col(company)) == F.col("_slug"), "left_anti")


def gate(rows: DataFrame, robots: DataFrame | None = None, allowed_hosts: list[str] = ALLOWED_HOSTS) -> DataFrame:
    """``allowed``: the host is on the list, or its robots verdict (host, allowed) isn't no; unknown counts as yes."""
    rows = rows.withColumn("host", T.host(F.col("url")))
    if robots is None:
        return rows.withColumn("allowed", F.lit(True))
    verdict = robots.select(F.col("host").alias("_host"), F.col("allowed").alias("_allowed"))
    listed: Column = F.col("host").isin(allowed_hosts) if allowed_hosts else F.lit(False)
    return rows.join(verdict, F.col("host") == F.col("_host"), "left").withColumn("allowed", listed | F.coalesce("_allowed", F.lit(True))).drop("_host", "_allowed")


def fetch(rows: DataFrame, reader: Callable[[str], tuple], delay: float = 0.0) -> DataFrame:
    """rows with ``f`` (html, pdf, ctype, err) from reader(url) -> (payload, ctype, err), called on the executors with a pause between calls.

    The reader decides how to fetch; an exception becomes err. Repartition by host before, to bound the load on each.
    """
    from pyspark.sql import types as S

    made = S.StructType.fromDDL("html string, pdf binary, ctype string, err string")
    schema = S.StructType([*rows.schema.fields, *made.fields])

    def run(batches):
        import time

        import pyarrow as pa

        for b in batches:
            out: list[list] = [[], [], [], []]
            for url in b.column(b.schema.get_field_index("url")).to_pylist():
                try:
                    payload, ctype, err = reader(url)
                except Exception as e:
                    payload, ctype, err = None, None, str(e)
                is_pdf = ctype == "pdf"
                for column, x in zip(out, (None if is_pdf else payload, payload if is_pdf else None, ctype, err), strict=True):
                    column.append(x)
                time.sleep(delay)
            types = [pa.string(), pa.binary(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(out, types, strict=True))], schema.names)

    return rows.mapInArrow(run, schema)


def dispatch(sources: DataFrame, source: str = "source") -> DataFrame:
    """``kind`` of each given source: a url, a path of one line under 500 characters to a pdf or text file, or the text itself."""
    s = F.col(source)
    one_line = ~F.contains(s, F.lit("\n")) & (F.length(s) < 500)
    kind = F.when(s.rlike(r"^https?://\S+$"), "url").when(one_line & F.lower(s).endswith(".pdf"), "pdf").when(one_line & s.rlike(r"(?i)\.(?:md|txt|html?)$"), "file").otherwise("text")
    return sources.withColumn("kind", kind)


def http_reader(timeout: float = 30.0, user_agent: str = "Mozilla/5.0") -> Callable[[str], tuple]:
    """A reader for fetch() on the standard library: follows redirects, tells PDF by type or name, maps errors to text."""

    def read(url: str) -> tuple:
        import urllib.error
        import urllib.request

        request = urllib.request.Request(url, headers={"User-Agent": user_agent, "Accept": "text/html,application/pdf;q=0.9,*/*;q=0.8"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                body, kind = r.read(), r.headers.get("Content-Type", "")
                if "pdf" in kind.lower() or url.lower().endswith(".pdf"):
                    return body, "pdf", None
                return body.decode(r.headers.get_content_charset() or "utf-8", "replace"), "html", None
        except urllib.error.HTTPError as e:
            return None, None, f"HTTP {e.code}"
        except TimeoutError:
            return None, None, "Timeout"
        except urllib.error.URLError as e:  # connecting timed out, or failed
            return None, None, "Timeout" if isinstance(e.reason, TimeoutError) else str(e.reason)

    return read


def pdf_text(files: DataFrame, content: str = "content") -> DataFrame:
    """``text`` of PDF bytes, pages apart by a blank line; empty where no reader is installed or the file can't be read."""
    from pyspark.sql import types as S

    schema = S.StructType([*files.schema.fields, S.StructField("text", S.StringType())])

    def run(batches):
        import io

        import pyarrow as pa

        def text(raw: bytes) -> str:
            try:
                import pdfplumber

                with pdfplumber.open(io.BytesIO(raw)) as pdf:
                    return "\n\n".join(filter(None, (p.extract_text() for p in pdf.pages)))
            except Exception:
                return ""

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([text(x) for x in b.column(b.schema.get_field_index(content)).to_pylist()], pa.string())], schema.names)

    return files.mapInArrow(run, schema)


def load_sources(given: DataFrame, reader: Callable[[str], tuple] | None = None, source: str = "source") -> DataFrame:
    """``given`` with kind and ``text``: of a url what the reader fetches, as text (a page's runs of text apart by blank lines,
    a PDF's pages); of a file its text; of a text itself. What can't be read has an empty text and ``err``."""
    from clauseloom.operators.html import flat_text

    rows = dispatch(given, source)
    none = F.lit(None).cast("string")
    fetched = fetch(rows.where("kind = 'url'").withColumn("url", F.col(source)), reader or http_reader(20.0))
    page = F.regexp_replace(flat_text(F.coalesce("html", F.lit(""))), r"\s*\n\s*", "\n\n")
    pages = pdf_text(fetched, "pdf").withColumn("text", F.when(F.col("ctype") == "pdf", F.col("text")).otherwise(page))
    urls = pages.select(*given.columns, "kind", "text", "err")
    plain = rows.where("kind = 'text'").select(*given.columns, "kind", F.col(source).alias("text"), none.alias("err"))
    return urls.unionByName(plain).unionByName(_load_files(rows.where("kind in ('file', 'pdf')"), given.columns, source))


def _load_files(rows: DataFrame, keep: list[str], source: str) -> DataFrame:
    """Files by path through the cluster's file system; a path that isn't there counts as the text that it is."""
    from pyspark.sql import types as S

    schema = S.StructType([*rows.schema.fields, S.StructField("content", S.BinaryType()), S.StructField("err", S.StringType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.fs as pafs

        def read(path: str):
            try:
                fs, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
                with fs.open_input_stream(at) as f:
                    return f.read(), None
            except FileNotFoundError:
                return None, None
            except Exception as e:
                return b"", str(e)

        for b in batches:
            found = [read(x) for x in b.column(b.schema.get_field_index(source)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.binary()), pa.array([e for _, e in found], pa.string())], schema.names)

    files = pdf_text(rows.mapInArrow(run, schema))
    text = F.when(F.col("content").isNull(), F.col(source)).when(F.col("kind") == "pdf", F.col("text")).otherwise(F.decode("content", "UTF-8"))
    return files.withColumn("text", text).select(*keep, "kind", "text", "err")


def literal_json(spark: SparkSession, raw: str, schema: str) -> DataFrame:
    """Rows of a JSON array given in the program."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(raw), f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in schema.split(','))}>>")))


def inline_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(company, text) of texts given in the program."""
    return spark.createDataFrame(list(texts.items()), "company string, text string")
