"""Token counts by offset-mapped attribution (8).

Each document is encoded once, as a whole; the byte lengths of its tokens give their spans, and a sorted interval join
of the spans with the document's sections counts tokens by section. Sections tile the text, so counts add up to the
document's. Rule for a token that crosses a boundary: it belongs to the section in which it starts (``rule="start"``)
or to the one that holds most of its bytes, the earlier of equals (``rule="most"``).

Sections are lines with their line ends by default, or given spans in code points (``sections``: a column of
array<struct<start, end>> that tiles the text). Documents are independent: one scan, no shuffle.

Null or empty text: one section, 0 to 0, without tokens. Repeated rows get equal results. An empty table gives an empty
result. Only the columns named are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.llm.common import documents

OUT_ROWS = 50_000


def public_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _encoding(path: str, pattern: str):
    """Encoder and byte length of every token; one for each worker process."""
    import base64

    import numpy as np
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_clauseloom_kept", {})
    if (path, pattern) not in kept:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        kept[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return kept[path, pattern]


def attribute(spans, edges, rule: str):
    """Tokens by section, and those that cross. spans: token edges in bytes, 0 first; edges: section edges in bytes."""
    import numpy as np

    starts, ends = spans[:-1], spans[1:]
    first = np.searchsorted(edges, starts, side="right") - 1
    last = np.searchsorted(edges, ends, side="left") - 1
    own, n = first, len(edges) - 1
    cross = last > first
    if rule == "most" and cross.any():
        own = first.copy()
        for t in np.flatnonzero(cross):
            cut = np.clip(edges[first[t] : last[t] + 2], starts[t], ends[t])
            own[t] = first[t] + int(np.argmax(np.diff(cut)))
    return np.bincount(own, minlength=n)[:n], np.bincount(own[cross], minlength=n)[:n]


def section_tokens(df: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", sections: str | None = None, rule: str = "start") -> DataFrame:
    """(doc_id, section, start, end, n_tokens, n_crossing), a row for each section; start and end in code points."""
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t"), *([F.transform(sections, lambda s: s["end"].cast("long")).alias("_s")] if sections else []))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("section", "start", "end", "n_tokens", "n_crossing"))])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        encoding, sizes = _encoding(path, pattern)

        def one(t: str, given):
            raw = np.frombuffer(t.encode(), dtype=np.uint8)
            places = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # byte offset of each code point
            if given is None:
                edges = np.unique(np.r_[0, np.flatnonzero(raw == 10) + 1, len(raw)]) if len(raw) else np.array([0, 0])
            else:
                edges = places[np.r_[0, np.asarray(given, dtype=np.int64)]]
            ids = np.asarray(encoding.encode_ordinary(t), dtype=np.int64)
            spans = np.r_[0, np.cumsum(sizes[ids])]
            counts, crossing = attribute(spans, edges, rule) if len(ids) else (np.zeros(len(edges) - 1, np.int64),) * 2
            chars = np.searchsorted(places, edges)
            return np.arange(len(counts)), chars[:-1], chars[1:], counts, crossing

        for b in batches:
            for s in range(0, b.num_rows, 256):
                part, found, at, n = b.slice(s, 256), [], [], 0
                given = part.column(2).to_pylist() if sections else [None] * part.num_rows
                for i, (t, g) in enumerate(zip(part.column(1).to_pylist(), given, strict=True)):
                    found.append(one(t or "", g))
                    at.append(np.full(len(found[-1][0]), i))
                    n += len(at[-1])
                    if n >= OUT_ROWS or i + 1 == part.num_rows:
                        columns = [pa.array(np.concatenate([x[c] for x in found]).astype(np.int64)) for c in range(5)]
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.concatenate(at))), *columns], schema.names)
                        found, at, n = [], [], 0

    return rows.mapInArrow(run, schema)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_tokens(documents(spark, sf_dir), public_path(), public_tokenizers.PATTERN)
