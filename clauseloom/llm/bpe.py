"""BPE encoding and decoding by tree concatenation (4).

Each text is cut into leaves of ``leaf`` bytes wherever that falls, inside words too. The leaves of many texts are
encoded at once, as arrays: a leaf's pieces (runs between blanks, cut besides where the tokenizer's own pattern always
cuts, between letters and signs) are numbered, and only pieces that the worker doesn't know are given to the merges.
Then neighbours are joined, level by level of a binary tree: at each join a window of pieces on both sides is encoded
again from the text, and grows until its outer pieces have exactly the tokens that are already there on both sides.

A piece longer than a leaf isn't cut between leaves. It has its special tokens taken out, is normalised and
pre-tokenised as the tokenizer does it, and each of its long unsplit parts is encoded as a tree of its own, whose
windows are tokens. Every adjacent pair of tokens has then been seen together, so the joined tokens are exactly those of
the whole part.

Tokens are decoded by the rule for a tokenizer without a decoder, joined by blanks; one with a decoder is asked itself.
Documents are independent: one scan, no shuffle. A worker holds ``CHUNK`` bytes of texts at a time, a bounded table of
pieces, and one document's tokens.

Null or empty text: no tokens, decoded as the empty text. Repeated rows get equal results. An empty table gives an
empty result. Columns in ``keep`` are carried along; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseloom.llm.common import documents

LEAF = 1024
AGREE = 2
#: Bytes of text at a time, and pieces that a worker remembers at most, besides those of one chunk.
CHUNK, TABLE = 1 << 20, 150_000
#: Words that go to the merges as one text.
JOINED = 256
#: Pieces are apart here: a subset of what the tokenizer takes for white space.
BLANK = b" \n\t\r"
LETTERS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789"
#: A sign after a letter begins a piece; a letter after a sign does, but for one that may begin a contraction; a digit is
#: one. The bar of special tokens is no sign here.
AFTER = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~"
BEFORE = AFTER.replace(b"'", b"")
_AFTER, _BEFORE = re.escape(AFTER), re.escape(BEFORE)
SEAM = re.compile(
    b"(?<=[A-Za-z])(?=[%b])|(?<=[%b])(?=[A-Za-z])|(?<=[0-9])(?=[A-Za-z0-9%b])|(?<=[A-Za-z%b])(?=[0-9])" % (_AFTER, _BEFORE, _AFTER, _AFTER)
)
RUN = re.compile(b"[^ \n\t\r]+")


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Pieces of some bytes in order: where each starts and ends, and its number, equal for equal bytes."""

    def __init__(self, raw, edges):
        """edges: places, ascending, where a piece ends whatever stands there."""
        import numpy as np

        kind = np.zeros(256, dtype=np.uint8)
        for bit, which in ((1, BLANK), (2, LETTERS), (4, AFTER), (8, BEFORE), (16, DIGITS)):
            kind[np.frombuffer(which, dtype=np.uint8)] |= bit
        k = kind[raw]
        full = (k & 1) == 0
        cut = np.ones(len(raw) + 1, dtype=bool)
        a, b = k[:-1], k[1:]
        cut[1:-1] = (((a & 2) != 0) & ((b & 4) != 0)) | (((a & 8) != 0) & ((b & 2) != 0))
        cut[1:-1] |= (((a & 16) != 0) & ((b & 22) != 0)) | (((a & 22) != 0) & ((b & 16) != 0))
        cut[edges] = True
        before = np.r_[False, full[:-1]] if len(raw) else full
        after = np.r_[full[1:], False] if len(raw) else full
        self.start = np.flatnonzero(full & (cut[:-1] | ~before))
        self.end = np.flatnonzero(full & (cut[1:] | ~after)) + 1
        self.full = full

    def strings(self, raw):
        """The pieces as an Arrow array: what stands between them is left out, so they lie side by side."""
        import numpy as np
        import pyarrow as pa

        offsets = np.zeros(len(self.start) + 1, dtype=np.int64)
        np.cumsum(self.end - self.start, out=offsets[1:])
        return pa.Array.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[self.full])])


def pieces_of(text: bytes) -> list[tuple[int, int]]:
    """The same pieces of a short text: start and end of each."""
    out = []
    for m in RUN.finditer(text):
        ends = [x.start() for x in SEAM.finditer(m[0])]
        out += [(m.start() + a, m.start() + b) for a, b in zip([0, *ends], [*ends, len(m[0])], strict=True)]
    return out


class TreeBPE:
    """Encodes and decodes exactly as the tokenizer in the file at ``path`` does without added special tokens."""

    def __init__(self, path: str, leaf: int = LEAF, agree: int = AGREE, table: int = TABLE):
        import numpy as np
        import pyarrow as pa
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        plain = {"vocab": model["vocab"], "merges": merges}
        self.suffix = model.get("end_of_word_suffix") or ""
        #: Of a part's last piece, and of the others, whose last character doesn't end the word.
        ending = models.BPE(**plain, **({"end_of_word_suffix": self.suffix} if self.suffix else {}))
        self.ending = Tokenizer(ending)
        self.inner = Tokenizer(models.BPE(**plain))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.parts = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.token = [self.whole.id_to_token(i) or "" for i in range(self.whole.get_vocab_size())]
        self.ends = np.array([bool(self.suffix) and t.endswith(self.suffix) for t in self.token])
        #: For words of ASCII letters: normalised, parted by blanks, merged. It shares its model's memory.
        self.words = Tokenizer(ending)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.spaced = spec.get("decoder") is None
        self.leaf, self.agree, self.most = leaf, agree, table
        #: Row of each known piece; ids of row r are ids[start[r] : start[r + 1]]; whether a row was met, and met again.
        self.table: dict[bytes, int] = {}
        self.ids, self.start = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)
        self.used, self.again = np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
        self.probe()
        self.spelt = pa.array([f"{t} ".encode() for t in self.token], pa.large_binary())

    def probe(self) -> None:
        """Raises where the tokenizer doesn't cut at blanks and at all seams."""
        signs = AFTER.decode()
        for x in ["a b\nc\td", "1a2", "ab12cd", *(f"a{x}b{x}{x}1{x}c {x}'s'{x}" for x in signs), *(f"{x}{y}z{y}{x}9" for x, y in zip(signs, signs[1:], strict=False))]:
            raw, apart = x.encode(), []
            for a, b in pieces_of(raw):
                apart += self.whole.encode(raw[a:b].decode(), add_special_tokens=False).ids
            if self.whole.encode(x, add_special_tokens=False).ids != apart:
                raise ValueError(f"this tokenizer doesn't cut {x!r} where this operator does")

    # -- one unsplit part -----------------------------------------------------------------------------------------

    def tree(self, part: str) -> list[int]:
        """Token ids of one part that the tokenizer doesn't split before merging."""
        pieces = [part[i : i + self.leaf] for i in range(0, len(part), self.leaf)]
        *inner, last = pieces
        done = [e.ids for e in self.inner.encode_batch(inner, add_special_tokens=False)] + [self.ending.encode(last, add_special_tokens=False).ids]
        while len(done) > 1:
            done = [self.join(done[i], done[i + 1], i + 2 >= len(done)) if i + 1 < len(done) else done[i] for i in range(0, len(done), 2)]
        return done[0]

    def join(self, left: list[int], right: list[int], ends: bool) -> list[int]:
        size = 2 * self.agree
        while True:
            i, j = min(size, len(left)), min(size, len(right))
            window = left[len(left) - i :] + right[:j]
            at_end = ends and j == len(right)
            text = "".join(map(self.token.__getitem__, window))
            if at_end and self.suffix:
                text = text.removesuffix(self.suffix)
            new = (self.ending if at_end else self.inner).encode(text, add_special_tokens=False).ids
            k = self.agree
            if (i == len(left) or new[:k] == window[:k]) and (j == len(right) or new[-k:] == window[-k:]):
                return left[: len(left) - i] + new + right[j:]
            size *= 2

    def long_piece(self, piece: str) -> list[int]:
        ids: list[int] = []
        at = 0
        for m in [*self.parts.finditer(piece), None]:
            between = piece[at : m.start() if m else len(piece)]
            if between:
                for part, _ in self.whole.pre_tokenizer.pre_tokenize_str(self.normal(between)):
                    ids += self.tree(part)
            if m:
                ids.append(self.special[m[0]])
                at = m.end()
        return ids

    # -- pieces ---------------------------------------------------------------------------------------------------

    def merged(self, pieces: list[bytes]):
        """(places of the pieces in another order, their ids side by side, number of ids of each). Words of letters only
        go to the merges many in one text, apart by blanks: each gives one token that ends a word, so the tokens fall to
        them again; where the count is another, one by one."""
        import numpy as np

        order, flat, width = [], [], []
        plain = [bool(self.suffix) and len(p) <= 64 and p.isalpha() for p in pieces]
        text = {i: pieces[i].decode("utf-8", "replace") for i, x in enumerate(plain) if not x}
        word = [i for i, p in text.items() if self.suffix and len(p) <= 64 and p.isalpha() and unicodedata.is_normalized("NFC", p)]
        left = sorted(text.keys() - set(word))
        for own, encoder in (([i for i, x in enumerate(plain) if x], self.words), (word, self.whole)):
            runs = [own[s : s + JOINED] for s in range(0, len(own), JOINED)]
            joined = [" ".join([text[i] for i in run]) if encoder is self.whole else self.normal(b" ".join([pieces[i] for i in run]).decode()) for run in runs]
            for run, e in zip(runs, encoder.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=np.uint32)
                cuts = np.flatnonzero(self.ends[ids]) + 1
                if len(cuts) == len(run) and cuts[-1] == len(ids):
                    order += run
                    flat.append(ids)
                    width.append(np.diff(cuts, prepend=0))
                else:
                    left += run
        text |= {i: pieces[i].decode() for i in left if i not in text}
        short = [i for i in left if len(text[i]) <= self.leaf]
        found = dict(zip(short, (e.ids for e in self.whole.encode_batch_fast([text[i] for i in short], add_special_tokens=False)), strict=True))
        for i in left:
            ids = found[i] if i in found else self.long_piece(text[i])
            order.append(i)
            flat.append(np.array(ids, dtype=np.uint32))
            width.append(np.array([len(ids)]))
        return order, np.concatenate(flat), np.concatenate(width)

    def normal(self, text: str) -> str:
        return self.whole.normalizer.normalize_str(text) if self.whole.normalizer else text

    def known(self, pieces: list[bytes]):
        """Rows of the table for some different pieces, which are learnt before where they aren't in it."""
        import numpy as np

        if len(self.table) > self.most:
            self.forget()
        rows = list(map(self.table.get, pieces))
        new = [i for i, r in enumerate(rows) if r is None]
        if new:
            n, (order, ids, width) = len(self.start) - 1, self.merged([pieces[i] for i in new])
            self.ids = np.concatenate([self.ids, ids])
            self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(width)])
            self.used, self.again = (np.concatenate([x, np.zeros(len(new), dtype=bool)]) for x in (self.used, self.again))
            for r, k in enumerate(order, n):
                rows[new[k]] = r
                self.table[pieces[new[k]]] = r
        found = np.fromiter(rows, dtype=np.int64, count=len(rows))
        self.again[found] |= self.used[found]
        self.used[found] = True
        return found

    def forget(self) -> None:
        """Leaves in the table the short pieces that were met in two chunks or more, those longest in it, up to half of it."""
        import numpy as np

        keep = [(p, r) for p, r in self.table.items() if self.again[r] and len(p) <= 64]
        keep = keep[: self.most // 2]
        rows = np.array([r for _, r in keep], dtype=np.int64)
        self.ids, self.start = self.gathered(rows)
        self.table = {p: i for i, (p, _) in enumerate(keep)}
        self.used, self.again = np.ones(len(keep), dtype=bool), np.zeros(len(keep), dtype=bool)

    def gathered(self, rows):
        """(ids of the rows side by side, where each row's begin, and the end)."""
        import numpy as np

        low = self.start[rows]
        width = self.start[rows + 1] - low
        start = np.zeros(len(rows) + 1, dtype=np.int64)
        np.cumsum(width, out=start[1:])
        return self.ids[np.repeat(low - start[:-1], width) + np.arange(start[-1])], start

    # -- the tree of a chunk of texts -------------------------------------------------------------------------------

    def cuts(self, raw, bounds):
        """Places where leaves end within texts (bounds: ends of texts, from 0): on a character's first byte, and not
        within a run between blanks that is longer than a leaf."""
        import numpy as np

        sizes = np.diff(bounds)
        times = np.maximum(-(-sizes // self.leaf) - 1, 0)
        at = np.repeat(bounds[:-1] - self.leaf * (np.cumsum(times) - times), times) + self.leaf * np.arange(1, times.sum() + 1)
        padded = np.r_[raw, np.uint8(0)]
        for _ in range(3):
            at = at + ((padded[at] & 0xC0) == 0x80)
        blank = np.r_[(raw == 32) | (raw == 10) | (raw == 9) | (raw == 13), True]
        blank[bounds] = True
        # texts end at bounds, where the next one's first byte may stand, so one byte more or less doesn't matter
        apart = np.r_[-1, np.flatnonzero(blank)]
        i = np.searchsorted(apart, at)
        at = at[apart[i] - apart[np.maximum(i - 1, 0)] <= self.leaf]
        return at[np.r_[True, at[1:] > at[:-1]]] if len(at) else at

    def codes(self, raw, bounds):
        """(piece numbers of all texts in order, first piece of each text and the end, different pieces)."""
        import numpy as np

        cuts = self.cuts(raw, bounds)
        edges = np.unique(np.r_[cuts, bounds])
        found = Pieces(raw, edges)
        coded = found.strings(raw).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not len(cuts):
            return code, np.searchsorted(found.start, bounds), names
        # nodes of the tree: for each leaf the ranges of pieces that it holds
        at = np.searchsorted(found.start, edges)
        first = np.searchsorted(edges, bounds)
        number = {p: i for i, p in enumerate(names)}
        start, end, more = found.start, found.end, ([], [], [])
        n = len(code)
        nodes = [[(int(a), int(b))] for a, b in zip(at[:-1], at[1:], strict=True)]
        places = [list(range(a, b)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        text = raw.tobytes()

        def span(i):
            return (int(start[i]), int(end[i])) if i < n else (more[1][i - n], more[2][i - n])

        def take(ranges, size, back):
            """Up to ``size`` pieces from one side of a node."""
            out: list[int] = []
            for a, b in reversed(ranges) if back else ranges:
                got = range(max(a, b - size + len(out)), b) if back else range(a, min(b, a + size - len(out)))
                out = [*got, *out] if back else [*out, *got]
                if len(out) >= size:
                    break
            return out

        def without(ranges, size, back):
            ranges = list(ranges)
            while size:
                a, b = ranges.pop(-1 if back else 0)
                if b - a <= size:
                    size -= b - a
                else:
                    ranges.insert(len(ranges) if back else 0, (a, b - size) if back else (a + size, b))
                    size = 0
            return ranges

        def number_of(i):
            return int(code[i]) if i < n else more[0][i - n]

        while any(len(p) > 1 for p in places):
            for p in places:
                for k in range(0, len(p) - 1, 2):
                    left, right, size = nodes[p[k]], nodes[p[k + 1]], self.agree
                    while True:
                        i, j = take(left, size, True), take(right, size, False)
                        if not i or not j:
                            break
                        a, b = span(i[0])[0], span(j[-1])[1]
                        window = [(a + x, a + y) for x, y in pieces_of(text[a:b])]
                        new = [number.setdefault(text[x:y], len(number)) for x, y in window]
                        whole = (len(i) < size, len(j) < size)
                        if (whole[0] or new[0] == number_of(i[0])) and (whole[1] or new[-1] == number_of(j[-1])):
                            left, right = without(left, len(i), True), without(right, len(j), False)
                            if new == [number_of(x) for x in [*i, *j]]:
                                left += [(x, x + 1) for x in i]
                                right = [(x, x + 1) for x in j] + right
                            else:
                                m = n + len(more[0])
                                more[0].extend(new)
                                more[1].extend(x for x, _ in window)
                                more[2].extend(y for _, y in window)
                                left.append((m, m + len(new)))
                            break
                        size *= 2
                    nodes[p[k]] = left + right
                p[:] = p[::2]
        code = np.concatenate([code, np.array(more[0], dtype=np.int64)])
        ranges = [r for p in places for q in p for r in nodes[q]]
        sizes = [sum(b - a for q in p for a, b in nodes[q]) for p in places]
        lo = np.array([a for a, _ in ranges], dtype=np.int64)
        width = np.array([b for _, b in ranges], dtype=np.int64) - lo
        order = np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(width.sum())
        return code[order], np.r_[0, np.cumsum(sizes)].astype(np.int64), list(number)

    def encode_chunk(self, raw, bounds):
        """Arrow arrays for texts that lie side by side: ids of each as little-endian unsigned 32-bit integers, and the
        decoded text."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        code, first, names = self.codes(raw, bounds)
        ids, start = self.gathered(self.known(names)[code])
        ends = start[first]
        packed = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(4 * ends), pa.py_buffer(ids.astype("<u4"))])
        if not self.spaced:
            return packed, pa.array([self.decode(x) for x in packed.to_pylist()], pa.large_string())
        taken = self.spelt.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[ends] if len(ids) else ends
        decoded = pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(ends), taken.buffers()[2] or pa.py_buffer(b"")])
        return packed, pc.utf8_rtrim(decoded, characters=" ")

    def decode(self, ids: bytes) -> str:
        import array

        found = array.array("I")
        found.frombytes(ids)
        return self.whole.decode(found.tolist(), skip_special_tokens=False)

    def encode(self, texts):
        """(rows, ids, decoded) for runs of the texts (an Arrow binary array without nulls), in order."""
        import numpy as np
        import pyarrow as pa

        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1)
            raw = data[offsets[at] : offsets[to]]
            if to == at + 1 and len(raw) > 2 * CHUNK:
                yield 1, *self.encode_long(raw)
            else:
                yield to - at, *self.encode_chunk(raw, offsets[at : to + 1] - offsets[at])
            at = to

    def encode_long(self, raw):
        """One long text: in parts that end at a blank, where no token reaches over."""
        import numpy as np
        import pyarrow as pa

        text, at, ids, decoded = raw.tobytes(), 0, [], []
        while at < len(text):
            to = len(text)
            if to - at > 2 * CHUNK:
                m = re.compile(b"[ \n\t\r]").search(text, at + CHUNK)
                to = m.start() + 1 if m else to
            x, t = self.encode_chunk(raw[at:to], np.array([0, to - at], dtype=np.int64))
            ids.append(x[0].as_py())
            decoded.append(t[0].as_py())
            at = to
        whole = b"".join(ids)
        return pa.array([whole], pa.large_binary()), pa.array([" ".join(filter(None, decoded)) if self.spaced else self.decode(whole)], pa.large_string())


def _encoder(path: str, leaf: int):
    """One for each worker process, kept between tasks. A task has one core, and each thread of the library's own would hold
    tables of its own, so it gets none, unless the environment says otherwise."""
    import tokenizers

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = tokenizers.__dict__.setdefault("_clauseloom_kept", {})
    if (path, leaf) not in kept:
        kept[path, leaf] = TreeBPE(path, leaf)
    return kept[path, leaf]


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), leaf: int = LEAF) -> DataFrame:
    """The columns in ``keep``, n_tokens, ``ids`` (binary: little-endian unsigned 32-bit) and ``decoded``."""
    rows = df.select(*keep, F.col(text).alias("_t"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        encoder = _encoder(path, leaf)
        for batch in batches:
            at, texts = 0, pc.fill_null(batch.column(batch.num_columns - 1), "")
            for n, ids, decoded in encoder.encode(texts):
                own = [batch.column(i).slice(at, n) for i in range(batch.num_columns - 1)]
                count = pc.cast(pc.divide(pc.binary_length(ids), 4), pa.int64())
                yield pa.RecordBatch.from_arrays([*own, count, ids.cast(pa.binary()), decoded.cast(pa.string())], schema.names)
                at += n

    return rows.mapInArrow(run, schema)


def op4_bpe_tree(spark, sf_dir: str) -> DataFrame:
    found = encode_decode(documents(spark, sf_dir), public_path())
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
