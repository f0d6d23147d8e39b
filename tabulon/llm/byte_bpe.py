"""Byte-level BPE by dynamic programming over prefixes.

A text is split by the vocabulary's pattern and each match ("piece") is
encoded on its own.  The encoding of a byte string ends in one token, and what
stands before that token is the encoding of the prefix without it.  So one
token per prefix, the last one of its encoding, is the whole table: of the
vocabulary's tokens that end at a position (found by one automaton pass over
the bytes) exactly one is such that merging leaves it and the last token of
the prefix before it apart.  Tokens are read off from the end.

The table also makes changes cheap: bytes that are appended extend it, and
after an edit it is computed anew only until it agrees with the old one over
the length of the longest token.  ``prefix_tokens`` keeps it as a column and
``edit`` applies an edit or an append per row, exactly, splitting and encoding
again near the edit only.

Defined results: null and empty texts have no tokens; bytes that are no UTF-8
are read as U+FFFD; special tokens are ordinary text; an id outside the
vocabulary raises ValueError when decoded; rows and columns of the input stay
(a column of the output's name is replaced); repeated rows get equal answers;
an empty table gives an empty one.
"""

from __future__ import annotations

import base64
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, fresh, prepare

RANKS = "byte_bpe_50k.tiktoken"
#: Pieces and pairs that a task remembers.
REMEMBERED, PAIRS = 300_000, 1_000_000
#: Longer pieces are not remembered, longer texts not split at once.
LONG_PIECE, LONG_TEXT = 64, 1_000_000
#: Code points behind a match that the pattern may look at ("'" reads on for "ll").
REACH = 2
FAR = 2**62


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 and number per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def last_merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens that merging ``piece`` joins last, or None if it never becomes one."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 2:
        rank, i = min((ranks.get(a + b, FAR), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == FAR:
            return None
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return ranks[parts[0]], ranks[parts[1]]


class Vocabulary:
    """Tokens by rank and, of each, the two that are merged last into it.
    Some 50,000 entries, which bounds all that is made of it."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("a byte has no rank")
        size = max(ranks.values()) + 1
        self.ranks = ranks
        self.tokens: list[bytes | None] = [None] * size
        self.left, self.right = list(range(size)), list(range(size))
        self.made = []
        for token, rank in ranks.items():
            self.tokens[rank] = token
            if len(token) > 1:
                halves = last_merge(token, ranks)
                if halves is None:
                    continue  # never made by merging; found only as a whole piece
                if max(halves) >= rank:
                    raise ValueError("a token ranks before the tokens it is merged from")
                self.left[rank], self.right[rank] = halves
            self.made.append(rank)


class Memory(dict):
    """Results of ``make`` by string.  When it is full it keeps what was asked
    for since it was last full, so that common strings stay."""

    def __init__(self, make):
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> tuple:
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > LONG_PIECE:
                return got
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        self[key] = got
        return got


class Coder:
    """Encodes pieces; holds the automaton and what it has seen."""

    def __init__(self, v: Vocabulary, pattern: str):
        import ahocorasick
        import regex

        self.v, self.pattern = v, regex.compile(pattern)
        self.finder = ahocorasick.Automaton()
        self.size = [len(t) if t else 0 for t in v.tokens]
        for rank in v.made:
            self.finder.add_word(v.tokens[rank].decode("latin-1"), rank)
        self.finder.make_automaton()
        self.longest = max(self.size)
        self.pairs: dict[int, bool] = {}
        self.known = Memory(self.piece_ids)

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens a and b side by side.  Both are taken
        apart again, the one merged last first; while two parts touch, no merge
        of them may come before the merge taken back last."""
        key = a * len(self.size) + b
        known = self.pairs.get(key)
        if known is not None:
            return known
        v, limit = self.v, FAR
        while True:
            if v.ranks.get(v.tokens[a] + v.tokens[b], FAR) < limit:
                good = False
                break
            whole_a, whole_b = v.right[a] == a, v.left[b] == b
            if whole_a and whole_b:
                good = True
                break
            if not whole_a and (whole_b or a > b):
                a, limit = v.right[a], a
            else:
                b, limit = v.left[b], b + 1
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = good
        return good

    def extend(self, text: str, last: array, start: int, old: array | None = None, shift: int = 0, same: int = 0) -> None:
        """Fill ``last`` (tokens that end the prefixes of ``text``, bytes as
        characters) from ``start`` on.  Given ``old``, the table of a text whose
        bytes from ``same`` - ``shift`` on are those from ``same`` on here, stop
        and copy once both agree over the longest token's length."""
        size, found, run = self.size, start - 1, 0
        for end, token in self.finder.iter(text, max(0, start - self.longest + 1)):
            if end <= found:
                continue
            before = end - size[token]
            if before < 0 or self.apart(last[before], token):
                last[end], found = token, end
                if old is not None and end >= same:
                    run = run + 1 if old[end - shift] == token else 0
                    if run >= self.longest:
                        last[end + 1:] = old[end + 1 - shift:]
                        return

    def table(self, piece: bytes) -> list:
        """The last token of every prefix of a piece."""
        last, found = [], -1
        size, pairs, n = self.size, self.pairs, len(self.size)
        for end, token in self.finder.iter(piece.decode("latin-1")):
            if end > found:
                before = end - size[token]
                if before < 0:
                    good = True
                else:
                    good = pairs.get(last[before] * n + token)
                    if good is None:
                        good = self.apart(last[before], token)
                if good:
                    last.append(token)
                    found = end
        return last

    def read(self, piece: bytes, last) -> tuple:
        """Token ids of a piece from its table."""
        whole = self.v.ranks.get(piece)
        if whole is not None:
            return (whole,)
        out, at = [], len(piece) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.size[last[at]]
        return tuple(out[::-1])

    def piece_ids(self, piece: str) -> tuple:
        data = piece.encode()
        whole = self.v.ranks.get(data)
        return (whole,) if whole is not None else self.read(data, self.table(data))

    def pieces(self, text: str):
        if len(text) <= LONG_TEXT:
            return self.pattern.findall(text)
        return (m.group() for m in self.pattern.finditer(text))

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable(map(self.known.__getitem__, self.pieces(text))))

    # the table of a whole text: one token per byte, as ~token where a piece ends
    def prefixes(self, text: str) -> array:
        out = array("i")
        for piece in self.pieces(text):
            last = self.table(piece.encode())
            last[-1] = ~last[-1]
            out.extend(last)
        return out

    def tokens(self, data: bytes, prefixes: np.ndarray) -> array:
        """Token ids of a text from its table."""
        out, start = array("i"), 0
        for end in (np.flatnonzero(prefixes < 0) + 1).tolist():
            last = prefixes[start:end].tolist()
            last[-1] = ~last[-1]
            out.extend(self.read(data[start:end], last))
            start = end
        return out

    def edit(self, text: str, prefixes: np.ndarray, at: int, removed: int, added: str) -> tuple[str, array, int]:
        """Text and table after ``removed`` code points at ``at`` are replaced
        by ``added``, and the bytes for which the table was computed."""
        new = text[:at] + added + text[at + removed:]
        first = len(text[:at].encode())                       # bytes before the edit,
        gone = first + len(text[at:at + removed].encode())    # where it ends in the old text
        come = first + len(added.encode())                    # and in the new one
        shift = come - gone
        ends = np.flatnonzero(prefixes < 0) + 1
        # a match that ends REACH code points (of at most 4 bytes) before the edit did not see it
        keep = int(np.searchsorted(ends, first - 4 * REACH, "right"))
        start = int(ends[keep - 1]) if keep else 0
        old_ends = set(ends[keep:].tolist()) | {start}
        old_data = text.encode()
        here, out, work = start, array("i", prefixes[:start].tobytes()), 0
        for match in self.pattern.finditer(new, len(old_data[:start].decode())):
            if here >= come and here - shift in old_ends:
                out.frombytes(prefixes[here - shift:].tobytes())
                break
            piece = match.group().encode()
            stop, last = here + len(piece), array("i", bytes(4 * len(piece)))
            head = 0
            if here < first and here in old_ends:  # the piece that began here before the edit
                end = int(ends[np.searchsorted(ends, here, "right")])
                old = array("i", prefixes[here:end].tobytes())
                old[-1] = ~old[-1]
                head = min(first, stop, end) - here
                last[:head] = old[:head]
                if stop - shift == end and come <= stop:
                    self.extend(piece.decode("latin-1"), last, head, old, shift, come - here)
                else:
                    self.extend(piece.decode("latin-1"), last, head)
            else:
                self.extend(piece.decode("latin-1"), last, 0)
            work += len(piece) - head
            last[-1] = ~last[-1]
            out.extend(last)
            here = stop
        return new, out, work


_SENT: dict = {}


def _shared(spark, path: str | None, pattern: str | None):
    """Vocabulary and pattern as a broadcast value, bounded by the rank file."""
    path, pattern = path or default_path(), pattern or default_pattern()
    key = (spark.sparkContext.applicationId, path, pattern)
    if key not in _SENT:
        _SENT[key] = spark.sparkContext.broadcast((Vocabulary(read_ranks(path)), pattern))
    return _SENT[key]


def _texts(column: pa.Array) -> list[str]:
    return [x.decode("utf-8", "replace") for x in pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()]


def _sizes(column: pa.Array) -> np.ndarray:
    size = pc.fill_null(pc.binary_length(column.cast(pa.large_binary())), 0)
    return np.concatenate([[0], np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))])


def _lists(rows: list[array]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(map(memoryview, rows)), np.int32)))


def _encoding(sent, at: int, out: str, table: bool = False):
    def run(batches):
        coder = Coder(*sent.value)
        make = coder.prefixes if table else coder.encode
        for batch in batches:
            for lo, hi in chunked(_sizes(batch.column(at)), 500_000):
                part = batch.slice(lo, hi - lo)
                made = _lists([make(t) for t in _texts(part.column(at))])
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*batch.schema.names, out])

    return run


def _decoding(sent, at: int, out: str):
    def run(batches):
        tokens = sent.value[0].tokens
        length = np.array([len(t) if t else 0 for t in tokens])
        first = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)
        for batch in batches:
            column = batch.column(at)
            count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.fill_null(pc.list_flatten(column), -1).to_numpy(zero_copy_only=False)
            rows = np.concatenate([[0], np.cumsum(count)])
            for lo, hi in chunked(rows, 200_000):
                some = ids[rows[lo]:rows[hi]]
                if len(some) and (some.min() < 0 or some.max() >= len(tokens) or not length[some].all()):
                    raise ValueError("a token id is outside the vocabulary")
                size = length[some]
                total = np.concatenate([[0], np.cumsum(size)])
                data = flat[np.repeat(first[some] - total[:-1], size) + np.arange(total[-1])]
                ends = total[rows[lo:hi + 1] - rows[lo]].astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, made],
                                                 names=[*batch.schema.names, out])

    return run


def _with(df: DataFrame, *more: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *more])


def _place(df: DataFrame, name: str) -> int:
    return [c.lower() for c in df.columns].index(name.lower())


IDS = T.ArrayType(T.IntegerType())


def encode(df: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """``df`` with the token ids of its text column as array<int> ``out``."""
    prepare(df.sparkSession)
    sent = _shared(df.sparkSession, path, pattern)
    df = df.drop(out) if out.lower() != text.lower() else df
    return df.mapInArrow(_encoding(sent, _place(df, text), out), _with(df, T.StructField(out, IDS)))


def decode(df: DataFrame, tokens: str = "tokens", out: str = "decoded", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """``df`` with the bytes of its array<int> column of token ids as ``out``."""
    prepare(df.sparkSession)
    sent = _shared(df.sparkSession, path, pattern)
    df = df.drop(out) if out.lower() != tokens.lower() else df
    return df.mapInArrow(_decoding(sent, _place(df, tokens), out), _with(df, T.StructField(out, T.BinaryType())))


def round_trip(df: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``tokens`` and the bytes ``decoded`` from them, in one worker."""
    prepare(df.sparkSession)
    sent = _shared(df.sparkSession, path, pattern)
    df = df.drop(*[c for c in ("tokens", "decoded") if c != text.lower()])
    there, back = _encoding(sent, _place(df, text), "tokens"), _decoding(sent, len(df.columns), "decoded")
    schema = _with(df, T.StructField("tokens", IDS), T.StructField("decoded", T.BinaryType()))
    return df.mapInArrow(lambda batches: back(there(batches)), schema)


def prefix_tokens(df: DataFrame, text: str = "text", out: str = "prefixes", path: str | None = None,
                  pattern: str | None = None) -> DataFrame:
    """``df`` with the table of its texts as array<int>: for every byte the last
    token of its piece up to there, ~token (negative) at the end of a piece."""
    prepare(df.sparkSession)
    sent = _shared(df.sparkSession, path, pattern)
    df = df.drop(out) if out.lower() != text.lower() else df
    return df.mapInArrow(_encoding(sent, _place(df, text), out, True), _with(df, T.StructField(out, IDS)))


def edit(df: DataFrame, at: Column | None, removed: Column, added: Column, text: str = "text",
         prefixes: str = "prefixes", out: str = "tokens", path: str | None = None,
         pattern: str | None = None) -> DataFrame:
    """Rows of ``prefix_tokens`` after one edit each: ``removed`` code points
    from ``at`` (0-based; None or null: the end, an append) give way to
    ``added``.  Text and table are the new ones, with the token ids ``out`` and
    ``recoded`` (long), the bytes for which the table was computed anew.  Null
    counts remove nothing, null strings add nothing; places outside the text
    are moved to its ends."""
    prepare(df.sparkSession)
    sent = _shared(df.sparkSession, path, pattern)
    df = df.drop(out, "recoded")
    names = fresh(df, "edit_at", "edit_removed", "edit_added")
    where = F.lit(None).cast("long") if at is None else at.cast("long")
    wide = df.select("*", where.alias(names[0]), removed.cast("long").alias(names[1]), added.cast("string").alias(names[2]))
    t, p, n, kept = _place(df, text), _place(df, prefixes), len(df.columns), df.columns

    def run(batches):
        coder = Coder(*sent.value)
        for batch in batches:
            for lo, hi in chunked(_sizes(batch.column(t)), 200_000):
                part = batch.slice(lo, hi - lo)
                rows = zip(_texts(part.column(t)), part.column(p), part.column(n).to_pylist(),
                           part.column(n + 1).to_pylist(), _texts(part.column(n + 2)))
                texts, tables, ids, work = [], [], [], []
                for old, table, spot, drop, more in rows:
                    table = table.values.to_numpy(zero_copy_only=False) if table.is_valid else np.zeros(0, np.int32)
                    spot = len(old) if spot is None else min(max(spot, 0), len(old))
                    new, made, size = coder.edit(old, table.astype(np.int32), spot, max(drop or 0, 0), more)
                    texts.append(new)
                    tables.append(made)
                    ids.append(coder.tokens(new.encode(), np.frombuffer(made, np.int32)))
                    work.append(size)
                columns = list(part.columns[:n])
                columns[t], columns[p] = pa.array(texts, pa.string()), _lists(tables)
                yield pa.RecordBatch.from_arrays([*columns, _lists(ids), pa.array(work, pa.int64())],
                                                 names=[*kept, out, "recoded"])

    return wide.mapInArrow(run, _with(df, T.StructField(out, IDS), T.StructField("recoded", T.LongType())))
