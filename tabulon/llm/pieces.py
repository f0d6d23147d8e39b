"""SentencePiece (BPE) encoding and decoding by suffix-array matching.

Texts are cut where no piece of the vocabulary contains the two bytes on
either side (exact: nothing can be merged across), and every distinct segment
of a batch is encoded once.  The distinct segments are concatenated and
indexed by a suffix array (all suffixes sorted by their first 16 bytes, which
is further than most pieces reach); a binary search per piece gives the range
of its occurrences.  The occurrences are edges between byte positions; sorted
by their end they are relaxed from left to right: an edge is taken if it and
the edge taken into its start are a pair that byte-pair merging would leave
as two pieces.  Exactly one edge into each position is, so the path is the
encoding that the merges in score order produce.  Characters outside the
vocabulary become byte pieces.

Defined results: null and empty texts have no pieces; U+2581 is read as a
blank, as the format defines; decoding drops control pieces and the one blank
that encoding puts in front, null is empty, and ids outside the vocabulary
raise ValueError; rows and columns of the input stay (an existing column of
the output's name is replaced).  The model must use identity normalisation
and the dummy prefix; else ValueError.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, prepare, text_bytes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Distinct segments that a task remembers between batches.
REMEMBERED = 200_000
UNKNOWN, START, OPEN = -1, -2, -3
FAR = np.int64(2**40)


@dataclass
class Vocabulary:
    """Pieces by rank: single characters first, then in the order of merging."""
    ids: np.ndarray          # rank -> id
    pieces: list             # rank -> bytes
    left: np.ndarray         # rank -> ranks of the two pieces merged last
    right: np.ndarray
    pair_keys: np.ndarray    # left * n + right, sorted, of all pairs that merge
    pair_ranks: np.ndarray   # and the rank they merge to
    byte_ids: np.ndarray     # byte -> id
    joined: np.ndarray       # 256 x 256: some piece contains the two bytes
    surface: list            # id -> bytes that decoding writes


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Read a model file on the driver: a few 10,000 pieces, which bounds
    everything derived from it."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    probe = " ﬁ Á  Ａ\t x "
    if model.decode(model.encode(probe)) != probe or not model.encode("a", out_type=str)[0].startswith(BLANK):
        raise ValueError("only models with identity normalisation and a dummy prefix are supported")
    n = model.get_piece_size()
    surface, normal, byte_ids = [b""] * n, [], np.full(256, -1, np.int64)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            surface[i] = bytes([int(piece[3:5], 16)])
        elif model.is_unknown(i):
            surface[i] = " ⁇ ".encode()
        elif not model.is_control(i) and not model.is_unused(i):
            normal.append((piece.replace(BLANK, " "), model.get_score(i), i))
            surface[i] = piece.replace(BLANK, " ").encode()
    normal.sort(key=lambda x: (len(x[0]) > 1, -x[1]))
    rank = {piece: r for r, (piece, _, _) in enumerate(normal)}
    m = len(normal)
    left, right = np.arange(m), np.arange(m)
    keys, merged = [], []
    for r, (piece, _, _) in enumerate(normal):
        for k in range(1, len(piece)):
            a, b = rank.get(piece[:k]), rank.get(piece[k:])
            if a is not None and b is not None:
                keys.append(a * m + b)
                merged.append(r)
        symbols = list(piece)
        while len(symbols) > 1:
            best = min((rank.get(a + b, m), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if best[0] == m:
                break
            i = best[1]
            if len(symbols) == 2:
                left[r], right[r] = rank.get(symbols[0], -1), rank.get(symbols[1], -1)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
        if len(symbols) > 1 or left[r] < 0 or right[r] < 0:
            left[r] = -1  # byte-pair merging never makes this piece
    order = np.argsort(keys)
    joined = np.zeros((256, 256), bool)
    for piece, _, _ in normal:
        b = np.frombuffer(piece.encode(), np.uint8)
        joined[b[:-1], b[1:]] = True
    return Vocabulary(np.array([i for _, _, i in normal]), [p.encode() for p, _, _ in normal], left, right,
                      np.array(keys)[order], np.array(merged)[order], byte_ids, joined, surface)


def stays_apart(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging the characters of piece a and piece b leaves [a, b].
    Both are taken apart again, the one formed last first; while two parts
    touch, no merge of them may rank before the next part is formed."""
    out = np.zeros(len(a), bool)
    lane, limit = np.arange(len(a)), np.full(len(a), FAR)
    m = len(v.ids)
    while len(lane):
        key = a * m + b
        at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
        rank = np.where(v.pair_keys[at] == key, v.pair_ranks[at], FAR)
        inner_a, inner_b = v.right[a], v.left[b]
        whole_a, whole_b = inner_a == a, inner_b == b
        apart = rank >= limit
        done = apart & whole_a & whole_b
        out[lane[done]] = True
        first = ~whole_a & (whole_b | (a > b))
        limit = np.where(first, a, b + 1)
        a, b = np.where(first, inner_a, a), np.where(first, b, inner_b)
        go = apart & ~done
        lane, a, b, limit = lane[go], a[go], b[go], limit[go]
    return out


def _keys(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one big-endian number."""
    padded = np.concatenate([data, np.zeros(32, np.uint8)]).astype(np.uint64)
    n = len(data) + 24
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= padded[k:k + n] << np.uint64(56 - 8 * k)
    return out


def _bounds(piece: bytes) -> tuple[int, int]:
    head = piece[:8]
    return int.from_bytes(head.ljust(8, b"\0"), "big"), int.from_bytes(head.ljust(8, b"\xff"), "big")


class Encoder:
    """Encodes batches; remembers the segments it has seen."""

    def __init__(self, v: Vocabulary):
        self.v = v
        usable = [r for r in range(len(v.pieces)) if v.left[r] >= 0]
        self.ranks = np.array(usable)
        self.lengths = np.array([len(v.pieces[r]) for r in usable])
        bounds = np.array([_bounds(v.pieces[r]) for r in usable], np.uint64)
        self.low, self.high = bounds[:, 0], bounds[:, 1]
        self.long = {i: v.pieces[usable[i]] for i in np.flatnonzero(self.lengths > 8)}
        self.cut = ~v.joined.reshape(-1)
        self._forget()

    def _forget(self):
        self.known, self.flat, self.first = pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def edges(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, index of the piece) of every occurrence of a usable piece
        in ``data`` at the ascending positions ``at``."""
        keys = _keys(data)
        k1, k2 = keys[at], keys[at + 8]
        order = np.lexsort((k2, k1))
        k1, k2, at = k1[order], k2[order], at[order]
        lo = np.searchsorted(k1, self.low, "left")
        hi = np.searchsorted(k1, self.high, "right")
        chosen = []
        for i, piece in self.long.items():
            a, b = lo[i], hi[i]
            if a < b:
                low, high = _bounds(piece[8:])
                lo[i], hi[i] = a + np.searchsorted(k2[a:b], [np.uint64(low), np.uint64(high) + np.uint64(high < 2**64 - 1)])
                if high == 2**64 - 1:
                    hi[i] = b
                if len(piece) > 16 and lo[i] < hi[i]:  # further bytes one by one
                    held = at[lo[i]:hi[i]]
                    for k in range(16, len(piece)):
                        held = held[held + k < len(data)]
                        held = held[data[held + k] == piece[k]]
                    chosen.append((held, i))
                    hi[i] = lo[i]
        count = hi - lo
        piece = np.repeat(np.arange(len(lo)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        start = at[offset]
        if chosen:
            start = np.concatenate([start, *[h for h, _ in chosen]])
            piece = np.concatenate([piece, *[np.full(len(h), i) for h, i in chosen]])
        return start, piece

    def segments(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of distinct non-empty segments."""
        v = self.v
        raw = np.frombuffer(texts.buffers()[2], np.uint8)
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        raw, ends = raw[ends[0]:ends[-1]], ends - ends[0]
        n = len(texts)
        seg = np.repeat(np.arange(n), np.diff(ends))
        data = np.zeros(len(raw) + n, np.uint8)  # a zero byte after each segment
        inside = np.arange(len(raw)) + seg
        data[inside] = raw
        owner = np.zeros(len(data), np.int64)
        owner[inside] = seg
        begin = ends[:-1] + np.arange(n)
        finish = ends[1:] + np.arange(n)
        at = inside[(raw & 0xC0) != 0x80]
        of = owner[at]
        start, piece = self.edges(data, at)
        stop, rank = start + self.lengths[piece], self.ranks[piece]
        after = np.append(at[1:], 0)
        last_of = np.append(of[1:] != of[:-1], True)
        after[last_of] = finish[of[last_of]]
        single = np.zeros(len(data) + 1, bool)
        until = np.zeros(len(data), np.int64)
        until[at] = after
        single[start[stop == until[start]]] = True
        foreign = ~single[at]
        start = np.concatenate([start, at[foreign]])
        stop = np.concatenate([stop, after[foreign]])
        rank = np.concatenate([rank, np.full(foreign.sum(), UNKNOWN)])
        depth = stop - begin[owner[start]]
        order = np.argsort(depth, kind="stable")
        start, stop, rank, depth = start[order], stop[order], rank[order], depth[order]
        taken = np.full(len(data) + 1, OPEN, np.int64)
        back = np.zeros(len(data) + 1, np.int64)
        taken[begin] = START
        m = len(v.ids)
        level = np.flatnonzero(np.append(True, depth[1:] != depth[:-1])) if len(depth) else np.zeros(0, np.int64)
        for lo, hi in zip(level, np.append(level[1:], len(depth))):
            r, before = rank[lo:hi], taken[start[lo:hi]]
            good = (before == START) | (before != OPEN) & ((before == UNKNOWN) | (r == UNKNOWN))
            ask = np.flatnonzero((before >= 0) & (r >= 0))
            if len(ask):
                pairs, which = np.unique(before[ask] * m + r[ask], return_inverse=True)
                good[ask] = stays_apart(v, pairs // m, pairs % m)[which]
            good = lo + np.flatnonzero(good)
            taken[stop[good]], back[stop[good]] = rank[good], start[good]
            taken[begin] = START
        here, where, what, to = finish.copy(), [], [], []
        while len(here):
            where.append(back[here])
            what.append(taken[here])
            to.append(here)
            here = back[here]
            here = here[taken[here] != START]
        where, what, to = map(np.concatenate, (where, what, to))
        order = np.argsort(where)
        where, what, to = where[order], what[order], to[order]
        size = np.where(what == UNKNOWN, to - where, 1)
        flat = np.repeat(np.where(what == UNKNOWN, 0, v.ids[what]), size)
        spot = np.repeat(where, size) + np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        unknown = np.repeat(what == UNKNOWN, size)
        flat[unknown] = v.byte_ids[data[spot[unknown]]]
        seg = owner[where]
        return flat.astype(np.int32), np.concatenate([[0], np.cumsum(np.bincount(seg, size, n).astype(np.int64))])

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and row offsets of texts given as bytes with offsets from 0."""
        size = np.diff(offsets)
        filled = size > 0
        starts = offsets[:-1][filled] + np.arange(filled.sum())
        with_blank = np.full(len(data) + len(starts), 32, np.uint8)
        keep = np.ones(len(with_blank), bool)
        keep[starts] = False
        with_blank[keep] = data
        if not len(with_blank):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        two = with_blank[:-1].astype(np.int64) * 256 + with_blank[1:]
        cuts = np.concatenate([[True], self.cut[two] & ((with_blank[1:] & 0xC0) != 0x80)])
        cuts[starts] = True
        at = np.flatnonzero(cuts)
        texts = pa.Array.from_buffers(pa.binary(), len(at), [
            None, pa.py_buffer(np.append(at, len(with_blank)).astype(np.int32)), pa.py_buffer(with_blank)])
        coded = texts.dictionary_encode()
        distinct, index = coded.dictionary, coded.indices.to_numpy()
        known = pc.index_in(distinct, value_set=self.known)
        if known.null_count:
            if len(self.known) > REMEMBERED:
                self._forget()
                known = pa.nulls(len(distinct), pa.int32())
            new = pc.filter(distinct, pc.is_null(known))
            flat, first = self.segments(new)
            self.known = pa.concat_arrays([self.known, new])
            self.first = np.concatenate([self.first, self.first[-1] + first[1:]])
            self.flat = np.concatenate([self.flat, flat])
            known = pc.index_in(distinct, value_set=self.known)
        index = known.to_numpy()[index]
        size = self.first[index + 1] - self.first[index]
        total = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.repeat(self.first[index] - total[:-1], size) + np.arange(total[-1])]
        rows = np.zeros(len(offsets), np.int64)
        first_segment = np.searchsorted(at, starts)
        rows[:-1][filled] = total[first_segment]
        rows[-1] = total[-1]
        for_empty = np.flatnonzero(~filled)[::-1]
        for i in for_empty:
            rows[i] = rows[i + 1]
        return flat, rows


def _shared(spark, path: str):
    """The vocabulary as a broadcast value (a few MB, bounded by the model)."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _SENT:
        _SENT[key] = spark.sparkContext.broadcast(read_vocabulary(path))
    return _SENT[key]


_SENT: dict = {}


#: Text bytes, and ids, that a task turns into arrays at a time.
ENCODED, DECODED = 250_000, 100_000


def _encoding(sent, at: int, out: str):
    def run(batches):
        encoder = Encoder(sent.value)
        for batch in batches:
            column = batch.column(at).cast(pa.large_string())
            if pc.any(pc.match_substring(column, BLANK)).as_py():
                column = pc.replace_substring(column, BLANK, " ")
            data, offsets = text_bytes(column)
            for lo, hi in chunked(offsets, ENCODED):
                flat, rows = encoder.batch(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                ids = pa.ListArray.from_arrays(rows.astype(np.int32), pa.array(flat))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*batch.schema.names, out])

    return run


def _decoding(sent, at: int, out: str):
    def run(batches):
        surface = sent.value.surface
        length = np.array([len(x) for x in surface])
        first = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(surface), np.uint8)
        for batch in batches:
            column = batch.column(at)
            count = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = pc.list_flatten(column).to_numpy(zero_copy_only=False)
            rows = np.concatenate([[0], np.cumsum(count)])
            for lo, hi in chunked(rows, DECODED):
                some = ids[rows[lo]:rows[hi]]
                if len(some) and (some.min() < 0 or some.max() >= len(surface)):
                    raise ValueError("a piece id is outside the vocabulary")
                size = length[some]
                total = np.concatenate([[0], np.cumsum(size)])
                data = flat[np.repeat(first[some] - total[:-1], size) + np.arange(total[-1])]
                ends = total[rows[lo:hi + 1] - rows[lo]]
                raw = data.tobytes()
                texts = [raw[a + (raw[a:a + 1] == b" "):b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 names=[*batch.schema.names, out])

    return run


def encode(df: DataFrame, text: str = "text", out: str = "tokens", model: str = MODEL) -> DataFrame:
    """``df`` with the piece ids of its text column as array<int> ``out``."""
    prepare(df.sparkSession)
    sent = _shared(df.sparkSession, model)
    df = df.drop(out) if out.lower() != text.lower() else df
    at = [c.lower() for c in df.columns].index(text.lower())
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(_encoding(sent, at, out), schema)


def decode(df: DataFrame, tokens: str = "tokens", out: str = "decoded", model: str = MODEL) -> DataFrame:
    """``df`` with the text of its array<int> column of piece ids as ``out``."""
    prepare(df.sparkSession)
    sent = _shared(df.sparkSession, model)
    df = df.drop(out) if out.lower() != tokens.lower() else df
    at = [c.lower() for c in df.columns].index(tokens.lower())
    return df.mapInArrow(_decoding(sent, at, out), T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))


def encode_checked(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, tokens, round_trip) for every row of ``docs``:
    round_trip says that decoding gives the text back.  One worker a task
    encodes, decodes and compares; no text goes back to the JVM."""
    prepare(docs.sparkSession)
    sent = _shared(docs.sparkSession, model)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    there, back = _encoding(sent, 1, "tokens"), _decoding(sent, 2, "decoded")

    def run(batches):
        for batch in back(there(batches)):
            same = pc.equal(batch.column(3), pc.replace_substring(batch.column(1).cast(pa.string()), BLANK, " "))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), same],
                                             names=["doc_id", "tokens", "round_trip"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("tokens", T.ArrayType(T.IntegerType())),
                           T.StructField("round_trip", T.BooleanType())])
    return docs.mapInArrow(run, schema).select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), "tokens",
                                               "round_trip")
