"""Repeated passages: every byte covered by a 200-byte string that also starts
anywhere else, by a distributed merge sort of suffixes.

Suffixes are sampled by content: among the 32-byte grams of each 200-byte
window the one with the least hash (leftmost of equals) is its anchor, so
equal windows have their anchors at the same offset, and a document has about
one anchor per 85 bytes.  Two anchors that share l bytes before and r bytes
from the anchor on, l + r >= 200, repeat the l + r bytes around them; all
windows of an anchor contain it, so what it covers is one run, from its
longest such l to its longest such r.  Nothing is lost by the sample.

1.  Anchors with the hashes of the 100 bytes on either side; an anchor
    matters only if one of the two occurs again (l or r is 100 at least).
2.  Each task sorts the suffixes at its remaining anchors (200 bytes, with the
    168 bytes before the anchor read backwards), folds equal ones, and sends
    them front-coded - length shared with the previous suffix, then the rest -
    as one run per partition; suffixes with equal first 32 bytes meet.
3.  A partition merges its runs with a loser tree that keeps each suffix's
    common prefix with the last winner: unequal lengths decide without
    looking at a byte, equal ones compare from there on.  The merged order
    comes with the prefixes shared by neighbours; within each interval of
    that order the backward contexts give the longest l for its r.
4.  Runs are merged per document and cut out.

Suffixes with the same first 32 bytes meet in one task, up to ``HOT`` of them;
only anchors that pass step 1 and, folded per task, distinct contexts get
there.  Beyond it (a header of a third of all documents) a start of 32 bytes is
solved by grouping alone: anchors with the same 368 bytes around them fold into
one; each that is left gives 128-bit hashes of the strings that hold it, which
are counted: first 8 of 176 bytes, then those of 200 bytes that hold one of the
former that occurs again.

Defined results: null text is empty; documents are told apart by (doc_id,
text), so repeated rows are copies of each other and get the same answer;
null ids and empty tables are fine; other columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SALTS, chunked, mix, prepare, sized, span_hashes, stage, text_bytes

LENGTH, GRAM, HALF = 200, 32, 100
#: Bytes before an anchor that a window of it can reach.
BEFORE = LENGTH - GRAM
#: Suffixes that a partition merges, on average.
PER_PARTITION = 20_000
#: Anchors with equal first 32 bytes that a task may get, counted once for each
#: side of 100 bytes that occurs again.
HOT = 50_000
#: Bytes between the beginnings of strings that are looked at first.
STEP = 24
#: Rows of two longs, hashes or runs, that may be broadcast (32 MB).
BROADCAST_ROWS = 2_000_000


def anchors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Anchor positions, ascending, of all 200-byte windows inside the rows."""
    width = LENGTH - GRAM + 1
    n = len(data) - GRAM + 1
    lengths = np.diff(offsets)
    if n < width or not (lengths >= LENGTH).any():
        return np.zeros(0, np.int64)
    at = np.arange(n)
    key = span_hashes(data, at, at + GRAM)
    key = (key & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, np.uint64(2**64 - 1))
    padded[:n] = key
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = n - width + 1
    least = np.minimum(behind[:starts], ahead[width - 1:width - 1 + starts]) & np.uint64(0xFFFFFFFF)
    change = np.zeros(len(data) + 1, np.int64)
    whole = lengths >= LENGTH
    np.add.at(change, offsets[:-1][whole], 1)
    np.add.at(change, offsets[1:][whole] - LENGTH + 1, -1)
    least = least[np.cumsum(change)[:starts] > 0].astype(np.int64)
    return least[np.concatenate([[True], least[1:] != least[:-1]])] if len(least) else least


def _find(batches):
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in chunked(offsets):
            part, edge = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            at = anchors(part, edge)
            row = np.searchsorted(edge, at, "right") - 1
            hashes = [pa.array((span_hashes(part, at, at + GRAM) >> np.uint64(32)).astype(np.uint32).view(np.int32))]
            for start, salt in ((at, SALTS[3000]), (at - HALF, SALTS[3001])):
                inside = (start >= edge[row]) & (start + HALF <= edge[row + 1])
                h = mix(span_hashes(part, start[inside], start[inside] + HALF) ^ salt).view(np.int64)
                full = np.zeros(len(at), np.int64)
                full[inside] = h
                hashes.append(pa.array(full, mask=~inside))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[lo:hi][row]), pa.array(at - edge[row]), *hashes],
                names=["key", "pos", "gram", "h_right", "h_left"])


#: A second, unlike hash of bytes takes them through this permutation first.
OTHER = np.random.default_rng(20240301).permutation(256).astype(np.uint8)


def _spots(batches):
    """Texts with their hot positions, in slices: (keys, positions, row edges, bytes)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        lists, keys = batch.column(2), batch.column(0).to_numpy(zero_copy_only=False)
        for lo, hi in chunked(offsets):
            part, edge = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
            own = lists.slice(lo, hi - lo)
            row = np.repeat(np.arange(hi - lo), own.value_lengths().to_numpy(zero_copy_only=False))
            yield keys[lo:hi][row], own.flatten().to_numpy(zero_copy_only=False).astype(np.int64), row, edge, part


def _double(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, offset: np.ndarray) -> list[pa.Array]:
    """Two 64-bit hashes of each span together with the anchor's offset in it."""
    salt = SALTS[3100 + offset]
    return [pa.array(mix(span_hashes(x, starts, ends) ^ salt).view(np.int64)) for x in (part, OTHER[part])]


def _contexts(batches):
    """The 368 bytes around every hot anchor as two hashes, and as bytes the
    first time that a task meets them (it forgets what it met now and then)."""
    met = set()
    for key, pos, row, edge, part in _spots(batches):
        at, raw = edge[row] + pos, part.tobytes()
        l, r = np.minimum(pos, BEFORE), np.minimum(edge[row + 1] - at, LENGTH)
        for lo in range(0, len(pos), 10_000):
            cut = slice(lo, lo + 10_000)
            hashes = _double(part, (at - l)[cut], (at + r)[cut], l[cut])
            if len(met) > 200_000:
                met.clear()
            around = []
            for *h, i, j in zip(*(x.to_pylist() for x in hashes), (at - l)[cut].tolist(), (at + r)[cut].tolist()):
                around.append(None if tuple(h) in met else raw[i:j])
                met.add(tuple(h))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[cut]), pa.array(pos[cut]), pa.array(l[cut]), pa.array(r[cut]),
                 pa.array(around, pa.binary()), *hashes], names=["key", "pos", "l", "r", "around", "h1", "h2"])


def _strings(width: int, first: int):
    """Hashes of the strings of ``width`` bytes that hold an anchor and begin
    0 to ``first`` bytes, or so many as ``steps`` ask for, before it."""
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                own = batch.slice(lo, 1_000)
                key, pos, l = (own.column(c).to_numpy(zero_copy_only=False) for c in range(3))
                around = own.column(3).to_pylist()
                edge = np.concatenate([[0], np.cumsum([len(x) for x in around])]).astype(np.int64)
                part = np.frombuffer(b"".join(around), np.uint8)
                if first:
                    backs = np.arange(0, first + 1, STEP)
                    i, back = np.repeat(np.arange(len(key)), len(backs)), np.tile(backs, len(key))
                else:
                    i = np.repeat(np.arange(len(key)), own.column(4).value_lengths().to_numpy() * STEP)
                    back = (own.column(4).flatten().to_numpy()[:, None] + np.arange(STEP)).reshape(-1)
                start = edge[i] + l[i] - back
                inside = (back <= l[i]) & (start + width <= edge[i + 1])
                i, back, start = i[inside], back[inside], start[inside]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[i]), pa.array(pos[i]), pa.array(back.astype(np.int64)),
                     *_double(part, start, start + width, back)], names=["key", "pos", "back", "h1", "h2"])
    return run


def shared(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of a and b, known to be ``start`` at least."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[list[int], bytes, list[int]]:
    """Shared prefix with the previous string, the rests, and their lengths."""
    lcps = [0] + [shared(a, b) for a, b in zip(strings, strings[1:])]
    rests = [s[k:] for s, k in zip(strings, lcps)]
    return lcps, b"".join(rests), [len(r) for r in rests]


def front_decode(lcps, rests: bytes, lengths) -> list[bytes]:
    out, last, at = [], b"", 0
    for k, n in zip(lcps, lengths):
        last = last[:k] + rests[at:at + n]
        at += n
        out.append(last)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> list[tuple[int, int, int]]:
    """Merge sorted runs of (strings, prefix shared with the previous one of
    the run): (run, index, prefix shared with the previous of the result)."""
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * len(runs)
    head = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k
    losers = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows its prefix shared with the winner."""
        x, y = head[a], head[b]
        if y is None or x is None:
            return (a, b) if y is None else (b, a)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        h = shared(x, y, known[a])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner, out = build(1), []
    while head[winner] is not None:
        i = at[winner]
        out.append((winner, i, known[winner]))
        strings, lcps = runs[winner]
        at[winner] = i = i + 1
        if i < len(strings):
            head[winner], known[winner] = strings[i], lcps[i]
        else:
            head[winner] = None
        node = (winner + k) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2
    return out


def _prefixes(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common prefix of each pair of padded rows, ``most`` at most."""
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, most)


def longest(lcps: np.ndarray, before: np.ndarray, lengths: np.ndarray, ls: np.ndarray, rs: np.ndarray) -> None:
    """Raise ``ls`` and ``rs`` to what each suffix shares with others of the
    merged order: rows of ``before`` are the padded backward contexts."""
    n = len(lcps)
    starts = np.flatnonzero(lcps < LENGTH - BEFORE)
    ends = np.append(starts[1:], n)
    two = starts[ends - starts == 2]
    if len(two):
        r = lcps[two + 1]
        l = _prefixes(before[two], before[two + 1], np.minimum(lengths[two], lengths[two + 1]))
        good = l + r >= LENGTH
        for at in (two[good], two[good] + 1):
            ls[at] = np.maximum(ls[at], l[good])
            rs[at] = np.maximum(rs[at], r[good])
    for s, e in zip(starts[ends - starts > 2], ends[ends - starts > 2]):
        own = before[s:e]
        order = np.array(sorted(range(e - s), key=[x.tobytes() for x in own].__getitem__))
        rank = np.empty(e - s, np.int64)
        rank[order] = np.arange(e - s)
        inner = lcps[s + 1:e]
        for rho in np.unique(inner)[::-1]:
            cut = np.flatnonzero(np.concatenate([[True], inner < rho, [True]]))
            held = np.add.reduceat(np.concatenate([[0], inner == rho]).astype(np.int64), cut[:-1])
            for a, b in zip(cut[:-1][held > 0], cut[1:][held > 0]):
                at = a + np.argsort(rank[a:b])
                near = _prefixes(own[at[1:]], own[at[:-1]],
                                 np.minimum(lengths[s + at[1:]], lengths[s + at[:-1]]))
                best = np.zeros(b - a, np.int64)
                best[1:] = near
                best[:-1] = np.maximum(best[:-1], near)
                good = best + rho >= LENGTH
                at = s + at[good]
                ls[at] = np.maximum(ls[at], best[good])
                rs[at] = np.maximum(rs[at], rho)


def _runs(parts: int):
    schema = pa.schema([("part", pa.int32()), ("lcps", pa.binary()), ("rests", pa.binary()),
                        ("lengths", pa.binary()), ("before", pa.binary()), ("before_lengths", pa.binary()),
                        ("counts", pa.binary()), ("keys", pa.binary()), ("positions", pa.binary())])

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw = memoryview(data)
            by_part: dict[int, list] = {}
            for i, (key, positions) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                text = bytes(raw[offsets[i]:offsets[i + 1]])
                back = text[::-1]
                for p in positions:
                    right = text[p:p + LENGTH]
                    left = back[len(text) - p:len(text) - p + BEFORE]
                    part = zlib.crc32(right[:GRAM]) % parts
                    by_part.setdefault(part, []).append((right, left, key, p))
            rows = []
            for part, items in by_part.items():
                items.sort()
                rights, lefts, counts = [], [], []
                for right, left, _, _ in items:
                    if rights and rights[-1] == right and lefts[-1] == left:
                        counts[-1] += 1
                    else:
                        rights.append(right)
                        lefts.append(left)
                        counts.append(1)
                lcps, rests, lengths = front_code(rights)
                rows.append((part, np.array(lcps, np.uint8).tobytes(), rests, np.array(lengths, np.uint8).tobytes(),
                             b"".join(lefts), np.array([len(x) for x in lefts], np.uint8).tobytes(),
                             np.array(counts, np.int32).tobytes(), np.array([x[2] for x in items], np.int64).tobytes(),
                             np.array([x[3] for x in items], np.int32).tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)],
                                                 schema=schema)
    return run


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    runs, lefts, counts, keys, positions = [], [], [], [], []
    for x in group.itertuples():
        lcps = list(x.lcps)
        runs.append((front_decode(lcps, x.rests, x.lengths), lcps))
        size = np.frombuffer(x.before_lengths, np.uint8).astype(np.int64)
        flat = np.frombuffer(x.before, np.uint8)
        padded = np.zeros((len(size), BEFORE), np.uint8)
        padded[np.arange(BEFORE)[None] < size[:, None]] = flat
        lefts.append((padded, size))
        counts.append(np.frombuffer(x.counts, np.int32))
        keys.append(np.frombuffer(x.keys, np.int64))
        positions.append(np.frombuffer(x.positions, np.int32))
    first = np.cumsum([0] + [len(c) for c in counts])
    merged = np.array(merge_runs(runs), np.int64).reshape(-1, 3)
    order = first[merged[:, 0]] + merged[:, 1]
    before = np.concatenate([p for p, _ in lefts])[order]
    lengths = np.concatenate([n for _, n in lefts])[order]
    count = np.concatenate(counts)
    own = np.concatenate([np.fromiter(map(len, r), np.int64, len(r)) for r, _ in runs])[order]
    again = (count[order] > 1) & (lengths + own >= LENGTH)
    ls, rs = np.where(again, lengths, 0), np.where(again, own, 0)
    longest(merged[:, 2], before, lengths, ls, rs)
    reach = np.zeros((2, len(order)), np.int64)
    reach[0, order], reach[1, order] = ls, rs
    keys, positions = np.concatenate(keys), np.concatenate(positions)
    ls, rs = np.repeat(reach[0], count), np.repeat(reach[1], count)
    hit = rs > 0
    return pd.DataFrame({"key": keys[hit], "s": positions[hit] - ls[hit], "e": positions[hit] + rs[hit]})


def _hot_hits(docs: DataFrame, spots: DataFrame, n_spots: int) -> DataFrame:
    """(key, s, e): what the anchors ``spots`` (key, pos; at most ``n_spots``)
    repeat among themselves, without a group of equal starts in any task."""
    held = spots.groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    held = F.broadcast(held) if n_spots <= BROADCAST_ROWS // 8 else held
    whole = stage(docs.join(held, "key").select("key", "text", "positions").mapInArrow(
        _contexts, "key long, pos long, l long, r long, around binary, h1 long, h2 long"))
    own = F.when(F.col("around").isNotNull(), F.struct("key", "pos", "l", "around"))
    each = stage(whole.where(f"l + r >= {LENGTH}").groupBy("h1", "h2")
                 .agg(F.count("*").alias("n"), F.min_by(own, F.when(own.isNotNull(), F.struct("key", "pos"))).alias("one")))
    same = sized(each.where("n > 1").select("h1", "h2"), BROADCAST_ROWS // 8)
    same = whole.join(same, ["h1", "h2"], "left_semi").selectExpr("key", "pos - l as s", "pos + r as e")
    # a string of 200 bytes holds one of 176 bytes that begins at a whole step before the anchor
    schema = "key long, pos long, back long, h1 long, h2 long"
    reps = each.select("one.*")
    rough = stage(reps.mapInArrow(_strings(LENGTH - STEP, BEFORE), schema))
    often = rough.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    steps = (rough.join(often, ["h1", "h2"], "left_semi").groupBy("key", "pos")
             .agg(F.sort_array(F.collect_set("back")).alias("steps")))
    seen = stage(reps.join(steps, ["key", "pos"]).select("key", "pos", "l", "around", "steps"))
    seen = seen.mapInArrow(_strings(LENGTH, 0), schema)
    again = stage(seen.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"))
    part = seen.join(sized(again, BROADCAST_ROWS // 8), ["h1", "h2"], "left_semi").groupBy("key", "pos")
    part = part.agg(F.max("back").alias("most"), F.min("back").alias("least"))
    return same.union(part.selectExpr("key", "pos - most as s", f"pos - least + {LENGTH} as e"))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(key, spans): the maximal repeated runs, as array of (s, e) in bytes, of
    each document (key long, text) that has any."""
    spark = docs.sparkSession
    found = stage(docs.mapInArrow(_find, "key long, pos long, gram int, h_right long, h_left long"))
    each = found.select("key", "pos", "gram", F.explode(F.array("h_right", "h_left")).alias("h")).where("h is not null")
    again = stage(each.groupBy("h").count().where("count > 1").select("h"))
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    held = each.join(again, "h", "left_semi").select("key", "pos", "gram")
    # grams by 32 bits of their hash: what shares them is hot or not together
    hot = stage(held.groupBy("gram").count().where(f"count > {HOT}"))
    n_spots = hot.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    if n_spots:
        hot = sized(hot.select("gram"), BROADCAST_ROWS // 8)
        spots, held = held.join(hot, "gram", "left_semi").select("key", "pos"), held.join(hot, "gram", "left_anti")
    held = stage(held.groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias("positions")))
    total = held.agg(F.coalesce(F.sum(F.size("positions")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PER_PARTITION))
    runs = docs.join(held, "key").select("key", "text", "positions")
    runs = runs.mapInArrow(_runs(parts), "part int, lcps binary, rests binary, lengths binary, before binary,"
                           " before_lengths binary, counts binary, keys binary, positions binary")
    hits = runs.groupBy("part").applyInPandas(_merge, "key long, s long, e long")
    if n_spots:
        hits = hits.union(_hot_hits(docs, spots, n_spots))
    by = Window.partitionBy("key").orderBy("s", "e")
    reach = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.distinct().withColumn("new", F.coalesce((F.col("s") > reach).cast("int"), F.lit(1)))
    hits = hits.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = hits.groupBy("key", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for every row of ``docs`` (doc_id, text):
    the removed runs of bytes and the bytes that stay, joined."""
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("doc_id", "text"))
    spans = stage(repeated_runs(docs.select("key", "text")))
    total = spans.agg(F.coalesce(F.sum(F.size("spans") + 1), F.lit(0))).first()[0]
    spans = F.broadcast(spans) if total <= BROADCAST_ROWS // 2 else spans
    piece = ("transform(sequence(0, size(spans)), i -> string(substring(binary(text),"
             " int(if(i = 0, 0L, get(spans, i - 1).e)) + 1,"
             " int(if(i = size(spans), n_bytes, get(spans, i).s) - if(i = 0, 0L, get(spans, i - 1).e)))))")
    return (docs.join(spans, "key", "left").withColumn("n_bytes", F.octet_length("text").cast("long"))
            .select("doc_id", "n_bytes", F.coalesce("spans", F.expr("array()")).alias("spans"),
                    F.when(F.col("spans").isNull(), F.col("text"))
                    .otherwise(F.array_join(F.expr(piece), "")).cast("binary").alias("kept")))
