"""Phrase collocations by mergeable Misra-Gries summaries.

Phrases are hashed into partitions.  A task counts the phrases of its texts and
hands every partition its share together with the share's mass (the running
phrases behind it).  A partition first learns its whole mass M, so it can take
more than M / least counters; then it merges the shares: once more phrases are
held than counters, the count of rank capacity + 1 is taken off all of them.
All that is taken off a phrase is at most M / (capacity + 1) < least, so every
phrase with ``least`` occurrences survives, and a survivor whose count plus all
that was taken off stays under ``least`` cannot have them.  Survivors set bits
of a bitmap of fixed size, and a second pass over the texts counts what hits
the bitmap, by the words themselves, exactly: strangers that hit it too are
told by their counts.

Scores come from joins of the counted phrases with their parts; every part of a
frequent phrase is at least as frequent, so it was counted as well.

Defined results: null text is empty, null lang ``und`` (one group with a lang of
that name); texts without words add nothing; repeated rows count as often as
they stand there; a lang without candidates gives no rows, nor does an empty
table; ties go by score, occurrences, then the phrase's UTF-8 bytes; further
columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SALTS, chunked, mix, prepare, span_hashes, stage, text_bytes

LEAST, LONGEST, FIRST, INSIDE = 10, 3, 2000, 50
#: Text bytes behind one hash partition; their number follows from it.
PARTITION_BYTES = 32_000_000
#: Text bytes that a task turns into arrays at a time, and running phrases that it counts before it hands them on.
CHUNK, HELD = 400_000, 1_000_000
#: Bits of the survivors' bitmap: 16 MB at any size of the input.
BITS = 27

GAP, BREAK = np.zeros(256, bool), np.zeros(256, bool)
GAP[[9, 32]] = True
BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True


def grams(data: np.ndarray, offsets: np.ndarray, salt: np.ndarray, longest: int):
    """Lower-cased bytes and words (start, end, row) of texts given as bytes,
    and for every length k up to ``longest`` the hashes of all phrases of k
    words with the index of their first word."""
    low = LOWER[data]
    breaks = BREAK[low]
    apart = GAP[low] | breaks
    edge = np.ones(len(low) + 2, bool)
    edge[1:-1] = apart
    first_byte = np.zeros(len(low) + 1, bool)
    first_byte[offsets] = True
    starts = np.flatnonzero(~apart & (edge[:-2] | first_byte[:-1]))
    ends = np.flatnonzero(~apart & (edge[2:] | first_byte[1:])) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    piece = np.cumsum(breaks)[starts]
    word = span_hashes(low, starts, ends)
    out = []
    for k in range(1, longest + 1):
        m = max(0, len(starts) - k + 1)
        first = np.flatnonzero((rows[:m] == rows[k - 1:]) & (piece[:m] == piece[k - 1:])) if m else np.zeros(0, np.int64)
        h = salt[rows[first]] + SALTS[300 + k]
        for j in range(k):
            h += word[first + j] * SALTS[310 + j]
        out.append((mix(h), first))
    return low, starts, ends, rows, out


def _salts(langs: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    coded = langs.dictionary_encode()
    names = coded.dictionary.to_pylist()
    raw = [n.encode() for n in names]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - np.array([len(r) for r in raw], np.int64) if raw else ends
    salt = span_hashes(data, starts, ends) if raw else np.zeros(0, np.uint64)
    return salt, names, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def counted(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, with the sum of their counts (of ones if None)."""
    if counts is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
    at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    if counts is None:
        return hashes[at], np.diff(np.append(at, len(hashes)))
    return hashes[at], np.add.reduceat(counts, at) if len(at) else counts


class Summary:
    """Misra-Gries counters of one partition whose whole mass is known."""

    def __init__(self, mass: int, least: int):
        self.capacity = mass // least + 1
        self.keys, self.counts, self.off = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        self.waiting, self.held = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.held += len(keys)
        if self.held > max(200_000, self.capacity // 2):
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        self.keys, self.counts = counted(np.concatenate([self.keys, *[k for k, _ in self.waiting]]),
                                         np.concatenate([self.counts, *[c for _, c in self.waiting]]))
        self.waiting, self.held = [], 0
        if len(self.keys) > self.capacity:
            at = len(self.counts) - self.capacity - 1
            cut = int(np.partition(self.counts, at)[at])
            keep = self.counts > cut
            self.keys, self.counts = self.keys[keep], self.counts[keep] - cut
            self.off += cut

    def survivors(self, least: int) -> np.ndarray:
        self.merge()
        return self.keys[self.counts + self.off >= least]


def _shares(parts: int, longest: int):
    """Arrow kernel: (part, mass, keys, counts) of the phrases of a task, for
    each share a row with its mass alone as well."""
    def flush(held):
        keys, counts = counted(np.concatenate(held))
        part = ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends, mass, part = np.append(at[1:], len(part)), np.add.reduceat(counts, at), part[at]
        counts = counts.astype(np.uint32)
        for lo, hi in chunked(np.append(at, len(keys)), 100_000, 1000):
            n, spans = hi - lo, list(zip(at[lo:hi], ends[lo:hi]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(part[lo:hi], 2)), pa.array(np.concatenate([mass[lo:hi], np.zeros(n, np.int64)])),
                 pa.array([None] * n + [keys[a:b].tobytes() for a, b in spans], pa.binary()),
                 pa.array([None] * n + [counts[a:b].tobytes() for a, b in spans], pa.binary())],
                names=["part", "mass", "keys", "counts"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            salt, _, lang = _salts(batch.column(1))
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in chunked(offsets, CHUNK):
                *_, found = grams(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], salt[lang[lo:hi]], longest)
                held += [h for h, _ in found]
                size += sum(len(h) for h, _ in found)
                if size >= HELD:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


def _surviving(least: int, bits: int):
    """Arrow kernel over shares sorted by part, masses first: (start, bits),
    the bytes of the bitmap from ``start`` on that a part's survivors set.
    Parts are ranges of hashes, so all their pieces make up one bitmap."""
    def run(batches):
        now, mass, summary = None, 0, None

        def piece():
            at = (summary.survivors(least) >> np.uint64(64 - bits)).astype(np.int64) if summary else np.zeros(0, np.int64)
            if len(at):
                start = int(at.min()) >> 3
                held = np.zeros(((int(at.max()) >> 3) - start + 1) * 8, bool)
                held[at - start * 8] = True
                yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([np.packbits(held).tobytes()], pa.binary())],
                                                 names=["start", "bits"])

        for batch in batches:
            for part, size, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                batch.column(2), batch.column(3)):
                if part != now:
                    yield from piece()
                    now, mass, summary = part, 0, None
                if not keys.is_valid:
                    mass += size
                    continue
                summary = summary or Summary(mass, least)
                summary.add(np.frombuffer(keys.as_buffer(), np.uint64).copy(),
                            np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64))
        yield from piece()

    return run


def bitmap(texts: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS,
           partition_bytes: int = PARTITION_BYTES) -> np.ndarray:
    """Bits of all phrases of ``texts`` (text, lang) that may occur ``least``
    times, by the first ``bits`` bits of their hash; of fixed size."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shares = texts.mapInArrow(_shares(64 + size // partition_bytes, longest),
                              "part long, mass long, keys binary, counts binary")
    dealt = shares.repartition("part").sortWithinPartitions("part", F.col("keys").isNotNull())
    out = np.zeros(2**bits // 8, np.uint8)
    for batch in dealt.mapInArrow(_surviving(least, bits), "start long, bits binary").toArrow().to_batches():
        for start, held in zip(batch.column(0).to_pylist(), batch.column(1)):
            held = np.frombuffer(held.as_buffer(), np.uint8)
            out[start:start + len(held)] |= held
    return out


def _occurrences(sent, longest: int, bits: int):
    """Arrow kernel: (lang, phrase, f) of the phrases of a task that hit the
    bitmap, told apart by their words, and per lang its running words."""
    def batch_of(names, langs, phrases, counts):
        return pa.RecordBatch.from_arrays([names.take(pa.array(langs)), phrases, pa.array(counts, pa.int64())],
                                          names=["lang", "phrase", "f"])

    def run(batches):
        marked = sent.value
        for batch in batches:
            salt, names, lang = _salts(batch.column(1))
            names = pa.array(names, pa.string())
            data, offsets = text_bytes(batch.column(0))
            for lo, hi in chunked(offsets, CHUNK):
                low, starts, ends, rows, found = grams(
                    data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], salt[lang[lo:hi]], longest)
                if not len(starts):
                    continue
                own = lang[lo:hi][rows]
                running = np.bincount(own, minlength=len(names))
                seen = np.flatnonzero(running)
                yield batch_of(names, seen, pa.nulls(len(seen), pa.string()), running[seen])
                # words by exact code; a phrase is its phrase without the last word, by code, and that word
                cut = np.stack([starts, ends], 1).ravel()
                words = pa.Array.from_buffers(pa.large_binary(), len(cut), [
                    None, pa.py_buffer(np.append(cut, len(low))), pa.py_buffer(low)]).take(pa.array(np.arange(len(starts)) * 2))
                coded = words.dictionary_encode()
                distinct, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                before, size = own, len(distinct)
                for k, (h, first) in enumerate(found):
                    place = (h >> np.uint64(64 - bits)).astype(np.int64)
                    first = first[(marked[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0]
                    first = first[before[first] >= 0]
                    _, sample, index, count = np.unique(before[first] * size + code[first + k], return_index=True,
                                                        return_inverse=True, return_counts=True)
                    before = np.full(len(starts), -1)
                    before[first] = index
                    at = first[sample]
                    parts = [distinct.take(pa.array(code[at + j])) for j in range(k + 1)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k else parts[0]
                    yield batch_of(names, own[at], phrase.cast(pa.binary()).view(pa.string()), count)

    return run


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int = BITS,
             partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to ``longest`` words with at least
    ``least`` occurrences, and per lang a row without phrase: its running words."""
    spark = docs.sparkSession
    prepare(spark)
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    sent = spark.sparkContext.broadcast(bitmap(texts, least, longest, bits, partition_bytes))
    found = texts.mapInArrow(_occurrences(sent, longest, bits), "lang string, phrase string, f long")
    return stage(found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where(f"phrase is null or f >= {int(least)}"))


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, first: int = FIRST, inside: int = INSIDE,
            bits: int = BITS, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each lang's ``first`` phrases
    of 2 to ``longest`` words: floor(10**6 * a * a / (l * r)) of the lowest cut,
    without phrases that stand within a longer one in ``inside`` percent of
    their occurrences."""
    counts = frequent(docs, least, longest, bits, partition_bytes)
    single = counts.where("phrase is not null")
    found = single.selectExpr("lang", "phrase", "f as a", "split(phrase, ' ') as w").where("size(w) > 1")
    cuts = found.selectExpr("lang", "phrase", "a", "w", "explode(sequence(1, size(w) - 1)) as k").selectExpr(
        "lang", "phrase", "a", "k", "array_join(slice(w, 1, k), ' ') as head",
        "array_join(slice(w, k + 1, size(w) - k), ' ') as tail")
    left = single.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = single.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    wide = "cast({0} as decimal(15,0))".format
    value = f"({wide('a')} * {wide('a')} * 1000000BD) div ({wide('l')} * {wide('r')})"
    best = (cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"])
            .groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr(value).alias("score"), "k", "l", "r")).alias("cut")))
    covered = (found.where("size(w) > 2")
               .selectExpr("lang", "a", "w", "explode(sequence(2, size(w) - 1)) as k")
               .selectExpr("lang", "a", "explode(transform(sequence(1, size(w) - k + 1), i -> "
                           "array_join(slice(w, i, k), ' '))) as phrase")
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (best.join(covered, ["lang", "phrase"], "left")
            .where(f"longer is null or 100 * longer < {int(inside)} * a"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    words = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    top = kept.withColumn("rank", F.row_number().over(order)).where(f"rank <= {int(first)}")
    return top.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r",
                                          "n", F.col("cut.score").cast("long").alias("score"))
