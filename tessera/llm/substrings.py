"""Removal of long substrings that repeat anywhere, by bucket refinement.

A full suffix array of a corpus refines q-gram buckets of *all* offsets.  This
one sorts only offsets that can matter, with buckets named by content:

1. Anchors: offsets whose 16-gram hash is least in some window of ``WINDOW``
   starts.  Both occurrences of a repeated ``length``-byte string choose the
   same anchor in it, so anchors stand for all offsets (about 1 in 150).
2. Initial buckets: anchors with equal following bytes (``length - WINDOW``
   of them).  Buckets of one anchor are done: nothing there repeats.
3. Refinement to later (and earlier) offsets: the bucket of an anchor's whole
   surroundings.  Where two anchors share it, every string around them
   repeats, and they are done too.
4. What is left, the edges of repeats, is refined in two steps.  The starts
   around an anchor go in parts of ``PART``; members whose part has the same
   core (what all its strings have in common) stay, and only their strings get
   bucket identifiers (rolling hashes), of which equal ones repeat.  One member
   stands for each group that was done in step 3.  Whole buckets lie side by
   side after one exchange and sort by bucket; a task refines thousands at once.

Identifiers combine the hashes of the parts at later offsets, so no bucket is
numbered by a global sort and updates need no pass over other buckets.  Every
count is an aggregation with map-side combining: copies by the thousand meet
as partial counts.  Buckets of over ``most`` different surroundings are not
gathered but refined by a distributed count of their identifiers.

Passages of ``words`` words that another text holds too are told beside that:
their anchors are words (the least of nine-word hashes in each window), their
buckets the nine words, and their identifiers those of the whole passages.
They share the scans, counts and the one join with the texts.

Equality is that of 64-bit identifiers: two strings are taken for equal where
both a bucket and a string (or surroundings) identifier agree.

Defined results: null and empty texts have nothing to remove; repeated rows
are occurrences of each other, but no other text for a passage; null ids are
ids like others; documents shorter than ``length`` stay whole; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, ByteType, IntegerType, LongType, StringType, StructField, StructType

from tessera.llm.common import scan
from tessera.operators.lineage import free, store

WINDOW, GRAM = 300, 16
SEGMENT = 1 << 19
WORD_BLOCK = 1 << 15
LOW = np.uint64((1 << 20) - 1)
C1, C2, C3, STEP = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xDA942042E4DD58B5))
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))

ANCHOR = StructType([
    StructField("rid", LongType()), StructField("pos", IntegerType()), StructField("k", LongType()),
    StructField("ctx", LongType()), StructField("kind", ByteType()),
])
AROUND = StructType([
    StructField("k", LongType()), StructField("rid", LongType()), StructField("pos", IntegerType()),
    StructField("left", IntegerType()), StructField("around", BinaryType()), StructField("open", BooleanType()),
    StructField("large", BooleanType()),
])
SPAN = StructType([StructField("rid", LongType()), StructField("a", IntegerType()), StructField("b", IntegerType())])
RESULT = StructType([
    StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("n_removed", LongType()),
    StructField("n_spans", LongType()), StructField("kept_sha256", StringType()),
    StructField("repeats", BooleanType()), StructField("kept", StringType()),
])


@lru_cache(maxsize=8)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= C3
    x ^= x >> np.uint64(32)
    return x


class Hashes:
    """Rolling hashes of all substrings (of 16 bytes or more) of some bytes."""

    def __init__(self, data: bytes):
        n = max(0, len(data) - GRAM + 1)
        v = np.ndarray((n + 8,), "<u8", data, 0, (1,)) if n else np.zeros(8, np.uint64)
        self.grams = _mix(v[:n] * C1 + v[8:8 + n] * C2)
        room = 1 << max(11, int(n).bit_length())
        self.back = _powers(room, int(BACK))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.grams * _powers(room, int(STEP))[:n], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b - (GRAM - 1)] - self.sums[a]) * self.back[a])


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w elements."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    behind = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1: n])


def anchors(data: bytes, length: int):
    """Anchors of a text: offset, bucket, surroundings; both as signed longs."""
    n, found = len(data), []
    for s in range(0, n - length + 1, SEGMENT):
        lo = max(0, s - WINDOW + 1)
        hi = min(n, s + SEGMENT - 1 + WINDOW + length)
        h = Hashes(data[lo:hi])
        starts = min(SEGMENT, n - length + 1 - s)
        x = h.grams[s - lo: s - lo + starts + WINDOW - 1]
        best = _least(x & ~LOW | np.arange(len(x), dtype=np.uint64), WINDOW) & LOW
        p = best[np.concatenate([[True], best[1:] != best[:-1]])].astype(np.int64) + (s - lo)
        left, right = np.minimum(p + lo, WINDOW - 1), np.minimum(n - lo - p, length)
        k = h.of(p, p + (length - WINDOW))
        ctx = _mix(h.of(p - left, p + right) + (left * 1024 + right).astype(np.uint64) * C2)
        found.append(np.stack([(p + lo).astype(np.uint64), k, ctx], 1))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = found[0] if len(found) == 1 else np.concatenate(found)
    if len(found) > 1:
        rows = rows[np.unique(rows[:, 0], return_index=True)[1]]
    return rows[:, 0].astype(np.int64), rows[:, 1].astype(np.int64), rows[:, 2].astype(np.int64)


def _covered(pos: int, n: int, length: int):
    """Bytes of the strings around an anchor whose surroundings repeat, or None."""
    left, right = min(pos, WINDOW - 1), min(n - pos, length)
    return (pos - left, pos + right) if left + right >= length else None


def merged(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _merge(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans merged where they overlap."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] >= b[:-1]])  # not across texts that meet
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]


def _ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``start[i], start[i] + 1, ...`` of each i, and the i of each."""
    owner = np.repeat(np.arange(len(count)), count)
    return start[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner], owner


def _changes(x: np.ndarray) -> np.ndarray:
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def chunk_anchors(data: np.ndarray, at: np.ndarray, length: int, h: Hashes):
    """Anchors of texts that lie in ``data`` at ``at[i]: at[i + 1]``: text, offset, bucket, surroundings."""
    starts = _ranges(at[:-1], np.maximum(0, np.diff(at) - length + 1))[0]
    if not len(starts):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    best = _least(h.grams & ~LOW | np.arange(len(h.grams), dtype=np.uint64), WINDOW) & LOW
    p = _changes(best[starts]).astype(np.int64)
    doc = np.searchsorted(at, p, side="right") - 1
    left, right = np.minimum(p - at[doc], WINDOW - 1), np.minimum(at[doc + 1] - p, length)
    k = h.of(p, p + (length - WINDOW))
    return doc, p - at[doc], k, _mix(h.of(p - left, p + right) + (left * 1024 + right).astype(np.uint64) * C2)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; none goes on from one text to the next."""
    ink = np.concatenate([[False], ~_SPACE[data], [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    return np.flatnonzero(ink[1:] & (~ink[:-1] | cut)), np.flatnonzero(ink[:-1] & (~ink[1:] | cut))


def _passage_anchors(h: Hashes, start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray, windows: np.ndarray, words: int):
    """Anchor words of passages of ``words`` words, the words at ``windows`` being their first ones; bucket, surroundings.

    ``first`` and ``last`` bound the words of each word's text.
    """
    if not len(windows):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = h.of(start[: 1 - LEAD], end[LEAD - 1:])
    best = _least(_mix(grams) & ~LOW | np.arange(len(grams), dtype=np.uint64), words - LEAD + 1) & LOW
    p = _changes(best[windows]).astype(np.int64)
    lo, hi = np.maximum(first[p], p - (words - LEAD)), np.minimum(last[p], p + words - 1)
    return p, _mix(grams[p] + C1), _mix(h.of(start[lo], end[hi]) + ((p - lo) * 1024 + hi - p).astype(np.uint64) * C2)


#: Words whose hash makes an anchor of a passage.
LEAD = 9


def _chunks(texts: pa.Array):
    """Runs of texts of up to ``SEGMENT`` bytes together (or one long text), as bytes and offsets."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + SEGMENT, side="right")) - 1)
        yield i, j, data[at[i]: at[j]], at[i: j + 1] - at[i]
        i = j


def _of_chunk(data: np.ndarray, at: np.ndarray, length: int, words: int):
    """Rows of ``ANCHOR`` without ids: text, offset, bucket, surroundings, kind."""
    if len(at) == 2 and len(data) > SEGMENT:
        pos, k, ctx = anchors(data.tobytes(), length)
        doc, k, ctx = np.zeros(len(pos), np.int64), k.view(np.uint64), ctx.view(np.uint64)
        wdoc, wpos, wk, wctx = _long_passages(data, words)
    elif len(data) < GRAM:
        return
    else:
        h = Hashes(data)
        doc, pos, k, ctx = chunk_anchors(data, at, length, h)
        start, end = word_bounds(data, at)
        lo, hi = np.searchsorted(start, at[:-1]), np.searchsorted(start, at[1:])
        windows, _ = _ranges(lo, np.maximum(0, hi - lo - words + 1))
        own = np.repeat(np.arange(len(lo)), hi - lo)
        p, wk, wctx = _passage_anchors(h, start, end, lo[own], hi[own] - 1, windows, words)
        wdoc, wpos = own[p], start[p] - at[own[p]]
    if len(doc):
        order = np.lexsort((pos, ctx, k, doc))
        d, x, c = doc[order], k[order], ctx[order]
        heads = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (c[1:] != c[:-1])]))
        counts = np.diff(np.append(heads, len(order)))
        again = order[np.repeat(counts > 1, counts)]
        size = np.diff(at)[doc[again]]
        left, right = np.minimum(pos[again], WINDOW - 1), np.minimum(size - pos[again], length)
        fits = left + right >= length
        if fits.any():
            base = at[doc[again]][fits]
            a, b = _merge((pos[again] - left)[fits] + base, (pos[again] + right)[fits] + base)
            d = np.searchsorted(at, a, side="right") - 1
            yield d, a - at[d], (b - at[d]).astype(np.uint64), np.zeros(len(a), np.uint64), np.full(len(a), 1)
        o = order[heads]
        yield doc[o], pos[o], k[o], ctx[o], np.where(counts > 1, 2, 0)
    if len(wdoc):
        order = np.lexsort((wpos, wctx, wk, wdoc))
        d, x, c = wdoc[order], wk[order], wctx[order]
        o = order[np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]) | (c[1:] != c[:-1])])]
        yield wdoc[o], wpos[o], wk[o], wctx[o], np.full(len(o), 3)


def _long_passages(data: np.ndarray, words: int):
    """Anchors of passages of one long text, block of words by block of words."""
    start, end = word_bounds(data, np.array([0, len(data)]))
    n, found = len(start), []
    for j in range(0, n - words + 1, WORD_BLOCK):
        lo, hi = max(0, j - words), min(n, j + (WORD_BLOCK) + 2 * words)
        a, b = start[lo:hi] - start[lo], end[lo:hi] - start[lo]
        windows = np.arange(j, min(j + (WORD_BLOCK), n - words + 1)) - lo
        h = Hashes(data[start[lo]: end[hi - 1]])
        p, k, ctx = _passage_anchors(h, a, b, np.zeros(hi - lo, np.int64), np.full(hi - lo, hi - lo - 1), windows, words)
        found.append((np.zeros(len(p), np.int64), start[lo + p], k, ctx))
    if not found:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchor_rows(length: int, words: int):
    schema = to_arrow_schema(ANCHOR)

    def run(batches):
        for batch in batches:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, data, at in _chunks(batch.column(1)):
                for doc, pos, k, ctx, kind in _of_chunk(data, at, length, words):
                    cols = (rid[i + doc], pos.astype(np.int32), k.view(np.int64), ctx.view(np.int64), kind.astype(np.int8))
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run


def _around_rows(length: int, words: int):
    def start():
        def one(rid, text, members):
            data = (text or "").encode()
            passages = [m["pos"] for m in members if m["words"]]
            for m in members:
                if not m["words"]:
                    p = m["pos"]
                    left = min(p, WINDOW - 1)
                    yield m["k"], rid, p, left, data[p - left: p + length], m["open"], m["large"]
            if passages:
                for x in passage_ids(np.frombuffer(data, np.uint8), passages, words).tolist():
                    yield x, rid, -1, None, None, None, None

        return one

    return start


def passage_ids(data: np.ndarray, pos: list[int], words: int) -> np.ndarray:
    """Identifiers of the passages of ``words`` words around some anchor words."""
    start, end = word_bounds(data, np.array([0, len(data)]))
    j, n, out = np.searchsorted(start, np.sort(np.array(pos))), len(start), []
    for part in np.split(j, np.flatnonzero(np.diff(j) > 1 << 12) + 1):
        lo, hi = max(0, part[0] - words), min(n, part[-1] + words + 1)
        h = Hashes(data[start[lo]: end[hi - 1]])
        a, b = start[lo:hi] - start[lo], end[lo:hi] - start[lo]
        first = np.maximum(0, part - (words - LEAD))
        i = np.unique(_ranges(first, np.maximum(0, np.minimum(part, n - words) - first + 1))[0]) - lo
        out.append(h.of(a[i], b[i + words - 1]))
    return np.unique(np.concatenate(out)).view(np.int64)


#: Starts around an anchor go in parts of so many; the strings of a part have its core in common.
PART = 20
def _starts(size: int, left: int, length: int) -> tuple[int, int]:
    """Least and greatest distance from the anchor back to the start of a string inside ``around``."""
    return max(0, left + length - size), left


def _cores(h: Hashes, size: int, left: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts that hold a start, and the identifiers of their cores."""
    lo, hi = _starts(size, left, length)
    if lo > hi:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    parts = np.arange(lo // PART, hi // PART + 1)
    a = left - parts * PART  # the core: what the strings of every start in the part have in common
    return parts, _mix(h.of(a, a + length - PART + 1) + parts.astype(np.uint64) * C1)


def _strings(h: Hashes, size: int, left: int, length: int, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the starts in some parts, and identifiers of their strings, places mixed in."""
    lo, hi = _starts(size, left, length)
    back = (parts[:, None] * PART + np.arange(PART)).ravel()
    back = back[(back >= lo) & (back <= hi)]
    a = left - back
    return back, _mix(h.of(a, a + length) + back.astype(np.uint64) * C1)


def _again(ids: np.ndarray) -> np.ndarray:
    """Which of the identifiers occur more than once."""
    _, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _runs(rid, pos, back: np.ndarray, length: int):
    """Spans of bytes from the distances of repeated starts."""
    start = np.sort(pos - back)
    if len(start):
        edge = np.flatnonzero(np.diff(start) > 1)
        for a, b in zip(start[np.append(0, edge + 1)].tolist(), start[np.append(edge, len(start) - 1)].tolist()):
            yield rid, a, b + length


def _repeated(k, rid, pos, left, around: pa.Array, is_open, length: int):
    """Members of whole buckets -> spans of those that are open: cores first, then the strings of repeated cores."""
    at = np.frombuffer(around.buffers()[1], np.int64)[around.offset: around.offset + len(around) + 1]
    h, off, size = Hashes(np.frombuffer(around.buffers()[2], np.uint8)[at[0]: at[-1]]), at[:-1] - at[0], np.diff(at)
    salt = _mix(k.view(np.uint64) * C2)
    lo = np.maximum(0, left + length - size)
    part, m = _ranges(lo // PART, np.maximum(0, left // PART - lo // PART + 1) * (lo <= left))
    a = off[m] + left[m] - part * PART
    ids = _mix(h.of(a, a + length - PART + 1) + part.astype(np.uint64) * C1) ^ salt[m]
    twice = _again(ids)
    part, m = part[twice], m[twice]
    back, m = (part[:, None] * PART + np.arange(PART)).ravel(), np.repeat(m, PART)
    inside = (back >= lo[m]) & (back <= left[m])
    back, m = back[inside], m[inside]
    a = off[m] + left[m] - back
    found = _again(_mix(h.of(a, a + length) + back.astype(np.uint64) * C1) ^ salt[m]) & is_open[m]
    back, m = back[found], m[found]
    order = np.lexsort((-back, m))
    m, begin = m[order], pos[m[order]] - back[order]
    if not len(m):
        return m, m, m
    edge = np.flatnonzero((m[1:] != m[:-1]) | (begin[1:] - begin[:-1] > 1))
    first, last = np.append(0, edge + 1), np.append(edge, len(m) - 1)
    return rid[m[first]], begin[first], begin[last] + length


def _refine(length: int, batch: int = 1 << 20):
    """Rows in the order of their buckets -> spans, many buckets at a time."""
    schema = to_arrow_schema(SPAN)

    def spans(t: pa.Table):
        n = lambda c: t[c].combine_chunks().to_numpy(zero_copy_only=False)
        around = t["around"].combine_chunks().cast(pa.large_binary())
        cols = _repeated(n("k"), n("rid"), n("pos").astype(np.int64), n("left").astype(np.int64), around, n("open").astype(bool), length)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(f.type.to_pandas_dtype())) for c, f in zip(cols, schema)], schema=schema)

    def run(batches):
        held: list[pa.RecordBatch] = []
        room = batch
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                held.append(b.slice(at, 1024))
                if sum(x.nbytes for x in held) < room:
                    continue
                t = pa.Table.from_batches(held)
                k = t["k"].to_numpy()
                new = np.flatnonzero(k[1:] != k[:-1]) + 1
                whole = int(new[-1]) if len(new) else 0  # the last bucket may go on
                if whole:
                    yield spans(t.slice(0, whole))
                held = t.slice(whole).combine_chunks().to_batches()
                room = batch + sum(x.nbytes for x in held)
        if held:
            yield spans(pa.Table.from_batches(held))

    return run


def repeated_spans(docs: DataFrame, length: int = 400, most: int = 2048, text_col="text", words: int = 51) -> DataFrame:
    """``rid, spans``: structs ``a, b`` of repeated bytes; b = -1 marks an anchor at a that is wholly repeated,
    b = -2 a text with a passage of ``words`` words that stands in another text as well.

    ``docs`` carries ``rid``, a long that equal rows share.
    """
    if length < WINDOW + 2 * GRAM:
        raise ValueError(f"length must be at least {WINDOW + 2 * GRAM}")
    if words < 2 * LEAD:
        raise ValueError(f"words must be at least {2 * LEAD}")
    texts = docs.select("rid", docs[text_col].cast("string").alias("text"))
    rows = store(texts.mapInArrow(_anchor_rows(length, words), ANCHOR))
    local = store(rows.where("kind = 1").select("rid", F.col("pos").alias("a"), F.col("k").cast("int").alias("b")))
    found = rows.where("kind <> 1").withColumn("n", F.when(F.col("kind") == 2, 2).otherwise(1)).withColumn("words", F.col("kind") == 3)
    # a bucket lives if it holds two strings, for passages those of two texts
    counts = [F.sum("n").alias("t"), F.min("rid").alias("r1"), F.max("rid").alias("r2")]
    several = F.when(F.col("words"), F.col("r1") != F.col("r2")).otherwise(F.col("t") > 1)
    shared = found.groupBy("k", "words").agg(*counts).where(several).select("k", "words")
    live = store(found.join(shared, ["k", "words"], "left_semi").select("rid", "pos", "k", "ctx", "n", "words"))
    free(rows)
    groups = store(live.groupBy("k", "words", "ctx").agg(*counts, F.min(F.struct("rid", "pos")).alias("first")).withColumn("all", several))
    equal = live.join(groups.where("all").select("k", "words", "ctx"), ["k", "words", "ctx"], "left_semi")
    done = equal.select("rid", F.when(F.col("words"), 0).otherwise(F.col("pos")).alias("a"), F.when(F.col("words"), -2).otherwise(-1).alias("b")).distinct()
    sizes = groups.groupBy("k", "words").agg(F.count(F.lit(1)).alias("different"), F.sum((~F.col("all")).cast("int")).alias("loose"))
    left = groups.join(sizes.where("different > 1 and loose > 0"), ["k", "words"]).select(
        F.col("first.rid").alias("rid"), F.struct(F.col("first.pos").alias("pos"), "k", (~F.col("all")).alias("open"), "words", (F.col("different") > most).alias("large")).alias("m"))
    left = store(left)
    wanted = left.groupBy("rid").agg(F.collect_list("m").alias("members"))  # at most the anchors of one text
    around = store(scan(texts.join(wanted, "rid"), ["rid", "text", "members"], _around_rows(length, words), AROUND))
    passages = around.where("pos = -1").select("k", "rid")
    again = passages.groupBy("k").agg(F.min("rid").alias("r1"), F.max("rid").alias("r2")).where("r1 <> r2").select("k")
    repeats = passages.join(again, "k", "left_semi").select("rid").distinct().select("rid", F.lit(0).alias("a"), F.lit(-2).alias("b"))
    # whole buckets by one exchange right below the map: Spark may split or drop an exchange that a join asks for
    small = around.where("pos >= 0 and not large").drop("large").repartition("k").sortWithinPartitions("k").mapInArrow(_refine(length), SPAN)
    large = around.where("pos >= 0 and large").drop("large")
    out = local.unionByName(done).unionByName(small).unionByName(repeats)
    tables = [local, live, groups, left, around]
    if not large.isEmpty():
        cores, each = _large(large, length)
        tables += [cores, each]
        twice = each.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
        out = out.unionByName(each.where("at >= 0").join(twice, "id", "left_semi").select("rid", F.col("at").alias("a"), (F.col("at") + length).alias("b")))
    out = store(out.groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("spans")))  # at most what stands in one text
    free(*tables)
    return out


#: A core or string of a large bucket: its identifier, with the bucket's mixed in; the anchor's place; a core's part, or
#: a string's start (-1 if it only counts).
EACH = StructType([StructField("id", LongType()), StructField("rid", LongType()), StructField("pos", IntegerType()), StructField("at", IntegerType())])


def _large(around: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Cores, and strings of repeated cores, of the buckets that are not gathered, refined by distributed counts."""
    cores = store(scan(around, ["k", "rid", "pos", "left", "around"], _each_core(length), EACH))
    twice = cores.groupBy("id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("id")
    alive = cores.join(twice, "id", "left_semi").groupBy("rid", "pos").agg(F.collect_list("at").alias("parts"))  # at most the parts of one anchor
    return cores, store(scan(around.join(alive, ["rid", "pos"]), ["k", "rid", "pos", "left", "around", "open", "parts"], _each_string(length), EACH))


def _in_bucket(ids: np.ndarray, k: int) -> list[int]:
    return _mix(ids + np.uint64(k & (1 << 64) - 1)).view(np.int64).tolist()


def _each_core(length: int):
    def start():
        def one(k, rid, pos, left, around):
            parts, ids = _cores(Hashes(around), len(around), left, length)
            for c, h in zip(parts.tolist(), _in_bucket(ids, k)):
                yield h, rid, pos, c

        return one

    return start


def _each_string(length: int):
    def start():
        def one(k, rid, pos, left, around, is_open, parts):
            back, ids = _strings(Hashes(around), len(around), left, length, np.array(sorted(parts), np.int64))
            for d, h in zip(back.tolist(), _in_bucket(ids, k)):
                yield h, rid, pos, pos - d if is_open else -1

        return one

    return start


def _cut_rows(length: int, with_text: bool):
    def start():
        def one(i, text, spans):
            data = (text or "").encode()
            found, repeats = [], False
            for s in spans or ():
                if s["b"] == -2:
                    repeats = True
                    continue
                span = (s["a"], s["b"]) if s["b"] >= 0 else _covered(s["a"], len(data), length)
                if span:
                    found.append(span)
            runs, kept, at = merged(found), [], 0
            for a, b in runs:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rest = b"".join(kept)
            yield (i, len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), repeats,
                   rest.decode(errors="ignore") if with_text else None)

        return one

    return start


def remove_repeats(docs: DataFrame, length: int = 400, most: int = 2048, id_col="doc_id", text_col="text", with_text=True, words: int = 51) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats, kept`` of every row.

    ``repeats`` tells whether the text holds a passage of ``words`` words, as
    written, that also stands in the text of another document; those may be
    shorter than ``length`` bytes and are told, not removed.  ``kept`` is the
    remaining text (bytes of characters cut in half dropped), or null unless
    ``with_text``.
    """
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    d = d.withColumn("rid", F.xxhash64("doc_id", "text"))
    return scan(d.join(repeated_spans(d, length, most, words=words), "rid", "left"), ["doc_id", "text", "spans"], _cut_rows(length, with_text), RESULT)
