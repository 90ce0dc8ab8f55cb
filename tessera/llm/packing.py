"""Packing documents into training sequences along a Hilbert curve.

1. One Python pass tokenizes every whole text (words are looked up in a worker
   cache of token ids), hashes the ids into a signed vector, projects it to
   four dimensions and takes the Hilbert key of the quantised point.  Only a
   digest of each document goes on: lengths, the key, and CRC-32s of its full
   sequences and of each 64-id block of the rest, from which the CRC of any
   cut at a block boundary follows without the ids.
2. Digests are range-partitioned and sorted by (key, id): the id splits the
   one key that many copies share, so no key decides a partition's size.
3. Along the curve, in windows of ``window`` documents, rests go by best fit
   into sequences; what lies in poorly filled ones is laid end to end and cut
   at block boundaries, which leaves under 64 ids unused in each.  The last,
   open sequence of each partition is packed again with its neighbours'.

Defined results: null and empty texts are documents of one id (``end_id``);
null ids stay null and come after others where ids decide;
equal documents get equal keys and land side by side; repeated rows are packed
as often as they occur; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from tessera.llm.common import scan
from tessera.operators.lineage import cut

BLOCK = 64
BUCKETS, DIMS, BITS = 256, 4, 8
_ODD_SPACE = tuple("\x1c\x1d\x1e\x1f")


@lru_cache(maxsize=1)
def encoder(path: str, cache: int = 400_000):
    """text -> ids as little-endian unsigned 32-bit bytes, exactly the library's.

    Where the tokenizer drops white space, words are independent of each other
    and cached, ``cache`` of them (a worker process keeps the cache between its tasks); texts with special strings or
    control separators go whole.
    """
    from tessera.llm.bpe import Kept, WordBpe

    bpe = WordBpe(path, cache)
    whole = lambda text: bpe.slow(text).tobytes()
    words = Kept(bpe.ids, cache)

    def encode(text: str) -> bytes:
        if not bpe.suffix or any(s in text for s in bpe.specials) or any(s in text for s in _ODD_SPACE):
            return whole(text)
        return b"".join(map(words.__getitem__, text.split()))

    return encode


@lru_cache(maxsize=1)
def _tables(vocab: int):
    """Bucket and sign of each id, and the projection; the same in every worker."""
    x = np.arange(vocab, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    sign = np.where(x >> np.uint64(63), 1.0, -1.0)
    return (x % np.uint64(BUCKETS)).astype(np.intp), sign, np.random.RandomState(7).randn(BUCKETS, DIMS)


def hilbert(point: list[int], bits: int = BITS) -> int:
    """Index on the Hilbert curve of a point with ``bits`` bits per axis."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    key = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = key << 1 | (v ^ t) >> b & 1
    return key


DIGEST = StructType([
    StructField("doc_id", LongType()), StructField("doc_tokens", LongType()), StructField("key", LongType()),
    StructField("fulls", BinaryType()), StructField("blocks", BinaryType()),
])
PIECE = StructType([
    StructField("doc_id", LongType()), StructField("start", LongType()), StructField("length", LongType()),
    StructField("ids_crc32", LongType()), StructField("doc_tokens", LongType()),
    StructField("sequence_id", LongType()), StructField("offset", LongType()),
    StructField("blocks", BinaryType()), StructField("settled", BooleanType()),
])


def digests(docs: DataFrame, path: str, size: int, end_id: int, id_col="doc_id", text_col="text", cache: int = 400_000) -> DataFrame:
    def start():
        encode, end = encoder(path, cache), np.uint32(end_id).astype("<u4").tobytes()
        bucket, sign, plane = _tables(1 << 17)

        def one(i, text):
            data = encode(text or "") + end
            ids = np.frombuffer(data, "<u4")
            n = len(ids)
            v = np.zeros(BUCKETS)
            for at in range(0, n, 1 << 16):
                part = ids[at:at + (1 << 16)] & 0x1FFFF
                v += np.bincount(bucket[part], weights=sign[part], minlength=BUCKETS)
            v = np.sign(v) * np.sqrt(np.abs(v))
            at = v @ plane / (np.linalg.norm(v) or 1.0)
            point = np.clip((at + 3) * ((1 << BITS) / 6), 0, (1 << BITS) - 1).astype(int).tolist()
            rest = n // size * size
            crc = lambda a, b: zlib.crc32(data[4 * a:4 * b])
            fulls = np.array([crc(a, a + size) for a in range(0, rest, size)], "<u4").tobytes()
            blocks = np.array([crc(a, min(a + BLOCK, n)) for a in range(rest, n, BLOCK)], "<u4").tobytes()
            yield i, n, hilbert(point), fulls, blocks

        return one

    return scan(docs, [docs[id_col].cast("long"), docs[text_col].cast("string")], start, DIGEST)


def joined_crc(blocks: bytes, length: int) -> int:
    """CRC-32 of ``length`` ids from the CRCs of their 64-id blocks."""
    crc, left = 0, length
    for c in np.frombuffer(blocks, "<u4").tolist():
        zeros = bytes(4 * min(BLOCK, left))
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ c
        left -= BLOCK
    return crc


class _Packer:
    """Packs rests window by window; keeps one window and one open sequence."""

    def __init__(self, size: int, window: int, base: int):
        self.size, self.window, self.next = size, window, base
        self.wait: list[tuple] = []  # (length, doc_id, start, doc_tokens, blocks)
        self.open: list[tuple] = []
        self.room = size

    def emit(self, pieces, settled=True):
        at = 0
        for length, i, start, n, blocks in pieces:
            yield i, start, length, joined_crc(blocks, length), n, self.next, at, b"" if settled else blocks, settled
            at += length
        self.next += 1

    def add(self, rest):
        self.wait.append(rest)
        if len(self.wait) >= self.window:
            yield from self.pack()

    def pack(self):
        """Best fit, longest first; poorly filled sequences are laid end to end."""
        bins, free = {}, []
        for k, r in enumerate(sorted(self.wait, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))):
            at = bisect_left(free, (r[0], -1))
            room, b = free.pop(at) if at < len(free) else (self.size, k)
            bins.setdefault(b, []).append(r)
            insort(free, (room - r[0], b))
        place = {r: k for k, r in enumerate(self.wait)}
        self.wait = []
        loose = []
        for room, b in sorted(free, key=lambda x: x[1]):
            if room < BLOCK // 2:
                yield from self.emit(bins[b])
            else:
                loose += bins[b]
        for r in sorted(loose, key=place.__getitem__):
            yield from self.lay(r)

    def lay(self, r):
        while r:
            length, i, start, n, blocks = r
            if length <= self.room:
                self.open.append(r)
                self.room -= length
                r = None
            else:
                part = self.room // BLOCK
                if part:
                    self.open.append((part * BLOCK, i, start, n, blocks[:4 * part]))
                    r = (length - part * BLOCK, i, start + part * BLOCK, n, blocks[4 * part:])
                self.room = 0
            if self.room < BLOCK // 2 or r:
                yield from self.emit(self.open)
                self.open, self.room = [], self.size

    def finish(self, settled):
        yield from self.pack()
        if self.open:
            yield from self.emit(self.open, settled or self.room < BLOCK)
            self.open, self.room = [], self.size


def _packed(rows: DataFrame, size: int, window: int, first: bool) -> DataFrame:
    """One packing pass over curve-ordered partitions."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(PIECE)

    def run(batches):
        pack = _Packer(size, window, (TaskContext.get().partitionId() << 32) + (0 if first else 1 << 62))
        out: list[tuple] = []

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(target)], schema=target)
            out.clear()
            return b

        for batch in batches:
            for row in batch.to_pylist():
                if first:
                    i, n = row["doc_id"], row["doc_tokens"]
                    fulls = np.frombuffer(row["fulls"], "<u4").tolist()
                    for k, c in enumerate(fulls):
                        out.append((i, k * size, size, c, n, pack.next, 0, b"", True))
                        pack.next += 1
                    at = len(fulls) * size
                    if n > at:
                        out.extend(pack.add((n - at, i, at, n, row["blocks"])))
                else:
                    out.extend(pack.add((row["length"], row["doc_id"], row["start"], row["doc_tokens"], row["blocks"])))
                if len(out) >= 4096:
                    yield flush()
        out.extend(pack.finish(not first))
        yield flush()

    return rows.mapInArrow(run, PIECE)


def pack(docs: DataFrame, path: str, size: int = 4096, end_id: int = 2, window: int = 2048,
         docs_per_partition: int = 20_000, id_col="doc_id", text_col="text", cache: int = 400_000) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``cache`` words and as many word cores are kept in each Python worker, in
    two generations (some 400 bytes each); it changes speed and memory only.
    """
    if size % BLOCK:
        raise ValueError(f"size must be a multiple of {BLOCK}")
    d = cut(digests(docs, path, size, end_id, id_col, text_col, cache))
    parts = max(1, -(-d.count() // docs_per_partition))
    order = ["key", "doc_id", "doc_tokens", "blocks"]
    sorted_ = d.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    first = cut(_packed(sorted_, size, window, True))
    loose = first.where("not settled")
    groups = max(1, -(-first.rdd.getNumPartitions() // 256))
    return first.where("settled").union(_packed(loose.coalesce(groups), size, window, False)).drop("blocks", "settled")
