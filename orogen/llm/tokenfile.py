"""Token ids in files coded by a static range asymmetric numeral system.

A segment is a run of documents in ascending doc_id: a header, one frequency table shared by all its blocks, and
blocks that are coded independently.  A block interleaves LANES coders (symbol k belongs to lane k mod LANES), keeps the
lanes' states and the word position every CHECKPOINT steps, so that decoding can begin at any of them, and carries a
checksum of its ids.  A worker holds one segment, at most SEGMENT_TOKENS and one document more.

    segment := "RNS1" | n_blocks u32 | n_docs u32 | n_symbols u32 | scale u32
               | symbols u32[n_symbols] | frequencies u32[n_symbols] | doc_ids i64[n_docs] | has_id u8[n_docs] | lengths u64[n_docs]
               | block offsets u64[n_blocks + 1] | blocks
    block   := n_ids u64 | n_checkpoints u32 | n_words u32 | crc32 u32 | pad u32
               | (states u64[LANES], word u64) per checkpoint | words u32[n_words]

All integers are little-endian.  Segments are the rows of a Parquet table in the shared folder (partition, segment, counts,
bytes), so any store that Spark reads will do, and a lost task is written anew by the commit protocol.

Defined cases: a null or empty text is one end id; null doc_ids come first; repeated rows stay, in the order of reading; an empty table gives no segments; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orogen.llm.tokenise import IdTable
from orogen.shared import materialise

LANES = 4096
CHECKPOINT = 128
BLOCK_TOKENS = 1 << 20
SEGMENT_TOKENS = 1 << 22
PART_BYTES = 32 << 20  # of the stored table
MOST_PARTS = 1 << 20
BROADCAST_SEGMENTS = 1_000_000
LOW = np.uint64(1 << 31)
SCHEMA = "part int, segment int, n_docs long, n_tokens long, bytes binary"
DECODED = "part int, segment int, doc_id long, local_start long, ids binary"


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbols, their frequencies (each at least 1, together a power of two) and that power."""
    symbols, counts = np.unique(ids, return_counts=True)
    scale = min(20, max(12, int(np.ceil(np.log2(len(symbols) + 1))) + 3))
    total = 1 << scale
    f = np.maximum(1, counts * (total - len(symbols)) // counts.sum()).astype(np.int64)
    over = int(f.sum()) - total
    if over > 0:  # take from the largest, which feel it least
        for k in np.argsort(-f):
            cut = min(over, int(f[k]) - 1)
            f[k] -= cut
            over -= cut
            if not over:
                break
    else:
        f[np.argmax(f)] -= over
    return symbols, f, scale


def encode_block(symbol: np.ndarray, f: np.ndarray, start: np.ndarray, scale: int, crc: int) -> bytes:
    """symbol: indices into the frequency table."""
    n = len(symbol)
    steps = -(-n // LANES) if n else 0
    freq, base = f.astype(np.uint64), start.astype(np.uint64)
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    sh, limit = np.uint64(scale), np.uint64((1 << 31 >> scale) << 32)
    for k in range(steps - 1, -1, -1):
        s = symbol[k * LANES : (k + 1) * LANES]
        x, fs = state[: len(s)], freq[s]
        big = x >= limit * fs
        words.append((x[big] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        x = np.where(big, x >> np.uint64(32), x)
        q, r = np.divmod(x, fs)
        state[: len(s)] = (q << sh) + r + base[s]
        if k % CHECKPOINT == 0:
            marks.append((k, state.copy()))
    words.reverse()
    before = np.concatenate(([0], np.cumsum([len(w) for w in words]))) if words else np.zeros(1, np.int64)
    stream = np.concatenate(words) if words else np.zeros(0, "<u4")
    head = struct.pack("<QIIII", n, len(marks), len(stream), crc, 0)
    return head + b"".join(st.astype("<u8").tobytes() + struct.pack("<Q", int(before[k])) for k, st in reversed(marks)) + stream.tobytes()


def decode_block(raw: bytes, symbols: np.ndarray, f: np.ndarray, scale: int, checkpoint: int = 0, only: bool = False) -> np.ndarray:
    """The ids of a block from a checkpoint on, or only up to the next one."""
    n, n_marks, n_words, crc, _ = struct.unpack_from("<QIIII", raw)
    at, size = 24, 8 * LANES + 8
    stream = np.frombuffer(raw, "<u4", n_words, at + n_marks * size).astype(np.uint64)
    if not n:
        return np.zeros(0, "<u4")
    state = np.frombuffer(raw, "<u8", LANES, at + checkpoint * size).copy()
    (word,) = struct.unpack_from("<Q", raw, at + checkpoint * size + 8 * LANES)
    freq = f.astype(np.uint64)
    base = np.concatenate(([0], np.cumsum(f)[:-1])).astype(np.uint64)
    slot = np.repeat(np.arange(len(f)), f)
    mask, sh = np.uint64((1 << scale) - 1), np.uint64(scale)
    first, steps = checkpoint * CHECKPOINT, -(-n // LANES)
    out = []
    for k in range(first, min(steps, first + CHECKPOINT) if only else steps):
        m = min(LANES, n - k * LANES)
        x = state[:m]
        low = x & mask
        s = slot[low.astype(np.int64)]
        out.append(s)
        x = freq[s] * (x >> sh) + low - base[s]
        small = np.flatnonzero(x < LOW)
        x[small] = (x[small] << np.uint64(32)) | stream[word : word + len(small)]
        word += len(small)
        state[:m] = x
    ids = symbols[np.concatenate(out)].astype("<u4")
    if checkpoint == 0 and not only and zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return ids


def encode_segment(keys: list[int | None], docs: list[bytes]) -> bytes:
    lengths = np.fromiter((len(d) // 4 for d in docs), np.int64, len(docs))
    ids = np.frombuffer(b"".join(docs), "<u4")
    symbols, f, scale = frequencies(ids)
    start = np.concatenate(([0], np.cumsum(f)[:-1]))
    index = np.zeros(int(symbols.max()) + 1, np.int64)
    index[symbols] = np.arange(len(symbols))
    cuts = range(0, len(ids), BLOCK_TOKENS)
    blocks = [encode_block(index[p], f, start, scale, zlib.crc32(p.tobytes())) for p in (ids[c : c + BLOCK_TOKENS] for c in cuts)]
    offsets = np.concatenate(([0], np.cumsum([len(b) for b in blocks]))).astype("<u8")
    parts = [
        b"RNS1", struct.pack("<IIII", len(blocks), len(docs), len(symbols), scale), symbols.astype("<u4").tobytes(), f.astype("<u4").tobytes(),
        np.array([k or 0 for k in keys], "<i8").tobytes(), np.array([k is not None for k in keys], np.uint8).tobytes(), lengths.astype("<u8").tobytes(), offsets.tobytes(), *blocks,
    ]
    return b"".join(parts)


def decode_segment(raw: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, where each document's ids end, and all ids."""
    if raw[:4] != b"RNS1":
        raise ValueError("not a token segment")
    n_blocks, n_docs, n_symbols, scale = struct.unpack_from("<IIII", raw, 4)
    at = 20

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    symbols, f = take("<u4", n_symbols), take("<u4", n_symbols).astype(np.int64)
    keys, has, lengths, offsets = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs), take("<u8", n_blocks + 1)
    ids = [decode_block(raw[at + int(a) : at + int(b)], symbols, f, scale) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return [k if h else None for k, h in zip(keys.tolist(), has.tolist(), strict=True)], np.cumsum(lengths.astype(np.int64)), np.concatenate(ids)


def write(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents' ids in ascending doc_id; the written table of segments."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, size // PART_BYTES) if size < 1 << 60 else 0)  # a size of 2**63 - 1 means unknown

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, segment = IdTable.of_worker(tokenizer), TaskContext.get().partitionId(), 0
        keys, held, tokens = [], [], 0

        def flush():
            cols = ([part], pa.int32()), ([segment], pa.int32()), ([len(keys)], pa.int64()), ([tokens], pa.int64()), ([encode_segment(keys, held)], pa.binary())
            return pa.record_batch([pa.array(v, t) for v, t in cols], names=["part", "segment", "n_docs", "n_tokens", "bytes"])

        for b in batches:
            own = iter(b.column(0).to_pylist())
            for ids, ends in table.many(b.column(1), end_id):
                raw, ends = ids.tobytes(), ends.tolist()
                for key, at, to in zip(islice(own, len(ends) - 1), ends, ends[1:]):
                    keys.append(key)
                    held.append(raw[4 * at : 4 * to])
                    tokens += to - at
                    if tokens >= SEGMENT_TOKENS:
                        yield flush()
                        keys, held, tokens, segment = [], [], 0, segment + 1
        if keys:
            yield flush()

    # The row number parts the rows of a hot or null doc_id; it is the same whenever a lost task reads its split again.
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    return materialise(rows.select("doc_id", "text").mapInArrow(run, SCHEMA), "token-segments", compression="none")


def _segment_parts(raw: bytes) -> tuple[np.ndarray, np.ndarray, int, list[tuple[int, int]]]:
    """Symbols, frequencies and scale of a segment, and where its blocks lie."""
    n_blocks, n_docs, n_symbols, scale = struct.unpack_from("<IIII", raw, 4)
    symbols = np.frombuffer(raw, "<u4", n_symbols, 20)
    f = np.frombuffer(raw, "<u4", n_symbols, 20 + 4 * n_symbols).astype(np.int64)
    at = 20 + 8 * n_symbols + 17 * n_docs
    ends = np.frombuffer(raw, "<u8", n_blocks + 1, at).tolist()
    at += 8 * (n_blocks + 1)
    return symbols, f, scale, [(at + a, at + b) for a, b in zip(ends, ends[1:])]


def _bases(segments: DataFrame) -> DataFrame:
    """(part, segment, base): the ids before each segment.

    A number per partition comes to the driver; segments within a partition are summed where they are.
    """
    sums = dict(sorted((r["part"], r["n"]) for r in segments.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()))
    before = dict(zip(sums, [0, *accumulate(sums.values())], strict=False))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    manifest = segments.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inside"))
    starts = segments.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    return manifest.join(F.broadcast(starts), "part").select("part", "segment", (F.col("before") + F.col("inside")).alias("base"))


def read_range(segments: DataFrame, start: int, n: int) -> DataFrame:
    """(at, ids): n ids of the whole file from place ``start`` on, in stretches of bounded size.

    Of the segments that the range meets each block is decoded from the last checkpoint before it, stretch by stretch, and
    not beyond it; nothing else is decoded.
    """
    stretch = LANES * CHECKPOINT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, total, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                symbols, f, scale, blocks = _segment_parts(raw)
                low, high = max(0, start - base), min(total, start + n - base)
                for k, (a, z) in enumerate(blocks):
                    first = k * BLOCK_TOKENS
                    for mark in range(-(-min(BLOCK_TOKENS, total - first) // stretch)):
                        at = first + mark * stretch
                        if at < high and at + stretch > low:
                            ids = decode_block(raw[a:z], symbols, f, scale, mark, only=True)
                            s, e = max(low - at, 0), min(high - at, len(ids))
                            if s < e:
                                yield pa.record_batch([pa.array([base + at + s]), pa.array([ids[s:e].tobytes()], pa.binary())], names=["at", "ids"])

    rows = segments.join(_bases(segments), ["part", "segment"]).filter((F.col("base") < start + n) & (F.col("base") + F.col("n_tokens") > start))
    return rows.select("base", "n_tokens", "bytes").mapInArrow(run, "at long, ids binary")


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, segment, raw in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                keys, ends, ids = decode_segment(raw)
                starts, data = np.concatenate(([0], ends[:-1])), ids.tobytes()
                for k in range(0, len(keys), 2048):
                    s, e = starts[k : k + 2048], ends[k : k + 2048]
                    cols = (
                        ([part] * len(s), pa.int32()), ([segment] * len(s), pa.int32()), (keys[k : k + 2048], pa.int64()), (s, pa.int64()),
                        ([data[4 * x : 4 * y] for x, y in zip(s.tolist(), e.tolist(), strict=True)], pa.binary()),
                    )
                    yield pa.record_batch([pa.array(v, t) for v, t in cols], names=["part", "segment", "doc_id", "local_start", "ids"])

    bases = _bases(segments)
    found = segments.select("part", "segment", "bytes").mapInArrow(run, DECODED)
    few = segments.count() <= BROADCAST_SEGMENTS
    return found.join(F.broadcast(bases) if few else bases, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "ids")
