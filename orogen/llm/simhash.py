"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``radius`` bits just when some value lies within half the radius of both.  So
every distinct fingerprint has all values of its ball of half the radius looked at, and two fingerprints that share one
are linked; the triangle inequality makes each such meeting a verified link, and linking neighbours in the sorted list
of a value's owners keeps every component without forming all pairs.

For 64 bits and half radius 2 a ball has 2081 values.  They are dealt out by their first ``prefix`` bits: a row per
fingerprint and per prefix that its ball reaches (79 for 12 bits) goes through the shuffle, and the task that owns
a prefix makes the values below it.  All values are made, but the shuffle carries a prefix and not every value.
``prefix`` follows the number of distinct fingerprints, so that a prefix stays small; a prefix that more than HOT rows
reach all the same, counted beforehand, is replaced by longer ones, which only the fingerprints near them reach.  A
task makes at most a few CHUNK_VALUES values at a time and hands on a spanning forest of its links: one row per fingerprint
at most.

Fingerprints: A-Z lower-cased, words are runs of anything but white space, shingles of ``width`` words joined by
a space, XXH64 with seed 42; a bit is set if it is set in over half the shingles, repeats included.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; a text of fewer words is
one shingle; repeated rows stay, each with its class; a null doc_id never names a class unless all of its class are
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.worker import trimmed
from orogen.operators.graph import connected_components
from orogen.shared import materialise

HOT = 1 << 17
BUCKET_ROWS = 1 << 13
CHUNK_VALUES = 1 << 22
LONGER = 12  # bits that a hot prefix grows by at most before the shuffle; tasks go on from there


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint as a signed 64-bit integer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter((h(joined[s:e], 42) for s, e in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit integer."""
    n, ones = len(hashes), np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) of every document."""

    def run(batches):
        for b in batches:
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array((fingerprint(t, width) for t in b.column(1).to_pylist()), pa.int64(), size=b.num_rows)], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=64)
def _masks(bits: int, radius: int) -> np.ndarray:
    """All values of ``bits`` bits with at most ``radius`` of them set."""
    return np.array([sum(1 << k for k in c) for r in range(radius + 1) for c in combinations(range(bits), r)], dtype=np.uint64)


def _mixed(values: np.ndarray) -> np.ndarray:
    """20 bits of hash."""
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable over the edges (a, b) from each of n nodes."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _meet(prefix: np.ndarray, fps: np.ndarray, bits: int, half: int, stars: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, root) from all values under these prefixes; stars: (owner, first owner) of every value instead."""
    low_bits = 64 - bits
    used = np.bitwise_count((fps >> np.uint64(low_bits)) ^ prefix)
    values, owners = [], []
    for r in range(half + 1):
        at = np.flatnonzero(used == half - r)
        if len(at):
            low = fps[at] & np.uint64((1 << low_bits) - 1)
            v = ((prefix[at] << np.uint64(low_bits)) | low)[:, None] ^ _masks(low_bits, r)[None, :]
            values.append(v.ravel())
            owners.append((at, v.shape[1]))
    # Values are sorted alone, which is fast; owners are looked up only for the few values that occur twice.
    v = np.sort(np.concatenate(values))
    met = np.unique(v[1:][v[1:] == v[:-1]])
    if not len(met):
        return fps[:0], fps[:0]
    maybe = np.zeros(1 << 20, bool)
    maybe[_mixed(met)] = True
    keys, own = [], []
    for v, (at, columns) in zip(values, owners, strict=True):
        near = np.flatnonzero(maybe[_mixed(v)])
        place = np.minimum(np.searchsorted(met, v[near]), len(met) - 1)
        hit = met[place] == v[near]
        keys.append(place[hit])
        own.append(at[near[hit] // columns])
    v, o = np.concatenate(keys), np.concatenate(own)
    names, node = np.unique(fps, return_inverse=True)
    order = np.lexsort((node[o], v))
    v, o = v[order], node[o[order]]
    same = np.flatnonzero(v[1:] == v[:-1])
    if stars:
        begins = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
        first = np.repeat(o[begins], np.diff(np.append(begins, len(v))))
        pairs = np.unique(o[same + 1].astype(np.int64) * len(names) + first[same + 1])
        pairs = pairs[pairs // len(names) != pairs % len(names)]
        return names[pairs // len(names)], names[pairs % len(names)]
    pairs = np.unique(o[same].astype(np.int64) * len(names) + o[same + 1])
    label = _forest(len(names), pairs // len(names), pairs % len(names))
    moved = np.flatnonzero(label != np.arange(len(names)))
    return names[moved], names[label[moved]]


def _divide(prefix: np.ndarray, fps: np.ndarray, bits: int, half: int, stars: bool = False, chunk: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of _meet, from longer prefixes where these hold more than ``chunk`` (CHUNK_VALUES) values."""
    if int(_work(prefix, fps, bits, half).sum()) <= 2 * (chunk or CHUNK_VALUES) or bits > 56:
        yield _meet(prefix, fps, bits, half, stars)
        return
    more = 3
    for k in range(1 << more):
        longer = (prefix << np.uint64(more)) | np.uint64(k)
        near = np.bitwise_count((fps >> np.uint64(64 - bits - more)) ^ longer) <= half
        if near.any():
            yield from _divide(longer[near], fps[near], bits + more, half, stars, chunk)


def _once(parts: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of all parts; a repeated one once, as far as ``most`` pairs held at a time tell."""
    held, n = [], 0

    def distinct():
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        return a[new], b[new]

    for pair in parts:
        held.append(pair)
        n += len(pair[0])
        if n > most:
            held = [distinct()]
            n = len(held[0][0])
            if 2 * n > most:
                yield held.pop()
                n = 0
    if n:
        yield distinct()


def _work(prefix: np.ndarray, fps: np.ndarray, bits: int, half: int) -> np.ndarray:
    """How many values each row has under its prefix."""
    each = np.array([len(_masks(64 - bits, half - u)) for u in range(half + 1)], dtype=np.int64)
    return each[np.bitwise_count((fps >> np.uint64(64 - bits)) ^ prefix)]


def links(distinct: DataFrame, n: int, radius: int = 4, bucket_rows: int = BUCKET_ROWS, stars: bool = False, chunk: int | None = None) -> DataFrame:
    """(a, b): a spanning set of the links between the n distinct fingerprints ``fp``; more bucket_rows: fewer rows through the shuffle.

    stars: each fingerprint with the smallest one at any of its values, for callers that judge links one by one.
    chunk: how many values a task makes at a time, CHUNK_VALUES if None; it needs some 100 bytes a value where most meet.
    """
    half, bits = radius // 2, 8
    if radius % 2:
        raise ValueError("an even radius has a middle")
    while bits < 30 and n * len(_masks(bits, half)) > bucket_rows << bits:
        bits += 1
    masks = F.array(*[F.lit(int(m)) for m in _masks(bits, half)]).cast("array<bigint>")
    reach = F.explode(F.transform(masks, lambda m: F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(m))).alias("prefix")
    rows = distinct.select("fp", reach)
    # Rows per prefix follow from the fingerprints per prefix of their own, of which there are at most 2**bits.
    own = distinct.groupBy(F.shiftrightunsigned("fp", 64 - bits).alias("own")).agg(F.count("*").alias("n"))
    near = own.select("n", F.explode(F.transform(masks, lambda m: F.col("own").bitwiseXOR(m))).alias("prefix")).groupBy("prefix").agg(F.sum("n").alias("n"))
    hot = near.filter(F.col("n") > HOT).select("prefix", F.least(F.lit(LONGER), F.ceil(F.log2(F.col("n") / (HOT // 4))).cast("int")).alias("more"))
    hot = materialise(hot, "hot-prefixes")
    rows = rows.join(_small(hot), "prefix", "left").withColumn("more", F.coalesce("more", F.lit(0)))
    rows = rows.withColumn("longer", F.explode(F.expr("transform(sequence(0L, shiftleft(1L, more) - 1), k -> shiftleft(prefix, more) + k)")))
    rows = rows.withColumn("bits", F.lit(bits) + F.col("more")).filter(F.expr(f"bit_count(shiftrightunsigned(fp, 64 - bits) ^ longer) <= {half}"))
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select(F.col("longer").alias("prefix"), "bits", "fp").repartition(parts, "prefix", "bits").sortWithinPartitions("bits", "prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        limit = 1 << 17

        def flush(prefix, fps, width):
            if len(prefix):
                found = _divide(prefix, fps, int(width[0]), half, stars, chunk)
                for a, b in _once(found) if stars else found:
                    yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        def cuts(cols, final):
            """Slices of one width at prefix borders, of about CHUNK_VALUES values; the rest stays."""
            prefix, fps, width = cols
            border = np.flatnonzero((np.diff(prefix.view(np.int64)) != 0) | (np.diff(width) != 0)) + 1
            work = np.zeros(len(prefix), np.int64)
            for w in np.unique(width).tolist():
                own = width == w
                work[own] = _work(prefix[own], fps[own], w, half)
            work, at = np.cumsum(work), 0
            for k in border.tolist():
                if work[k - 1] - (work[at - 1] if at else 0) >= (chunk or CHUNK_VALUES) or width[k] != width[k - 1]:
                    yield at, k
                    at = k
            if final:
                yield at, len(prefix)

        for b in batches:
            held.append((b.column("prefix").to_numpy().view(np.uint64), b.column("fp").to_numpy().view(np.uint64), b.column("bits").to_numpy()))
            if sum(len(h[0]) for h in held) >= limit:
                cols, at = tuple(map(np.concatenate, zip(*held, strict=True))), 0
                for s, at in cuts(cols, False):
                    yield from flush(*(c[s:at] for c in cols))
                held = [tuple(c[at:] for c in cols)]
                limit = max(1 << 17, 2 * len(held[0][0]))
        if held and len((cols := tuple(map(np.concatenate, zip(*held, strict=True))))[0]):
            for s, e in cuts(cols, True):
                yield from flush(*(c[s:e] for c in cols))

    return rows.select("prefix", "fp", "bits").mapInArrow(trimmed(run), "a long, b long")


def _small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df, broadcast if its counted rows are few."""
    return F.broadcast(df) if df.count() <= rows else df


def classes(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its class)."""
    fps = materialise(fingerprints(docs, width), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-classes")
    n = distinct.count()
    found = connected_components(links(distinct.select("fp"), n, radius))
    of = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    low = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    of = of.join(low, "component").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
