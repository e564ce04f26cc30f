"""Line deduplication that can be taken back: cuckoo filters over exact reference counts.

A line's key is the line stripped of white space at both ends, with A-Z lower-cased, held as a 128-bit hash.  The index
has two tables in the shared folder: ``refs`` (key, number of documents that hold it), exact, and ``filters``, one
cuckoo filter per shard over the keys with at least ``min_docs`` references.  Documents may be inserted and deleted:
their keys are added to or subtracted from refs, and the keys that cross the threshold are put into or taken out of
the filters of their shards only.  Deleting what was inserted gives the tables of before.

Removing lines: each key asks the filter of its own shard, which never misses a frequent key, and what passes is looked
up exactly.  The filters go to the workers as one block while they are at most FILTER_BYTES together, and so do the exact
keys while they are at most BROADCAST_KEYS, both counted beforehand.  Beyond that, keys meet their shard's filter in a
stream (sorted so that the filter comes first, and a shard with many keys is salted), and the passing ones are joined
with the exact keys.

Lines are counted per document, and hot keys are summed in the workers and again before the shuffle.

Defined cases: a null or empty text is one empty line, which has no key and stays; repeated rows are documents of
their own; an empty table gives an empty index; columns beside doc_id and text are passed through untouched, but that
n_lines and n_dropped replace columns of these names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.shared import materialise

SPACE = b" \t\n\x0b\x0c\r"
BROADCAST_KEYS = 1_000_000
SHARD_KEYS = 1 << 16
FILTER_BYTES = 128 << 20
HELD_KEYS = 100_000


def line_keys(raw: bytes, min_chars: int = 1) -> list[bytes | None]:
    """The key of each line of a text, None for a line of fewer characters."""
    import xxhash

    h = xxhash.xxh3_128_digest
    stripped = [line.strip(SPACE).lower() for line in raw.split(b"\n")]
    if min_chars <= 1:
        return [h(s) if s else None for s in stripped]
    return [h(s) if len(s.decode()) >= min_chars else None for s in stripped]


class Cuckoo:
    """A cuckoo filter of 16-bit marks, four to a bucket; keys are 16 bytes of hash."""

    def __init__(self, capacity: int = 0, table: np.ndarray | None = None):
        size = 1 << max(4, int(np.ceil(np.log2(max(1, capacity) / 3.2))))
        self.table = np.zeros((size, 4), np.uint16) if table is None else table
        self.mask = len(self.table) - 1

    @staticmethod
    def load(raw: bytes) -> Cuckoo:
        return Cuckoo(table=np.frombuffer(raw, np.uint16).reshape(-1, 4).copy())

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First bucket, second bucket and mark of keys given as (n, 2) 64-bit integers."""
        mark = (keys[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (keys[:, 0] & np.uint64(self.mask)).astype(np.int64)
        return first, first ^ self._hop(mark), mark

    def _hop(self, mark):
        return (np.asarray(mark).astype(np.int64) * 0x5BD1E995 >> 7) & self.mask

    def contains(self, keys: np.ndarray) -> np.ndarray:
        a, b, mark = self._places(keys)
        return (self.table[a] == mark[:, None]).any(1) | (self.table[b] == mark[:, None]).any(1)

    def add(self, key: np.ndarray) -> bool:
        """False if there is no room; the filter must then be built anew with twice the capacity."""
        a, b, mark = (x[0] for x in self._places(key[None, :]))
        for at in (a, b):
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        at = a
        for k in range(500):
            slot = k & 3
            self.table[at, slot], mark = mark, self.table[at, slot]
            at = at ^ int(self._hop(mark))
            free = np.flatnonzero(self.table[at] == 0)
            if len(free):
                self.table[at, free[0]] = mark
                return True
        return False

    def remove(self, key: np.ndarray) -> None:
        a, b, mark = (x[0] for x in self._places(key[None, :]))
        for at in (a, b):
            held = np.flatnonzero(self.table[at] == mark)
            if len(held):
                self.table[at, held[0]] = 0
                return

    @staticmethod
    def build(keys: np.ndarray) -> Cuckoo:
        capacity = max(16, len(keys))
        while True:
            f = Cuckoo(capacity)
            if all(f.add(k) for k in keys):
                return f
            capacity *= 2


def _words(keys) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)  # a view, so that shard_of can read the bytes


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of keys given as (n, 2) 64-bit integers."""
    return keys.view(">u4")[:, 3].astype(np.int64) % shards


def count_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(key, refs): in how many of the documents each line key occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush():
            out = pa.record_batch([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["key", "refs"])
            held.clear()
            return out

        for b in batches:
            for t in b.column(0).to_pylist():
                held.update({k for k in line_keys((t or "").encode(), min_chars) if k})
                if len(held) >= HELD_KEYS:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(run, "key binary, refs long").groupBy("key").agg(F.sum("refs").alias("refs"))


@dataclass(frozen=True)
class LineIndex:
    """refs (key, refs) and filters (shard, filter) as tables of the shared folder."""

    refs: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    @staticmethod
    def _shard(shards: int):
        """By the key's last four bytes, of which a filter makes no use."""
        return (F.conv(F.hex(F.substring("key", 13, 4)), 16, 10).cast("long") % shards).cast("int").alias("shard")

    @staticmethod
    def build(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
        refs = materialise(count_keys(docs, min_chars), "line-refs")
        frequent = refs.filter(F.col("refs") >= min_docs)
        shards = 1 + frequent.count() // SHARD_KEYS

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [Cuckoo.build(_words(pdf["key"])).table.tobytes()]})

        filters = frequent.select("key", LineIndex._shard(shards)).groupBy("shard").applyInPandas(run, "shard int, filter binary")
        return LineIndex(refs, materialise(filters, "line-filters"), shards, min_docs, min_chars)

    def _changed(self, docs: DataFrame, sign: int) -> LineIndex:
        delta = count_keys(docs, self.min_chars).withColumnRenamed("refs", "delta")
        both = materialise(
            self.refs.join(delta, "key", "full").select("key", F.coalesce("refs", F.lit(0)).alias("was"), (F.coalesce("refs", F.lit(0)) + sign * F.coalesce("delta", F.lit(0))).alias("refs")), "line-refs"
        )
        was, now = F.col("was") >= self.min_docs, F.col("refs") >= self.min_docs
        crossing = both.filter(was != now).select("key", self._shard(self.shards), now.alias("in"))
        frequent = both.filter(now).select("key", self._shard(self.shards))

        def run(filters: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            shard = int((filters if len(filters) else moved)["shard"].iloc[0])
            f = Cuckoo.load(filters["filter"].iloc[0]) if len(filters) else Cuckoo(16)
            full = False
            for key, enters in zip(_words(moved["key"]) if len(moved) else [], moved["in"], strict=True):
                if enters:
                    full |= not f.add(key)
                else:
                    f.remove(key)
            return pd.DataFrame({"shard": [shard], "filter": [b"" if full else f.table.tobytes()]})

        def rebuild(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "filter": [Cuckoo.build(_words(pdf["key"])).table.tobytes()]})

        changed = materialise(self.filters.groupBy("shard").cogroup(crossing.groupBy("shard")).applyInPandas(run, "shard int, filter binary"), "line-filters")
        full = changed.filter(F.length("filter") == 0).select("shard")  # these are built anew from the exact counts
        again = frequent.join(full, "shard", "left_semi").groupBy("shard").applyInPandas(rebuild, "shard int, filter binary")
        filters = materialise(changed.filter(F.length("filter") > 0).unionByName(again), "line-filters")
        return LineIndex(both.filter(F.col("refs") > 0).select("key", "refs"), filters, self.shards, self.min_docs, self.min_chars)

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._changed(docs, 1)

    def delete(self, docs: DataFrame) -> LineIndex:
        """docs: the documents as they were inserted."""
        return self._changed(docs, -1)

    def remove_lines(self, docs: DataFrame, broadcast_keys: int = BROADCAST_KEYS, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """The documents with ``text`` rid of frequent lines, and n_lines and n_dropped added."""
        frequent = self.refs.filter(F.col("refs") >= self.min_docs).select("key")
        spark, min_chars = docs.sparkSession, self.min_chars
        columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]  # the results replace equal names
        docs = docs.select(*columns)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", n_lines long, n_dropped long"
        n, at = frequent.count(), columns.index("text")

        def dropped(b: pa.RecordBatch, known) -> pa.RecordBatch:
            """known: of a batch's distinct keys, those to drop."""
            raw = [(t or "").encode() for t in b.column(at).to_pylist()]
            keys = [line_keys(r, min_chars) for r in raw]
            gone = known({k for ks in keys for k in ks if k}, b)
            texts, n_lines, n_dropped = [], [], []
            for k, (r, ks) in enumerate(zip(raw, keys, strict=True)):
                drop = gone if not isinstance(gone, list) else gone[k]
                kept = [line for line, key in zip(r.split(b"\n"), ks, strict=True) if key not in drop]
                texts.append(b"\n".join(kept).decode())
                n_lines.append(len(ks))
                n_dropped.append(len(ks) - len(kept))
            arrays = [pa.array(texts, pa.string()) if k == at else b.column(k) for k in range(len(columns))]
            return pa.record_batch([*arrays, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=[*columns, "n_lines", "n_dropped"])

        shards = self.shards
        size = self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0

        def passing(loaded: dict[int, Cuckoo], listed: list[bytes]) -> np.ndarray:
            """Which keys pass the filters of their shards."""
            words, out = _words(listed), np.zeros(len(listed), bool)
            of = shard_of(words, shards)
            order = np.argsort(of, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(order) else []:
                if (f := loaded.get(int(of[own[0]]))) is not None:
                    out[own] = f.contains(words[own])
            return out

        filters = spark.sparkContext.broadcast([(r["shard"], bytes(r["filter"])) for r in self.filters.collect()]) if size <= filter_bytes else None

        if n <= broadcast_keys and filters:
            sent = spark.sparkContext.broadcast(b"".join(bytes(r["key"]) for r in frequent.collect()))  # 16 bytes a key

            def small(batches):
                keys, loaded = sent.value, {k: Cuckoo.load(f) for k, f in filters.value}
                exact = {keys[k : k + 16] for k in range(0, len(keys), 16)}

                def known(found: set, _):
                    listed = list(found)
                    return {listed[k] for k in np.flatnonzero(passing(loaded, listed))} & exact

                for b in batches:
                    yield dropped(b, known)

            return docs.mapInArrow(small, schema)

        rows = materialise(docs.withColumn("__row", F.monotonically_increasing_id()), "line-docs")

        def keys_of(batches):
            """Distinct keys of each document; only those that pass, where the filters are at hand."""
            loaded = {k: Cuckoo.load(f) for k, f in filters.value} if filters else None
            for b in batches:
                ids, keys = [], []
                for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = list({k for k in line_keys((t or "").encode(), min_chars) if k})
                    if loaded is not None and own:
                        own = [own[k] for k in np.flatnonzero(passing(loaded, own))]
                    ids += [row] * len(own)
                    keys += own
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(keys, pa.binary())], names=["row", "key"])

        found = rows.select("__row", "text").mapInArrow(keys_of, "row long, key binary")
        if not filters:
            found = self._streamed(found)
        bad = found.join(frequent, "key", "left_semi").groupBy("row").agg(F.collect_set("key").alias("__drop"))
        joined = rows.join(bad, rows["__row"] == bad["row"], "left").select(*columns, "__drop")

        def large(batches):
            for b in batches:
                drops = [set(d or ()) for d in b.column(len(columns)).to_pylist()]
                yield dropped(b, lambda _, __, drops=drops: drops)

        return joined.mapInArrow(large, schema)

    def _streamed(self, found: DataFrame) -> DataFrame:
        """(row, key) of the keys that pass their shard's filter, each shard a stream that its filter leads."""
        parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        salts = -(-parts // self.shards) * 4
        keys = found.select(self._shard(self.shards), F.pmod("row", F.lit(salts)).cast("int").alias("salt"), "row", "key", F.lit(None).cast("binary").alias("filter"))
        leads = self.filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("key"), "filter")
        both = leads.unionByName(keys).repartition(parts, "shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, f = None, None
            for b in batches:
                shards, leads = b.column(0).to_numpy(), np.flatnonzero(b.column(4).is_valid().to_numpy(zero_copy_only=False))
                cuts = np.unique(np.concatenate(([0, b.num_rows], np.flatnonzero(np.diff(shards)) + 1, leads)))
                out = []
                for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if b.column(4)[s].is_valid:
                        shard, f = shards[s], Cuckoo.load(b.column(4)[s].as_py())
                        s += 1
                    if s < e and f is not None and shards[s] == shard:
                        out.append(np.flatnonzero(f.contains(_words(b.column(3).slice(s, e - s).to_pylist()))) + s)
                at = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
                yield pa.record_batch([b.column(2).take(at), b.column(3).take(at)], names=["row", "key"])

        return both.mapInArrow(run, "row long, key binary")
