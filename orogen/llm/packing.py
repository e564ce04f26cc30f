"""Best-fit packing of tokenised documents by the sum-of-squares rule.

A task tokenises its documents and packs them in windows of a bounded number of tokens, the longest pieces of a
window first.  Open sequences are counted per residual gap: a piece goes to the gap for which the sum of the squared
counts becomes smallest (the tightest of equal ones), and opens a sequence where no gap has room.  After each window the well-filled sequences leave
the task; the others wait for the next window.  What waits is bounded too: beyond HELD_TOKENS it leaves as loose.

First round: each partition alone, without a shuffle; its pieces are written once to the shared folder.
Second round: the pieces of loose sequences (those a task had left over) are packed again in far fewer partitions;
nothing else is shuffled.  Sequence numbers are unique over both rounds.

Defined cases: a null or empty text is one piece that holds the end id alone; repeated rows are packed each; an
empty table gives no pieces; other columns are ignored; a piece is never longer than ``size``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.tokenise import IdTable
from orogen.llm.worker import trimmed
from orogen.shared import materialise

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long, loose boolean"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
WINDOW_TOKENS = 4 << 20
HELD_TOKENS = 8 << 20
LOOSE_TOKENS = 4 << 20  # in a partition of the second round
PER_TASK = 1 << 36


class SumOfSquares:
    """Online packing: place(length) -> (sequence, offset)."""

    def __init__(self, size: int):
        self.size = size
        self.counts = np.zeros(size + 1, dtype=np.int64)  # open sequences by gap; a full one is not open
        self.open: list[list[int]] = [[] for _ in range(size + 1)]
        self.n = 0

    def place(self, length: int) -> tuple[int, int]:
        size, counts = self.size, self.counts
        # What a placement adds to the sum: a gap that shrinks loses a term and another gains one, a gap that closes
        # only loses one.  A sequence is opened where none has room, since each one costs the caller.
        change = 2 * (counts[: size + 1 - length] - counts[length:] + 1)
        change[0] -= 1
        change = np.where(counts[length:] > 0, change, np.iinfo(np.int64).max)
        at = int(change.argmin())
        if counts[at + length] > 0:
            gap = at + length
            sequence = self.open[gap].pop()
            counts[gap] -= 1
        else:
            gap, sequence, self.n = size, self.n, self.n + 1
        left = gap - length
        if left:
            self.open[left].append(sequence)
            counts[left] += 1
        return sequence, size - gap

    def close(self, gap: int) -> None:
        """No more pieces for sequences with at most this gap."""
        for g in range(1, gap + 1):
            self.open[g].clear()
        self.counts[: gap + 1] = 0


def _cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; all but the first are of full size."""
    first = n if n <= size else n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def _batches(sequences: dict[int, list[tuple]], base: int, loose: bool) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, piece, start, length, ids, offset) of these sequences, in batches of bounded size."""
    rows: list[tuple] = []
    for k, (sequence, own) in enumerate(sequences.items()):
        rows += [(*r[:5], base + sequence, r[5], loose) for r in own]
        if rows and (len(rows) >= 8192 or k + 1 == len(sequences)):
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)
            rows = []


def _packed(pieces: Iterable[tuple], size: int, base: int, reopen: float) -> Iterator[pa.RecordBatch]:
    """Batches of the pieces (doc_id, piece, start, length, ids) with their place."""
    packer, held, spare = SumOfSquares(size), {}, int(size * (1 - reopen))

    def settle(window: list[tuple]) -> Iterator[pa.RecordBatch]:
        for r in sorted(window, key=lambda r: -r[3]):
            sequence, offset = packer.place(r[3])
            held.setdefault(sequence, []).append((*r, offset))
        packer.close(spare)
        done = {k: v for k, v in held.items() if v[-1][5] + v[-1][3] >= size - spare}
        for k in done:
            del held[k]
        yield from _batches(done, base, False)
        if sum(v[-1][5] + v[-1][3] for v in held.values()) > HELD_TOKENS:
            packer.close(size)
            yield from _batches(held, base, True)
            held.clear()

    window, tokens = [], 0
    for r in pieces:
        window.append(r)
        tokens += r[3]
        if tokens >= WINDOW_TOKENS:
            yield from settle(window)
            window, tokens = [], 0
    yield from settle(window)
    yield from _batches(held, base, True)


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, reopen: float = 0.97) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id, offset.

    reopen: sequences that a task leaves filled less than this share are packed again across partitions.
    """

    def first(batches):
        table, base = IdTable.of_worker(tokenizer), TaskContext.get().partitionId() * PER_TASK

        def pieces():
            for b in batches:
                keys = iter(b.column(0).to_pylist())
                for ids, ends in table.many(b.column(1), end_id):
                    raw, ends = ids.tobytes(), ends.tolist()
                    for key, at, to in zip(islice(keys, len(ends) - 1), ends, ends[1:]):
                        for k, (s, n) in enumerate(_cut(to - at, size)):
                            yield key, k, s, n, raw[4 * (at + s) : 4 * (at + s + n)]

        yield from _packed(pieces(), size, base, reopen)

    def second(batches):
        def pieces():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("doc_id", "piece", "start", "length", "ids")), strict=True)

        yield from _packed(pieces(), size, -(TaskContext.get().partitionId() + 1) * PER_TASK, reopen)

    written = materialise(docs.select("doc_id", "text").mapInArrow(trimmed(first), SCHEMA), "packed")
    loose = written.filter("loose").select("doc_id", "piece", "start", "length", "ids")
    tokens = written.filter("loose").agg(F.sum("length")).first()[0] or 0
    again = loose.repartition(-(-tokens // LOOSE_TOKENS) or 1).mapInArrow(trimmed(second), SCHEMA)
    return written.filter("not loose").unionByName(again).drop("loose")
