"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-token parts and their numbers of tokens, broadcast to every worker: at most
FREQUENT entries.  It comes from one pass over all texts in which each task counts its parts in a bounded table and
writes one row, a summary of its TASK_TOP heaviest; the summaries are merged by groups of GROUP tasks until one is left.
So no pre-token is shuffled: what moves is one row of bounded size per task.  Tier two is each worker's own bounded table
for the rest, filled by the tokenizers library.  The tables only save work: whatever they hold, each count is the library's.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows are counted each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orogen.llm.tokenise import LONG_PART, CountTable, cut, groups, texts_of
from orogen.shared import materialise

FREQUENT = 1 << 14
TASK_TOP = 1 << 12
TASK_HELD = 1 << 16
GROUP = 64
SUMMARY = "task long, parts array<binary>, counts array<long>"


def _summary(task: int, seen: Counter, top: int) -> pa.RecordBatch:
    best = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:top]
    return pa.record_batch([pa.array([task]), pa.array([[p for p, _ in best]], pa.list_(pa.binary())), pa.array([[n for _, n in best]], pa.list_(pa.int64()))], names=["task", "parts", "counts"])


def frequent(docs: DataFrame, text: str = "text", top: int = FREQUENT) -> list[bytes]:
    """The most frequent parts over all documents, at most ``top``: what is heavy in any task is a candidate."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for group in groups(texts_of(b.column(0))):
                coded = cut(group)[0].dictionary_encode()
                n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
                n[pc.binary_length(coded.dictionary).to_numpy() > LONG_PART] = 0
                at = np.sort(np.argsort(-n, kind="stable")[:TASK_HELD])
                for p, k in zip(coded.dictionary.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist(), n[at].tolist(), strict=True):
                    seen[p] += k
                if len(seen) > 2 * TASK_HELD:  # counts that are small so far start anew
                    seen = Counter(dict(seen.most_common(TASK_HELD)))
        yield _summary(TaskContext.get().partitionId(), seen, TASK_TOP)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}
        for b in batches:
            for task, parts, counts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                seen = held.setdefault(task // GROUP, Counter())
                for p, k in zip(parts, counts, strict=True):
                    seen[p] += k
        for task, seen in held.items():
            yield _summary(task, seen, top)

    rows = materialise(docs.select(text).mapInArrow(count, SUMMARY), "frequent-parts")
    while (n := rows.count()) > 1:
        dealt = rows.repartition(-(-n // GROUP), (F.col("task") / GROUP).cast("long"))
        rows = materialise(dealt.mapInArrow(merge, SUMMARY), "frequent-parts")
    return [bytes(p) for r in rows.select("parts").collect() for p in r["parts"]]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every document."""
    common = frequent(docs)
    known = [len(ids) for ids in CountTable(tokenizer).encoded([p.decode() for p in common])]
    sent = docs.sparkSession.sparkContext.broadcast((common, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = CountTable.of_worker(tokenizer)
        table.pin(*sent.value)
        for b in batches:
            yield pa.record_batch([b.column(0).cast(pa.int64()), pa.array(table.many(b.column(1))), b.column(2)], names=["doc_id", "n_tokens", "n_bytes"])

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")).mapInArrow(run, "doc_id long, n_tokens long, n_bytes long")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
