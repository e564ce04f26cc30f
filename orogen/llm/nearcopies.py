"""Near copies: texts that ball hashing links and whose shingles are the same to ``least``, verified exactly.

A text's shingles are its runs of ``width`` words as in ``simhash``, as a set of 64-bit hashes; the similarity of two texts
is the Jaccard similarity of their sets.  A text has two fingerprints: of its shingles and of its distinct words.  A
scattered edit changes five shingles but only one word, so that most similar texts lie within few bits of each other by
their words; long common runs are found by the shingles.  What is linked wrongly is told by the exact comparison.

Equal texts are taken together first.  Then, in rounds, over the texts still undecided:

1. Fingerprints of either kind that meet at a value of the ball are linked in stars about the value's smallest one, and
   texts of one fingerprint about its first text, so that a group of copies never gives all its pairs.
2. Every link is verified; those that aren't similar are dropped.
3. Each component of similar links is taken by doc_id: a text goes if one of its component that stays is similar to it,
   and stays otherwise.  Of a component with more than TASK_SHINGLES shingles, which no task should hold, only the first text
   is compared with the others.
4. Texts that stay for none to go, but for the first of its component, and those not yet compared are undecided and linked
   anew, without the others; a text without similar links stays.

So none goes but for a similar text that stays; most groups are decided in one round.  What ball hashing doesn't link is not found; the README gives the recall.

Defined cases: a null text is an empty one; texts without words are copies of each other; a text of fewer words is one
shingle; a null doc_id comes after all others; different texts under one doc_id are different documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.llm import simhash
from orogen.llm.worker import give_back, trimmed
from orogen.operators.graph import connected_components
from orogen.shared import materialise

RADIUS, WIDTH = 6, 5
LEAST = (4, 5)
BROADCAST_KEYS = 1_000_000
BUCKET_ROWS = 1 << 22
CHUNK_VALUES = 1 << 18  # a group of near copies has most values meet: arrays of 49 MB, 192 MB at four times as many
TASK_EDGES = 1 << 20
TASK_SHINGLES = 1 << 21
TRIM_SHINGLES = 1 << 16
STAYS, GOES, UNDECIDED = 0, 1, 2


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    h = xxhash.xxh64_intdigest
    return np.unique(np.array([h(b" ".join(words[k : k + width]), 42) for k in range(max(1, len(words) - width + 1))] if words else [], np.uint64)).view(np.int64)


def word_print(text: str | None) -> int:
    """The fingerprint of a text's distinct words, as a signed 64-bit integer; zero without words."""
    import xxhash

    words = set((text or "").encode().lower().split())
    return simhash.majority(np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))) if words else 0


def few(df: DataFrame, n: int) -> DataFrame:
    """df, sent to all workers if its n rows are few."""
    return F.broadcast(df) if n <= BROADCAST_KEYS else df


def _shingled(batches):
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array(map(shingles, b.column(1).to_pylist()), pa.list_(pa.int64()), size=b.num_rows)], names=["key", "shingles"])


def _links(rest: DataFrame, radius: int) -> DataFrame:
    """(a, b): keys of texts whose fingerprints of either kind are equal or meet, in stars; each pair once."""
    out = None
    for kind in ("fp", "words"):
        hubs = rest.groupBy(F.col(kind).alias("fp")).agg(F.min(F.struct("doc_id", "key"))["key"].alias("hub"))
        hubs = materialise(hubs, "near-hubs")
        meet = materialise(simhash.links(hubs.select("fp"), hubs.count(), radius, BUCKET_ROWS, stars=True, chunk=CHUNK_VALUES), "near-meet").distinct()
        far = meet.join(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("u")), "a").join(hubs.select(F.col("fp").alias("b"), F.col("hub").alias("v")), "b").select("u", "v")
        near = rest.select("key", F.col(kind).alias("fp")).join(hubs, "fp").filter("key <> hub").select(F.col("key").alias("u"), F.col("hub").alias("v"))
        both = far.unionByName(near)
        out = both if out is None else out.unionByName(both)
    return out.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).filter("a <> b").distinct()


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, and other columns) with ``similar``: whether the shingles are the same to LEAST.

    A text in very many pairs makes one side of a join large, which adaptive execution splits.
    """
    rows = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return rows.withColumn("similar", LEAST[1] * both >= LEAST[0] * (F.size("sa") + F.size("sb") - both)).drop("sa", "sb")


def _components(edges: DataFrame) -> DataFrame:
    """(node, component) of the edges (a, b): in one task if they are few, else in rounds."""
    if edges.count() > TASK_EDGES:
        return connected_components(edges)

    def run(batches):
        ends = [(b.column(0), b.column(1)) for b in batches]
        if ends:
            nodes = pa.concat_arrays([a for a, _ in ends] + [b for _, b in ends]).dictionary_encode()
            at, names = nodes.indices.to_numpy(), nodes.dictionary
            label = simhash._forest(len(names), at[: len(at) // 2], at[len(at) // 2 :])
            yield pa.record_batch([names, names.take(pa.array(label))], names=["node", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(trimmed(run), "node binary, component binary")


def _judge(group: pa.Table) -> pa.Table:
    """A component's texts with their state.

    Similar sets share one of their rarest members, so many that fewer than LEAST are left; only those of kept texts are looked up.
    """
    key, doc = group["key"].to_pylist(), group["doc_id"].to_pylist()
    order = sorted(range(len(key)), key=lambda k: (doc[k] is None, doc[k] or 0, key[k]))
    lists = pa.concat_arrays(group["shingles"].chunks)
    ends = lists.offsets.to_numpy()
    _, place, count = np.unique(lists.values.to_numpy()[ends[0] : ends[-1]], return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    members = rank[place]
    sets = [np.sort(members[s:e]) for s, e in zip(ends[:-1] - ends[0], ends[1:] - ends[0], strict=True)]
    state, holders = np.full(len(key), UNDECIDED, np.int32), {}
    state[order[0]] = STAYS
    for at, k in enumerate(order):
        own = sets[k]
        rarest = own[: len(own) + LEAST[0] * -len(own) // LEAST[1] + 1].tolist() or [-1]
        for c in sorted({c for m in rarest for c in holders.get(m, ())}):
            both, total = len(np.intersect1d(own, sets[order[c]], assume_unique=True)), len(own) + len(sets[order[c]])
            if LEAST[1] * both >= LEAST[0] * (total - both):
                state[k], state[order[c]] = GOES, STAYS
                break
        else:
            for m in rarest:
                holders.setdefault(m, []).append(at)
    if len(members) > TRIM_SHINGLES:
        give_back()
    return group.select(["key", "doc_id", "fp", "words"]).append_column("state", pa.array(state))


def _judge_first(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Texts of components of any size with their state; the first of each, which stays, isn't among them."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("b")
    leaders = members.groupBy("component").agg(first)
    others = members.join(leaders, "component").filter("key <> b").withColumnRenamed("key", "a")
    return _similar(others, sets).select(F.col("a").alias("key"), "doc_id", "fp", "words", F.when(F.col("similar"), GOES).otherwise(UNDECIDED).alias("state"))


def decide(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """The texts of docs (key, doc_id, n, fp, words; doc_id the smallest of the text's n rows), and the keys of those that go."""

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            prints = (pa.array(kind, pa.int64(), size=b.num_rows) for kind in ((simhash.fingerprint(t, WIDTH) for t in texts), map(word_print, texts)))
            yield pa.record_batch([b.column(0), b.column(1), *prints], names=["key", "doc_id", "fp", "words"])

    keyed = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = keyed.mapInArrow(trimmed(run), "key binary, doc_id long, fp long, words long")
    texts = materialise(prints.groupBy("key", "fp", "words").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "near-texts")
    gone, sets, rest = texts.select("key").limit(0), None, texts.select("key", "doc_id", "fp", "words")
    while True:
        pairs = materialise(_links(rest, radius), "near-pairs")
        if pairs.isEmpty():
            return texts, gone
        if sets is None:
            linked = materialise(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "near-linked")
            own = keyed.join(few(linked, linked.count()), "key", "left_semi").select("key", "text")
            # Equal texts are dealt to one row only: their sets are the same.
            sets = materialise(own.mapInArrow(trimmed(_shingled), "key binary, shingles array<long>").dropDuplicates(["key"]), "near-shingles")
        similar = materialise(_similar(pairs, sets).filter("similar").select("a", "b"), "near-similar")
        if similar.isEmpty():
            return texts, gone
        of = materialise(_components(similar), "near-components")
        members = rest.join(few(of, of.count()), rest["key"] == of["node"]).select("key", "doc_id", "fp", "words", "component")
        members = materialise(members.join(sets, "key"), "near-members")
        large = materialise(members.groupBy("component").agg(F.sum(F.size("shingles")).alias("n")).filter(F.col("n") > TASK_SHINGLES).select("component"), "near-large")
        n = large.count()
        whole = members.join(few(large, n), "component", "left_anti") if n else members
        judged = whole.groupBy("component").applyInArrow(_judge, "key binary, doc_id long, fp long, words long, state int")
        if n:
            judged = judged.unionByName(_judge_first(members.drop("shingles").join(few(large, n), "component", "left_semi"), sets))
        judged = materialise(judged, "near-judged")
        gone = gone.unionByName(judged.filter(F.col("state") == GOES).select("key"))
        rest = judged.filter(F.col("state") == UNDECIDED).drop("state")
        if rest.isEmpty():
            return texts, gone


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs without copies and near copies; of equal texts a row with the smallest doc_id stays."""
    texts, gone = decide(docs, radius)
    again = materialise(texts.filter("n > 1").join(gone, "key", "left_anti").select(F.col("key").alias("__key"), F.col("doc_id").alias("__first")), "near-repeated")
    away = materialise(gone.withColumnRenamed("key", "__key").unionByName(again.select("__key")), "near-gone")
    keyed = docs.withColumn("__key", text_key(F.col("text")))
    once = keyed.join(few(away, away.count()), "__key", "left_anti").select(docs.columns)
    kept = keyed.join(few(again, again.count()), "__key").filter(F.col("doc_id").eqNullSafe(F.col("__first")))
    return once.unionByName(kept.dropDuplicates(["__key"]).select(docs.columns))
