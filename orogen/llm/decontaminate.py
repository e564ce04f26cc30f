"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of digits, letters a-z after lower-casing A-Z, and all characters beyond ASCII.  The n-grams of a
benchmark item are its windows of ``n`` words; an item of fewer words is one n-gram.

The plan is built-in expressions only:

1. The distinct n-grams of the benchmark become a set (n-gram -> items), and a fixed-size bitmap of their hashes
   is folded from them on the executors.  The bitmap has 64 * SLOTS bits whatever the benchmark holds.
2. Every window of every document is hashed inside its row and looked up in the bitmap.  A clean document ends here.
3. The few windows that pass leave the row as text and are joined with the n-gram set, which verifies them exactly.
   The set is broadcast if its counted size is below BROADCAST_GRAMS, else the join shuffles the passing windows.

Only passing windows and one small row per document are shuffled, never texts.

Defined cases: a null text has no words and is never contaminated; an empty benchmark leaves all documents clean;
repeated documents are judged each (an internal row number keeps them apart); repeated items or n-grams count once;
a text of any length is one row throughout; only the named columns are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLOTS = 1 << 17  # longs of the bitmap; the top 17 bits of a hash name one, the low 6 bits a bit in it
BROADCAST_GRAMS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def benchmark_grams(benchmark: DataFrame, n: int = 13) -> DataFrame:
    """(gram, size, item_id): the distinct n-grams of each item."""
    w = F.col("w")
    rows = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).filter(F.size(w) > 0)
    size = F.least(F.size(w), F.lit(n))
    return (
        rows.select("item_id", w, size.alias("size"))
        .select("item_id", "size", F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - F.col("size") + 1), lambda i: F.array_join(F.slice(w, i, F.col("size")), " "))).alias("gram"))
        .distinct()
    )


def _slot(hash_: Column) -> Column:
    return F.shiftrightunsigned(hash_, 47).cast("int")


def _bit(hash_: Column) -> Column:
    return hash_.bitwiseAND(F.lit(63)).cast("int")


def _bitmap(grams: DataFrame) -> tuple[Column, list[int], int]:
    """The hash bitmap as a constant array of longs, the n-gram sizes that occur, the number of distinct n-grams."""
    h = F.xxhash64(F.split("gram", " "))
    bits = grams.select("gram", "size").distinct().select("size", _slot(h).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), _bit(h)).alias("bit"))
    rows = bits.groupBy("at").agg(F.bit_or("bit").alias("bits"), F.collect_set("size").alias("sizes"), F.count("*").alias("n")).collect()  # SLOTS rows at most
    held = ["0"] * SLOTS
    for r in rows:
        held[r["at"]] = str(r["bits"])
    # One constant that the optimiser folds; a literal per long would be SLOTS expressions.
    return F.split(F.lit(",".join(held)), ",").cast("array<bigint>"), sorted({s for r in rows for s in r["sizes"]}), sum(r["n"] for r in rows)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: ``keep``, n_words, n_hit, item_ids (array), spans (array of first word and word after), longest
    (words of the longest window found, 0 if none), contaminated.

    contaminated: some word is hit, and ``share`` times the hit words are at least all words.
    """
    grams = benchmark_grams(benchmark, n)
    bitmap, sizes, n_grams = _bitmap(grams)
    w = F.col("__w")
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*keep).alias("__keep"), words(F.col("text")).alias("__w"))

    def hashed(size: int) -> Column:
        return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(size))))).alias(f"__h{size}")

    rows = rows.select("*", *map(hashed, sizes))

    def passing(size: int) -> Column:
        h = F.col(f"__h{size}")
        known = lambda k: F.getbit(F.get(bitmap, _slot(F.get(h, k))), _bit(F.get(h, k))) == 1
        at = F.filter(F.sequence(F.lit(0), F.size(h) - 1), known)
        return F.when(F.size(w) >= size, F.transform(at, lambda i: F.struct(i.alias("p"), (i + size).alias("q"), F.array_join(F.slice(w, i + 1, F.lit(size)), " ").alias("g")))).otherwise(F.array())

    found = F.concat(*[passing(s) for s in sizes]) if sizes else F.expr("cast(array() as array<struct<p:int,q:int,g:string>>)")
    rows = rows.select("__row", "__keep", F.size(w).cast("long").alias("n_words"), found.alias("__found"))
    rows = rows.select("__row", "__keep", "n_words", F.explode_outer("__found").alias("f")).select("__row", "__keep", "n_words", "f.p", "f.q", F.coalesce("f.g", F.concat(F.lit(" "), F.col("__row"))).alias("gram"))  # no n-gram begins with a space
    known = grams.groupBy("gram").agg(F.collect_set("item_id").alias("items"))
    rows = rows.join(F.broadcast(known) if n_grams <= BROADCAST_GRAMS else known, "gram", "left")
    hit = F.col("items").isNotNull()
    rows = rows.groupBy("__row").agg(
        F.first("__keep").alias("__keep"), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(hit, F.struct(F.col("p"), F.col("q"))))).alias("__at"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("item_ids"), F.coalesce(F.max(F.when(hit, F.col("q") - F.col("p"))), F.lit(0)).alias("longest"),
    )
    # Windows in order of their first word: one that begins within or right behind the last span makes it longer.
    none = F.expr("named_struct('done', cast(array() as array<struct<start:int,end:int>>), 'start', -1, 'end', -1)")
    span = lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"))
    closed = lambda a: F.when(a["end"] >= 0, F.concat(a["done"], F.array(span(a)))).otherwise(a["done"])
    longer = lambda a, x: F.struct(a["done"].alias("done"), a["start"].alias("start"), F.greatest(a["end"], x["q"]).alias("end"))
    fresh = lambda a, x: F.struct(closed(a).alias("done"), x["p"].alias("start"), x["q"].alias("end"))
    rows = rows.withColumn("spans", F.aggregate("__at", none, lambda a, x: F.when(x["p"] <= a["end"], longer(a, x)).otherwise(fresh(a, x)), closed))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"]).cast("long")
    rows = rows.select("__keep", "n_words", n_hit.alias("n_hit"), "item_ids", "spans", "longest")
    return rows.select("__keep.*", "n_words", "n_hit", "item_ids", "spans", "longest", ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))


def remove_spans(text: Column, spans: Column) -> Column:
    """The text without the words in ``spans`` and what stands between them; spans as ``hits`` gives them for this text."""
    own = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # words before A-Z are lower-cased
    text = F.coalesce(text, F.lit(""))
    found, between = F.regexp_extract_all(text, F.lit(f"({own})"), 1), F.split(text, own)
    gone = lambda k: F.exists(spans, lambda s: (s["start"] <= k) & (k < s["end"]))
    kept = F.transform(F.sequence(F.lit(0), F.size(found) - 1), lambda k: F.concat(F.when(gone(k), "").otherwise(F.get(found, k)), F.when(gone(k) & gone(k + 1), "").otherwise(F.get(between, k + 1))))
    return F.when(F.size(found) > 0, F.concat(F.get(between, F.lit(0)), F.array_join(kept, ""))).otherwise(text)


def telling(longest: Column, contaminated: Column, n: int = 13) -> Column:
    """Whether a document holds a whole window of ``n`` words, or is contaminated by its share of hit words.

    Hits of items below ``n`` words may be chance; alone they tell only by their share.
    """
    return contaminated | (longest >= n)
