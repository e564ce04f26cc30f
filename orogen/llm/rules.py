"""Quality rules kept as a bitmask ledger.

Every rule is evaluated once per document.  The ledger row holds the measurements and one failure bit per rule;
a policy is a named, versioned mask over those bits, so a new policy or an ablation reads the ledger and never the
texts.  All of it is built-in expressions: a document is one row from scan to result and nothing is shuffled.

Defined cases: a null or empty text has no words and fails ``few_words``; repeated rows give repeated rows; an empty
table gives an empty ledger; columns beside the key and the text are carried only if asked for in ``keep``, and
the ledger's own names replace equal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

# Order gives the bit; append only, so that stored ledgers keep their meaning.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "5 * n_symbols > n_words"),
    ("duplicate_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

# Policies are versioned: a published mask never changes, a new version gets a new name.
POLICIES: dict[str, int] = {
    "base-1": BASE,
    "default-1": (1 << len(RULES)) - 1,
}


# A window's sort key: 39 bits of its hash above its position.
_POS_BITS = 24


def _window_keys(words: Column, n: Column) -> Column:
    """Sorted keys of all 3-word windows; null for fewer words and for texts whose positions the key can't hold."""
    key = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(words[i], words[i + 1], words[i + 2]), 64 - 39), _POS_BITS) + i
    return F.when((n >= 3) & (n < (1 << _POS_BITS)), F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), key)))


def _exact_pairs(words: Column, n: Column) -> Column:
    """Positions of windows found twice or more, by sorting the windows themselves."""
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("p"))))
    same = lambda x, j: F.coalesce(F.get(windows, j)["w"] == x["w"], F.lit(False))
    return F.when(n >= 3, F.transform(F.filter(windows, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["p"]))


def _twice(words: Column, n: Column, keys: Column) -> Column:
    """Positions of the windows found twice or more.

    Equal hashes only nominate: neighbours in hash order are compared word by word, and a text in which two
    different windows share a hash is done again by sorting its windows.
    """
    at = lambda k: F.get(keys, k).bitwiseAND(F.lit((1 << _POS_BITS) - 1)).cast("int")
    hashed = lambda k: F.shiftright(F.get(keys, k), _POS_BITS)
    equal = lambda p, q: (words[p] == words[q]) & (words[p + 1] == words[q + 1]) & (words[p + 2] == words[q + 2])
    near = lambda k, j: F.coalesce(hashed(k) == hashed(j), F.lit(False))
    order = F.sequence(F.lit(0), F.size(keys) - 1)
    nominated = F.filter(order, lambda k: near(k, k - 1) | near(k, k + 1))
    clash = F.exists(nominated, lambda k: near(k, k - 1) & ~equal(at(k), at(k - 1)))
    return F.when(keys.isNull() | clash, _exact_pairs(words, n)).otherwise(F.transform(nominated, at))


def _covered(at: Column) -> Column:
    """Number of words that lie in a window at one of these positions."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("end"))
    step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end"))
    return F.coalesce(F.aggregate(F.sort_array(at), zero, step)["n"], F.lit(0))


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, ``keep``, the measurements, and ``failed`` with a bit for each failed rule."""
    names = [F.col(c) for c in dict.fromkeys((key, *keep)) if c not in (*MEASURES, "failed")]
    rows = docs.select(*names, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    rows = rows.select(
        *names, F.array_remove(F.split("__t", SPACE), "").alias("__w"), F.regexp_count("__t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__l"),
    )
    words, n = F.col("__w"), F.col("n_words")
    rows = rows.withColumn("n_words", F.size("__w")).withColumn("__keys", _window_keys(words, n)).withColumn("__at", _twice(words, n, F.col("__keys")))
    rows = rows.select(
        *names, n.cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), "n_symbols", F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), _covered(F.col("__at")).cast("long").alias("n_repeat_words"),
    )
    failed = sum((F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, (_, rule) in enumerate(RULES)), F.lit(0))
    return rows.withColumn("failed", failed.cast("int"))


def kept(policy: str = "default-1", failed: str = "failed") -> Column:
    """Whether a ledger row passes the policy."""
    return F.col(failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def passing(docs: DataFrame, policy: str = "default-1", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that the policy keeps, with all their columns.

    The partition number in the condition keeps the optimiser from moving the filter below the measurements, where it would
    evaluate every rule again for each use of a measurement.
    """
    rows = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(key).alias("__key"), F.col(text).alias("__text"))
    rows = ledger(rows, "__key", "__text", keep=("__doc",)).withColumn("__at", F.spark_partition_id())
    return rows.filter((F.col("__at") >= 0) & kept(policy)).select("__doc.*")


def ablations(rows: DataFrame, policy: str = "default-1") -> DataFrame:
    """For each rule of the policy: documents it fails, documents that only it fails, documents kept without it.

    One pass: the ledger is first counted by failure mask (at most 2**rules rows), the rest works on those counts.
    """
    mask = POLICIES[policy]
    masks = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items() if bit & mask]))
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return (
        masks.select("m", "n", rules.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            hit(F.col("m").bitwiseAND(F.col("r.bit")) != 0)("n_failed"),
            hit(F.col("m") == F.col("r.bit"))("n_failed_alone"),
            hit(F.col("m").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0)("n_kept_without"),
        )
    )
