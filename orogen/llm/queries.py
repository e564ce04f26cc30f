"""The registered queries of the subpackage: one per operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import chat, decontaminate, langid, linededup, packing, rules, simhash, sql, tokencount, tokenfile, warc
from orogen.shared import materialise
from orogen.tables import table


BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """A vocabulary file's place on this machine; the workers have it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def rows_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table, dealt out anew if its scan gives fewer tasks than there are cores, as a small file of one row group does.

    Dealing is by rows alone and goes by their sorted order, so that a task that runs again gets the same ones.
    """
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(rows_of(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    out = chat.format_conversations(rows.unionByName(own)).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under_mask = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    out = out.filter(F.assert_true(F.col("round_trip") & (F.col("loss") == under_mask), "a conversation doesn't come back from its formatted text").isNull())
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokenfile.read(tokenfile.write(rows_of(spark, sf_dir, "documents"), vocabulary(BYTE_BPE), end_id=2))
    return rows.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op4_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(rows_of(spark, sf_dir, "documents"), vocabulary(WORD_BPE), limit=2048)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.hits(rows_of(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.sort_array(F.col("item_ids").cast("array<string>")), ",")
    return rows.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), "contaminated")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    rows = langid.predict(docs, *langid.learn(docs.filter(~out), vocabulary(PIECES)))
    return rows.select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rows_of(spark, sf_dir, "documents").select("doc_id", "text")
    rows = linededup.LineIndex.build(docs, min_docs=10).remove_lines(docs)
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = materialise(warc.read(spark, warc.write(rows_of(spark, sf_dir, "pages")), payload=False).drop("payload"), "warc-heads")
    captures = warc.resolve(warc.transactions(heads)).withColumn("complete", F.col("request").isNotNull() & F.col("metadata").isNotNull())
    captures = captures.filter(F.assert_true("complete", "a capture lacks its request or metadata record").isNull())
    return captures.select(
        "page_id", "response.payload_bytes", F.col("response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"), "refers_to", "complete",
    )


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(rows_of(spark, sf_dir, "documents"))
    base_failed = F.col("failed").bitwiseAND(F.lit(rules.BASE)) != 0
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"),
        (~base_failed & rules.kept()).alias("kept"),
    )


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(rows_of(spark, sf_dir, "documents"), radius=4, width=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_chat": op2_chat,
    "op3_tokenfile": op3_tokenfile,
    "op4_tokencount": op4_tokencount,
    "op5_decontaminate": op5_decontaminate,
    "op6_langid": op6_langid,
    "op7_linededup": op7_linededup,
    "op8_warc": op8_warc,
    "op9_rules": op9_rules,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = sql.ORACLES
