"""From raw documents to packed token sequences, a stage at a time.

Each stage takes the whole table its predecessor kept and returns a DataFrame that is written and read again, so a lost
executor costs the stage at hand only.  All stages but the last return the columns of ``documents``; n_chars follows
the text.  What a stage drops follows from the text, so null and repeated doc_ids need no care.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm import decontaminate, linededup, nearcopies, packing, rules
from orogen.llm.queries import BYTE_BPE, vocabulary
from orogen.shared import materialise
from orogen.tables import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the default policy keeps."""
    return rules.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten documents or more are removed; documents stay."""
    index = linededup.LineIndex.build(docs, min_docs=10)
    return index.remove_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, and none that a kept one with a near fingerprint equals in 0.8 of its five-word shingles."""
    return nearcopies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no whole benchmark window of 13 words, however long they are, and no telling share of shorter items."""
    keyed = docs.withColumn("__key", nearcopies.text_key(F.col("text")))
    found = decontaminate.hits(keyed, table(spark, sf_dir, "benchmark"), keep=("__key",)).filter(decontaminate.telling(F.col("longest"), F.col("contaminated")))
    found = materialise(found.select("__key").distinct(), "dropped-texts")
    return keyed.join(nearcopies.few(found, found.count()), "__key", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence."""
    return packing.pack(docs, vocabulary(BYTE_BPE))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("best-fit packing", pack)]

# Fingerprints by XXH64 and token ids are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, "stage")
    return docs
