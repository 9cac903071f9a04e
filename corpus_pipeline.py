"""The corpus pipeline: each stage works on all that its predecessor kept.

The stages' edge cases are those of the operators that they call; a stage only takes its decision:
texts without a known language go, one text of each group of near copies stays, contaminated texts go,
secrets are masked, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townhall.llm.common import if_small, materialize
from townhall.llm.decontamination import contaminated, contamination
from townhall.llm.language_id import CONFIDENT, UNDETERMINED, predict_language, train_language_model
from townhall.llm.near_dup import near_duplicates
from townhall.llm.secrets import redacted, secrets
from townhall.llm.transducer import checked_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NEAR = 80


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents that aren't among gone (doc_id, text_hash)."""
    keys = gone.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct()
    on = F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.xxhash64("text") == F.col("g_hash"))
    return docs.select(*COLUMNS).join(if_small(keys, "gone"), on, "left_anti")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts whose language isn't known (no letters, or no confident label)."""
    found = predict_language(docs.select(*COLUMNS), train_language_model(docs))
    return found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= CONFIDENT)).select(*COLUMNS)


def one_of_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each near-duplicate group; of its repeated rows (one id, one text) one stays."""
    near = near_duplicates(docs, percent=NEAR)
    left = without(docs, near.filter(~F.col("kept")))
    again = near.filter("kept").groupBy("doc_id", "text_hash").count().filter("count > 1")
    again = if_small(again.select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash")), "repeated")
    on = F.col("doc_id").eqNullSafe(F.col("r_id")) & F.xxhash64("text").eqNullSafe(F.col("r_hash"))
    once = left.join(again, on, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.join(again, on, "left_anti").unionByName(once)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops contaminated documents."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.filter(contaminated()))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret; documents stay."""
    found = secrets(docs).select(F.col("doc_id").alias("s_id"), "text_hash", F.array_sort(F.concat("base", "added")).alias("spans"))
    found = if_small(found.filter(F.size("spans") > 0).dropDuplicates(["s_id", "text_hash"]), "spans", size=F.size("spans"))
    on = F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("text_hash"))
    masked = docs.select(*COLUMNS).join(found, on, "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("spans")))
    n = F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("masked").cast("long"))
    return masked.withColumn("masked", text).withColumn("n_chars", n).select("doc_id", F.col("masked").alias("text"), "lang", "source", "n_chars")


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, piece_ids, n_pieces, same: the encoded corpus; same: decoding gives the text again."""
    checked = checked_pieces(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return checked.select("doc_id", "lang", "source", "piece_ids", "n_pieces", "same")


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_copies),
    ("decontamination", no_benchmark),
    ("secret_scan", no_secrets),
    ("sentencepiece", pieces),
]
#: No SQL can express the network, the groups and the encoder; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
