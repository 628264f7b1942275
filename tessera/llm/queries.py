"""The queries of the corpus operators, with production parameters, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, langid, lm, mixing, quality, rlz, simhash, toxicity, weak_rules
from .common import settle

#: The rank file of the byte-level vocabulary.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Weights of the mix: by domain, and by language under any of them; sources weigh alike.
MIX_WEIGHTS = {("web",): 0.5, ("books",): 0.3, ("code",): 0.2, ("*", "en"): 0.5, ("*", "de"): 0.2, ("*", "fr"): 0.2, ("*", "es"): 0.1}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def remainder(n: int):
    """crc32 of doc_id as text, modulo n (a null id: 0)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % n


def domain():
    """The tree's first level, from the source's number: documents has no such column of its own."""
    number = F.try_to_number(F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d{1,9})$", 1), F.lit("999999999"))
    k = F.coalesce(number.cast("long"), F.lit(0)) % 3
    return F.when(k == 0, "web").when(k == 1, "books").otherwise("code")


def mix_levels():
    return [domain(), F.col("lang"), F.col("source")]


def n_words(text):
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), weak_rules.SPACE, -1), ""))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir), mix_levels(), n_words(F.col("text")), MIX_WEIGHTS, share=0.8, epochs=3, seed=42)
    return out.select("doc_id", F.col("path")[0].alias("domain"), F.col("path")[1].alias("lang"), F.col("path")[2].alias("source"), "tokens", "epoch")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(remainder(3) != 1))
    found = docs.select("doc_id", (remainder(3) == 1).alias("held_out"), langid.language_column(spark, model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), k=4, t=4, seed=42)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(RANKS)
    encoded = bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)
    both = encoded.select("doc_id", "ids", bpe.decode_column(spark, ranks, F.col("ids")).alias("decoded"))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz.dedupe(documents(spark, sf_dir), window=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = quality.train(docs, labels(spark, sf_dir).where(remainder(4) != 2))
    scored = docs.select("doc_id", (remainder(4) == 2).alias("held_out"), quality.quality_column(spark, machine, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = toxicity.train(docs, labels(spark, sf_dir).where(remainder(5) != 0))
    scored = docs.select("doc_id", (remainder(5) == 0).alias("held_out"), toxicity.toxicity_column(spark, net, F.col("text")).alias("score"), toxicity.threshold_column(net, F.col("lang")).alias("lang_threshold"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = weak_rules.judged(documents(spark, sf_dir), settle)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.col("good")).alias("kept"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm.score(documents(spark, sf_dir), remainder(5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_language_id, op3_simhash, op4_byte_bpe, op5_substring_dedup, op6_quality, op7_toxicity, op8_quality_rules, op9_lm_scoring, op10_nearest)}
