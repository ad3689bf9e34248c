"""The registered queries of these operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mistgrove.llm import langid, toxicity
from mistgrove.llm.alignment import align_documents
from mistgrove.llm.common import documents, remainder
from mistgrove.llm.conversations import repair_conversations
from mistgrove.llm.decontaminate import find_leaks
from mistgrove.llm.exact import exact_groups
from mistgrove.llm.jaccard import jaccard_groups
from mistgrove.llm.lm import score_corpus
from mistgrove.llm.mixing import mix
from mistgrove.llm.resharding import reshard
from mistgrove.llm.sanitise import find_personal
from mistgrove.llm.secrets import find_secrets
from mistgrove.llm.tokens import token_counts


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to 150 % of their words by weights 5, 2, 1."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents, with every text's digest."""
    return exact_groups(documents(spark, sf_dir), digest_all=True).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def toxicity_model(docs: DataFrame, spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from labelled rows whose crc32(doc_id) mod 3 is not 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = toxicity.training_sample(docs, labels, remainder(F.col("doc_id"), 3) != 1, "doc_id", "text", "toxic")
    return toxicity.fit(*sample)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    docs = documents(spark, sf_dir)
    scored = toxicity.score_texts(docs, toxicity_model(docs, spark, sf_dir))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents linked by 90 % of their three-word shingles."""
    return jaccard_groups(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of all documents."""
    import public_tokenizers

    counted = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents, learned from those whose crc32(doc_id) mod 7 is not 2."""
    return score_corpus(documents(spark, sf_dir), remainder(F.col("doc_id"), 7) == 2)


def op7_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From eight shards by source, very uneven, to eight of even bytes."""
    old = (F.crc32(F.col("source").cast("binary")) % 8).cast("int")
    plan = reshard(documents(spark, sf_dir), old)
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = documents(spark, sf_dir)
    sample = langid.training_sample(docs, remainder(F.col("doc_id"), 4) != 2, "doc_id", "text", "lang")
    return langid.identify(docs, langid.fit(*sample)).select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return find_secrets(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two vocabularies over all documents, aligned and counted."""
    import public_tokenizers

    return align_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the words that give it away."""
    return find_personal(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_mix, op2_exact_dedup, op3_toxicity, op4_jaccard, op5_token_counts, op6_lm, op7_reshard, op8_decontaminate, op9_language,
                                   op10_secrets, op11_repair, op12_align, op13_personal)}
