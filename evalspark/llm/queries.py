"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import (embedding_dedup, exact_dedup, jaccard_join, packing, periodic_runs, piece_codec, secret_scan, sharding, substring_dedup,
                           token_counts, topk, toxicity, whitening)
from evalspark.llm.common import read_table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file on this machine (executors have the same package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 20-word windows taken out of all documents."""
    return substring_dedup.remove_repeats_digest(read_table(spark, sf_dir, "documents"), length=20)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts, uniformly shuffled."""
    placed = sharding.shuffle_into_shards(read_table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies among all documents."""
    return jaccard_join.near_copies(read_table(spark, sf_dir, "documents"), percent=75, shingle=5)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids and decoded text of every document, as digests."""
    return piece_codec.encode_digests(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside fold 2."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), cut=0.3)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among all documents, and the row that stays of each group."""
    return exact_dedup.find_copies(read_table(spark, sf_dir, "documents"))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector."""
    return topk.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), limit=512)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.find_secrets(read_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens packed into sequences of at most 1024."""
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 and more among all vectors, and their components."""
    return embedding_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every document (a tenth of them made periodic), as digests."""
    docs = periodic_runs.with_planted_periods(read_table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs, least=12))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every vector."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=16, scale=64.0, shift=1_000_000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_sharding, op3_jaccard_join, op4_sentencepiece, op5_toxicity, op6_exact_dedup, op7_topk_search, op8_token_counts, op9_secret_scan, op10_packing,
        op11_embedding_dedup, op12_periodic_runs, op13_embedding_whitening)
}
ORACLES: dict[str, str] = {"op7_topk_search": topk.ORACLE}
