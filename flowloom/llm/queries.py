"""All registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import fitting, minhash_dedup, piece_lattice, quality_cnn, queries_native, quote_chat, sharding, token_wavelet, toxicity_gru
from flowloom.llm.common import small_batches, table


def tokenizer_file(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _classified(spark: SparkSession, sf_dir: str, module, folds: int, held: int) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = module.fit(docs, labels, fitting.fold(F.col("id"), folds) != held)
    scored, s = fitting.score_texts(docs, model, "text", ["doc_id"])
    return scored.select("doc_id", (fitting.fold(F.col("doc_id"), folds) == held).alias("held_out"), F.col(s).alias("score"), (F.col(s) >= 0.3).cast("int").alias("predicted"))


def op1_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, quality_cnn, 5, 0)


def op2_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_wavelet.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op3_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of ids, a digest of them, and whether decoding them gives the text again."""
    model = tokenizer_file("piece_bpe_32k.model")
    coded, ids = piece_lattice.encode(table(spark, sf_dir, "documents"), model, carry=["doc_id", "text"], decoded="decoded")
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(piece_lattice.SPACE), F.lit(" "))
    return coded.select("doc_id", F.size(ids).cast("long").alias("n_ids"), F.crc32(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary")).alias("ids_crc32"), same.alias("round_trip"))


def op4_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(spark, sf_dir, toxicity_gru, 4, 2)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped, g = minhash_dedup.near_groups(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return grouped.select("doc_id", f"{g}.*")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, p = sharding.assign(table(spark, sf_dir, "documents"), 16, carry=["doc_id"])
    return placed.select("doc_id", F.col(f"{p}.size"), F.col(f"{p}.text_crc32"), F.lit("key").alias("law"), F.col(f"{p}.shard"), F.col(f"{p}.slot"), F.col(f"{p}.grown_shard"))


def op10_quote_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quote_chat.chats(table(spark, sf_dir, "conversations"))


def _bounded(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(small_batches(spark), sf_dir)

    return run


QUERIES = queries_native.QUERIES | {f.__name__: _bounded(f) for f in (op1_quality_cnn, op2_token_wavelet, op3_piece_lattice, op4_toxicity_gru, op6_minhash_dedup, op8_sharding, op10_quote_chat)}
ORACLES = queries_native.ORACLES
