"""Registered queries of the package and their comparison SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import comparison_sql
from .common import is_held_out, table
from .conversation_trie import conversation_trie
from .decontamination import find_contamination
from .hilbert_shards import assign_shards, quantised_name, quantised_size
from .license_scan import scan_licenses
from .line_quality import line_quality
from .ngram_join import ngram_join
from .piece_ids import encode_pieces
from .suffix_tree_lm import language_model_scores
from .token_alignment import aligned_counts
from .token_counts import count_tokens
from .token_files import token_file_digest
from .toxicity import score_toxicity, train_toxicity
from .warc_files import warc_round_trip

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return token_file_digest(spark, docs, public_tokenizers.path(BYTE_BPE))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), lambda key: ~is_held_out(key, 5, 0))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("id", "doc_id")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_quality(_documents(spark, sf_dir, "doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         "base_failed", "kept", "lost_chars")


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text", "lang", "source")
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
                       F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"), "lang", "source")
    cells = [quantised_name(F.col("lang")), quantised_name(F.col("source")), quantised_size(F.col("size"))]
    placed = assign_shards(rows, cells, ["text_crc32", "doc_id"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


def op7_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    scored = language_model_scores(docs, lambda key: ~is_held_out(key, 7, 2)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", is_held_out("doc_id", 7, 2).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(BYTE_BPE)).drop("text")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_documents(spark, sf_dir, "doc_id", "text")).withColumnRenamed("id", "doc_id").drop("licenses")


def op10_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return encode_pieces(docs, public_tokenizers.path(PIECE_BPE), digests=True).drop("text")


def op11_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    return aligned_counts(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_decontamination": op2_decontamination,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_join": op4_ngram_join,
    "op5_line_quality": op5_line_quality,
    "op6_hilbert_shards": op6_hilbert_shards,
    "op7_suffix_tree_lm": op7_suffix_tree_lm,
    "op8_token_counts": op8_token_counts,
    "op9_license_scan": op9_license_scan,
    "op10_piece_ids": op10_piece_ids,
    "op11_warc_records": op11_warc_records,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_token_alignment": op13_token_alignment,
}

#: The others need a library's tokenizer, a trained model or a curve index and have tests instead.
SQL: dict[str, str] = {
    "op2_decontamination": comparison_sql.DECONTAMINATION,
    "op4_ngram_join": comparison_sql.NGRAM_JOIN,
    "op5_line_quality": comparison_sql.LINE_QUALITY,
    "op11_warc_records": comparison_sql.WARC_RECORDS,
    "op12_conversation_trie": comparison_sql.CONVERSATION_TRIE,
}
