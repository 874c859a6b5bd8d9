"""Named queries of the training-data operators, one per operator, and the pipeline."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import alignment, divergence, jaccard, licenses, mixing, ogg, packing, quality, secret_scan, sharding, token_planes, toxicity, warc
from millrace.llm.common import table

#: The vocabulary file of the tokenized queries.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(table(spark, sf_dir, "documents"), shards=16)


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *counts, F.col("n_lines_removed").cast("long"), F.md5("cleaned").alias("cleaned_md5"))


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_table(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, end_id=1)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), percent=80)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix_sources(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_planes.token_plane_table(table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(secret_scan.scan_secrets(table(spark, sf_dir, "documents")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_sharding, op2_line_quality, op3_ogg, op4_warc, op5_packing, op6_jaccard, op7_licenses, op8_mixing, op9_toxicity, op10_token_planes, op11_divergence, op12_secrets, op13_alignment, pipeline)}
ORACLES: dict[str, str] = {"op2_line_quality": quality.oracle(), "op4_warc": warc.ORACLE, "op11_divergence": divergence.oracle()}
