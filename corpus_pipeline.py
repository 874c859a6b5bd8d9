"""The corpus pipeline: rules, toxicity, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one's docs
are that, written as Parquet and read again. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import jaccard, mixing, packing, quality, toxicity
from millrace.llm.common import SPACES, fresh_name, materialize, table

#: A score from which a document counts as toxic.
TOXIC = 0.7


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that line-first cleaning keeps, without the lines that it removes.

    n_chars follows the text; the other columns stay. Null and empty texts go; repeated
    rows stay alike; an empty table gives no rows.
    """
    verdict = fresh_name(docs, "_verdict")
    kept = quality.with_verdict(docs, verdict).where(F.col(verdict)["kept"])
    kept = kept.withColumn("text", F.col(verdict)["cleaned"])
    return _counted(kept).select(*docs.columns)


def _counted(docs: DataFrame) -> DataFrame:
    """With n_chars, where there is such a column, that of the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, trained on the labelled ones among
    them, scores below ``TOXIC``. Null texts have only the model's bias; repeated rows get
    equal scores and stay or go alike; an empty table gives no rows."""
    model, score = toxicity.train(docs, table(spark, sf_dir, "labels")), fresh_name(docs, "_score")
    return toxicity.with_scores(docs, model, score).where(F.col(score) < TOXIC).select(*docs.columns)


def _numbered(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows with a number of their own each, stored so that it stays, and the
    number's column; doc_ids may be null or repeated."""
    row = fresh_name(docs, "_row")
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of the Jaccard join at 0.8: the one with the smallest
    doc_id, null last.

    The join takes rows, not doc_ids: rows whose texts are unlike stay whether their
    doc_ids are null, the same or different, and copies go likewise. Rows without words
    are in no group; of those, rows with one doc_id and text become one row. An empty table
    gives no rows.
    """
    rows, row = _numbered(docs, "distinct-rows")
    found = jaccard.jaccard_components(rows.select(F.col(row).alias("doc_id"), "text"))
    found = found.select(F.col("doc_id").alias("row"), F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component"))
    blank = F.when(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACES)) == "", F.col("text"))
    slim = rows.select(F.col(row).alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), blank.alias("blank")).join(found, "row")
    single = F.when(F.col("component").isNull(), F.col("doc_id"))
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "row")).alias("best")
    kept = slim.groupBy("component", single.alias("single"), "blank").agg(best).select(F.col("best.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that the mix takes: none to three rows per document,
    the last of a source's stream cut to the words that reach its target, in the order
    of the mix's shards and of the places in each.

    n_chars follows the text; the other columns of a copy are its document's. Documents
    without words have no place in a mix of words. Rows with null or repeated doc_ids
    are documents of their own: a placement returns the row that it was made for. An empty
    table gives no rows.
    """
    copies, copy = mixing.mixed_copies(docs)
    return mixing.in_order(_counted(copies), copy).select(*docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix packed into sequences of at most 2048 tokens; the columns of
    :data:`millrace.llm.packing.PIECES`. Null and empty texts are packed as their end id
    alone; repeated rows and null doc_ids are documents of their own; an empty table gives
    no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", source_mix),
    ("packing", sequence_packing),
]

#: The stages learn a model, follow links of any length and tokenize: no SQL has that.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
