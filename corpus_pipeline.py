"""A corpus pipeline of five stages; each takes all that its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables (an empty table comes
out), and leaves columns that it doesn't know, whatever their names, as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import decontaminate, minhash, mixing, quality, token_files
from pulsegrid.llm.common import bounded_broadcast, cut, drop_folder, scratch_path, table

#: The mixing stage keeps about this share of the tokens that reach it.
BUDGET = 0.9


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. Null and empty texts are judged by the features of an empty
    text; a probability of exactly the threshold stays; repeated rows are judged alike; without labels the classifier
    has no evidence, and all stay."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: the one with the least doc_id, and of rows that share it, those
    that are there. Texts without words, null ones included, are nobody's duplicates; a null doc_id stays."""
    gone = cut(minhash.near_duplicates(docs).filter("not kept").select("doc_id").distinct())  # numbers only
    return docs.join(bounded_broadcast(gone, 1_000_000), "doc_id", "left_anti").select(docs.columns)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that leak a benchmark item. Null and empty texts leak nothing; of repeated rows all go or stay;
    with an empty benchmark all stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def keep_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples the documents toward the target weights of sources, languages and topics. Null sources and languages are
    values like others; texts without words have no tokens, and are drawn by their cell's probability; rows of one
    doc_id fall together."""
    return mixing.sampled(docs, budget=BUDGET)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids and returns what each document's read back as: (doc_id, start, n_tokens, ids_crc32). Null and
    empty texts have the end id alone; rows of one doc_id follow each other by their texts; null ids stand first."""
    return token_files.tokens_of(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("decontamination", keep_clean), ("mixing", keep_mix), ("token_ids", write_ids)]

#: Trained models and tokenizers can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's table is deleted when the next one stands written."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        at = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            drop_folder(spark, before)
        before = at
    found = STAGES[-1][1](spark, docs, sf_dir)  # the token files are written, and found reads these alone
    drop_folder(spark, before)
    return found
