"""A corpus pipeline of five operators: each stage works on all that the one before it kept.

Every stage is a function of (spark, docs, sf_dir). Its result is written as Parquet and read again as the
next one's docs, so no stage's lineage reaches behind its own input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagewarden.llm import bpe, common, decontamination, exact_dedup, jaccard_join, queries, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity models don't reject.

    Rows alike in id and text stay or go together; several texts of one id are judged each for itself. Null
    and empty texts have no expressions and stay as long as toxic documents are few. Columns may have any
    names; an empty table stays empty, and without labels nothing goes.
    """
    judged = toxicity.toxicity(docs, queries.table(spark, sf_dir, "labels"), keep_text_hash=True)
    return common.without_rows(docs, judged.filter("predicted = 1").select("doc_id", "text_hash").distinct(), "doc_id", "text")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest id; null and empty texts are one group (see exact_dedup)."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that with the smallest id; texts without words all stay (see jaccard_join)."""
    return jaccard_join.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark; null and empty texts hold none (see decontamination)."""
    return decontamination.without_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the tokens and of the decoded text of each document; a null text has no tokens (see bpe)."""
    return bpe.encode_digests(docs, queries.tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: No SQL: the first stage's models and the last one's merges are out of its reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each result goes to the shared checkpoint folder, and goes again when the next one is there."""
    common.ensure_checkpoint_dir(spark)
    place = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
        if k:
            common.remove(spark, f"{place}/{k - 1}")
    return docs
