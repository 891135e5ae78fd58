"""The corpus pipeline: quality filter, near-duplicates, repeated passages, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return
the columns of documents; the last returns each document's ids. Tables that a stage needs beside docs, labels
and benchmark, are read whole.

Cases. As the operators' own, nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names among them; n_chars, where docs has it, is the length of the text that is left. A document
whose whole text repeats earlier ones goes on with an empty text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.llm import blocks, crf, minhash, sentencepiece_scan, suffix_dedup, wumanber


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier takes for good."""
    return crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that of the smallest id."""
    return minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 100 bytes that stand earlier already."""
    out = suffix_dedup.dedup(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)
    return out


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return wumanber.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, score and round_trip of each document."""
    import public_tokenizers

    return sentencepiece_scan.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontaminated", decontaminated), ("token_ids", token_ids)]

#: SQL can express neither the classifier nor the ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what each but the last keeps is written to the shared folder and read again, so that none is computed twice, and what the one before had kept is deleted then.

    The result reads what the last but one has written, so that stays as long as the result is wanted.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{blocks.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            where, path = blocks.file_system(before)
            where.delete_dir(path)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
