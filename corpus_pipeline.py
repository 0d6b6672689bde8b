"""Training-corpus pipeline: documents to packed token sequences.

Each stage takes all that the one before kept.  Stages 1 to 4 return rows of ``documents`` with their
columns; the last returns a row for each piece of a document with its token ids and its place in a sequence.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm import decontaminate, exact_dedup, near_dedup, packing, quality
from tabspark.llm.files import prepare, scratch, shared_folder
from tabspark.session import delete_path, read_table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry classifier accepts; learnt from the labels outside fold 1 of 3."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels").where(fold != 1))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, white space aside, the longest original."""
    return exact_dedup.drop_copies(docs)


def first_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return near_dedup.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", first_copies),
    ("MinHash near-dedup", first_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

ORACLE_SQL = None  # the classifier and the packing have no SQL form; tests/llm/test_pipeline.py holds the stages against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written for itself goes when its output is written, and its input when the next one's is."""
    prepare(spark)
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_folder(spark, "stage-" + name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
