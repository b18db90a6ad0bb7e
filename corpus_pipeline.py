"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) of the documents that the stage
before kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import minhash_dedup, packing, quality_ranking, suffix_dedup, toxicity
from tessera.llm.common import shared_dir, table
from tessera.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ranking learned from ``labels.quality`` does not reject."""
    model = quality_ranking.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_ranking.score(docs, model, extra=tuple(COLUMNS[1:])).where("predicted = 1").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier learned from ``labels.toxic`` does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model, extra=tuple(COLUMNS[1:])).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the least id; of repeated rows one."""
    return minhash_dedup.near_duplicates(docs, extra=tuple(COLUMNS[1:])).where("representative").select(*COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 200 bytes and more that occur more than once."""
    out = suffix_dedup.remove_repeats(docs, extra=("lang", "source"), as_text=True)
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack_texts(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", keep_quality),
    ("toxicity", drop_toxic),
    ("minhash_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: Classifiers and similarity joins have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage's documents are written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    folder = f"{shared_dir(spark)}/corpus-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
