"""A corpus pipeline: documents in, packed training sequences out.

Toxic documents go, one document of each class of near-duplicates stays, secrets are blotted out, and what is left is
packed. Each stage is written and read again, so a lost executor costs the stage it hits; what a stage wrote on its way
goes with its end, and its input once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapgraph.llm import dartminhash, packing, secrets, toxicity
from lapgraph.storage import release, settled


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below their language's threshold.

    Null texts are judged as empty ones; rows that repeat stay or go together; without labels of both kinds all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the least doc_id, a null one only if there is no other.

    Null texts and empty ones are one class. Of rows that repeat id and text one stays.
    """
    return dartminhash.deduplicate(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the values of secrets replaced; ``n_chars``, if there, follows the text.

    A null text stays null and keeps its ``n_chars``; an empty one stays empty; rows that repeat stay as many, and alike.
    """
    model = secrets.train(secrets.labelled_samples(spark))
    found = docs.withColumn("text", secrets.redact(F.col("text"), model))
    if "n_chars" not in docs.columns:
        return found
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids.

    A null or empty text gives one piece, of the end id alone; rows that repeat are packed as often; no document, no piece.
    """
    return packing.pack(docs, 1024, digest=True)


STAGES = [("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("secrets", redact_secrets), ("packing", pack)]
#: The stages rest on trained models and on a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(stage, spark, docs, sf_dir)
        release(before)
    pieces = STAGES[-1][1](spark, docs, sf_dir)
    release(docs)  # the pieces are cut from written ids
    return pieces
