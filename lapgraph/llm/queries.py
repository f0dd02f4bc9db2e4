"""The thin queries over the operators, one for each, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lapgraph.llm import chunked_bpe, dartminhash, flac, hmm, licenses, mih, packing, secrets, sharding, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(_table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(_table(spark, sf_dir, "documents"))


def op3_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_doc_id", "class_size", "representative")


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.read_back(flac.encode_texts(_table(spark, sf_dir, "documents")))


def op5_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunked_bpe.encode_decode(_table(spark, sf_dir, "documents"))
    n = (F.octet_length("ids") / 4).cast("long")
    return found.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), 1024, digest=True)


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_samples(spark))
    return secrets.scan_documents(_table(spark, sf_dir, "documents"), model)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.report(licenses.scan(_table(spark, sf_dir, "documents")))
    line = lambda x: F.concat_ws(":", x["label"], x["start"].cast("string"), x["end"].cast("string"))
    return found.withColumn("spans", F.array_join(F.transform("spans", line), ","))


def op10_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def queries():
    named = (op1_sharding, op2_hmm, op3_dartminhash, op4_flac, op5_chunked_bpe, op6_packing, op7_secret_scans, op8_toxicity, op9_license_scans, op10_multi_index_hashing)
    return {f.__name__: f for f in named}


def oracle_sql():
    return {}
