"""A training-data pipeline over `documents`: each stage works on what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossmill.llm import bpe, minhash, suffix, tiling, toxicity
from glossmill.llm.frames import checkpoint, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is scored as toxic go, each by its own text; null and empty texts stay. The model learns from the labelled documents of the corpus."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, carry=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 0").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays; similarity 0.8 on five words.

    Ids name documents: all rows of an id that goes go, rows without an id stay, as do null and empty texts."""
    gone = minhash.near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes that a smaller document has are cut; a document that a cut leaves without text goes.

    Rows that share an id are cut each by itself; null texts stay null, and n_chars changes with the text only."""
    docs = docs.withColumn("blank", F.col("text").isNull())
    cut = suffix.dedup_substrings(docs, carry=("lang", "source", "n_chars", "blank"))
    done = F.col("n_removed") > 0
    text = F.when(~F.col("blank"), F.col("kept"))
    n_chars = F.when(done, F.length("kept").cast("long")).otherwise(F.col("n_chars").cast("long"))
    return cut.where(~done | (F.col("kept") != "")).select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go: all rows of such an id; rows without an id and blank ones stay."""
    bad = tiling.decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: id, number of tokens, digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", contaminated), ("tokens", tokens)]

#: Neither the network, the search for near copies nor the tokenizer is SQL's to state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the cluster's shared folder and read again; what a stage has read then goes."""
    docs = table(spark, sf_dir, "documents")
    checkpoint(spark.range(1))  # makes sure that a shared folder is set
    context = spark.sparkContext
    folder = f"{context._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    last = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            old = context._jvm.org.apache.hadoop.fs.Path(last)
            old.getFileSystem(context._jsc.hadoopConfiguration()).delete(old, True)
        last = path
    return docs
