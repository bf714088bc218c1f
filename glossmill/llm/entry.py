"""The operators as registered queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bond, bpe, htmlcut, licenses, minhash, quality, spelling, suffix, tiling, toxicity, urlrules, warc, webp
from .frames import table


def op1_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digest_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup_substrings(table(spark, sf_dir, "documents"), texts_too=False).drop("kept")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.read_media(webp.store_media(table(spark, sf_dir, "documents")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "archive", "at", "size")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.extract_main_text(table(spark, sf_dir, "pages"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlrules.judge_urls(pages, urlrules.label_pages(pages, table(spark, sf_dir, "labels")))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_spellings(spelling.count_words(table(spark, sf_dir, "documents"), least_letters=7, least=2, damage=31), ratio=10)


def op12_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_documents(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)
    return bond.hard_negatives(table(spark, sf_dir, "embeddings"), is_anchor=lambda i: i % 50 == 0, mislabel=moved)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_bpe, op2_suffix_dedup, op3_decontaminate, op4_webp, op5_licenses, op6_warc, op7_minhash, op8_toxicity, op9_main_text, op10_url_rules, op11_spelling, op12_host_quality, op13_hard_negatives, pipeline]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """Of the operators whose results SQL can state in full; tests hold the others against brute force."""
    return {"op11_spelling": spelling.SQL, "op12_host_quality": quality.SQL, "op13_hard_negatives": bond.SQL}
