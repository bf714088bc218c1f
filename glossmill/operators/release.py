"""Nested views and release exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import checkpoint
from .order import bank_numbers


def nest_entries(entries: DataFrame, forms: DataFrame, senses: DataFrame, glosses: DataFrame, examples: DataFrame, lang: str | None = None) -> DataFrame:
    """entry_id, forms[], senses[glosses[], examples[]] in stored order; glosses and examples carry entry_id, so that all is grouped by it."""
    if lang is not None:
        senses = senses.where(F.col("lang") == lang)
    g = glosses.groupBy("entry_id", "sense_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("glosses"))
    e = examples.groupBy("entry_id", "sense_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("examples"))
    s = senses.join(g, ["entry_id", "sense_id"], "left").join(e, ["entry_id", "sense_id"], "left")
    s = s.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("lang", "position", "sense_id", "glosses", "examples"))).alias("senses"))
    f = forms.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((~F.col("common")).alias("rare"), F.when(F.col("kind") == "kanji", 0).otherwise(1).alias("k"), "text"))), lambda x: x["text"]).alias("forms"))
    return entries.select("entry_id").join(f, "entry_id", "left").join(s, "entry_id", "left")


def by_language(nested: DataFrame) -> DataFrame:
    """entry_id, languages: map of language to its senses."""
    langs = F.array_distinct(F.transform("senses", lambda s: s["lang"]))
    return nested.where("senses is not null").select("entry_id", F.map_from_entries(F.transform(langs, lambda k: F.struct(k, F.filter("senses", lambda s: s["lang"] == k)))).alias("languages"))


def project_lookup(nested: DataFrame, lang: str) -> DataFrame:
    """The shared lookup shape; no row where no sense is in the language."""
    own = F.filter("senses", lambda s: s["lang"] == lang)
    return nested.withColumn("senses", own).where("size(senses) > 0").select("entry_id", F.try_element_at("forms", F.lit(1)).alias("headword"), "senses")


def in_release_order(df: DataFrame, key: str) -> DataFrame:
    return df.repartitionByRange(key).sortWithinPartitions(key)


def export_jsonl(nested: DataFrame, path: str, key: str = "entry_id") -> None:
    """One JSON line per entry, in order of the key over all part files; empty lists are left out."""
    in_release_order(by_language(nested), key).select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("value")).write.mode("errorifexists").text(path)


def manifest(coverage: DataFrame, counts: dict[str, DataFrame], sources: DataFrame, artifacts: DataFrame, versions: dict[str, str]) -> DataFrame:
    """One row of JSON: versions, rows by table, coverage(lang, ...) by language, sources(name, ...), and artifacts(file, sha256, bytes)."""
    listed = lambda df, by: df.agg(F.array_sort(F.collect_list(F.struct(by, *[c for c in df.columns if c != by]))).alias("x"))
    out = listed(coverage, "lang").select(F.map_from_entries(F.transform("x", lambda x: F.struct(x["lang"], x))).alias("coverage"))
    for name, df in counts.items():
        out = out.crossJoin(df.agg(F.count("*").alias(f"_{name}")))  # one row each
    out = out.crossJoin(listed(sources, "name").withColumnRenamed("x", "sources")).crossJoin(listed(artifacts, "file").withColumnRenamed("x", "artifacts"))
    rows = F.struct(*(F.col(f"_{n}").alias(n) for n in counts))
    return out.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(versions.items())), rows.alias("rows"), "coverage", "sources", "artifacts")).alias("value"))


def write_manifest(path: str, *args, **named) -> None:
    """The manifest as one text file in a folder of its own, written last, so that a release without one is unfinished."""
    manifest(*args, **named).coalesce(1).write.mode("errorifexists").text(path)


def term_rows_ja(forms: DataFrame, senses: DataFrame, glosses: DataFrame, lang: str) -> DataFrame:
    """The rows of Japanese term banks: entry_id, form_no, text, reading, rules, score, glossary[]; senses that exclude a form don't count."""
    g = glosses.groupBy("sense_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("glosses"))
    s = senses.where(F.col("lang") == lang).join(g, "sense_id")
    pairs = forms.join(s, "entry_id").where(X.sense_applies_to(F.col("kind"), F.col("text"), F.col("reading"), F.col("applies_to_kanji"), F.col("applies_to_kana")))
    keys = ["entry_id", "form_no", "text", "reading", "common"]
    out = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "glosses", "part_of_speech"))).alias("s"))
    return out.select("entry_id", "form_no", "text", F.coalesce("reading", F.lit("")).alias("reading"), X.pack_rules(F.flatten(F.transform("s", lambda x: x["part_of_speech"]))).alias("rules"), X.pack_score(F.col("common"), F.col("form_no")).alias("score"), F.flatten(F.transform("s", lambda x: x["glosses"])).alias("glossary"))


def term_rows_en(entries: DataFrame, senses: DataFrame, glosses: DataFrame, lang: str) -> DataFrame:
    g = glosses.groupBy("sense_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("glosses"))
    s = senses.where(F.col("lang") == lang).join(g, "sense_id").groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("position", "glosses", "part_of_speech"))).alias("s"))
    out = entries.join(s, "entry_id")
    return out.select("entry_id", F.lit(0).alias("form_no"), F.col("headword").alias("text"), F.lit("").alias("reading"), F.array_join(F.array_distinct(F.transform("s", lambda x: x["part_of_speech"])), " ").alias("tags"), F.lit("").alias("rules"), F.lit(0).alias("score"), F.flatten(F.transform("s", lambda x: x["glosses"])).alias("glossary"))


def export_term_banks(rows: DataFrame, order: str = "entry_id", size: int = 10_000) -> DataFrame:
    """Term rows with `sequence`, shared by the rows of an entry, and `bank`."""
    counts = checkpoint(rows.groupBy(order).agg(F.count("*").alias("n_rows")))  # two numbers an entry, read four times
    return rows.join(bank_numbers(counts, [order], size).select(order, "sequence", "bank"), order)


def pack_attribution(credits: DataFrame, lang: str, authored: str = "Authored content") -> DataFrame:
    """credits(name, lang, attribution): those of the language, joined; else the text for authored content."""
    own = credits.where(F.col("lang") == lang).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("name", "attribution"))), lambda x: x["attribution"]), "; ").alias("attribution"))
    return own.select(F.when(F.col("attribution") == "", F.lit(authored)).otherwise(F.col("attribution")).alias("attribution"))
