"""Checks that return problems as rows; a job fails on the first few of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def _all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _say(df: DataFrame, key: Column, problem: str) -> DataFrame:
    return df.select(key.cast("string").alias("key"), F.lit(problem).alias("problem"))


def duplicates(df: DataFrame, keys: list[str], problem: str) -> DataFrame:
    return _say(df.groupBy(*keys).count().where("count > 1"), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)), problem)


def validate_english(entries: DataFrame, senses: DataFrame, glosses: DataFrame, evidence: DataFrame, prefix: str) -> DataFrame:
    """Problems of English entries: key, problem."""
    from pyspark.sql import Window

    placed = senses.withColumn("_n", F.row_number().over(Window.partitionBy("entry_id", "lang").orderBy("position", "sense_id")))
    return _all([
        _say(entries.where("coalesce(trim(headword), '') = ''"), F.col("entry_id"), "empty-headword"),
        _say(entries.where(~F.startswith(F.col("entry_id").cast("string"), F.lit(prefix))), F.col("entry_id"), "bad-id-prefix"),
        duplicates(entries, ["entry_id"], "duplicate-entry"),
        duplicates(senses, ["sense_id"], "duplicate-sense"),
        _say(entries.join(senses.select("entry_id").distinct(), "entry_id", "left_anti"), F.col("entry_id"), "no-language"),
        _say(placed.where("position <> _n"), F.col("sense_id"), "position-out-of-order"),
        _say(senses.join(glosses.select("sense_id").distinct(), "sense_id", "left_anti"), F.col("sense_id"), "no-glosses"),
        _say(senses.where("coalesce(part_of_speech, '') = ''"), F.col("sense_id"), "empty-part-of-speech"),
        _say(senses.where("provenance = 'source'").join(evidence.select("sense_id").distinct(), "sense_id", "left_anti"), F.col("sense_id"), "source-sense-without-evidence"),
        _say(senses.where("provenance = 'generated'").join(evidence.select("sense_id").distinct(), "sense_id", "left_semi"), F.col("sense_id"), "generated-sense-with-evidence"),
        _say(senses.where("provenance = 'generated' and generation_id is null"), F.col("sense_id"), "generated-sense-without-generation"),
    ])


def validate_constraints(table: DataFrame, unique: list[list[str]] = (), allowed: dict[str, list] | None = None, parents: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Unique keys, allowed values and foreign keys: key, problem."""
    out = [duplicates(table, k, "unique:" + "+".join(k)) for k in unique]
    out += [_say(table.where(F.col(c).isNotNull() & ~F.col(c).isin(v)), F.col(c), f"check:{c}") for c, v in (allowed or {}).items()]
    for c, (parent, key) in (parents or {}).items():
        out.append(_say(table.where(F.col(c).isNotNull()).join(parent.select(F.col(key).alias(c)).distinct(), c, "left_anti"), F.col(c), f"foreign-key:{c}"))
    return _all(out)


def check_lookups(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """golden(query, expected), answers(query, place, entry_id): failures with what was found."""
    top = answers.where("place = 1").select("query", "entry_id")
    return golden.join(top, "query", "left").where(~F.col("expected").eqNullSafe(F.col("entry_id")))


def check_language_isolation(senses: DataFrame, examples: DataFrame, home: str = "ja") -> DataFrame:
    """examples(sense_id, translation_langs[]): those whose translations are not exactly in the language of their sense (none at home)."""
    joined = examples.join(senses.select("sense_id", "lang"), "sense_id", "left")
    expected = F.when(F.col("lang") == home, F.array().cast("array<string>")).otherwise(F.array("lang"))
    return joined.where(F.col("lang").isNull() | (F.col("translation_langs") != expected))


def raise_on(problems: DataFrame, most: int = 20) -> None:
    found = problems.limit(most).collect()  # at most `most` rows
    if found:
        raise ValueError("; ".join(f"{r['key']}: {r['problem']}" for r in found))


def validate_authored(candidates: DataFrame, evidence: DataFrame, vocabulary: DataFrame, lang_check: Column | None = None) -> DataFrame:
    """candidates(candidate_id, sense_no, headword, reading, lang, labels[], glosses[], evidence_ids[], pos[]), evidence(candidate_id, evidence_id, pos[], labels[]),
    vocabulary(kind, code): key (candidate and sense), problem. An empty vocabulary admits nothing."""
    key = F.concat_ws("/", F.col("candidate_id").cast("string"), F.col("sense_no").cast("string"))
    used = candidates.select("candidate_id", "sense_no", F.explode("evidence_ids").alias("evidence_id"))
    given = evidence.select("candidate_id", "evidence_id")
    pos = candidates.select("candidate_id", "sense_no", F.explode("pos").alias("code"))
    labels = candidates.select("candidate_id", "sense_no", F.explode("labels").alias("code"))
    known = lambda kind: vocabulary.where(F.col("kind") == kind).select("code").distinct()
    text = F.array_join("glosses", "; ")
    changed = used.join(evidence.select("candidate_id", "evidence_id", F.col("pos").alias("_pos"), F.col("labels").alias("_labels")), ["candidate_id", "evidence_id"]).join(candidates.select("candidate_id", "sense_no", "pos", "labels"), ["candidate_id", "sense_no"])
    same = lambda a, b: (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    return _all([
        _say(candidates.where(~X.is_japanese_text(F.col("headword"))), key, "headword"),
        _say(candidates.where(F.col("reading").isNotNull() & ~X.is_kana(F.col("reading"))), key, "reading"),
        _say(pos.join(known("pos"), "code", "left_anti"), key, "part-of-speech-not-in-vocabulary"),
        _say(labels.join(known("label"), "code", "left_anti"), key, "label-not-in-vocabulary"),
        _say(used.join(given, ["candidate_id", "evidence_id"], "left_anti"), key, "unknown-evidence"),
        _say(given.join(used.select("candidate_id", "evidence_id"), ["candidate_id", "evidence_id"], "left_anti"), F.concat_ws("/", F.col("candidate_id").cast("string"), "evidence_id"), "omitted-evidence"),
        _say(changed.where(~same("pos", "_pos")), key, "source-part-of-speech-changed"),
        _say(changed.where(~same("labels", "_labels")), key, "source-labels-changed"),
        duplicates(candidates.withColumn("glosses", X.text_identity(text)), ["candidate_id", "lang", "glosses"], "duplicate-sense"),
        _say(candidates.where(lang_check if lang_check is not None else X.invalid_explanation_text(F.col("lang"), text)), key, "gloss-language"),
        _say(candidates.where(X.any_circular_gloss(F.col("glosses"), F.array_compact(F.array("headword", "reading")))), key, "circular-gloss"),
    ])


def validate_authored_english(candidates: DataFrame, sources: DataFrame, pronunciations: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """candidates(candidate_id, sense_no, headword, pos, sources[], ipa[], glosses[]), sources/pronunciations(candidate_id, value): problems as above."""
    key = F.concat_ws("/", F.col("candidate_id").cast("string"), F.col("sense_no").cast("string"))
    who = F.col("candidate_id").cast("string")
    kept = candidates.select("candidate_id", F.explode("ipa").alias("value"))
    merged = candidates.select("candidate_id", F.explode("sources").alias("value"))
    return _all([
        _say(candidates.where(~X.is_english_text(F.col("headword"))), key, "headword"),
        _say(candidates.join(vocabulary.where("kind = 'pos'").select(F.col("code").alias("pos")).distinct(), "pos", "left_anti"), key, "part-of-speech-not-in-vocabulary"),
        _say(sources.join(merged, ["candidate_id", "value"], "left_anti"), who, "source-left-out"),
        _say(merged.join(sources, ["candidate_id", "value"], "left_anti"), who, "unknown-source"),
        _say(pronunciations.join(kept, ["candidate_id", "value"], "left_anti"), who, "pronunciation-lost"),
        _say(candidates.where(F.size(X.string_list(F.col("glosses"))) == 0), key, "no-glosses"),
    ])


def validate_language_group(group: DataFrame, english: DataFrame) -> DataFrame:
    """group(sense_id, lang, provenance, evidence_ids[], ipa[], text), english(text): authored groups cite no source and repeat no English wording."""
    key = F.col("sense_id")
    wording = english.select(X.text_identity(F.col("text")).alias("_same")).distinct()
    return _all([
        _say(group.where("size(evidence_ids) > 0"), key, "evidence"),
        _say(group.where("size(ipa) > 0"), key, "pronunciation"),
        _say(group.where("provenance <> 'generated'"), key, "provenance"),
        _say(group.where(X.invalid_explanation_text(F.col("lang"), F.col("text"))), key, "language"),
        _say(group.withColumn("_same", X.text_identity(F.col("text"))).join(wording, "_same", "left_semi"), key, "repeats-english"),
    ])


def validate_examples(examples: DataFrame, contains: Column, lang_check: Column) -> DataFrame:
    """examples(example_id, ...): the headword must be used and the text be in its language."""
    return _all([_say(examples.where(~contains), F.col("example_id"), "headword-not-used"), _say(examples.where(lang_check), F.col("example_id"), "language")])
