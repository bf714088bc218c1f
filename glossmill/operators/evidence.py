"""Translation evidence from large dictionary dumps: filter, flag, corroborate, cap, count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import checkpoint
from .order import global_cap, record_occurrence

TRANSLATION = "struct<code:string,lang_code:string,lang:string,word:string,roman:string,sense:string,tags:array<string>,topics:array<string>,note:string>"
ENTRY_SCHEMA = f"word string, pos string, lang string, lang_code string, pageid long, page_id long, etymology_number int, senses array<struct<id:string,glosses:array<string>,tags:array<string>,raw_tags:array<string>,topics:array<string>,categories:array<string>,examples:array<struct<text:string>>,translations:array<{TRANSLATION}>>>, sounds array<struct<ipa:string,tags:array<string>>>, translations array<{TRANSLATION}>"


def evidence_rows(entries: DataFrame, source: str, edition: str, version: str) -> DataFrame:
    """entries: ENTRY_SCHEMA and `ordinal`. One row per translation into a target language, with its reason if rejected.

    Stateless but for `occurrence`, which counts records of one word, part of speech and etymology."""
    english = entries.where((F.col("lang_code") == "en") & F.coalesce(F.col("word") != "", F.lit(False)))
    pos = F.coalesce(X.nonempty(F.col("pos")), F.lit("unknown"))
    english = english.withColumn("pos", pos).withColumn("etymology", F.coalesce("etymology_number", F.lit(0)))
    english = record_occurrence(english.withColumn("_key", F.concat_ws("|", "word", "pos", F.col("etymology").cast("string"))), "_key", "ordinal")
    return stateless_rows(english, source, edition, version)


def stateless_rows(english: DataFrame, source: str, edition: str, version: str) -> DataFrame:
    empty = F.array().cast(f"array<{TRANSLATION}>")
    senses = F.coalesce("senses", F.array().cast(english.schema["senses"].dataType))
    entry_id = F.concat_ws(":", F.lit(f"{source}-{edition}"), F.lit(version), "word", "pos", F.col("etymology").cast("string"), F.col("occurrence").cast("string"))
    base = english.select("ordinal", "word", F.coalesce("pageid", "page_id").alias("page_id"), "pos", entry_id.alias("source_entry_id"), senses.alias("senses"), F.coalesce("translations", empty).alias("translations"))
    base = base.withColumn("glosses", F.transform("senses", lambda s: X.sense_gloss_text(s["glosses"]))).withColumn("n_senses", F.size("senses"))
    # all translations of an entry as one array, so that the entries are read, and any stream's state kept, once
    none = F.lit(None)
    record = lambda scope, sense, place, hint, t: F.struct(F.lit(scope).alias("scope"), sense.cast("int").alias("sense_index"), place.cast("int").alias("place"), hint.cast("string").alias("hint"), t.alias("t"))
    numbered = F.filter(F.transform("glosses", lambda g, i: F.struct(i.alias("i"), g.alias("g"))), lambda x: x["g"].isNotNull())

    def matched(hint):
        hits = F.filter(numbered, lambda x: X.gloss_matches_hint(x["g"], hint))
        return F.when(hint.isNotNull() & (F.size(hits) == 1), F.get(hits, F.lit(0))["i"])

    local = F.flatten(F.transform("senses", lambda s, i: F.transform(F.coalesce(s["translations"], empty), lambda t, j: record("sense-local", i, j, none, t))))
    level = F.transform("translations", lambda t, j: record("entry-level", matched(X.nonempty(t["sense"])), j, X.nonempty(t["sense"]), t))
    rows = base.select("*", F.explode(F.concat(local, level)).alias("r")).select("ordinal", "word", "page_id", "pos", "source_entry_id", "n_senses", "glosses", "senses", "r.*")
    code = X.evidence_code(F.col("t.code"), F.col("t.lang_code"))
    rows = rows.withColumn("code", code).withColumn("lang", X.evidence_language(F.col("code"))).where("lang is not null")
    rows = rows.withColumn("term", X.trim(F.coalesce(F.col("t.word"), F.lit("")))).withColumn("rejection", X.rejection_reason(F.col("term"), F.col("lang")))
    rows = rows.withColumn("qualifiers", X.qualifiers(F.col("t.tags"), F.col("t.topics"), F.col("t.note")))
    rows = rows.withColumn("ambiguity", X.ambiguity_reasons(F.col("term"), F.col("scope"), F.col("sense_index"), F.col("n_senses")))
    where = F.when(F.col("scope") == "entry-level", F.lit("translations")).otherwise(F.concat(F.lit("senses["), F.col("sense_index").cast("string"), F.lit("].translations")))
    return rows.select(
        "ordinal", "word", "page_id", "pos", "source_entry_id", F.get("senses", F.col("sense_index"))["id"].alias("source_sense_id"), "scope", "sense_index",
        F.get("glosses", F.col("sense_index")).alias("source_gloss"), "hint", "place", "code", "lang", "term", X.nonempty(F.col("t.roman")).alias("roman"), "qualifiers", "ambiguity", "rejection",
        F.concat("source_entry_id", F.lit("#"), where, F.lit("["), F.col("place").cast("string"), F.lit("]")).alias("evidence_id"),
    )


def corroborate(rows: DataFrame, japanese: DataFrame | None, taiwan: DataFrame | None) -> DataFrame:
    """japanese(term, support, ordinal), taiwan(english, chinese, support, ordinal): the first support of a term or pair
    by ordinal wins (without an ordinal the smallest); adds support, taiwan_support, locale."""
    none = F.lit(None).cast("string")
    first = lambda t: F.min_by("support", "ordinal" if "ordinal" in t.columns else "support")
    if japanese is not None:
        ja = japanese.groupBy("term").agg(first(japanese).alias("ja_support"))
        rows = rows.join(ja, "term", "left")
    else:
        rows = rows.withColumn("ja_support", none)
    rows = rows.withColumn("pair", X.term_pair_key(F.col("word"), F.col("term")))
    if taiwan is not None:
        tw = taiwan.groupBy(X.term_pair_key(F.col("english"), F.col("chinese")).alias("pair")).agg(first(taiwan).alias("tw_support"))
        rows = rows.join(tw, "pair", "left")
    else:
        rows = rows.withColumn("tw_support", none)
    supported = F.col("tw_support").isNotNull()
    return (
        rows.withColumn("support", F.when(F.col("lang") == "ja", F.col("ja_support")).otherwise(F.col("tw_support")))
        .withColumn("taiwan_support", (F.col("lang") == "zh") & supported)
        .withColumn("locale", X.evidence_locale(F.col("lang"), F.col("code"), F.col("qualifiers"), supported))
        .drop("pair", "ja_support", "tw_support")
    )


def filter_evidence(entries: DataFrame, source: str, edition: str, version: str, japanese: DataFrame | None = None, taiwan: DataFrame | None = None, per_entry: int = 24, total: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(accepted rows under both caps, all rows with `kept` and `state` for coverage)."""
    rows = corroborate(evidence_rows(entries, source, edition, version), japanese, taiwan)
    from pyspark.sql import Window

    order = Window.partitionBy("ordinal").orderBy(F.when(F.col("scope") == "sense-local", 0).otherwise(1), F.when(F.col("scope") == "sense-local", F.col("sense_index")), "place")
    good = rows.where("rejection is null").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_entry)
    counts = checkpoint(good.groupBy("ordinal").agg(F.count("*").alias("n_rows")))  # two numbers an entry, read four times
    kept = good.join(global_cap(counts, ["ordinal"], total).select("ordinal", "kept_rows"), "ordinal").where(F.col("_n") <= F.col("kept_rows")).drop("_n", "kept_rows")
    return kept, rows


def evidence_totals(entries: DataFrame, rows: DataFrame, per_entry: int = 24, total: int = 500_000) -> DataFrame:
    """One row: entries_read, english_entries, entries_with_evidence, rows_emitted, truncated.

    Reading stops counting English entries after the one whose rows meet the cap over all; entries_read counts on."""
    n = checkpoint(rows.where("rejection is null").groupBy("ordinal").agg(F.least(F.count("*"), F.lit(per_entry)).alias("n_rows")))
    capped = global_cap(n, ["ordinal"], total)
    emitted = capped.agg(F.count_if(F.col("kept_rows") > 0).alias("entries_with_evidence"), F.coalesce(F.sum("kept_rows"), F.lit(0)).alias("rows_emitted"), F.min(F.when(F.col("kept_rows") < F.col("n_rows"), F.col("ordinal"))).alias("_at"))
    english = F.coalesce((F.col("lang_code") == "en") & (F.col("word") != ""), F.lit(False))
    counted = entries.select("ordinal", english.alias("english")).crossJoin(F.broadcast(emitted.select("_at")))  # one row
    read = counted.agg(F.count("*").alias("entries_read"), F.count_if(F.col("english") & (F.col("_at").isNull() | (F.col("ordinal") <= F.col("_at")))).alias("english_entries"))
    return read.crossJoin(emitted).select("entries_read", "english_entries", "entries_with_evidence", "rows_emitted", F.col("_at").isNotNull().alias("truncated"))  # one row each


def evidence_coverage(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """Per language: sense_local, entry_level, ambiguous, corroborated, unmatched, rejected, and the rejections by reason."""
    accepted = kept.groupBy("lang").agg(
        F.count_if(F.col("scope") == "sense-local").alias("sense_local"),
        F.count_if(F.col("scope") == "entry-level").alias("entry_level"),
        F.count_if(F.size("ambiguity") > 0).alias("ambiguous"),
        F.count_if(F.col("support").isNotNull()).alias("corroborated"),
        F.count_if(F.col("support").isNull()).alias("unmatched"),
    )
    reasons = rows.where("rejection is not null").groupBy("lang", "rejection").agg(F.count("*").alias("n"))
    rejected = reasons.groupBy("lang").agg(F.sum("n").alias("rejected"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("rejection", "n")))).alias("by_reason"))
    return accepted.join(rejected, "lang", "full_outer").fillna(0)


def wiktionary_records(entries: DataFrame, version: str) -> DataFrame:
    """entries: ENTRY_SCHEMA -> one row per English lexeme with senses, pronunciations and labels; records without a sense are dropped."""
    pos = X.wiktionary_pos(F.col("pos"))
    word = X.nonempty(F.col("word"))
    rows = entries.where((F.trim("lang_code") == "en") & F.exists(F.array(word), X.is_lexical_headword) & pos.isNotNull()).withColumn("headword", word).withColumn("pos", pos)
    rows = rows.withColumn("record", F.concat_ws(":", F.lit("en"), "headword", "pos", F.coalesce("etymology_number", F.lit(1)).cast("string")))
    numbered = F.transform("senses", lambda s, i: F.struct((i + 1).alias("no"), X.string_list(s["glosses"]).alias("glosses"), s.alias("s")))
    good = F.filter(numbered, lambda x: (F.size(x["glosses"]) > 0) & ~X.is_inflected_form_sense(x["glosses"], x["s"]["tags"], x["s"]["categories"]))
    senses = F.transform(
        good,
        lambda x: F.struct(
            F.concat(F.lit("wiktionary:"), F.col("record"), F.lit(":"), x["no"].cast("string")).alias("evidence_id"),
            x["glosses"][0].alias("gloss"),
            X.sense_labels(x["s"]["tags"], x["s"]["raw_tags"], x["s"]["topics"]).alias("labels"),
            F.array_compact(F.transform(F.coalesce(x["s"]["examples"], F.array().cast("array<struct<text:string>>")), lambda e: X.nonempty(e["text"]))).alias("examples"),
        ),
    )
    sounds = F.filter(
        F.transform(F.coalesce("sounds", F.array().cast("array<struct<ipa:string,tags:array<string>>>")), lambda s, i: F.struct((i + 1).alias("no"), X.nonempty(s["ipa"]).alias("ipa"), F.try_element_at(F.array_compact(F.transform(X.string_list(s["tags"]), X.region)), F.lit(1)).alias("region"))),
        lambda s: s["ipa"].isNotNull(),
    )
    some = F.explode(F.filter(F.array(senses), lambda s: F.size(s) > 0))  # a plain filter is moved ahead, with all that makes the senses, which are then made twice
    return rows.select("headword", "pos", "record", F.lit(version).alias("source_version"), some.alias("senses"), "sounds").withColumn("pronunciations", sounds).drop("sounds")


def propose_target_glosses(kaikki: DataFrame, matches: DataFrame, taken: DataFrame, parts: list[str], limit: int = 6) -> DataFrame:
    """kaikki(ordinal, word, pos, translations) -> word, entry_id, glosses, skip_reason (null if proposed; the first reason that holds).

    matches(word, entry_id, status), taken(entry_id): entries that already have the target language."""
    rows = kaikki.withColumn("g", X.group_target_glosses(F.col("translations")))
    rows = rows.join(matches, "word", "left").join(taken.select("entry_id").distinct().withColumn("_taken", F.lit(True)), "entry_id", "left")
    clean = F.array_distinct(F.array_compact(F.transform(F.col("g.glosses"), X.clean_target_gloss)))
    from pyspark.sql import Window

    reason = (
        F.when(~F.coalesce(F.col("pos").isin(parts), F.lit(False)), "part-of-speech")
        .when(X.is_short_ambiguous(F.col("word")), "short-ambiguous-word")
        .when(F.col("g.mixed"), "mixed-senses")
        .when(F.size(clean) == 0, "no-clean-gloss")
        .when(F.coalesce("status", F.lit("no-match")) != "match", F.coalesce("status", F.lit("no-match")))
        .when(F.col("_taken"), "has-target-language")
    )
    rows = rows.select("ordinal", "word", "entry_id", F.slice(clean, 1, limit).alias("glosses"), reason.alias("skip_reason"))
    first = F.row_number().over(Window.partitionBy("entry_id", F.col("skip_reason").isNull()).orderBy("ordinal"))
    return rows.withColumn("_n", first).withColumn("skip_reason", F.coalesce("skip_reason", F.when(F.col("_n") > 1, "repeated-sense"))).drop("_n")
