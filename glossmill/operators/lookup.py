"""Batch lookup of surfaces: exact, by English lemma, and by Japanese inflection tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from .order import first_wins, positions

#: Requests of one word that a task joins.
KEY_ROWS = 100_000


def lookup_exact(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """queries(query), terms(term, entry_id) -> query, entry_id."""
    return queries.select("query").distinct().join(terms.select(F.col("term").alias("query"), "entry_id"), "query")


def resolve_lemma(surfaces: DataFrame, lexicon: DataFrame) -> DataFrame:
    """surfaces(surface), lexicon(term) -> surface, lemma: the surface itself if known, else its first known base form, else null.

    Surfaces are read once: of their candidates those that are known go on, and each surface itself, known or not."""
    every = surfaces.select("surface").distinct()
    known = lexicon.select("term").distinct().withColumn("known", F.lit(True))
    tried = every.select("surface", F.posexplode(F.concat(F.array("surface"), X.english_lemma_candidates(F.col("surface")))).alias("rank", "term"))
    found = tried.join(known, "term", "left").where(F.col("known") | (F.col("rank") == 0))
    return found.groupBy("surface").agg(F.min_by("term", F.when(F.col("known"), F.col("rank"))).alias("lemma"))


def lookup_english(queries: DataFrame, terms: DataFrame, senses: DataFrame, lang: str) -> DataFrame:
    """queries(query) -> query, lemma, entry_id of entries that have senses in the language."""
    lemmas = resolve_lemma(queries.select(F.col("query").alias("surface")), terms).where("lemma is not null")
    explained = senses.where(F.col("lang") == lang).select("entry_id").distinct()
    return lemmas.join(terms.withColumnRenamed("term", "lemma"), "lemma").join(explained, "entry_id", "left_semi").select(F.col("surface").alias("query"), "lemma", "entry_id")


def best_form(forms: DataFrame) -> DataFrame:
    """forms(entry_id, text, reading, kind, common) -> entry_id, headword: common first, then kanji, text, reading."""
    order = (F.col("common").desc(), F.when(F.col("kind") == "kanji", 0).otherwise(1), F.col("text"), F.col("reading"))
    return first_wins(forms, ["entry_id"], *order).select("entry_id", F.col("text").alias("headword"))


def rank_entries(forms: DataFrame, entries: DataFrame) -> DataFrame:
    """term, entry_id, place: how likely each entry is meant by a term, from 1.

    Common forms first, then entries whose best form the term is, then easier levels, then the id."""
    reach = forms.groupBy(F.col("text").alias("term"), "entry_id").agg(F.max(F.col("common").cast("int")).alias("common"))
    level = F.lit(len(R.LEVELS))
    for i, name in enumerate(R.LEVELS):
        level = F.when(F.col("level") == name, i).otherwise(level)
    rows = reach.join(best_form(forms), "entry_id").join(entries.select("entry_id", level.alias("level")), "entry_id")
    order = (F.col("common").desc(), F.when(F.col("headword") == F.col("term"), 0).otherwise(1), F.col("level"), F.col("entry_id"))
    return positions(rows, ["term"], *order, name="place").select("term", "entry_id", "headword", "place")


def japanese_candidates(queries: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """query, term, rank (0 exact, 10, 20), step (order of trial), reason (null if exact) of distinct queries; with terms(term), of those among them.

    A query is turned into its few candidates in one pass, and those that are no term go before anything is sorted."""
    exact = F.array(F.struct(F.lit(-1).alias("place"), F.col("query").alias("text"), F.lit(None).cast("string").alias("reason")))
    tried = queries.select("query", F.explode(F.concat(exact, X.deinflections(F.col("query")))).alias("c")).select("query", F.col("c.text").alias("term"), F.col("c.place").alias("step"), F.col("c.reason").alias("reason"))
    if terms is not None:
        tried = tried.join(terms.select("term").distinct(), "term", "left_semi")
    low = F.max(F.coalesce(X.is_low_reason(F.col("reason")), F.lit(False)))
    # dealt by query once, for the sums per term and for what comes after
    out = tried.repartition("query").groupBy("query", "term").agg(F.min("step").alias("step"), F.min_by("reason", "step").alias("reason"), low.alias("low"))
    return out.select("query", "term", F.when(F.col("step") < 0, 0).when(F.col("low"), 20).otherwise(10).alias("rank"), "step", "reason")


def lookup_japanese(queries: DataFrame, forms: DataFrame, entries: DataFrame, senses: DataFrame | None = None, lang: str | None = None) -> DataFrame:
    """query, entry_id, place, reason: the entries of the best tier that has any with senses in `lang` (any language if null)."""
    ranked = rank_entries(forms, entries)
    if lang is not None:
        ranked = ranked.join(senses.where(F.col("lang") == lang).select("entry_id").distinct(), "entry_id", "left_semi")
    # a term of the form list may have no entry in the language, so tiers are settled among terms that have
    tried = japanese_candidates(queries.select("query").distinct(), ranked)
    # a query has a few candidates at most, so its tier is settled in one list
    best = tried.groupBy("query").agg(F.min("rank").alias("tier"), F.collect_list(F.struct("rank", "term", "step", "reason")).alias("c"))
    best = best.select("query", F.explode(F.filter("c", lambda x: x["rank"] == F.col("tier"))).alias("c")).select("query", "c.term", "c.step", "c.reason")
    hits = best.join(ranked, "term")
    once = first_wins(hits, ["query", "entry_id"], "step", "place")
    return positions(once, ["query"], "step", "place", name="no").select("query", "entry_id", F.col("no").alias("place"), "term", "reason")


def lookup_candidates_english(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """queries(query), terms(term, entry_id) -> query, lemma, entry_id of what a query reaches in any language."""
    lemmas = resolve_lemma(queries.select(F.col("query").alias("surface")), terms).where("lemma is not null")
    return lemmas.join(terms.select(F.col("term").alias("lemma"), "entry_id").distinct(), "lemma").select(F.col("surface").alias("query"), "lemma", "entry_id")


def lookup_candidates_japanese(queries: DataFrame, forms: DataFrame, entries: DataFrame) -> DataFrame:
    """The best tier of a query, whatever languages its entries are explained in."""
    return lookup_japanese(queries, forms, entries)


def _spread_join(rows: DataFrame, items: DataFrame, key: str, own: str, asks: Column, copy: str) -> DataFrame:
    """rows left joined with items(key, ...) where `asks` holds, as one row each. Rows that don't ask are spread over all tasks, and a key with more than KEY_ROWS rows is dealt in parts by `copy`, each with a copy of its item."""
    asked = rows.withColumn("_key", F.when(asks, F.col(own)))
    # one row for each KEY_ROWS rows at most
    often = F.broadcast(asked.where("_key is not null").groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > KEY_ROWS).select("_key", F.ceil(F.col("n") / KEY_ROWS).alias("_parts")))
    place = F.xxhash64(copy)
    dealt = asked.join(often, "_key", "left").withColumn("_part", F.when(F.col("_key").isNull(), place).otherwise(F.pmod(place, F.coalesce("_parts", F.lit(1))))).drop("_parts")
    copies = items.withColumnRenamed(key, "_key").join(often, "_key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copies, ["_key", "_part"], "left").drop("_key", "_part")


def lookup_batch(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """requests(request_no, query, lemma), answers(query, entry_id, place): one row per request, in its order and multiplicity.

    A request that reaches nothing by its query falls back to its lemma if that differs; only such requests are dealt by lemma."""
    items = answers.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "entry_id"))).alias("hits"))
    got = _spread_join(requests, items.withColumnRenamed("hits", "own"), "query", "query", F.lit(True), "request_no")
    falls = F.col("own").isNull() & (F.col("lemma") != F.col("query"))
    got = _spread_join(got, items.withColumnRenamed("hits", "other"), "query", "lemma", falls, "request_no")
    ids = F.transform(F.coalesce("own", "other"), lambda h: h["entry_id"])
    return got.select("request_no", "query", F.get(ids, F.lit(0)).alias("entry_id"), F.coalesce(F.array_join(F.slice(ids, 2, F.greatest(F.size(ids), F.lit(1))), ","), F.lit("")).alias("alternatives"))


def merge_enriched(authored: DataFrame, released: DataFrame) -> DataFrame:
    """query, place, entry_id of both: authored answers first, then released ones that are not authored."""
    rest = released.join(authored.select("query", "entry_id"), ["query", "entry_id"], "left_anti")
    both = authored.withColumn("_s", F.lit(0)).unionByName(rest.withColumn("_s", F.lit(1)))
    return positions(both, ["query"], "_s", "place", name="no").select("query", "entry_id", F.col("no").alias("place"))


def find_source_evidence(queries: DataFrame, index: DataFrame) -> DataFrame:
    """queries(query), index(evidence_id, headword, reading) -> query, headword (adopted if only one), n_headwords, n_records."""
    reach = index.select("evidence_id", "headword", F.explode(F.array_distinct(F.array_compact(F.array("headword", "reading")))).alias("query"))
    got = queries.select("query").distinct().join(reach, "query")
    out = got.groupBy("query").agg(F.countDistinct("headword").alias("n_headwords"), F.count("*").alias("n_records"), F.min("headword").alias("_h"))
    return out.select("query", F.when(F.col("n_headwords") == 1, F.col("_h")).alias("headword"), "n_headwords", "n_records")


def canonical_entry(answers: DataFrame, langs: list[str]) -> DataFrame:
    """answers(query, lang, place, entry_id) -> query, entry_id that it reaches first, languages tried in order."""
    order = F.lit(len(langs))
    for i, name in enumerate(langs):
        order = F.when(F.col("lang") == name, i).otherwise(order)
    return answers.groupBy("query").agg(F.min_by("entry_id", F.struct(order, F.col("place"))).alias("entry_id"))


def match_single_sense(words: DataFrame, terms: DataFrame, senses: DataFrame, lang: str = "en") -> DataFrame:
    """words(word) -> word, entry_id, status: the one entry of the word that has exactly one sense in the language."""
    single = senses.where(F.col("lang") == lang).groupBy("entry_id").agg(F.count("*").alias("n")).where("n = 1").select("entry_id")
    hits = words.select("word").distinct().join(terms.select(F.col("term").alias("word"), "entry_id").distinct(), "word", "left").join(single.withColumn("ok", F.lit(1)), "entry_id", "left")
    out = hits.groupBy("word").agg(F.count("ok").alias("n"), F.min(F.when(F.col("ok") == 1, F.col("entry_id"))).alias("_e"))
    return out.select("word", F.when(F.col("n") == 1, F.col("_e")).alias("entry_id"), F.when(F.col("n") == 1, "match").when(F.col("n") == 0, "no-match").otherwise("ambiguous").alias("status"))


def inflected_proposals(headwords: DataFrame, lexicon: DataFrame, candidates: Column) -> DataFrame:
    """headwords(headword) -> headword, base: proposals whose base form is an entry already; `candidates` gives base forms in order."""
    tried = headwords.select("headword", F.posexplode(candidates).alias("rank", "term"))
    return tried.join(lexicon.select("term").distinct(), "term").groupBy("headword").agg(F.min_by("term", "rank").alias("base"))


def related_headword(headword: Column, inputs: list[Column], dictionary: str) -> Column:
    """Whether a proposed headword is one of the inputs (query, lemma, reading; null or blank ones don't count), one that an input
    is an inflection of, or, in Japanese, one that shares a Chinese character with an input. English columns are taken as
    normalize_english_term() leaves them, in a step of their own, as its Arrow helper may not stand in a lambda."""
    given = [X.nonempty(c) for c in inputs]
    if dictionary == "en":
        found = [(c == headword) | F.array_contains(X.english_lemma_candidates(c), headword) for c in given]
    else:
        han = lambda c: F.regexp_extract_all(c, F.lit(rf"({X.HAN})"), F.lit(1))
        found = [(c == headword) | F.exists(X.deinflect(c), lambda x: x["text"] == headword) | F.arrays_overlap(han(c), han(headword)) for c in given]
    out = F.lit(False)
    for f in found:
        out = out | F.coalesce(f, F.lit(False))
    return out


def enrichment_gaps(queries: DataFrame, answers: DataFrame, senses: DataFrame, lang: str) -> DataFrame:
    """query, entry_id, gap: unknown-word, missing-language or incomplete-examples; senses(entry_id, lang, complete)."""
    state = senses.where(F.col("lang") == lang).groupBy("entry_id").agg(F.min(F.col("complete").cast("int")).alias("complete"))
    got = queries.select("query").distinct().join(answers.select("query", "entry_id"), "query", "left").join(state, "entry_id", "left")
    gap = F.when(F.col("entry_id").isNull(), "unknown-word").when(F.col("complete").isNull(), "missing-language").when(F.col("complete") == 0, "incomplete-examples")
    return got.select("query", "entry_id", gap.alias("gap")).where("gap is not null")
