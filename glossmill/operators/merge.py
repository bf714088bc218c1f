"""Joins that build dictionaries from several sources; every one keeps a count of what it left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..sources.shared import checkpoint
from .digest import digest_sums
from .order import first_wins, positions, range_bounds, range_of

#: Pairs of a concept and a term up to which they are broadcast, after they were counted.
FEW_HOLDERS = 200_000


# --- English ------------------------------------------------------------------------------------


def import_wordnet(senses: DataFrame, synsets: DataFrame) -> DataFrame:
    """senses(ordinal, headword, pos_key, sense_no, sense_id, synset), synsets(synset, definition, domain_topic[], examples[], members[]).

    One row per sense that has a definition; its domains are the first members of its topics' synsets."""
    base = senses.join(synsets.select("synset", "definition", "domain_topic", "examples"), "synset").where(X.nonempty(F.col("definition")).isNotNull())
    topics = base.select("sense_id", F.posexplode("domain_topic").alias("no", "topic"))
    label = synsets.select(F.col("synset").alias("topic"), X.normalize_member(F.get("members", F.lit(0))).alias("label")).where("label is not null")
    domains = topics.join(label, "topic").groupBy("sense_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "label"))), lambda x: x["label"]).alias("domains"))
    out = base.join(domains, "sense_id", "left").withColumn("domains", F.coalesce("domains", F.array().cast("array<string>")))
    return out.select("ordinal", "headword", X.wordnet_pos(F.col("pos_key")).alias("pos"), "sense_no", "sense_id", "synset", "definition", "examples", "domains")


def merge_fallback(primary: DataFrame, fallback: DataFrame, term: str = "term") -> DataFrame:
    """The fallback records with `canonical`: whether the primary source lacks their term."""
    known = primary.select(term).distinct().withColumn("_known", F.lit(True))
    return fallback.join(known, term, "left").withColumn("canonical", F.col("_known").isNull()).drop("_known")


def admit_secondary(mappings: DataFrame, reference: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """mappings(ordinal, evidence_id), reference(evidence_id, entry_id, source, source_entry_id, ...), sources(entry_id, source, source_entry_id).

    (admitted rows, counts by outcome). Blank and repeated mappings are errors; a record that an entry has is skipped."""
    bad = mappings.where(X.nonempty(F.col("evidence_id")).isNull()).limit(1).count()
    twice = mappings.groupBy("evidence_id").count().where("count > 1").limit(1).count()
    if bad or twice:
        raise ValueError("a mapping is blank or repeated")
    found = mappings.join(reference, "evidence_id", "left")
    key = ["entry_id", "source", "source_entry_id"]
    fresh = found.where("entry_id is not null").join(sources.select(key), key, "left_anti")
    admitted = first_wins(fresh, key, "ordinal")
    counts = found.agg(F.count_if(F.col("entry_id").isNull()).alias("dropped")).crossJoin(admitted.agg(F.count("*").alias("admitted")))  # one row each
    return admitted, counts


def fill_pronunciations(entries: DataFrame, pronunciations: DataFrame, reference: DataFrame) -> DataFrame:
    """entries(entry_id, term), pronunciations(entry_id), reference(term, ordinal, ipa[]): all of the first record that has any, for entries that have none."""
    missing = entries.join(pronunciations.select("entry_id").distinct(), "entry_id", "left_anti")
    first = first_wins(reference.where("size(ipa) > 0"), ["term"], "ordinal").select("term", "ipa")
    return missing.join(first, "term").select("entry_id", F.posexplode("ipa").alias("position", "ipa")).withColumn("position", F.col("position") + 1)


def import_concepts(records: DataFrame, mappings: DataFrame, lang: str = "jpn") -> DataFrame:
    """records(synset, lemma, lang), mappings(ordinal, synset, pwn_synset, validated), the last of a synset counting: rows with `reason` if rejected."""
    last = first_wins(mappings, ["synset"], F.col("ordinal").desc()).select("synset", "pwn_synset", "validated")
    reason = F.when(F.col("lang") != lang, R.NOT_JAPANESE).when(F.col("pwn_synset").isNull(), R.NO_MAPPING).when(~F.coalesce("validated", F.lit(False)), R.NOT_VALIDATED)
    return records.join(last, "synset", "left").withColumn("reason", reason)


def publish_concepts(accepted: DataFrame, senses: DataFrame, range_rows: int = 50_000) -> DataFrame:
    """accepted(ordinal, lemma, pwn_synset), senses(ordinal, synset, term, pos): one sense per accepted row and term that holds its concept.

    Terms that hold the same concepts number their rows alike, so rows are numbered once for each such set of terms (told apart by digests of their concepts), by ranges of
    ordinals, and meet the terms last: what comes out, rows times terms, is neither shuffled nor sorted."""
    holders = checkpoint(first_wins(senses.withColumn("key", X.concept_key(F.col("synset"))), ["key", "term"], "ordinal").select("key", "term", "pos").where("key is not null"))
    alike = holders.groupBy("term").agg(F.count("*").alias("n"), *digest_sums(F.sha2("key", 256)))
    alike = alike.select("term", F.sha2(F.concat_ws(":", F.col("n").cast("string"), *(F.col(f"s{k}").cast("string") for k in range(4))), 256).alias("set"))
    held = holders.join(alike.withColumnRenamed("term", "_term"), F.col("term").eqNullSafe(F.col("_term"))).select("key", "term", "pos", "set")
    few = holders.count() <= FEW_HOLDERS
    near = F.broadcast if few else lambda df: df
    ranges = max(8, accepted.count() // range_rows)
    rows = accepted.withColumn("key", X.concept_key(F.col("pwn_synset"))).crossJoin(F.broadcast(range_bounds(accepted, ["ordinal"], ranges)))  # one row
    rows = rows.withColumn("_range", range_of(F.col("_bounds"), F.struct("ordinal"), ranges)).select("ordinal", "lemma", "key", "_range")
    rows = rows.join(near(held.select("key", "set").distinct()), "key")
    ahead = Window.partitionBy("set").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("set", "_range").agg(F.count("*").alias("n")).select("set", "_range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    # by number, as each row becomes many
    numbered = positions(rows.repartition(ranges, "set", "_range"), ["set", "_range"], "ordinal", name="n").join(before, ["set", "_range"])
    return numbered.join(near(held), ["set", "key"]).select("ordinal", "lemma", "term", "pos", (F.col("before") + F.col("n")).alias("position"))


def import_terminology(rows: DataFrame) -> DataFrame:
    """Rows with `reason` naming the fields that are missing, null if none is."""
    blank = F.array_compact(F.array(*(F.when(X.nonempty(F.col(c)).isNull(), F.lit(c)) for c in R.TERMINOLOGY_FIELDS)))
    return rows.withColumn("reason", F.when(F.size(blank) > 0, F.concat(F.lit(R.REASON_PROVENANCE + ":"), F.array_join(blank, "+"))))


def publish_domain_terms(accepted: DataFrame, entries: DataFrame, first_pos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """accepted(ordinal, english, chinese, domain), entries(entry_id, term), first_pos(entry_id, pos): (senses, rows without an entry)."""
    rows = accepted.withColumn("term", X.normalize_english_term(F.col("english")))
    out = rows.join(entries.select("entry_id", "term"), "term").join(first_pos, "entry_id", "left")
    out = positions(out.withColumn("pos", F.coalesce("pos", F.lit("noun"))), ["entry_id"], "ordinal")
    return out.select("entry_id", "position", "chinese", "domain", "pos"), rows.join(entries.select("term"), "term", "left_anti")


def merge_headwords(records: DataFrame) -> DataFrame:
    """records(ordinal, headword, forms[]): one entry per normalized term.

    The headword is the plain spelling if a source writes it so, else the spelling met first."""
    rows = records.withColumn("term", X.normalize_english_term(F.col("headword"))).withColumn("spelling", X.nfkc(X.trim(F.col("headword"))))
    out = rows.groupBy("term").agg(
        F.max((F.col("spelling") == F.col("term")).cast("int")).alias("_plain"),
        F.min_by("spelling", "ordinal").alias("_first"),
        F.min("ordinal").alias("ordinal"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("forms", F.array().cast("array<string>")))))).alias("forms"),
        F.count("*").alias("n_records"),
    )
    return out.select("term", F.when(F.col("_plain") == 1, F.col("term")).otherwise(F.col("_first")).alias("headword"), "forms", "ordinal", "n_records")


def lookup_terms(entries: DataFrame) -> DataFrame:
    """entries(entry_id, term, forms[]) -> distinct term, entry_id of headwords and forms."""
    forms = entries.select("entry_id", F.explode("forms").alias("form")).select(X.normalize_english_term(F.col("form")).alias("term"), "entry_id")
    return entries.select("term", "entry_id").unionByName(forms.where("term <> ''")).distinct()


def canonical_evidence(sources: DataFrame, senses: DataFrame, glosses: DataFrame) -> DataFrame:
    """One row per source of an entry that has senses: entry_id, source, senses array<struct(position, glosses)>."""
    g = glosses.groupBy("sense_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("glosses"))
    s = senses.join(g, "sense_id", "left").groupBy("entry_id", "source").agg(F.array_sort(F.collect_list(F.struct("position", "glosses"))).alias("senses"))
    return sources.join(s, ["entry_id", "source"])


# --- Japanese -----------------------------------------------------------------------------------


def explode_words(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """words in the lexicon schema with `ordinal` -> (forms, senses, glosses); a word's senses split by published language."""
    kanji = words.select("id", F.posexplode("kanji").alias("no", "k"), "kana")
    forms = kanji.select(F.col("id").alias("entry_id"), F.col("k.text").alias("text"), F.lit("kanji").alias("kind"), X.reading_for_kanji(F.col("kana"), F.col("k.text")).alias("reading"), F.col("k.common").alias("common"), F.col("k.tags").alias("tags"))
    kana = words.select("id", F.posexplode("kana").alias("no", "k"))
    forms = forms.unionByName(kana.select(F.col("id").alias("entry_id"), F.col("k.text").alias("text"), F.lit("kana").alias("kind"), F.lit(None).cast("string").alias("reading"), F.col("k.common").alias("common"), F.col("k.tags").alias("tags")))
    sense = words.select(F.col("id").alias("entry_id"), F.posexplode("sense").alias("sense_no", "s"))
    gloss = sense.select("entry_id", "sense_no", "s", F.posexplode("s.gloss").alias("gloss_no", "g")).withColumn("lang", X.to_explanation_lang(F.col("g.lang"))).where("lang is not null")
    senses = gloss.groupBy("entry_id", "sense_no", "lang").agg(F.first("s").alias("s"))
    senses = positions(senses, ["entry_id", "lang"], "sense_no").select(F.concat_ws(":", F.concat_ws("_", "entry_id", (F.col("sense_no") + 1).cast("string")), "lang").alias("sense_id"), "entry_id", "sense_no", "lang", "position", F.col("s.partOfSpeech").alias("part_of_speech"), F.col("s.appliesToKanji").alias("applies_to_kanji"), F.col("s.appliesToKana").alias("applies_to_kana"))
    glosses = positions(gloss, ["entry_id", "sense_no", "lang"], "gloss_no").join(senses.select("sense_id", "entry_id", "sense_no", "lang"), ["entry_id", "sense_no", "lang"])
    return forms, senses, glosses.select("sense_id", "position", F.col("g.text").alias("text"), F.col("g.type").alias("type"))


def match_examples(senses: DataFrame, examples: DataFrame) -> DataFrame:
    """senses(word_id, sense_id, identity), examples(word_id, identity, ...): examples with `sense_id` and `outcome`.

    Imported only if the identity stands once on either side; else ambiguous, or unmatched."""
    left = senses.groupBy("word_id", "identity").agg(F.count("*").alias("_n"), F.min("sense_id").alias("sense_id"))
    right = examples.withColumn("_m", F.count("*").over(Window.partitionBy("word_id", "identity")))
    out = right.join(left, ["word_id", "identity"], "left")
    outcome = F.when(F.col("_n").isNull(), "unmatched").when((F.col("_n") > 1) | (F.col("_m") > 1), "ambiguous").otherwise("imported")
    return out.withColumn("outcome", outcome).withColumn("sense_id", F.when(F.col("outcome") == "imported", F.col("sense_id"))).drop("_n", "_m")


def attach_bilingual(examples: DataFrame, senses: DataFrame) -> DataFrame:
    """examples(example_id, entry_id, sense_no, sentences[(lang, text)]): each sentence to the sense of its language; a `jpn` one is needed."""
    own = F.filter("sentences", lambda s: s["lang"] == "jpn")
    rows = examples.withColumn("text", F.try_element_at(own, F.lit(1))["text"]).where("text is not null")
    rows = rows.select("example_id", "entry_id", "sense_no", "text", F.posexplode("sentences").alias("no", "s")).withColumn("lang", X.to_explanation_lang(F.col("s.lang"))).where("lang is not null")
    out = rows.join(senses.select("sense_id", "entry_id", "sense_no", "lang"), ["entry_id", "sense_no", "lang"])
    return positions(out, ["sense_id"], "example_id", "no").select("sense_id", "position", "text", "lang", F.col("s.text").alias("translation"))


def attach_legacy_glosses(rows: DataFrame, senses: DataFrame, langs: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows(ordinal, sense_id, lang, glosses[]), senses(sense_id, entry_id, lang): (new senses with glosses, problems)."""
    n = F.count("*").over(Window.partitionBy("sense_id", "lang"))
    held = senses.select(F.col("entry_id"), F.col("lang"), F.lit(True).alias("_held")).distinct()
    joined = rows.withColumn("_n", n).join(senses.select("sense_id", "entry_id"), "sense_id", "left").join(held, ["entry_id", "lang"], "left")
    clean = X.string_list(F.col("glosses"))
    problem = (
        F.when(F.col("entry_id").isNull(), "unknown-sense").when(F.col("_n") > 1, "duplicate").when(~F.col("lang").isin(langs), "bad-language").when(F.size(clean) == 0, "empty").when(F.col("_held"), "conflict")
    )
    marked = joined.withColumn("problem", problem).withColumn("glosses", clean)
    return marked.where("problem is null").select("sense_id", "entry_id", "lang", F.posexplode("glosses").alias("position", "text")).withColumn("position", F.col("position") + 1), marked.where("problem is not null").select("ordinal", "sense_id", "lang", "problem")


def attach_legacy_examples(rows: DataFrame, senses: DataFrame, taken: DataFrame) -> DataFrame:
    """rows(ordinal, sense_id, text, translations[(lang, text)]): each translation to position 1 of its language's sense, unless taken; first wins.

    A row counts as imported even where its slot was taken, so `slot` says whether it was stored."""
    parts = rows.select("ordinal", "sense_id", "text", F.posexplode("translations").alias("no", "t"))
    target = senses.select("sense_id", F.col("target_id"), F.col("lang"))
    hit = parts.join(target, (parts["sense_id"] == target["sense_id"]) & (F.col("t.lang") == F.col("lang"))).select("ordinal", "no", "target_id", "text", F.col("t.text").alias("translation"))
    free = first_wins(hit.join(taken.select("target_id").distinct(), "target_id", "left_anti"), ["target_id"], "ordinal", "no").select("ordinal", "no", "target_id", F.lit(True).alias("slot"))
    return hit.join(free, ["ordinal", "no", "target_id"], "left").fillna({"slot": False})


def assign_levels(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """lists(entry_id, n): the easiest level, i.e. the largest number, wins."""
    best = lists.groupBy("entry_id").agg(F.max("n").alias("n"))
    return entries.join(best, "entry_id", "left").withColumn("level", F.when(F.col("n").isNotNull(), F.concat(F.lit("N"), F.col("n").cast("string")))).drop("n")


def legacy_example_targets(examples: DataFrame, senses: DataFrame) -> DataFrame:
    """examples(example_id, sense_id, lang) -> target: the sense itself, else the sense of that language of the same stem."""
    known = senses.select("sense_id").distinct()
    own = known.select(F.col("sense_id"), F.col("sense_id").alias("_own"))
    other = known.select(F.col("sense_id").alias("_key"), F.col("sense_id").alias("_other"))
    out = examples.join(own, "sense_id", "left").withColumn("_key", F.concat_ws(":", "sense_id", "lang")).join(other, "_key", "left")
    return out.select("example_id", "sense_id", "lang", F.coalesce("_own", "_other").alias("target"))


def identity_of(labels: list[Column]) -> Column:
    return X.sense_identity(*labels)
