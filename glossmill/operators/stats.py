"""Coverage, credits, attempt analytics and review tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def language_coverage(senses: DataFrame, glosses: DataFrame, examples: DataFrame) -> DataFrame:
    """Per language: entries, senses, glosses, examples; three grouped counts, each shuffled by sense once."""
    s = senses.groupBy("lang").agg(F.countDistinct("entry_id").alias("entries"), F.count("*").alias("senses"))
    count = lambda t, name: t.groupBy("sense_id").agg(F.count("*").alias("n")).join(senses.select("sense_id", "lang"), "sense_id").groupBy("lang").agg(F.sum("n").alias(name))
    return s.join(count(glosses, "glosses"), "lang", "left").join(count(examples, "examples"), "lang", "left").fillna(0)


def languages_present(senses: DataFrame) -> DataFrame:
    return senses.select("lang").distinct()


def label_vocabulary(senses: DataFrame, columns: list[str]) -> DataFrame:
    """kind, code: the distinct codes in each array column."""
    named = lambda c: F.transform(F.col(c), lambda x: F.struct(F.lit(c).alias("kind"), x.alias("code")))
    pairs = F.flatten(F.array(*map(named, columns)))
    return senses.select(F.explode(pairs).alias("p")).select("p.kind", "p.code").where("code is not null").distinct()


def source_credits(sources: DataFrame, order: str = "ordinal", last: bool = False) -> DataFrame:
    """One credit per named source with licence and URL; the first or the last by order."""
    pick = F.max_by if last else F.min_by
    ok = sources.where("trim(coalesce(name, '')) <> '' and trim(coalesce(license, '')) <> '' and trim(coalesce(url, '')) <> ''")
    return ok.groupBy("name").agg(pick("license", order).alias("license"), pick("url", order).alias("url"))


def dictionary_meta(senses: DataFrame, accepted: dict[str, list[str]]) -> DataFrame:
    """senses(dictionary, lang): per dictionary the languages observed and those accepted."""
    rows = [(d, ",".join(sorted(v))) for d, v in accepted.items()]
    known = senses.sparkSession.createDataFrame(rows, "dictionary string, accepted string")  # as many rows as there are dictionaries
    seen = senses.groupBy("dictionary").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("observed"))
    return F.broadcast(known).join(seen, "dictionary", "inner")


def joined_sets(rows: DataFrame, columns: list[str], sep: str = "; ") -> DataFrame:
    """The sorted distinct values of each column, joined."""
    return rows.agg(*(F.array_join(F.array_sort(F.collect_set(c)), sep).alias(c) for c in columns))


def attempt_summary(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """attempts(keys, outcome, input_tokens, output_tokens, cost): counts, sums and a map of outcomes."""
    each = attempts.groupBy(*keys, "outcome").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"), F.sum("cost").alias("c"))
    return each.groupBy(*keys).agg(
        F.sum("n").alias("attempts"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"), F.sum("c").alias("cost"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes")
    )


def reviewer_evaluation(judgments: DataFrame, keys: list[str]) -> DataFrame:
    """judgments(expected, actual in accept/reject): false accepts and rejects with their rates (0 without cases), and whether a release is blocked."""
    false_accept = (F.col("expected") == "reject") & (F.col("actual") == "accept")
    false_reject = (F.col("expected") == "accept") & (F.col("actual") == "reject")
    out = judgments.groupBy(*keys).agg(
        F.count_if(false_accept).alias("false_accepts"), F.count_if(F.col("expected") == "reject").alias("should_reject"), F.count_if(false_reject).alias("false_rejects"), F.count_if(F.col("expected") == "accept").alias("should_accept")
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return out.withColumn("false_accept_rate", rate("false_accepts", "should_reject")).withColumn("false_reject_rate", rate("false_rejects", "should_accept")).withColumn("blocked", F.col("false_accepts") > 0)


def unanimous_review(verdicts: DataFrame, key: str) -> DataFrame:
    """verdicts(key, pass, verdict): accepted only if every pass accepts, else the outcome of the first that does not."""
    first = F.min_by("verdict", F.when(F.col("verdict") != "accept", F.col("pass")))
    return verdicts.groupBy(key).agg(F.every(F.col("verdict") == "accept").alias("accepted"), first.alias("_v"), F.count("*").alias("passes")).select(key, "accepted", F.when(F.col("accepted"), "accept").otherwise(F.col("_v")).alias("outcome"), "passes")


#: The outcomes that each stage of an import reports, also where none occurred.
STAGES = {
    "examples": ["imported", "unmatched", "ambiguous", "invalid"], "legacy-glosses": ["imported", "dropped"], "legacy-examples": ["imported", "dropped"], "retained": ["entries", "groups", "examples"], "primary": ["entries", "senses"],
    "fallback": ["entries", "senses", "reference-only"], "secondary": ["imported", "dropped"], "pronunciations": ["primary", "fallback"], "language": ["eligible", "imported", "evidence-only", "unmatched", "rejected"],
}


def import_stats(tagged: DataFrame, declared: dict[str, list[str]] | None = None) -> DataFrame:
    """tagged(stage, outcome) -> n, with 0 for declared outcomes that did not occur."""
    found = tagged.groupBy("stage", "outcome").agg(F.count("*").alias("n"))
    if not declared:
        return found
    every = tagged.sparkSession.createDataFrame([(s, o) for s, outcomes in declared.items() for o in outcomes], "stage string, outcome string")  # as many rows as are declared
    return found.join(F.broadcast(every), ["stage", "outcome"], "full_outer").fillna(0, ["n"])


def language_import_stats(records: DataFrame) -> DataFrame:
    """records(lang, rejected, role, matched): per language how many source records were eligible, imported, evidence_only, unmatched, rejected."""
    eligible = (F.col("role") == "direct-import") & ~F.col("rejected")
    return records.groupBy("lang").agg(
        F.count_if(eligible).alias("eligible"), F.count_if(eligible & F.col("matched")).alias("imported"), F.count_if(~F.col("rejected") & (F.col("role") != "direct-import")).alias("evidence_only"),
        F.count_if(eligible & ~F.col("matched")).alias("unmatched"), F.count_if("rejected").alias("rejected"),
    )


def skip_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("skip_reason", F.lit("proposed")).alias("reason")).agg(F.count("*").alias("n"))


def accepted_entries(senses: DataFrame, lang: str) -> DataFrame:
    return senses.where((F.col("lang") == lang) & F.col("generation_id").isNotNull()).select("entry_id").distinct()


def single_entry_share(terms: DataFrame) -> DataFrame:
    """terms(term, entry_id): how many terms, and what share of them reaches one entry."""
    per = terms.groupBy("term").agg(F.countDistinct("entry_id").alias("n"))
    return per.agg(F.count("*").alias("terms"), F.count_if(F.col("n") == 1).alias("single")).withColumn("share", F.coalesce(F.try_divide("single", "terms"), F.lit(0.0)))
