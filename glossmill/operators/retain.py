"""Rebuilds that keep accepted authored content: retention, restoration, graft, upsert, removal.

Tables: entries(entry_id, source, term), senses(sense_id, entry_id, lang, position, provenance,
generation_id), glosses(sense_id, position, text), examples(sense_id, position, text, source,
generation_id). A group is all senses of one entry in one language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import append_position, first_wins, positions

GROUP = ["entry_id", "lang"]


def retain_accepted(entries: DataFrame, senses: DataFrame, examples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(generated entries, authored groups on imported entries, authored examples on other imported senses)."""
    whole = entries.where("source = 'generated'")
    authored = senses.where("generation_id is not null").select(*GROUP).distinct().join(whole.select("entry_id"), "entry_id", "left_anti")
    inside = senses.join(authored, GROUP, "left_semi").select("sense_id")
    of_whole = senses.join(whole.select("entry_id"), "entry_id", "left_semi").select("sense_id")
    loose = examples.where("generation_id is not null").join(inside.unionByName(of_whole), "sense_id", "left_anti")
    return whole, authored, loose


def generations_used(*frames: DataFrame) -> DataFrame:
    out = None
    for f in frames:
        ids = f.where("generation_id is not null").select("generation_id")
        out = ids if out is None else out.unionByName(ids)
    return out.distinct()


def restore_entries(retained: DataFrame, rebuilt: DataFrame, explained: DataFrame | None = None) -> DataFrame:
    """retained(entry_id, term), rebuilt(entry_id, term): with `target`, the rebuilt entry that takes its groups over, and `action`.

    Same id or same term: reattach. In English, a term that another lexeme explains (explained(term)) is dropped. Else inserted whole."""
    same = rebuilt.select(F.col("entry_id"), F.col("entry_id").alias("_same")).distinct()
    shared = rebuilt.groupBy("term").agg(F.min("entry_id").alias("_shared"))
    out = retained.join(same, "entry_id", "left").join(shared, "term", "left")
    if explained is not None:
        out = out.join(explained.select("term").distinct().withColumn("_told", F.lit(True)), "term", "left")
    else:
        out = out.withColumn("_told", F.lit(None).cast("boolean"))
    target = F.coalesce("_same", "_shared")
    action = F.when(target.isNotNull(), "reattach").when(F.col("_told"), "drop").otherwise("insert")
    return out.select("entry_id", "term", F.when(action != "drop", F.coalesce(target, F.col("entry_id"))).alias("target"), action.alias("action"))


def restore_groups(groups: DataFrame, entries: DataFrame, senses: DataFrame) -> DataFrame:
    """groups(entry_id, lang, from_entry): those whose entry stands and has no senses in the language; of several the smallest origin."""
    free = groups.join(entries.select("entry_id").distinct(), "entry_id", "left_semi").join(senses.select(*GROUP).distinct(), GROUP, "left_anti")
    return first_wins(free, GROUP, "from_entry")


def restore_examples(examples: DataFrame, senses: DataFrame, present: DataFrame) -> DataFrame:
    """Examples whose sense stands, placed behind those it has."""
    return append_position(examples.drop("position").join(senses.select("sense_id").distinct(), "sense_id", "left_semi"), present, "sense_id", "text")


def promoted_entries(production: DataFrame, release: DataFrame) -> DataFrame:
    """production(entry_id, source, term), release(entry_id, term): generated entries that the release now supplies -> entry_id, replacement (smallest)."""
    ours = production.where("source = 'generated'").select("entry_id", "term")
    return ours.join(release.select(F.col("entry_id").alias("replacement"), "term"), "term").groupBy("entry_id").agg(F.min("replacement").alias("replacement"))


def graft_release(production: DataFrame, release: DataFrame, release_senses: DataFrame, senses: DataFrame) -> DataFrame:
    """senses after the graft: the release's, and authored groups (moved to promoted entries) where the release has none.

    production/release(entry_id, source, term), senses/release_senses(sense_id, entry_id, lang, position, generation_id)."""
    moved = promoted_entries(production, release)
    ours = senses.join(senses.where("generation_id is not null").select(*GROUP).distinct(), GROUP, "left_semi")
    ours = ours.withColumn("_from", F.col("entry_id")).join(moved, "entry_id", "left").withColumn("entry_id", F.coalesce("replacement", "entry_id")).drop("replacement")
    stand = release.select("entry_id").distinct().unionByName(production.where("source = 'generated'").join(moved, "entry_id", "left_anti").select("entry_id"))
    kept = ours.join(stand.distinct(), "entry_id", "left_semi").join(release_senses.select(*GROUP).distinct(), GROUP, "left_anti")
    # two promoted entries may have moved to one: of their groups in a language that of the smaller entry stays
    kept = kept.join(first_wins(kept.select(*GROUP, "_from").distinct(), GROUP, "_from"), [*GROUP, "_from"], "left_semi").drop("_from")
    return release_senses.withColumn("origin", F.lit("release")).unionByName(kept.select(*release_senses.columns).withColumn("origin", F.lit("production")))


def graft_tables(production: dict[str, DataFrame], release: dict[str, DataFrame], versions: tuple[str, str]) -> dict[str, DataFrame]:
    """Both: entries(entry_id, source, term), senses, glosses, examples. All four tables after the graft; nothing changes if the versions are equal.

    Imported content is the release's alone. Generated entries that the release does not supply stay whole, with all that hangs on
    their senses; authored groups follow graft_release(); authored examples come back to senses that stand, behind nothing of their own place."""
    if versions[0] == versions[1]:
        return production
    moved = promoted_entries(production["entries"], release["entries"])
    own = production["entries"].where("source = 'generated'").join(moved, "entry_id", "left_anti")
    entries = release["entries"].unionByName(own.select(*release["entries"].columns))
    whole = production["senses"].join(own.select("entry_id"), "entry_id", "left_semi")
    others = production["senses"].join(own.select("entry_id"), "entry_id", "left_anti")
    grafted = graft_release(production["entries"], release["entries"], release["senses"], others)
    senses = grafted.drop("origin").unionByName(whole.select(*release["senses"].columns))
    kept = grafted.where("origin = 'production'").select("sense_id").unionByName(whole.select("sense_id"))

    def hanging(name: str, old: DataFrame) -> DataFrame:
        first = release[name].withColumn("_s", F.lit(0)).unionByName(old.select(*release[name].columns).withColumn("_s", F.lit(1)))
        return first_wins(first, ["sense_id", "position"], "_s").drop("_s")

    examples = production["examples"].where("generation_id is not null or source = 'generated'").join(senses.select("sense_id").distinct(), "sense_id", "left_semi")
    examples = examples.unionByName(production["examples"].join(kept, "sense_id", "left_semi")).distinct()
    return {"entries": entries, "senses": senses, "glosses": hanging("glosses", production["glosses"].join(kept, "sense_id", "left_semi")), "examples": hanging("examples", examples)}


def upsert_group(senses: DataFrame, new: DataFrame) -> DataFrame:
    """Replace exactly the groups that `new` has."""
    return senses.join(new.select(*GROUP).distinct(), GROUP, "left_anti").unionByName(new)


def upsert_example(examples: DataFrame, new: DataFrame) -> DataFrame:
    """A new generated example replaces the generated ones of its sense, never sourced ones."""
    touched = new.select("sense_id").distinct().withColumn("_t", F.lit(True))
    kept = examples.join(touched, "sense_id", "left").where("not (source = 'generated' and coalesce(_t, false))").drop("_t")
    return kept.unionByName(append_position(new.drop("position"), kept, "sense_id", "text").select(*kept.columns))


def drop_component(senses: DataFrame, glosses: DataFrame, examples: DataFrame, lang: str, source: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Remove the imported senses of one language and source with all that hangs on them; authored ones stay. Last: what went."""
    gone = senses.where((F.col("lang") == lang) & (F.col("provenance") == "source") & (F.col("source_name") == source) & F.col("generation_id").isNull())
    ids = gone.select("sense_id")
    return senses.join(ids, "sense_id", "left_anti"), glosses.join(ids, "sense_id", "left_anti"), examples.join(ids, "sense_id", "left_anti"), gone


def split_legacy_groups(rows: DataFrame, present: DataFrame) -> DataFrame:
    """rows(entry_id, sense_no, gloss_no, lang, text): one group per gloss language with renumbered places; groups that stand already win."""
    fresh = rows.join(present.select(*GROUP).distinct(), GROUP, "left_anti").withColumn("sense_id", F.concat_ws(":", F.concat_ws("_", "entry_id", F.col("sense_no").cast("string")), "lang"))
    senses = positions(fresh.select("sense_id", "entry_id", "sense_no", "lang").distinct(), GROUP, "sense_no", name="sense_position")
    return positions(fresh, ["sense_id"], "gloss_no", name="gloss_position").join(senses.select("sense_id", "sense_position"), "sense_id").select("entry_id", "lang", "sense_id", "sense_position", "gloss_position", "text")


def convert_flat(entries: DataFrame) -> DataFrame:
    """entries(entry_id, definition) -> one English sense with one gloss each, with its provenance."""
    return entries.where("trim(definition) <> ''").select("entry_id", F.lit("en").alias("lang"), F.lit(1).alias("position"), F.trim("definition").alias("text"), F.lit("generated").alias("provenance"))


def not_imported(rows: DataFrame, marker: DataFrame, key: str) -> DataFrame:
    return rows.join(marker.select(key).distinct(), key, "left_anti")


def accepted_content(entries: DataFrame, senses: DataFrame, examples: DataFrame, incoming: DataFrame) -> DataFrame:
    """How many authored entries, groups and examples a replacement by `incoming` entries would destroy."""
    a, b, c = retain_accepted(entries, senses, examples)
    lost = lambda df: df.join(incoming.select("entry_id").distinct(), "entry_id", "left_anti")
    one = lost(a).agg(F.count("*").alias("entries"))
    return one.crossJoin(lost(b).agg(F.count("*").alias("groups"))).crossJoin(c.agg(F.count("*").alias("examples")))  # one row each
