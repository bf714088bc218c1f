"""Queries over files that jobs write and read again by many tasks: archives, one large document, term banks, and releases compared by digests."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import digest as D
from ..operators import evidence as E
from ..operators import stored as ST
from ..sources import archive as Z
from ..sources import banks as B
from ..sources import documents as J
from ..sources.shared import checkpoint, new_folder
from ..streaming import capped as C
from .registry import EVIDENCE, LEMMAS, SENSES, evidence_entries, lexicon, query, read, senses, tokens

#: Bytes of a stretch or a range, so small that the given tables need several.
SMALL = 64 << 10


@query("SELECT doc_id, lang, sha256(text) AS text_sha, n_chars::BIGINT AS n_chars, TRUE AS in_order FROM documents")
def gzip_archive(spark, sf):
    """All documents as gzipped lines of JSON, read back by stretches of 64 KB from a stored index. in_order: places rise with the lines of a file."""
    path = new_folder(spark, "archive")
    d = read(spark, sf, "documents").withColumn("at", F.monotonically_increasing_id())
    d.select("doc_id", "lang", "text", "n_chars", "at").write.json(path, compression="gzip")
    Z.gzip_index(spark, f"{path}/*.gz", SMALL).write.parquet(f"{path}-index")
    rows = Z.read_gzip_jsonl(spark.read.parquet(f"{path}-index"), "doc_id long, lang string, text string, n_chars long, at long")
    before = F.lag("at").over(Window.partitionBy("ordinal.file").orderBy("ordinal.place"))
    return rows.select("doc_id", "lang", F.sha2("text", 256).alias("text_sha"), "n_chars", F.coalesce(before < F.col("at"), F.lit(True)).alias("in_order"))


@query("SELECT 'w' || p_partkey AS id, p_name AS kana, p_type AS gloss, '1' AS version, TRUE AS in_order FROM part")
def large_lexicon(spark, sf):
    """The parts as words of large lexicon documents, one for each partition, read back by ranges of 64 KB."""
    path = new_folder(spark, "large")

    def document(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ['{"version": "1", "tags": {"n": "a \\" [ {"}, "words": [']})
        mark = ""
        for f in frames:
            yield pd.DataFrame({"value": [mark * (k == 0) + ("," if k else "") + v for k, v in enumerate(f.value)]})
            mark = "," if mark or len(f) else ""
        yield pd.DataFrame({"value": ["]}"]})

    gloss = F.struct(F.lit("eng").alias("lang"), F.col("p_type").alias("text"))
    word = F.struct(F.concat(F.lit("w"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.struct(F.col("p_name").alias("text"), F.lit(True).alias("common"))).alias("kana"), F.array(F.struct(F.array(gloss).alias("gloss"))).alias("sense"))
    read(spark, sf, "part").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").select(F.to_json(word).alias("value")).mapInPandas(document, "value string").write.text(path)
    words, header = J.read_large_lexicon(spark, f"{path}/part-*", SMALL)
    w = Window.partitionBy("file").orderBy("ordinal")
    number = F.substring("id", 2, 20).cast("long")
    good = (F.row_number().over(w) - 1 == F.col("ordinal")) & F.coalesce(F.lag(number).over(w) < number, F.lit(True))
    return words.join(header.select("file", "version"), "file").select("id", F.col("kana")[0]["text"].alias("kana"), F.col("sense")[0]["gloss"][0]["text"].alias("gloss"), "version", good.alias("in_order"))


@query(f"WITH {SENSES}, n AS (SELECT *, row_number() OVER (ORDER BY entry_id, sense_id) - 1 AS r, dense_rank() OVER (ORDER BY entry_id) AS q FROM senses) SELECT (1 + r // 1000)::BIGINT AS bank, r % 1000 AS place, 's' || sense_id || '\"' AS text, lang AS tags, (sense_id % 7)::BIGINT AS score, '[\"' || provenance || '\",\"é\"]' AS glossary, q::BIGINT AS sequence FROM n")
def term_bank_files(spark, sf):
    """Senses written as term banks of 1000 rows, whose files are read back: what bank a row is in, and where."""
    path = new_folder(spark, "banks")
    s = senses(spark, sf).withColumn("text", F.concat(F.lit("s"), F.col("sense_id").cast("string"), F.lit('"')))
    value = B.term_value(F.col("text"), F.lit(""), F.col("lang"), F.lit(""), F.col("sense_id") % 7, F.array("provenance", F.lit("é")), F.col("sequence"))
    B.write_term_banks(B.bank_rows(s, ["entry_id"], ["sense_id"], value, 1000), path, {"title": "senses"}, 1000)
    files = spark.read.text(f"{path}/term_bank_*.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"term_bank_(\d+)\.json", 1).cast("long").alias("bank"), F.from_json("value", "array<array<string>>").alias("rows"))
    rows = files.select("bank", F.posexplode("rows").alias("place", "r"))
    r = F.col("r")
    return rows.select("bank", F.col("place").cast("long").alias("place"), r[0].alias("text"), r[2].alias("tags"), r[4].cast("long").alias("score"), r[5].alias("glossary"), r[6].cast("long").alias("sequence"))


@query(f"WITH {SENSES} SELECT sense_id, change, true AS same_root FROM (SELECT sense_id, CASE WHEN sense_id % 101 = 0 THEN 'removed' WHEN sense_id % 97 = 0 THEN 'changed' END AS change FROM senses WHERE sense_id <> 0 UNION ALL SELECT -sense_id, 'added' FROM senses WHERE sense_id % 103 = 0 AND sense_id <> 0) WHERE change IS NOT NULL")
def release_changes(spark, sf):
    """Two releases of senses compared by their digest trees; same_root: another layout of the old one has the same root."""
    old = checkpoint(senses(spark, sf))  # read five times
    new = old.where("sense_id % 101 <> 0").withColumn("provenance", F.when(F.col("sense_id") % 97 == 0, "changed").otherwise(F.col("provenance")))
    new = new.unionByName(old.where("sense_id % 103 = 0").withColumn("sense_id", -F.col("sense_id")))
    trees = [D.merkle_tree(x, ["sense_id"]) for x in (old, new, old.repartition("sense_id").select(*sorted(old.columns, reverse=True)))]
    same = D.root(trees[0]) == D.root(trees[2]) and D.root(trees[0]) != D.root(trees[1])
    return D.changed_rows(old, new, ["sense_id"], D.changed_chunks(*trees[:2])).withColumn("same_root", F.lit(same))


@query(f"WITH {SENSES} SELECT 4 AS levels, count(*) AS rows, true AS verified, 'senses' AS title FROM senses")
def evidence_manifest(spark, sf):
    """Rows written with a manifest that holds their digest; what is read back has it too."""
    path, s = new_folder(spark, "evidence"), senses(spark, sf)
    s.write.parquet(path)
    tree = D.merkle_tree(s, ["sense_id"])
    top = tree.where(F.col("level") == D.LEVELS).select("level", "rows", "digest").first()  # one row
    manifest = spark.createDataFrame([(json.dumps({"title": "senses", "levels": top["level"], "rows": top["rows"], "digest": top["digest"]}),)], "value string")
    manifest.write.text(f"{path}-manifest")
    back = D.root(D.merkle_tree(spark.read.parquet(path), ["sense_id"]))
    m = spark.read.text(f"{path}-manifest").select(F.from_json("value", "title string, levels int, rows long, digest string").alias("m")).select("m.*")
    return m.select("levels", "rows", (F.col("digest") == back).alias("verified"), "title")


@query(f"WITH {EVIDENCE}, good AS (SELECT ordinal, word, term, lang, scope, ambiguity::INT AS ambiguity, row_number() OVER (ORDER BY ordinal) AS n FROM rej WHERE rejection IS NULL) SELECT word, term, lang, scope, ambiguity, count(*) AS n FROM good WHERE n <= (SELECT count(*) // 2 FROM good) GROUP BY ALL")
def stream_capped_evidence(spark, sf):
    """The evidence filter as a stream over ordered files of the dump, under a cap of half of all good rows."""
    path = new_folder(spark, "capped")
    entries = evidence_entries(spark, sf, dealt=True)
    entries.repartitionByRange(4, "ordinal").sortWithinPartitions("ordinal").drop("ordinal").write.json(f"{path}/in")
    good = E.evidence_rows(entries, "wiktionary", "en", "v1").where("rejection is null")
    query_ = C.stream_capped(C.read_entries(spark, f"{path}/in", 1000), f"{path}/out", "wiktionary", "en", "v1", total=good.count() // 2)
    query_.awaitTermination()
    return spark.read.parquet(f"{path}/out/rows").groupBy("word", "term", "lang", "scope", F.size("ambiguity").alias("ambiguity")).agg(F.count("*").alias("n"))


@query(f"WITH {LEMMAS} SELECT surface AS query, lemma, 'e_' || lemma AS entry_id FROM lemmas WHERE length(lemma) % 3 <> 0")
def lookup_stored(spark, sf):
    """All words of the documents, looked up in a stored index of buckets."""
    terms = lexicon(spark, sf).select("term", F.concat(F.lit("e_"), "term").alias("entry_id"), F.array(F.when(F.length("term") % 3 == 0, "ja").otherwise("en")).alias("langs"))
    index = ST.store_index(terms, f"terms_{uuid.uuid4().hex}", new_folder(spark, "index"), 8)
    return ST.lookup_stored(tokens(spark, sf).withColumnRenamed("surface", "query"), index, "en")


@query(f"WITH {SENSES} SELECT sense_id, CASE WHEN sense_id % 997 = 0 THEN 'generated' ELSE provenance END AS provenance, true AS few_written FROM senses WHERE sense_id % 1009 <> 0")
def release_in_buckets(spark, sf):
    """A release in buckets of entries, brought to the state of the next one: what it holds then; few_written: the first step wrote nothing, the second not more buckets than it had to."""
    path, s = new_folder(spark, "release"), senses(spark, sf)
    ST.store_buckets(s, ["entry_id"], path)
    still = ST.update_buckets(s.repartition(3), ["entry_id"], path)
    new = s.where("sense_id % 1009 <> 0").withColumn("provenance", F.when(F.col("sense_id") % 997 == 0, "generated").otherwise(F.col("provenance")))
    touched = ST.in_buckets(s.where("sense_id % 1009 = 0 or (sense_id % 997 = 0 and provenance <> 'generated')"), ["entry_id"], ST.BUCKETS).select("bucket").distinct().count()
    written = ST.update_buckets(new, ["entry_id"], path)
    return spark.read.parquet(path).select("sense_id", "provenance", F.lit(not still and len(written) == touched).alias("few_written"))
