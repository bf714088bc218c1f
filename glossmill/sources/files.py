"""Readers and writers of the lexical formats; all files go through Spark's own sources."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GLOSS = "struct<lang:string,gender:string,type:string,text:string>"
SENTENCE = "struct<lang:string,text:string>"
EXAMPLE = f"struct<source:struct<type:string,value:string>,text:string,sentences:array<{SENTENCE}>>"
SENSE = f"struct<partOfSpeech:array<string>,appliesToKanji:array<string>,appliesToKana:array<string>,related:string,antonym:string,field:array<string>,dialect:array<string>,misc:array<string>,info:array<string>,languageSource:array<struct<lang:string,full:boolean,wasei:boolean,text:string>>,gloss:array<{GLOSS}>,examples:array<{EXAMPLE}>>"
WORD = f"struct<id:string,kanji:array<struct<text:string,common:boolean,tags:array<string>>>,kana:array<struct<text:string,common:boolean,tags:array<string>,appliesToKanji:array<string>>>,sense:array<{SENSE}>>"
LEXICON = f"version string, languages array<string>, dictDate string, commonOnly boolean, tags map<string,string>, words array<{WORD}>"


def read_lexicon_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(words with `ordinal`, one header row) of a lexicon document."""
    doc = spark.read.schema(LEXICON).option("multiLine", True).json(path)
    words = doc.select(F.posexplode("words").alias("ordinal", "w")).select("ordinal", "w.*")
    return words.repartition("id"), doc.drop("words")


def with_ordinal(df: DataFrame) -> DataFrame:
    """`ordinal`, a struct of file, block and place that sorts as the files by name and the lines in them, as long as it is called on the read itself."""
    return df.withColumn("ordinal", F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place")))


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Lines of JSON, plain or gzipped, with `ordinal`; blank lines are skipped, wrongly typed fields null, lines that are no JSON all null."""
    lines = with_ordinal(spark.read.text(path)).where(~F.col("value").rlike(r"^\s*$"))
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"), "ordinal").select("j.*", "ordinal")


def read_keyed_json(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """file, ordinal, key, value of files that are one JSON object each, in file order."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", f"map<string,{value_schema}>").alias("m"))
    return raw.select("file", F.posexplode("m").alias("ordinal", "key", "value"))


def read_level_lists(spark: SparkSession, folder: str) -> DataFrame:
    """entry_id, n of the five lists n1.csv to n5.csv, each a file or a folder of files; rows whose first field is no number are skipped."""
    rows = spark.read.option("header", True).schema("jmdict_seq string, kana string, kanji string, waller_definition string").csv(f"{folder}/n[1-5].csv")
    rows = rows.select("jmdict_seq", F.regexp_extract(F.col("_metadata.file_path"), r"/n(\d)\.csv(/[^/]*)?$", 1).cast("int").alias("n"))
    if rows.select("n").distinct().count() != 5:
        raise ValueError("there must be five level lists")
    return rows.where(F.col("jmdict_seq").rlike(r"^\d+$")).select(F.col("jmdict_seq").alias("entry_id"), "n")


EVIDENCE_INDEX = "source string, sourceEntryId string, headword string, reading string, senses array<struct<evidenceId:string,partOfSpeech:array<string>,glosses:array<struct<lang:string,text:string>>,labels:array<string>,pronunciation:string>>"


def evidence_index_problems(rows: DataFrame) -> DataFrame:
    """problem, file, place, evidence_id of what makes read_evidence_index() fail: malformed rows, senses without an id, and all places of an id that stands there more than once."""
    where = [F.col("ordinal.file").alias("file"), F.col("ordinal.block").alias("block"), F.col("ordinal.place").alias("place")]
    malformed = F.expr("source is null or sourceEntryId is null or headword is null or senses is null")
    bad = rows.where(malformed).select(F.lit("malformed row").alias("problem"), *where, F.lit(None).cast("string").alias("evidence_id"))
    ids = rows.where(~malformed).select(*where, F.explode("senses").alias("s")).select("file", "block", "place", F.col("s.evidenceId").alias("evidence_id"))
    twice = ids.where("evidence_id is not null").groupBy("evidence_id").count().where("count > 1").select("evidence_id")
    repeated = ids.join(twice, "evidence_id", "left_semi").select(F.lit("repeated id").alias("problem"), "file", "block", "place", "evidence_id")
    blank = ids.where("evidence_id is null").select(F.lit("sense without an id").alias("problem"), "file", "block", "place", "evidence_id")
    return bad.unionByName(blank).unionByName(repeated)


def read_evidence_index(spark: SparkSession, paths: list[str]) -> DataFrame:
    """evidence_id, source, headword, reading per sense; malformed rows and repeated ids fail the job, and the error names the first of them."""
    rows = read_jsonl(spark, paths, EVIDENCE_INDEX)
    found = evidence_index_problems(rows).orderBy("file", "block", "place", "evidence_id").limit(5).collect()
    if found:
        raise ValueError("the evidence index has problems: " + "; ".join(f"{r.problem} {r.evidence_id or ''} in {r.file}".replace("  ", " ") for r in found))
    return rows.select("source", F.col("sourceEntryId").alias("source_entry_id"), "headword", "reading", F.explode("senses").alias("s")).select(F.col("s.evidenceId").alias("evidence_id"), "source", "source_entry_id", "headword", "reading")


def write_canonical(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        (df.write.partitionBy("lang") if name.endswith("senses") and "lang" in df.columns else df.write).mode("errorifexists").parquet(f"{folder}/{name}")


def read_canonical(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def snapshot_tables(spark: SparkSession, src: str, dst: str, keep: list[str]) -> None:
    write_canonical(read_canonical(spark, src, keep), dst)


def build_metadata(spark: SparkSession, values: dict[str, object]) -> DataFrame:
    import json

    return spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)) for k, v in sorted(values.items())], "key string, value string")


def file_checksums(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, sha256, bytes of each file, without a file going through the driver.

    Files of up to WHOLE_BYTES are read by Spark as one value; larger ones, which no value can hold, are streamed in blocks by
    the tasks, from a file system that pyarrow knows (file, hdfs, s3, gs)."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").load(path)
    whole = files.where(F.col("length") <= WHOLE_BYTES).select(name.alias("file"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"file": f.path.str.rsplit("/", n=1).str[-1], "sha256": [sha256_in_blocks(p) for p in f.path], "bytes": f.length})

    large = files.where(F.col("length") > WHOLE_BYTES).select("path", "length")
    return whole.unionByName(large.mapInPandas(run, "file string, sha256 string, bytes long"))


#: Bytes of the largest file read as one value, and of a block of a larger one.
WHOLE_BYTES, BLOCK_BYTES = 1 << 30, 16 << 20


def sha256_in_blocks(path: str, block: int = BLOCK_BYTES) -> str:
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    sha = hashlib.sha256()
    with system.open_input_stream(inner, compression=None) as stream:
        while data := stream.read(block):
            sha.update(data)
    return sha.hexdigest()


def verify_checksums(found: DataFrame, pins: DataFrame) -> DataFrame:
    """pins(file, sha256): those that are missing or differ."""
    return pins.join(found.select("file", F.col("sha256").alias("actual")), "file", "left").where(~F.col("sha256").eqNullSafe(F.col("actual")))


def write_evidence(rows: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines whose bytes depend on the rows alone: ordered by range, and within each part."""
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)


def publish_staged(spark: SparkSession, write: Callable[[str], None], check: Callable[[str], None], path: str) -> None:
    """Write beside the target, check, then swap by renaming; whatever fails leaves the old output, or, after a crash between the two
    renames, leaves it beside the target, from where the next call puts it back before it starts."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path
    staged, old, target = hadoop(f"{path}._staged"), hadoop(f"{path}._old"), hadoop(path)
    fs = staged.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def move(a: object, b: object) -> None:
        # a file system may say no by its answer, and moves into a target that is a folder already
        if fs.exists(b) or not fs.rename(a, b):
            raise OSError(f"{a} could not be renamed to {b}")

    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)  # the last swap was over
        else:
            move(old, target)
    fs.delete(staged, True)
    try:
        write(f"{path}._staged")
        check(f"{path}._staged")
    except Exception:
        fs.delete(staged, True)
        raise
    if fs.exists(target):
        move(target, old)
    try:
        move(staged, target)
    except Exception:
        if fs.exists(old) and not fs.exists(target):
            move(old, target)
        raise
    fs.delete(old, True)


def append_attempts(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("dictionary").parquet(path)


ATTEMPT = "traceId string, candidateId string, role string, promptVersion string, model string, reasoningEffort string, provider string, requestedServiceTier string, effectiveServiceTier string, requestId string, durationMs double, inputTokens long, outputTokens long, costUsd double, prompt string, response string, error string, outcome string"


def read_attempts(spark: SparkSession, path: str, dictionary: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if dictionary:
        rows = rows.where(F.col("dictionary") == dictionary)
    return rows.withColumn("attempt", F.from_json("attempt_json", ATTEMPT)).select("*", "attempt.*").drop("attempt", "attempt_json")
