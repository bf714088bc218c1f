"""The evidence filter and the attempt summary as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.evidence import ENTRY_SCHEMA, stateless_rows


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(ENTRY_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def count_occurrences(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Numbers the records of one word, part of speech and etymology across micro-batches; the state is one counter."""
    n = state.get[0] if state.exists else 0
    for f in frames:
        yield pd.DataFrame({"record": f["record"], "occurrence": range(n, n + len(f))})
        n += len(f)
    state.update((n,))


def stream_evidence(entries: DataFrame, source: str, edition: str, version: str) -> DataFrame:
    """Rows as in the batch filter before corroboration and caps, emitted while the dump is still read."""
    english = entries.where((F.col("lang_code") == "en") & F.coalesce(F.col("word") != "", F.lit(False)))
    english = english.withColumn("pos", F.coalesce(X.nonempty(F.col("pos")), F.lit("unknown"))).withColumn("etymology", F.coalesce("etymology_number", F.lit(0)))
    keyed = english.select(F.concat_ws("|", "word", "pos", F.col("etymology").cast("string")).alias("key"), F.to_json(F.struct("*")).alias("record"))
    numbered = keyed.groupBy("key").applyInPandasWithState(count_occurrences, "record string, occurrence int", "n int", "append", "NoTimeout")
    schema = ENTRY_SCHEMA + ", etymology int"
    back = numbered.select(F.from_json("record", schema).alias("e"), "occurrence").select("e.*", "occurrence", F.lit(0).cast("long").alias("ordinal"))
    return stateless_rows(back, source, edition, version)


def stream_attempts(attempts: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """attempts(ts, dictionary, outcome, cost): counts and cost per day, dictionary and outcome; rows later than `late` are dropped."""
    return attempts.withWatermark("ts", late).groupBy(F.window("ts", window), "dictionary", "outcome").agg(F.count("*").alias("attempts"), F.sum("cost").alias("cost"))
