"""The evidence filter as a stream with both caps: rows as the batch filter gives them over the same files, however these are cut into batches.

A stateful operator counts the records of a word, part of speech and etymology, in the order of their files: it sees no records, only how many of a key there
are in each file, and tells at which number each file begins. A counter for each key is held in RocksDB, and dropped by an event-time timer when no
record came for `keep` (the event time is the file's; a key that comes again later starts anew, so `keep` should cover a dump). The records pass beside it. Each
batch is stored, so that the operators run once; records are then numbered within the block of their file, behind those of blocks and files before. So a key that very many
records share is no more work for one task than a block holds. The caps follow for each batch: those of an entry within its own rows, and that over all by the batch operator,
less what earlier batches have emitted. Rows and that number are written in folders named by the batch, so a batch that runs again writes the same.

Batches must bring files in the order of their names, as a folder does whose files are written one after the other; files whose time is more than
`late` behind the latest are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..operators.evidence import ENTRY_SCHEMA, corroborate, stateless_rows
from ..operators.order import global_cap
from ..sources.shared import checkpoint, new_folder

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PLACE = ["file", "block", "place"]
#: Records whose translations a task reads.
TASK_RECORDS = 20_000
COUNTED = "key string, file string, ts timestamp, n long"
FIRST = T.StructType([T.StructField("key", T.StringType()), T.StructField("file", T.StringType()), T.StructField("first", T.LongType())])


class Occurrences(StatefulProcessor):
    """Tells how many records of a key there are before each file, and forgets the key `keep` after its last one."""

    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows))
        counts = every.groupby("file").n.sum().sort_index()
        n = self.seen.get()[0] if self.seen.exists() else 0
        self.seen.update((n + int(counts.sum()),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(every["ts"].max().timestamp() * 1000) + self.keep_ms)
        yield pd.DataFrame({"key": key[0], "file": counts.index, "first": n + counts.cumsum().to_numpy() - counts.to_numpy()})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        yield pd.DataFrame({f.name: pd.Series(dtype=int if f.name == "first" else object) for f in FIRST.fields})

    def close(self) -> None:
        pass


def read_entries(spark: SparkSession, folder: str, files_per_batch: int) -> DataFrame:
    """Entries with the file, and its block and time, that each comes from."""
    raw = spark.readStream.schema(ENTRY_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)
    return raw.withColumn("file", F.col("_metadata.file_name")).withColumn("block", F.col("_metadata.file_block_start")).withColumn("ts", F.col("_metadata.file_modification_time"))


def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each key is in a part of a file."""
    for b in batches:
        t = pa.Table.from_batches([b]).group_by(["key", "file", "ts"]).aggregate([([], "count_all")])
        yield from t.rename_columns([*t.column_names[:-1], "n"]).select(["key", "file", "ts", "n"]).to_batches()


def keyed_records(entries: DataFrame, keep_ms: int, late: str) -> DataFrame:
    """The records of English entries with their key, file and block, and rows without a record that say at which number the records of a key begin in a file (`first`)."""
    english = entries.where(F.coalesce((F.col("lang_code") == "en") & (F.col("word") != ""), F.lit(False)))
    named = english.withColumn("pos", F.coalesce(X.nonempty(F.col("pos")), F.lit("unknown"))).withColumn("etymology", F.coalesce("etymology_number", F.lit(0)))
    named = named.withColumn("key", F.concat_ws("|", "word", "pos", F.col("etymology").cast("string")))
    keys = named.select("key", "file", "ts").mapInArrow(counted, COUNTED).withWatermark("ts", late)
    firsts = keys.groupBy("key").transformWithStateInPandas(statefulProcessor=Occurrences(keep_ms), outputStructType=FIRST, outputMode="Append", timeMode="EventTime")
    return named.select("key", "file", "block", "word", "pos", "etymology", "pageid", "page_id", "senses", "translations").unionByName(firsts, allowMissingColumns=True)


def numbered_rows(stored: DataFrame, source: str, edition: str, version: str) -> DataFrame:
    """stored: `keyed_records` of a batch with `place` -> evidence rows before corroboration and caps, with `ordinal` (file, block, place). Records of files that came too late have no number, and go."""
    records, block = stored.where("first is null"), ["key", "file", "block"]
    ahead = Window.partitionBy("key", "file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    before = records.groupBy(*block).agg(F.count("*").alias("n")).select(*block, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    starts = before.join(stored.where("first is not null").select("key", "file", "first"), ["key", "file"]).select(*block, (F.col("first") + F.col("before")).alias("start"))
    own = F.row_number().over(Window.partitionBy(*block).orderBy("place")) - 1
    numbered = records.drop("first").withColumn("_own", own).join(starts, block)
    numbered = numbered.select("*", F.struct(*PLACE).alias("ordinal"), (F.col("start") + F.col("_own")).cast("int").alias("occurrence"))
    return stateless_rows(numbered.repartition(max(1, -(-records.count() // TASK_RECORDS)), "ordinal"), source, edition, version)


def stream_capped(entries: DataFrame, out: str, source: str, edition: str, version: str, japanese: DataFrame | None = None, taiwan: DataFrame | None = None, per_entry: int = 24, total: int = 500_000, keep_days: int = 365, late: str = "30 days") -> StreamingQuery:
    """Starts the stream over what is there and gives the query. Kept rows are in `<out>/rows`, the numbers per batch in `<out>/emitted`."""
    spark = entries.sparkSession
    place = [F.col(f"ordinal.{c}").alias(c) for c in PLACE]
    order = Window.partitionBy("ordinal").orderBy(F.when(F.col("scope") == "sense-local", 0).otherwise(1), F.when(F.col("scope") == "sense-local", F.col("sense_index")), "place")

    def emit(batch: DataFrame, number: int) -> None:
        ledger = spark.createDataFrame([], "n long, batch long")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/emitted")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            ledger = spark.read.schema("n long, batch long").parquet(f"{out}/emitted")
        work = new_folder(spark, "batch")
        batch.withColumn("place", F.monotonically_increasing_id()).write.parquet(f"{work}/records")  # the only run of the stream's operators in this batch
        before = ledger.where(F.col("batch") < number).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number
        found = numbered_rows(spark.read.parquet(f"{work}/records"), source, edition, version)
        corroborate(found, japanese, taiwan).where("rejection is null").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_entry).write.parquet(f"{work}/good")
        good = spark.read.parquet(f"{work}/good")
        counts = checkpoint(good.groupBy("ordinal").agg(F.count("*").alias("n_rows")).select(*place, "ordinal", "n_rows"))
        kept = good.join(global_cap(counts, PLACE, max(0, total - before)).select("ordinal", "kept_rows"), "ordinal").where(F.col("_n") <= F.col("kept_rows")).drop("_n", "kept_rows")
        rows = f"{out}/rows/batch={number}"
        kept.write.mode("overwrite").parquet(rows)
        n = spark.read.parquet(rows).count()
        spark.createDataFrame([(n,)], "n long").coalesce(1).write.mode("overwrite").parquet(f"{out}/emitted/batch={number}")
        done = spark._jvm.org.apache.hadoop.fs.Path(work)
        done.getFileSystem(spark._jsc.hadoopConfiguration()).delete(done, True)

    keyed = keyed_records(entries, keep_days * 86_400_000, late)
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)  # the query takes it along when it starts
    try:
        return keyed.writeStream.foreachBatch(emit).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, was)
