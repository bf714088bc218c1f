"""Stored tables in buckets: a lookup index that batch lookups join without moving it, and releases of which only changed buckets are written again.

The index is written once. A large batch of queries is dealt to the index's own buckets and meets them there, so only the queries are
shuffled, whatever the size of the index; of a small batch the terms are named in the filter, by which Spark reads the buckets they can be in,
and Parquet the row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import checkpoint
from .digest import digest_sums, row_digest

BUCKETS = 64
#: Terms up to which a batch is named in the filter.
FEW_TERMS = 1000


def store_index(terms: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """terms: term, entry_id, langs (of the entry's senses) and what else there is. Writes table `name` at a new path; one file for each bucket."""
    # dealt as bucketBy deals, so that each task writes one bucket
    writer = terms.where("term is not null").repartition(buckets, "term").write.format("parquet").mode("errorifexists").option("path", path).option("parquet.bloom.filter.enabled#term", "true")
    writer.bucketBy(buckets, "term").sortBy("term").saveAsTable(name)
    return terms.sparkSession.table(name)


def open_index(spark: SparkSession, name: str, path: str, schema: str, buckets: int = BUCKETS) -> DataFrame:
    """An index that another session has stored."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY (term) SORTED BY (term) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def reached(asked: DataFrame, index: DataFrame, few: int = FEW_TERMS) -> DataFrame:
    """asked(term, ...) joined with the index on `term`. Up to few + 1 terms reach the driver."""
    named = [r.term for r in asked.select("term").distinct().limit(few + 1).collect()]
    if len(named) <= few:
        return F.broadcast(asked).join(index.where(F.col("term").isin(named)), "term")
    # not by broadcast, and in the index's buckets: the merge hint keeps the index where it lies
    return asked.hint("merge").join(index, "term")


def lookup_stored(queries: DataFrame, index: DataFrame, lang: str, few: int = FEW_TERMS) -> DataFrame:
    """queries(query) -> query, lemma, entry_id as lookup.lookup_english() gives them, from an index with `langs`."""
    tried = queries.select("query").distinct().select("query", F.posexplode(F.concat(F.array("query"), X.english_lemma_candidates(F.col("query")))).alias("rank", "term"))
    lemmas = reached(tried, index.select("term"), few).groupBy("query").agg(F.min_by("term", "rank").alias("term"))
    entries = index.where(F.array_contains("langs", lang)).select("term", "entry_id")
    return reached(lemmas, entries, few).select("query", F.col("term").alias("lemma"), "entry_id")


# --- tables in buckets, of which only those that changed are written again -----------------------


def in_buckets(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def store_buckets(df: DataFrame, keys: list[str], path: str, buckets: int = BUCKETS) -> None:
    """A new folder with one sub-folder for each bucket of the keys."""
    in_buckets(df, keys, buckets).repartition(buckets, "bucket").write.mode("errorifexists").partitionBy("bucket").parquet(path)


def bucket_sums(df: DataFrame) -> DataFrame:
    """Of rows with `bucket`: their number and the sums of their digests."""
    rows = df.select("bucket", row_digest(df, ("bucket",)).alias("d"))
    return rows.groupBy("bucket").agg(F.struct(F.count("*"), *digest_sums(F.col("d"))).alias("sums"))


def update_buckets(new: DataFrame, keys: list[str], path: str, buckets: int = BUCKETS) -> list[int]:
    """Makes a folder of store_buckets() hold the rows of `new`, which may be made from it: buckets whose rows differ are written again, others keep
    their files. Gives the buckets that changed; their numbers, `buckets` at most, reach the driver.

    Rows are put aside in the shared folder before a bucket is replaced. Should the job stop while folders are replaced, running it again with the same rows ends it."""
    spark = new.sparkSession
    old = spark.read.parquet(path)
    given = in_buckets(new.select(*[c for c in old.columns if c != "bucket"]), keys, buckets)
    one, other = bucket_sums(old).withColumnRenamed("sums", "one"), bucket_sums(given).withColumnRenamed("sums", "other")
    differ = one.join(other, "bucket", "full").where(~F.col("one").eqNullSafe(F.col("other"))).select("bucket", F.col("other").isNull().alias("gone")).collect()
    if not differ:
        return []
    rows = checkpoint(given.where(F.col("bucket").isin([r.bucket for r in differ])))
    rows.repartition(len(differ), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for r in differ:
        if r.gone:
            folder = hadoop(f"{path}/bucket={r.bucket}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(r.bucket for r in differ)
