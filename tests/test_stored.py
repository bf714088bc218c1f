"""The stored index: equal answers, and plans that don't move it."""

import uuid

from pyspark.sql import functions as F

from glossmill.operators import lookup as L
from glossmill.operators import stored as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_of_any_size_equal_the_plain_lookup(spark, tmp_path):
    words = spark.range(3000).select(F.concat(F.lit("word"), F.col("id").cast("string")).alias("term"))
    words = words.unionByName(spark.createDataFrame([("walk",), ("bus",), ("study",)], "term string"))
    terms = words.withColumn("entry_id", F.concat(F.lit("e_"), "term")).withColumn("langs", F.when(F.length("term") % 2 == 0, F.array(F.lit("en"))).otherwise(F.array(F.lit("ja"), F.lit("en"))))
    more = terms.where("term like 'word1%'").withColumn("entry_id", F.concat("entry_id", F.lit("_2"))).withColumn("langs", F.array(F.lit("ja")))
    terms = terms.unionByName(more)
    name, path = f"terms_{uuid.uuid4().hex}", str(tmp_path / "index")
    index = S.store_index(terms, name, path, 8)
    queries = words.select(F.concat("term", F.when(F.length("term") % 3 == 0, "s").otherwise("")).alias("query")).unionByName(spark.createDataFrame([("walking",), ("buses",), ("studies",), ("none",), (None,), ("walking",)], "query string"))
    senses = terms.select("entry_id", F.explode("langs").alias("lang"))
    for lang in ("en", "ja"):
        want = sorted(map(tuple, L.lookup_english(queries, terms, senses, lang).collect()))
        assert sorted(map(tuple, S.lookup_stored(queries, index, lang).collect())) == want
        few = queries.where("query like 'word2%1s' or query like 'walk%'")
        names = {x.query for x in few.collect()}
        assert sorted(map(tuple, S.lookup_stored(few, index, lang).collect())) == [r for r in want if r[0] in names]
    again = S.open_index(spark, name + "_b", path, "term string, entry_id string, langs array<string>", 8)
    assert again.count() == index.count()
    # few terms: only their buckets are read, by a filter that reaches the files
    some = spark.createDataFrame([("walk",), ("bus",)], "term string")
    text = plan(S.reached(some, index))
    assert "PushedFilters: [In(term" in text and "SelectedBucketsCount: 8 out of 8" not in text and "Exchange hashpartitioning" not in text
    # many: the queries are dealt to the buckets, the index is not
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(S.reached(queries.select(F.col("query").alias("term")), index, few=10))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    left, right = text.split("FileScan parquet spark_catalog")[0], text.split("SortMergeJoin")[1]
    assert "SortMergeJoin" in text and text.count("Exchange hashpartitioning(term") == 1 and "Bucketed: true" in right and left


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.range(400).select("id", (F.col("id") % 3).cast("string").alias("text"))
    S.store_buckets(rows, ["id"], path, 16)
    files = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in tmp_path.glob("table/bucket=*/*.parquet")}
    of = {r.id: r.bucket for r in S.in_buckets(rows, ["id"], 16).collect()}
    first = files()
    assert S.update_buckets(rows.repartition(3), ["id"], path, 16) == [] and files() == first
    # one row changed, one gone, one doubled, one new; made from the table itself
    now = spark.read.parquet(path).drop("bucket")
    new = now.where("id <> 7").withColumn("text", F.when(F.col("id") == 5, "new").otherwise(F.col("text"))).unionByName(now.where("id = 9")).unionByName(spark.createDataFrame([(1000, None)], "id long, text string"))
    want = sorted(map(repr, map(tuple, new.collect())))
    added = S.in_buckets(spark.createDataFrame([(1000,)], "id long"), ["id"], 16).first().bucket
    assert S.update_buckets(new, ["id"], path, 16) == sorted({of[5], of[7], of[9], added})
    second = files()
    assert sorted(map(repr, map(tuple, spark.read.parquet(path).select("id", "text").collect()))) == want
    same = {f for f in first if int(f.split("bucket=")[1].split("/")[0]) not in {of[5], of[7], of[9], added}}
    assert len(same) >= 12 and all(second.get(f) == first[f] for f in same)
    # a bucket that loses all its rows loses its folder
    left = spark.read.parquet(path).where(F.col("bucket") != of[5]).drop("bucket")
    assert S.update_buckets(left, ["id"], path, 16) == [of[5]] and not (tmp_path / f"table/bucket={of[5]}").exists()
