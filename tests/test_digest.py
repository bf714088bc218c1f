"""Digest trees: equal for any layout, different for any change, and changes found through them."""

import random

from pyspark.sql import functions as F

from glossmill.operators import digest as D

rng = random.Random(8)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, lang string, text string")


def test_layout_is_no_matter_and_each_change_is_found(spark):
    rows = [(rng.randint(0, 300), rng.choice(["en", "ja", None]), rng.choice(["a", "b", None, ""])) for _ in range(600)] + [(7, "en", "x")] * 50
    new = list(rows)
    rng.shuffle(new)
    a, b = frame(spark, rows).repartition(3), frame(spark, new).repartition(7).select("text", "lang", "id")
    ta, tb = D.merkle_tree(a, ["id"]), D.merkle_tree(b, ["id"])
    assert D.root(ta) == D.root(tb) and not D.changed_chunks(ta, tb).count()
    assert sorted(map(tuple, ta.collect())) == sorted(map(tuple, tb.collect()))
    assert ta.where("level = 4").select("node", "rows").collect()[0] == (0, 650)
    for change in (lambda r: r[1:], lambda r: [*r, r[5]], lambda r: [(r[0][0], r[0][1], "new"), *r[1:]], lambda r: [*r, (1000, None, None)], lambda r: [x for x in r if x != (7, "en", "x")], lambda r: []):
        other = change(new)
        c = frame(spark, other)
        tc = D.merkle_tree(c, ["id"])
        chunks = D.changed_chunks(ta, tc)
        got = {tuple(r) for r in D.changed_rows(a, c, ["id"], chunks).collect()}
        count = lambda x: {k: sorted(map(repr, (r for r in x if r[0] == k))) for k in {r[0] for r in x}}
        one, two = count(rows), count(other)
        want = {(k, "added" if k not in one else "removed" if k not in two else "changed") for k in one.keys() | two.keys() if one.get(k) != two.get(k)}
        assert got == want and D.root(tc) != D.root(ta)
        assert chunks.count() <= len(want)
    assert D.root(D.merkle_tree(a.limit(0), ["id"])) == ""


def test_several_keys_and_names(spark):
    a = spark.range(100).select("id", (F.col("id") % 3).alias("lang"), F.lit(1).alias("node"))
    b = a.withColumn("node", F.when(F.col("id") == 50, 2).otherwise(F.col("node")))
    trees = [D.merkle_tree(x, ["id", "lang"], 2) for x in (a, b)]
    assert [tuple(r) for r in D.changed_rows(a.withColumnRenamed("node", "n"), b.withColumnRenamed("node", "n"), ["id", "lang"], D.changed_chunks(*trees, levels=2), 2).collect()] == [(50, 2, "changed")]


def test_rows_are_compared_in_as_many_tasks_as_they_need(spark, monkeypatch):
    monkeypatch.setattr(D, "TASK_ROWS", 500, raising=False)
    old = spark.range(3000).select((F.col("id") % 2900).alias("id"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    # of repeated keys one row is another, of one key the same rows another number of times
    new = old.where("id <> 7").withColumn("v", F.when(F.col("v") == "v2905", "x").otherwise(F.col("v"))).unionByName(old.where("v = 'v2910'"))
    chunks = D.changed_chunks(D.merkle_tree(old, ["id"], 2), D.merkle_tree(new, ["id"], 2), 2)
    everything = spark.range(256).select(F.col("id").alias("node"), F.lit(24).alias("rows"))
    for given in (chunks, everything):
        out = D.changed_rows(old, new, ["id"], given, 2)
        assert {r.id: r.change for r in out.collect()} == {7: "removed", 5: "changed", 10: "changed"}
    assert {r.node: r.rows for r in chunks.collect()}.keys() <= set(range(256)) and out.rdd.getNumPartitions() == 13  # those of the session, before
