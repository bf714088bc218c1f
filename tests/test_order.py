"""Global numbers over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from glossmill.operators import order as O

rng = random.Random(2)


@pytest.mark.parametrize("range_rows", [3, 1000])
def test_numbers_over_many_ranges_and_hot_first_keys(spark, range_rows):
    rows = [("hot" if k % 3 else rng.choice(["a", "z", None, ""]), k, rng.randint(0, 5)) for k in range(3000)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "a string, b long, n long").repartition(5)
    got = {r.b: (r.place, r.weight) for r in O.global_numbers(d, ["a", "b"], {"place": F.lit(1), "weight": F.col("n")}, range_rows).collect()}
    at = weight = 0
    for a, b, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        assert got[b] == (at, weight)
        at, weight = at + 1, weight + n


def test_ranges_are_even_and_found_by_halves(spark):
    d = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k"), (F.col("id") % 2).alias("x"))
    for ranges in (8, 300):
        bounds = O.range_bounds(d, ["x", "k"], ranges)
        both = d.crossJoin(F.broadcast(bounds)).select(O.range_of(F.col("_bounds"), F.struct("x", "k"), ranges).alias("r"), F.size(F.filter("_bounds", lambda b: b <= F.struct("x", "k"))).alias("plain"))
        assert not both.where("r <> plain").count()
        sizes = [r["count"] for r in both.groupBy("r").count().collect()]
        assert len(sizes) == ranges and max(sizes) < 3 * 20_000 / ranges
    assert O.global_numbers(d.limit(0), ["x", "k"], {"n": F.lit(1)}).count() == 0
