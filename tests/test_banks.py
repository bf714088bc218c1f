"""Term banks: whole files, exact sizes, order, and nothing left behind."""

import json

import pytest
from pyspark.sql import functions as F

from glossmill.sources import banks as B


def rows(spark, n):
    """Entries of 1 to 4 rows each."""
    d = spark.range(n).select(F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("entry"), F.explode(F.sequence(F.lit(0), (F.col("id") % 4).cast("int"))).alias("no"))
    return d.withColumn("text", F.concat("entry", F.lit('"\\é')))


def banked(d, size):
    value = B.term_value(F.col("text"), F.lit(None).cast("string"), F.lit("n"), F.lit(""), F.col("no"), F.array("text", F.lit("g")), F.col("sequence"))
    return B.bank_rows(d, ["entry"], ["no"], value, size)


@pytest.mark.parametrize("n,size", [(0, 10), (4, 10), (40, 10), (403, 64)])
def test_banks_are_full_and_in_order(spark, tmp_path, n, size):
    path = str(tmp_path / "banks")
    B.write_term_banks(banked(rows(spark, n).repartition(5), size), path, {"title": "é"}, size, tasks=3)
    want = [[f'e{e:05d}"\\é', "", "n", "", k, [f'e{e:05d}"\\é', "g"], e + 1, ""] for e in range(n) for k in range(e % 4 + 1)]
    files = sorted(p.name for p in (tmp_path / "banks").iterdir())
    count = -(-len(want) // size)
    assert files == sorted(["index.json", *(f"term_bank_{k}.json" for k in range(1, count + 1))])
    got = [json.loads((tmp_path / "banks" / f"term_bank_{k}.json").read_text()) for k in range(1, count + 1)]
    assert [len(b) for b in got[:-1]] == [size] * (count - 1) and [r for b in got for r in b] == want
    assert json.loads((tmp_path / "banks" / "index.json").read_text()) == {"title": "é"}


def test_a_failing_task_leaves_no_files(spark, tmp_path):
    path = tmp_path / "banks"
    bad = banked(rows(spark, 60), 10).withColumn("value", F.when(F.col("bank") == 7, F.raise_error(F.lit("no"))).otherwise(F.col("value")))
    with pytest.raises(Exception, match="no"):
        B.write_term_banks(bad, str(path), size=10, tasks=4)
    assert not path.exists() or not [p for p in path.iterdir() if p.name.startswith("term_bank")]
    gap = banked(rows(spark, 60), 10).where("bank <> 3")
    with pytest.raises(Exception, match="follow on"):
        B.write_term_banks(gap, str(path), size=10, tasks=4)
    assert not path.exists() or not list(path.iterdir())
