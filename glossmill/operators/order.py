"""Order without a single-task window: ordinals, first-wins, positions, caps and bank numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows sampled to find range bounds, at least and for each range.
SAMPLE, OVERSAMPLE = 4096, 64


def first_wins(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """Of the rows of a key the first in order, as an insert that ignores what is there."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def positions(df: DataFrame, keys: list[str], *order: str | Column, name: str = "position") -> DataFrame:
    """1-based places within a key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def record_occurrence(df: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """`occurrence` (from 0) of the records of one id, and `record_id`, suffixed from the second on."""
    out = positions(df, [key], *order, name="_n")
    return out.withColumn("occurrence", F.col("_n") - 1).withColumn("record_id", F.when(F.col("_n") > 1, F.concat_ws(":", F.col(key), F.col("_n").cast("string"))).otherwise(F.col(key))).drop("_n")


def cap_per_key(df: DataFrame, keys: list[str], n: int, *order: str | Column) -> DataFrame:
    return positions(df, keys, *order, name="_n").where(F.col("_n") <= n).drop("_n")


def append_position(new: DataFrame, old: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """`position` of new rows behind the largest one that their key has."""
    last = old.groupBy(key).agg(F.max("position").alias("_last"))
    return positions(new, [key], *order, name="_n").join(last, key, "left").withColumn("position", F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_n", "_last")


def range_bounds(df: DataFrame, order: list[str], ranges: int) -> DataFrame:
    """One row with `_bounds`, the sorted lower bounds of up to `ranges` ranges of about equal size (all but the first range's), from a sample of rows.

    The sample is the rows of least hash of their key, OVERSAMPLE for each range and SAMPLE at least, found in one pass with a bounded heap in each task. With
    k sampled rows for each range, the share of a range strays by about a part in the root of k."""
    key = F.struct(*order)
    some = df.select(*order).where(F.coalesce(*(F.col(c).isNotNull() for c in order))).orderBy(F.xxhash64(*order)).limit(max(SAMPLE, OVERSAMPLE * ranges)).select(key.alias("k"))
    # the sample is cut into ranges where it lies, so that only the bounds, fewer than `ranges`, travel
    bounds = some.withColumn("r", F.ntile(ranges).over(Window.orderBy("k"))).groupBy("r").agg(F.min("k").alias("k")).where("r > 1")
    return bounds.agg(F.array_sort(F.array_distinct(F.collect_list("k"))).alias("_bounds"))


def range_of(bounds: Column, key: Column, ranges: int) -> Column:
    """How many bounds are at most the key, by halving steps: as many comparisons as the number of ranges has bits."""
    steps = F.array(*(F.lit(1 << k) for k in range(max(1, ranges.bit_length()) - 1, -1, -1)))
    ahead = lambda at, step: (at + step <= F.size(bounds)) & (F.try_element_at(bounds, at + step) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(ahead(at, step), at + step).otherwise(at))


def global_numbers(df: DataFrame, order: list[str], amounts: dict[str, Column], range_rows: int = 500_000) -> DataFrame:
    """For each name the sum of its amount over all rows before a row, in a total order.

    Rows are dealt by ranges of the whole key, one for each `range_rows` rows, however many there are; within a range a window counts, and the
    sums of the ranges before it, one row per range, are added. So no task sees all rows, and a frequent first
    key is split by the others. `order` should tell rows apart. The input is read for its number, the sample, the sums and the windows; store it first if it is dear."""
    ranges = max(8, df.count() // range_rows)
    bounds = F.broadcast(range_bounds(df, order, ranges))  # one row, a key for each range
    dealt = df.crossJoin(bounds).withColumn("_range", range_of(F.col("_bounds"), F.struct(*order), ranges)).drop("_bounds")
    sums = dealt.groupBy("_range").agg(*(F.sum(c).alias(f"_sum_{n}") for n, c in amounts.items()))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_range", *(F.coalesce(F.sum(f"_sum_{n}").over(ahead), F.lit(0)).alias(f"_before_{n}") for n in amounts))
    w = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(before), "_range")  # one row per range
    return out.select(*df.columns, *((F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(w), F.lit(0))).cast("long").alias(n) for n, c in amounts.items()))


def global_number(df: DataFrame, order: list[str], name: str = "number", weight: str | None = None) -> DataFrame:
    """0-based running number (or running sum of weights before the row) in a total order."""
    return global_numbers(df, order, {name: F.col(weight) if weight else F.lit(1)})


def bank_numbers(entries: DataFrame, order: list[str], size: int = 10_000) -> DataFrame:
    """entries: one row per entry with `n_rows`; adds `sequence` (of entries that have rows) and `bank` of its first row."""
    out = global_numbers(entries.where("n_rows > 0"), order, {"sequence": F.lit(1), "_row": F.col("n_rows")})
    return out.withColumn("sequence", F.col("sequence") + 1).withColumn("bank", (F.col("_row") / size).cast("long") + 1).drop("_row")


def global_cap(entries: DataFrame, order: list[str], cap: int) -> DataFrame:
    """entries: one row per entry with `n_rows`; adds `kept_rows`, how many of its rows a cap over all leaves."""
    out = global_number(entries, order, "_before", weight="n_rows")
    return out.withColumn("kept_rows", F.greatest(F.lit(0), F.least(F.col("n_rows"), F.lit(cap) - F.col("_before")))).drop("_before")


def primary_and_rest(df: DataFrame, key: str, value: str, *order: str | Column) -> DataFrame:
    """Per key the first value and the array of the others, in order."""
    out = positions(df, [key], *order, name="_n").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))).alias("_all"))
    values = F.transform("_all", lambda x: x["v"])
    return out.select(key, values[0].alias("primary"), F.slice(values, 2, F.greatest(F.size(values), F.lit(1))).alias("alternatives"))
