"""Digests of releases: a tree of hashes over fixed chunks of keys, equal for any layout of files, by which releases are compared.

A row's digest is over its columns by name. Rows go to chunks by a hash of their key, and a chunk's digest is the sum of
its rows' digests, part by part, with their number, so that it can be added up before it is shuffled, by any grouping, and a key
with very many rows is no burden. Above the chunks each node is the hash of its sixteen children, up to one root. Two trees are compared from the
root downwards: only below nodes that differ are children looked at, and only rows of chunks that differ are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpoint

#: Children of a node as a power of two, and levels above the chunks: 16 ** 4 chunks.
FAN, LEVELS = 4, 4
#: Rows that a task compares.
TASK_ROWS = 250_000


def row_digest(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """sha256 of a row as JSON, columns in the order of their names, nulls stated."""
    return F.sha2(F.to_json(F.struct(*sorted(c for c in df.columns if c not in without)), {"ignoreNullFields": "false"}), 256)


def digest_sums(digest: Column) -> list[Column]:
    """The sums s0 to s3 of the four parts of digests, exact, and the same in any order."""
    return [F.sum(F.conv(F.substring(digest, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]


def signed_parts(digest: Column, side: Column) -> list[Column]:
    """The four parts of a digest, exact, with the sign of a side."""
    return [F.conv(F.substring(digest, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)") * side.cast("decimal(1,0)") for k in range(4)]


def chunk_of(keys: list[str], levels: int) -> Column:
    """The first bits of a hash of the key, which are the same on any platform."""
    hexes = F.substring(F.sha2(F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in sorted(keys))), {"ignoreNullFields": "false"}), 256), 1, 8)
    return F.shiftright(F.conv(hexes, 16, 10).cast("long"), 32 - FAN * levels).alias("node")


def merkle_tree(rows: DataFrame, keys: list[str], levels: int = LEVELS) -> DataFrame:
    """level (0: chunks), node, rows, digest of every chunk that has rows, and of the nodes above; the root is node 0 of the last level. The rows are read once."""
    digests = rows.select(chunk_of(keys, levels), row_digest(rows).alias("d"))
    tree = digests.groupBy("node").agg(F.count("*").alias("rows"), *digest_sums(F.col("d")))
    tree = tree.select(F.lit(0).alias("level"), "node", "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *(F.col(f"s{k}").cast("string") for k in range(4))), 256).alias("digest"))
    out = below = tree = checkpoint(tree)
    for level in range(1, levels + 1):
        children = F.array_sort(F.collect_list(F.struct("node", "digest")))  # sixteen at most
        below = below.groupBy(F.shiftright("node", FAN).alias("node")).agg(F.sum("rows").alias("rows"), F.sha2(F.to_json(children), 256).alias("digest"))
        below = below.select(F.lit(level).alias("level"), "node", "rows", "digest")
        out = out.unionByName(below)
    return out


def root(tree: DataFrame) -> str:
    """The digest of all rows; of none, an empty text."""
    last = tree.orderBy(F.desc("level")).limit(1).collect()
    return last[0]["digest"] if last else ""


def changed_chunks(old: DataFrame, new: DataFrame, levels: int = LEVELS) -> DataFrame:
    """node, rows (of both): chunks in which two trees differ, found from the root downwards."""
    at = lambda t, level: t.where(F.col("level") == level).select("node", "digest", "rows")
    open_ = None
    for level in range(levels, -1, -1):
        a, b = at(old, level), at(new, level)
        if open_ is not None:
            below = open_.select(F.col("node").alias("parent"))
            a, b = (x.join(below, F.shiftright("node", FAN) == F.col("parent"), "left_semi") for x in (a, b))
        both = a.select("node", F.col("digest").alias("one"), F.col("rows").alias("n")).join(b.select("node", F.col("digest").alias("other"), F.col("rows").alias("m")), "node", "full")
        rows = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        open_ = checkpoint(both.where(~F.col("one").eqNullSafe(F.col("other"))).select("node", rows.alias("rows")))
    return open_


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], chunks: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The keys of rows in the given chunks (node, rows) that two releases don't share, with `change`: added, removed or changed (the key stands in both). Rows may repeat; keys may be null.

    A key's rows are alike in both if their numbers and the sums of their digests are, so a key takes a few numbers, and as many tasks are used as the chunks' rows need."""
    tasks = int(chunks.agg(F.ceil(F.sum("rows") / TASK_ROWS)).first()[0] or 1)  # one number
    inside = chunks.select("node")

    def parts(df: DataFrame, side: int) -> DataFrame:
        there = df.withColumn("node", chunk_of(keys, levels)).join(inside, "node", "left_semi")
        return there.select(*keys, F.unhex(row_digest(there, ("node",))).alias("d"), F.lit(side).alias("side"))

    both = parts(old, -1).unionByName(parts(new, 1)).repartition(tasks, *keys)
    n = {"old": F.count_if(F.col("side") < 0), "new": F.count_if(F.col("side") > 0)}
    over = F.greatest(*(F.abs(F.sum(s)) for s in signed_parts(F.hex("d"), F.col("side"))))
    found = both.groupBy(*keys).agg(*(c.alias(name) for name, c in n.items()), over.alias("over"))
    change = F.when(F.col("old") == 0, "added").when(F.col("new") == 0, "removed").otherwise("changed")
    return found.where("old <> new or over <> 0").select(*keys, change.alias("change"))
