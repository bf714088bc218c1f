"""MinHash near-duplicates with sequential Bayesian verification.

1. One pass makes of each text its set of 5-word shingles (64-bit hashes of words between white
   space, A-Z lower-cased): the set's size, a 128-bit fingerprint, 120 minima and 24 band keys.
2. Rows with equal sets form a class; all else is between classes, so copies are never paired.
3. Every class is compared with the smallest of each bucket it falls into (a star, not all pairs).
   A pair is judged on batches of 24 minima: it is dropped once the posterior probability that its
   similarity reaches the threshold falls below `miss`. What survives is verified on the full sets.
4. Components of the verified links. Then, in buckets whose classes still lie in more than one
   component, all pairs between components are judged the same way inside tasks, on 720 further
   minima; only survivors leave a task, large buckets are cut into pairs of blocks, and pairs in one component are skipped
   since they can't change the result. So every pair of a bucket was tested or is already joined.

A pair at the threshold misses all 24 bands of 5 with probability 8e-7 at 0.85, 7e-5 at 0.8.

Defined cases: null, empty and blank texts have no shingles and no links (component: the own id);
texts under five words have one shingle, the whole sequence; rows without an id take part in
nothing, with a null component and kept true; rows that repeat an id count as the same document;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import checkpoint, components, small

SHINGLE, HASHES, ROWS, STEP = 5, 120, 5, 24
#: Minima of the longer, independent signature that classes get which are compared within buckets, and its batch.
LONG, LONG_STEP = 720, 48
#: Classes of one bucket compared within one task; a larger bucket is cut into blocks.
BLOCK = 2048
#: Pairs of one head that are confirmed together, about.
STAR = 1000
_rng = np.random.default_rng(11)
_FACTOR = (_rng.integers(1, 2**63, HASHES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_FLIP = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_LONG_FACTOR = (_rng.integers(1, 2**63, LONG, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_LONG_FLIP = _rng.integers(0, 2**63, LONG, dtype=np.uint64)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, _, _, row = K.word_hashes(data, off, K.NOT_SPACE)
    g = K.grams(h, k)
    ends = np.searchsorted(row, np.arange(len(off)))
    out = []
    for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if hi - lo >= k:
            s = np.sort(g[lo : hi - k + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif hi > lo:
            out.append(np.array([K.gram(h[lo:hi])], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(s: np.ndarray, flip: np.ndarray = _FLIP, factor: np.ndarray = _FACTOR) -> np.ndarray:
    out = np.full(len(flip), 2**64 - 1, np.uint64)
    for lo in range(0, len(s), 256):
        np.minimum(out, ((s[lo : lo + 256, None] ^ flip) * factor).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, h1, h2 (fingerprint of the set), sig (minima, 16 bits each), bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, data in K.chunks(batch):
                sets = shingle_sets(data, off)
                h1 = np.array([K.mix(s).sum(dtype=np.uint64) for s in sets], np.uint64)
                h2 = np.array([np.bitwise_xor.reduce(K.mix(s + np.uint64(7))) for s in sets], np.uint64)
                sig = np.array([minima(s) for s in sets], np.uint32).reshape(-1, HASHES)
                keys = K.grams_of_rows(sig.astype(np.uint64).reshape(len(sets), HASHES // ROWS, ROWS))
                sig16 = [x.tobytes() if len(s) else None for x, s in zip(sig.astype(np.uint16), sets, strict=True)]
                bands = [x if len(s) else None for x, s in zip(keys.view(np.int64).tolist(), sets, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(sig16, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["id", "n_shingles", "h1", "h2", "sig", "bands"],
                )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_shingles long, h1 long, h2 long, sig binary, bands array<long>")


def long_signatures(texts: DataFrame) -> DataFrame:
    """(id, text) -> rep, sig of LONG minima."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, data in K.chunks(batch):
                sigs = [minima(s, _LONG_FLIP, _LONG_FACTOR).astype(np.uint16).tobytes() for s in shingle_sets(data, off)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sigs, pa.binary())], names=["rep", "sig"])

    return texts.select("id", "text").mapInArrow(run, "rep long, sig binary")


def least_matches(threshold: float, miss: float, total_hashes: int = HASHES, step: int = STEP) -> list[int]:
    """For each batch end, the fewest matches with which a pair goes on.

    With a uniform prior, m matches of n leave a Beta(1 + m, 1 + n - m) posterior; the chance that it
    reaches t is the chance of at most m successes in n + 1 draws of probability t."""
    out = []
    for n in range(step, total_hashes + 1, step):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survives(a: np.ndarray, b: np.ndarray, least: list[int], step: int = STEP) -> np.ndarray:
    """Rows of b (or pairs of rows) that no batch rules out."""
    n = len(b)
    alive, seen = np.arange(n), np.zeros(n, np.int32)
    for k, need in enumerate(least):
        cols = slice(k * step, (k + 1) * step)
        left = a[alive, cols] if a.ndim == 2 else a[cols]
        seen[alive] += (left == b[alive, cols]).sum(axis=1, dtype=np.int32)
        alive = alive[seen[alive] >= need]
        if not len(alive):
            break
    return alive


def _sig(column: pa.Array, width: int = HASHES) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


def verified(pairs: DataFrame, sigs: DataFrame | None, texts: DataFrame, percent: int, miss: float) -> DataFrame:
    """The pairs (a, b) whose sets really reach the threshold; pruned on `sigs` first unless that was done."""
    least = least_matches(percent / 100, miss)

    def prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = survives(_sig(batch.column(2)), _sig(batch.column(3)), least)
                yield batch.select([0, 1]).take(pa.array(keep))

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            a, b, left, right = (batch.column(k) for k in range(4))
            keep = []
            for k in range(batch.num_rows):
                x = left[k].as_py()
                if x != last[0]:
                    raw = np.frombuffer(x.encode(), np.uint8)
                    last = x, shingle_sets(raw, np.array([0, len(raw)]))[0]
                raw = np.frombuffer(right[k].as_py().encode(), np.uint8)
                s = shingle_sets(raw, np.array([0, len(raw)]))[0]
                both = len(np.intersect1d(last[1], s, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(last[1]) - both) and both:
                    keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    if sigs is not None:
        pairs = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("y")), "b")
        pairs = pairs.select("a", "b", "x", "y").mapInArrow(prune, "a long, b long")
    # the head of a large star is dealt to several tasks, about STAR pairs each, whether or not a skewed join would be seen
    pairs = checkpoint(pairs)
    heads = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    dealt = pairs.join(small(heads.where("parts > 1")), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("x")).join(heads, "a").select("a", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    full = dealt.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").join(left, ["a", "part"])
    return full.select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long").distinct()


def across(members: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and survive the signature test.

    members: bucket, n (its size), rep, comp, sig (LONG minima). Buckets over BLOCK are dealt as pairs of blocks."""
    least = least_matches(percent / 100, miss, LONG, LONG_STEP)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            if batch is not None:
                held.append(batch)
            whole = pa.Table.from_batches(held).combine_chunks().to_batches() if held else []
            if not whole:
                continue
            rows = whole[0]
            key = np.stack([rows.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            cuts = [0, *new.tolist(), rows.num_rows]
            done = cuts if batch is None else cuts[:-1]  # the last group may go on in the next batch
            if len(done) > 1:
                rep, comp, side, sig = rows.column(3).to_numpy(), rows.column(4).to_numpy(), rows.column(5).to_numpy(), _sig(rows.column(6), LONG)
                a, b = [], []
                for lo, hi in zip(done[:-1], done[1:], strict=True):
                    if hi - lo < 2:
                        continue
                    one_block = key[1, lo] == key[2, lo]
                    c = comp[lo:hi]
                    if (c == c[0]).all():
                        continue
                    for i in range(lo, hi - 1 if one_block else hi):
                        if one_block:
                            other = np.arange(i + 1, hi)
                        elif side[i] == key[1, lo]:
                            other = lo + np.flatnonzero(side[lo:hi] == key[2, lo])
                        else:
                            continue
                        other = other[(comp[other] != comp[i]) & (rep[other] != rep[i])]
                        if len(other):
                            hit = other[survives(sig[i], sig[other], least, LONG_STEP)]
                            a.append(np.minimum(rep[hit], rep[i]))
                            b.append(np.maximum(rep[hit], rep[i]))
                if a:
                    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])
            held = [rows.slice(done[-1])] if batch is not None else []

    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.withColumn("side", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "rep", "comp", "side", "sig")
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, so that small but busy groups stay spread
    return dealt.repartition(tasks, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "a long, b long").distinct()


def _with_end(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, miss: float = 1e-6) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id)."""
    rows = checkpoint(sketches(docs, id_col, text_col))
    classes = rows.where("n_shingles > 0 and id is not null").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = checkpoint(classes)
    band = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = band.groupBy("bucket").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1")
    member = checkpoint(band.join(shared, "bucket"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = checkpoint(texts.join(member.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id", "text"]))
    star = member.where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    links = checkpoint(verified(star, classes, texts, percent, miss))
    first = checkpoint(components(links))

    placed = member.join(first.select(F.col("node").alias("rep"), F.col("component").alias("comp")), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    torn = placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi and bucket is not null").select("bucket")
    open_ = checkpoint(placed.join(torn, "bucket", "left_semi").select("bucket", "n", "rep", "comp"))
    longer = long_signatures(texts.join(open_.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))
    more = verified(across(open_.join(longer, "rep").select("bucket", "n", "rep", "comp", "sig"), percent, 10 * miss), None, texts, percent, miss)
    final = components(links.unionByName(more))

    known = classes.join(final.select(F.col("node").alias("rep"), F.col("component")), "rep", "left").select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = rows.select("id", "n_shingles", "h1", "h2").join(known, ["h1", "h2"], "left")
    found = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), found).alias("component_id"), F.coalesce(F.col("id") == found, F.lit(True)).alias("kept"))
