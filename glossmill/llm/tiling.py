"""Benchmark decontamination by greedy string tiling.

1. Every run of `least` words of the benchmark items is a seed (at most SEED words; a shorter item: all
   its words). The rolling hashes of all word runs of all documents are joined with the seeds, so that
   whatever can have a tile is looked at.
2. Each document is tiled with the items that share a seed: running Karp-Rabin looks for the
   longest common runs of words that no tile covers yet, verifies their words, marks them, and
   halves the length until `least` words. Order does not matter, so reordered passages are caught.
   Tiles cover no more than the item's words that stand in shared seeds; an item whose bound is below
   both the threshold and the best coverage found changes nothing and is passed over.
3. An item is leaked if tiles cover at least `threshold` of its words.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.

Defined cases: null and empty texts are clean; items without words match nothing; equal items each
count; rows that repeat an id are judged each by its own text; rows without an id are clean; other columns are
ignored; an empty table gives an empty result, an empty benchmark leaves all clean.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .frames import small

#: The longest seeds.
SEED = 5


def one(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Word hashes, starts, ends and bytes of one text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    h, start, end, _ = K.word_hashes(raw, np.array([0, len(raw)]), K.ALNUM)
    return h, start, end, K.LOWER[raw].tobytes()


def bound(shared: np.ndarray, item: tuple, k: int) -> float:
    """The share of an item's words in runs of k words whose hashes are among the sorted `shared`; no tiling with runs of k or more covers more."""
    g = K.grams(item[0], k)
    hit = shared[np.minimum(np.searchsorted(shared, g), len(shared) - 1)] == g if len(shared) else np.zeros(len(g), bool)
    edge = np.zeros(len(item[0]) + 1, np.int64)
    edge[:-k] += hit
    edge[k:] -= hit
    return int((np.cumsum(edge)[:-1] > 0).sum()) / len(item[0])


def tiles(doc: tuple, item: tuple, least: int) -> list[tuple[int, int, int]]:
    """(place in the item, place in the document, words) of the tiles, none overlapping another."""
    h, hs, he, text = doc
    g, gs, ge, other = item
    free_d, free_i = np.ones(len(h), bool), np.ones(len(g), bool)
    out: list[tuple[int, int, int]] = []

    def same(i: int, j: int) -> bool:
        return h[i] == g[j] and text[hs[i] : he[i]] == other[gs[j] : ge[j]]

    def windows(x: np.ndarray, free: np.ndarray, k: int) -> np.ndarray:
        """Starts of the runs of k words that no tile covers."""
        if len(x) < k:
            return np.zeros(0, np.int64)
        taken = np.concatenate([[0], np.cumsum(~free)])
        return np.flatnonzero(taken[k:] == taken[:-k])

    def rolled(x: np.ndarray, k: int) -> np.ndarray:
        return K.rolling(K.prefix_of(x), k)

    size = len(g)
    while size >= least:
        places: dict[int, list[int]] = {}
        hashes = rolled(g, size)
        for j in windows(g, free_i, size).tolist():
            places.setdefault(int(hashes[j]), []).append(j)
        found: list[tuple[int, int, int]] = []
        if places:
            hd = rolled(h, size)
            at = windows(h, free_d, size)
            at = at[np.isin(hd[at], np.fromiter(places, np.uint64, len(places)))] if len(at) else at
            for i in at.tolist():
                for j in places[int(hd[i])]:
                    k = 0
                    while i + k < len(h) and j + k < len(g) and free_d[i + k] and free_i[j + k] and same(i + k, j + k):
                        k += 1
                    if k >= size:
                        found.append((k, i, j))
        longest = max(found, default=(0, 0, 0))[0]
        if longest > 2 * size:
            size = longest
            continue
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[2], m[1])):
            while k >= size and not (free_d[i : i + k].all() and free_i[j : j + k].all()):
                k -= 1  # what is left of a match that another tile has cut
            if k >= size:
                free_d[i : i + k] = free_i[j : j + k] = False
                out.append((j, i, k))
        if size == least:
            break
        size = max(least, size // 2)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", threshold: float = 0.8, least: int = 3) -> DataFrame:
    """Per row: id, contaminated, item_ids (array<long>, sorted), coverage (largest), n_tiles (of that item)."""

    def seeds_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = one(text)[0]
                if item is not None and len(h):
                    k = min(least, SEED, len(h))
                    g = np.unique(K.grams(h, k))
                    out.append(g.view(np.int64))
                    ids += [(item, k)] * len(g)
            flat = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in ids], pa.int64()), pa.array([n for _, n in ids], pa.int32()), pa.array(flat)], names=["item", "words", "seed"])

    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    seeds = small(items.mapInArrow(seeds_of, "item long, words int, seed long"))
    lengths = [r[0] for r in seeds.select("words").distinct().collect()]  # at most five numbers

    def runs_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, data in K.chunks(batch):
                h, _, _, row = K.word_hashes(data, off, K.ALNUM)
                parts = []
                for k in lengths:
                    g = K.grams(h, k)
                    whole = row[: len(g)] == row[k - 1 :] if len(g) else np.zeros(0, bool)
                    parts.append((row[: len(g)][whole], g[whole]))
                rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
                vals = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.uint64)
                if len(parts) > 1:
                    order = np.argsort(rows, kind="stable")
                    rows, vals = rows[order], vals[order]
                cut = np.searchsorted(rows, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array(vals.view(np.int64)))], names=["row", "seeds"])

    # ids may be null or repeat: candidates belong to a row's id and text together
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("row", F.xxhash64("id", "text"))
    runs = texts.select("row", "text").mapInArrow(runs_of, "row long, seeds array<long>").select("row", F.explode("seeds").alias("seed"))
    pairs = runs.join(seeds.select("seed", "item"), "seed").select("row", "item").distinct()
    listed = pairs.join(small(items), "item").groupBy("row").agg(F.collect_list(F.struct("item", F.col("text").alias("words"))).alias("items"))

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            ids, cover, count = [], [], []
            for text, cands in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                got, best = [], (0.0, 0)
                doc = one(text.as_py()) if cands else None
                shared: dict[int, np.ndarray] = {}
                likely = []
                for cand in cands or ():
                    if len(known) > 5000:
                        known.clear()
                    item = known.get(cand["words"]) or known.setdefault(cand["words"], one(cand["words"]))
                    k = min(least, SEED, len(item[0]))
                    if k not in shared:
                        shared[k] = np.unique(K.grams(doc[0], k))
                    likely.append((bound(shared[k], item, k), cand, item))
                likely.sort(key=lambda x: -x[0])
                for most, cand, item in likely:
                    if most < threshold and most < best[0]:
                        break
                    t = tiles(doc, item, min(least, len(item[0])))
                    share = sum(k for _, _, k in t) / len(item[0])
                    best = max(best, (share, len(t)))
                    if share >= threshold:
                        got.append(cand["item"])
                ids.append(sorted(set(got)))
                cover.append(best[0])
                count.append(best[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bool(x) for x in ids]), pa.array(ids, pa.list_(pa.int64())), pa.array(cover, pa.float64()), pa.array(count, pa.int64())], names=["id", "contaminated", "item_ids", "coverage", "n_tiles"])
        K.release()

    judged = texts.join(listed, "row", "left").select("id", "text", "items").mapInArrow(judge, "id long, contaminated boolean, item_ids array<long>, coverage double, n_tiles long")
    return judged.withColumnRenamed("id", id_col)
