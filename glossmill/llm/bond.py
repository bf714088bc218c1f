"""Hard negatives by a vertical scan of vectors in blocks (branch and bound on decomposed data).

Rows are dealt into blocks without regard to their keys. A block holds its vectors by dimension, sorted by
label and id, with each label's least and largest component of every dimension. An anchor reads the
dimensions in descending order of its own magnitude, a few at a time, and adds up partial scores; what the
remaining dimensions can still add, from their least and largest components, bounds every row's score. Rows
whose bounds leave the question undecided stay in the bitmap, the others go, until all is read and what
is left has exact scores. The question is, first, which rows of the anchor's label are its best, the
positives; then, for each positive, which rows of other labels stand best inside its score window.

Every group of anchors meets every block: the anchors are a stated set of queries. Groups go to blocks by
an equi-join on the block's number, a pair is one unit of work, and a pair passes on a few rows per anchor.
Scores are integers, exact in 64-bit floats while no sum can reach 2^53, else Python's integers.

Defined cases: rows with a null label, a null vector or any null or non-finite component take no part, nor do
rows without an id, as they can't be named; shorter vectors count as padded by zeros, an empty one scores 0; rows that
share an id are rows of their own, but no row of the anchor's id is its positive; repeated anchors give repeated
rows; scaled components beyond 2^56 count as 2^56, and scores beyond a long are compared exactly and given as the
nearest long; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpoint

#: Rows of a block at most and, so that small tables are shared out too, at least; anchors of a group.
BLOCK_ROWS, LEAST_BLOCK_ROWS, GROUP_ANCHORS = 65_536, 4096, 512
#: Components beyond this count as this, so that scores of up to 4096 dimensions have no more than 38 digits.
LARGEST = 1 << 56
#: Dimensions read in each step; the last step reads the rest.
STEPS = (24, 8, 8, 8)
PACK = "block long, rows int, dims int, ids binary, labels binary, columns binary, wide boolean"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int, mislabel: Callable | None) -> DataFrame:
    """id, label, q (floor(scale * x) as array<long>) of the rows that take part."""
    label, vec = F.col(label_col).cast("long"), F.col(vec_col)
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & vec.isNotNull() & ~odd)
    shown = mislabel(F.col(id_col), label) if mislabel else label
    most = F.lit(float(LARGEST))
    component = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -most), most))
    return rows.select(F.col(id_col).cast("long").alias("id"), shown.cast("long").alias("label"), F.transform(vec, component).alias("q"))


def _pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all rows of a task: by dimension, sorted by label and id."""
    ids, labels, vectors = [], [], []
    for b in batches:
        ids.append(b.column(0).to_numpy())
        labels.append(b.column(1).to_numpy())
        values = b.column(2)
        size = np.diff(values.offsets.to_numpy())
        flat, width = values.flatten().to_numpy().astype(np.int64), int(size.max(initial=0))
        out = np.zeros((len(size), width), np.int64)
        out[np.arange(width) < size[:, None]] = flat
        vectors.append(out)
    if not ids or not sum(map(len, ids)):
        return
    width = max(v.shape[1] for v in vectors)
    every = np.concatenate([np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in vectors])
    i, y = np.concatenate(ids).astype(np.int64), np.concatenate(labels).astype(np.int64)
    order = np.lexsort((i, y))
    wide = bool(every.size) and (every.max() >= 2**31 or every.min() < -(2**31))
    columns = np.ascontiguousarray(every[order].T.astype(np.int64 if wide else np.int32))
    values = [TaskContext.get().partitionId(), len(i), width, i[order].tobytes(), y[order].tobytes(), columns.tobytes(), wide]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]
    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["block", "rows", "dims", "ids", "labels", "columns", "wide"])


def packed(rows: DataFrame, blocks: int) -> DataFrame:
    """The rows dealt evenly into blocks, one row each."""
    return checkpoint(rows.repartition(blocks).mapInArrow(_pack, PACK))


class Block:
    """Columns of a packed block, as numbers of a kind that holds every score exactly."""

    def __init__(self, rows: int, dims: int, ids: bytes, labels: bytes, columns: bytes, wide: bool) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.columns = np.frombuffer(columns, np.int64 if wide else np.int32).reshape(dims, rows)
        self.largest = max(abs(int(self.columns.max(initial=0))), abs(int(self.columns.min(initial=0))))
        self.first = np.concatenate([[0], np.flatnonzero(np.diff(self.labels)) + 1, [rows]])
        self.names = self.labels[self.first[:-1]]

    def counting_in(self, kind: type) -> Block:
        """Least and largest components follow for each label and, at the end, for the block."""
        self.columns = self.columns.astype(kind)
        cut = self.first[:-1]
        lows, highs = np.minimum.reduceat(self.columns, cut, axis=1), np.maximum.reduceat(self.columns, cut, axis=1)
        every = lambda f, x: np.concatenate([x, f.reduce(x, axis=1, keepdims=True)], axis=1)
        self.lows, self.highs = every(np.minimum, lows), every(np.maximum, highs)
        return self

    def slice_of(self, label: int) -> tuple[int, int, int]:
        """Which label it is here (-1: none), and its rows."""
        k = int(np.searchsorted(self.names, label))
        if k == len(self.names) or self.names[k] != label:
            return -1, 0, 0
        return k, int(self.first[k]), int(self.first[k + 1])


def scan(columns: np.ndarray, lows: np.ndarray, highs: np.ndarray, anchor: np.ndarray, alive: np.ndarray, decide: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Rows left in a bitmap and their exact scores, after reading dimensions in the anchor's descending magnitude, a few at a time.

    decide(partial, least, most) tells of rows, by their partial scores and what unread dimensions can add at least and at most,
    which are still undecided. Columns are read whole while many rows are left, and only at these rows afterwards."""
    order = np.argsort(-np.abs(anchor), kind="stable")
    q = anchor[order]
    one, other = q * lows[order], q * highs[order]
    zero = np.zeros(1, one.dtype)
    least = np.concatenate([np.cumsum(np.minimum(one, other)[::-1])[::-1], zero])
    most = np.concatenate([np.cumsum(np.maximum(one, other)[::-1])[::-1], zero])
    partial, rows, at = np.zeros(len(alive), columns.dtype), None, 0
    for size in (*STEPS, len(order)):
        if at == len(order) and at:
            break
        end = min(at + size, len(order))
        part = columns[order[at:end]] if rows is None else columns[order[at:end]].take(rows, axis=1)
        partial = partial + q[at:end] @ part
        at = end
        if rows is not None:
            keep = decide(partial, least[at], most[at])
            rows, partial = rows[keep], partial[keep]
        else:
            live = np.flatnonzero(alive)
            alive[live[~decide(partial[live], least[at], most[at])]] = False
            if np.count_nonzero(alive) * 3 < len(alive) or at == len(order):
                rows = np.flatnonzero(alive)
                partial = partial[rows]
    return rows, partial


def best_of_label(block: Block, anchor: np.ndarray, label: int, own: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the block that may be among the n best of a label, own id left out, and their exact scores."""
    k, start, end = block.slice_of(label)

    def decide(partial: np.ndarray, least: float, most: float) -> np.ndarray:
        if len(partial) <= n:
            return np.ones(len(partial), bool)
        return partial + most >= np.partition(partial, len(partial) - n)[-n] + least

    if k < 0:
        return np.zeros(0, np.int64), np.zeros(0, block.columns.dtype)
    rows, score = scan(block.columns[:, start:end], block.lows[:, k], block.highs[:, k], anchor, block.ids[start:end] != own, decide)
    return start + rows, score


def best_in_windows(block: Block, anchor: np.ndarray, label: int, floors: np.ndarray, ceilings: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of other labels that may be among the n best scores of any window [floor, ceiling], and their exact scores."""
    lowest, highest, widest = floors.min(), ceilings.max(), (ceilings - floors).max()

    def decide(partial: np.ndarray, least: float, most: float) -> np.ndarray:
        keep = (partial >= lowest - most) & (partial <= highest - least)
        if most - least > widest:  # no row is known to be inside a window
            return keep
        left = np.flatnonzero(keep)
        partial = partial[left]
        undecided = np.zeros(len(partial), bool)
        for floor, ceiling in zip(floors, ceilings, strict=True):
            sure = partial[(partial >= floor - least) & (partial <= ceiling - most)]
            enough = max(floor, np.partition(sure, len(sure) - n)[-n] + least) if len(sure) >= n else floor
            undecided |= (partial >= enough - most) & (partial <= ceiling - least)
        keep[left] = undecided
        return keep

    alive = block.labels != label
    return scan(block.columns, block.lows[:, -1], block.highs[:, -1], anchor, alive, decide)


def _first(score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """The n best, ties by the smaller id."""
    return np.lexsort((ids, -score))[:n]


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, Block, Block]]:
    """Each row's group of anchors and block of rows, in numbers that hold their scores."""
    for b in batches:
        for row in (b.slice(k, 1).to_pylist()[0] for k in range(len(b))):
            group = Block(*(row[f"g_{c}"] for c in ("rows", "dims", "ids", "labels", "columns", "wide")))
            block = Block(*(row[c] for c in ("rows", "dims", "ids", "labels", "columns", "wide")))
            dims = max(len(group.columns), len(block.columns))
            for x in (group, block):
                x.columns = np.pad(x.columns, ((0, dims - len(x.columns)), (0, 0)))
            kind = np.float64 if group.largest * block.largest * max(dims, 1) < 2**53 else object
            yield row, group.counting_in(kind), block.counting_in(kind)


def _meet(groups: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """Every group with every block, by an equi-join on the block's number."""
    sent = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
    return sent.join(blocks, "block")


def positives_of(groups: DataFrame, blocks: DataFrame, n_blocks: int, n: int) -> DataFrame:
    """anchor_group, anchor, no (from 1), positive_id, exact (the score as text), each anchor's n best rows of its label."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, group, block in _pairs(batches):
            out = []
            for a in range(len(group.ids)):
                alive, score = best_of_label(block, group.columns[:, a], int(group.labels[a]), int(group.ids[a]), n)
                out += [(row["anchor_group"], a, int(block.ids[alive[x]]), str(int(score[x]))) for x in _first(score, block.ids[alive], n)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.string()], strict=True)], names=["anchor_group", "anchor", "positive_id", "exact"])

    found = _meet(groups, blocks, n_blocks).mapInArrow(run, "anchor_group long, anchor int, positive_id long, exact string")
    w = Window.partitionBy("anchor_group", "anchor").orderBy(F.col("exact").cast("decimal(38,0)").desc(), "positive_id")
    return found.withColumn("no", F.row_number().over(w)).where(F.col("no") <= n)


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", is_anchor: Callable | None = None, mislabel: Callable | None = None, positives: int = 5, negatives: int = 3, floor_percent: int = 50, ceiling_percent: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and positive the best rows of other labels whose score is
    at least `floor_percent` and at most `ceiling_percent` of the positive's.

    is_anchor: a condition on the id column (all rows if None); mislabel: the label that counts, from id and label columns."""
    rows = checkpoint(quantised(vectors, id_col, vec_col, label_col, scale, mislabel))
    anchors = rows.where(is_anchor(F.col("id"))) if is_anchor else rows
    n_rows, n_anchors = rows.count(), anchors.count()
    n_blocks = max(1, math.ceil(n_rows / max(LEAST_BLOCK_ROWS, min(BLOCK_ROWS, n_rows // 16))))
    blocks = packed(rows, n_blocks)
    groups = packed(anchors, max(1, math.ceil(n_anchors / GROUP_ANCHORS)))
    groups = groups.select(F.col("block").alias("anchor_group"), *(F.col(c).alias(f"g_{c}") for c in ("rows", "dims", "ids", "labels", "columns", "wide")))
    best = checkpoint(positives_of(groups, blocks, n_blocks, positives))
    # at most GROUP_ANCHORS * positives small rows meet in a list
    wanted = best.groupBy("anchor_group").agg(F.array_sort(F.collect_list(F.struct("anchor", "no", "positive_id", "exact"))).alias("wanted"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, group, block in _pairs(batches):
            out, by_anchor = [], {}
            for w in row["wanted"]:
                by_anchor.setdefault(w["anchor"], []).append(w)
            for a, asked in by_anchor.items():
                score = [int(w["exact"]) for w in asked]
                floors, ceilings = np.array([-(-floor_percent * s // 100) for s in score], object), np.array([ceiling_percent * s // 100 for s in score], object)
                if block.columns.dtype != object:
                    floors, ceilings = floors.astype(np.float64), ceilings.astype(np.float64)
                alive, got = best_in_windows(block, group.columns[:, a], int(group.labels[a]), floors, ceilings, negatives)
                for w, floor, ceiling in zip(asked, floors, ceilings, strict=True):
                    inside = np.flatnonzero((got >= floor) & (got <= ceiling))
                    ids = block.ids[alive[inside]]
                    out += [(row["anchor_group"], a, w["no"], int(group.ids[a]), w["positive_id"], w["exact"], int(ids[x]), str(int(got[inside[x]]))) for x in _first(got[inside], ids, negatives)]
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    names = ["anchor_group", "anchor", "no", "anchor_id", "positive_id", "positive", "negative_id", "negative"]
    schema = "anchor_group long, anchor int, no int, anchor_id long, positive_id long, positive string, negative_id long, negative string"
    found = _meet(groups.join(wanted, "anchor_group"), blocks, n_blocks).mapInArrow(run, schema)
    number = lambda c: F.col(c).cast("decimal(38,0)")
    w = Window.partitionBy("anchor_group", "anchor", "no").orderBy(number("negative").desc(), "negative_id")
    long = lambda c: F.least(F.greatest(number(c), F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", long("positive").alias("positive_score"), long("negative").alias("negative_score"), F.col("no").alias("positive_no"))


#: The same in DuckDB, over the table `embeddings`, all of whose vectors are of one length.
SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label AS l, b.vec_id, b.label, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a, v b WHERE a.vec_id % 50 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS no FROM s WHERE label = l AND vec_id <> anchor_id QUALIFY no <= 5),
    n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, no, row_number() OVER (PARTITION BY p.anchor_id, no ORDER BY s.score DESC, s.vec_id) AS rank
        FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE s.label <> s.l AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
    SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score, no::INTEGER AS positive_no FROM n WHERE rank <= 3"""
