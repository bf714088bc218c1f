"""One large JSON document read by many tasks: the elements of one of its arrays, found by a structural scan of byte ranges.

Where a range starts inside a string or how deep it is nested follows from the ranges before: each range counts its unescaped quotes and,
for both cases, what its brackets add to the depth; sums over the ranges of a file, a few numbers each, tell every range
where it starts. A second scan finds where the array opens and closes and how many elements start in each range, a third one cuts them out,
reading on past its range for the last one. Bytes are looked at in numpy, each range by its own task; no task holds more than a range and an element.

Files must be on a file system that pyarrow knows (file, hdfs, s3, gs), in UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .archive import Read, opened
from .files import LEXICON, WORD

#: Bytes of a range; bytes read on at a time for an element that goes past it; bytes before a bracket in which its key stands.
RANGE, MORE, KEY = 16 << 20, 1 << 20, 4096
_KIND = np.zeros(256, np.int8)
_KIND[list(b"{[")], _KIND[list(b"}]")] = 1, -1
_NAME = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*$', re.DOTALL)


def backslashes_before(read: Read, at: int) -> int:
    n = 0
    while at > 0:
        part = read(max(0, at - KEY), min(at, KEY))
        left = part.rstrip(b"\\")
        n += len(part) - len(left)
        if left:
            break
        at -= len(part)
    return n


def scan(data: np.ndarray, escapes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets, whether an odd number of unescaped quotes stands before each, and the number of unescaped quotes. escapes: backslashes right before the data."""
    quotes = np.flatnonzero(data == 34)
    last = np.maximum.accumulate(np.where(data != 92, np.arange(len(data)), -1)) if len(data) else np.zeros(0, np.int64)
    before = np.where(quotes > 0, last[quotes - 1], -1) if len(quotes) else quotes
    run = quotes - 1 - before + np.where(before < 0, escapes, 0)
    quotes = quotes[run % 2 == 0]
    brackets = np.flatnonzero(_KIND[data])
    return brackets, np.searchsorted(quotes, brackets) % 2 == 1, len(quotes)


def nested(data: np.ndarray, escapes: int, in_string: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places of brackets outside strings, the bytes there, the depth behind each, and whether the data ends inside a string."""
    brackets, odd, quotes = scan(data, escapes)
    brackets = brackets[odd == in_string]
    return brackets, data[brackets], depth + np.cumsum(_KIND[data[brackets]], dtype=np.int64), bool(quotes % 2) != in_string


def _ranges(frames: Iterable[pd.DataFrame], read_range: int) -> Iterator[tuple[pd.DataFrame, list[tuple]]]:
    for f in frames:
        out = []
        for r in f.itertuples(index=False):
            read, at = opened(r.path), int(r.k) * read_range
            out.append((r, read, at, np.frombuffer(read(at, read_range), np.uint8), backslashes_before(read, at)))
        yield f, out


def array_ranges(spark: SparkSession, path: str | list[str], key: str | None, size: int = RANGE) -> DataFrame:
    """path, k, in_string, depth, opens, closes (places of the array's brackets in the file), first (number of the first element that starts in the range)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    cuts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size))).alias("k")).repartition("path", "k")
    level = 2 if key is not None else 1  # depth behind the array's opening bracket

    def count(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, ranges in _ranges(frames, size):
            found = [scan(data, escapes) + (data,) for _, _, _, data, escapes in ranges]
            adds = [[int(_KIND[data[b[odd == side]]].sum(dtype=np.int64)) for side in (False, True)] for b, odd, _, data in found]
            yield f.assign(quotes=[n % 2 for _, _, n, _ in found], outside=[a for a, _ in adds], inside=[b for _, b in adds])

    w = Window.partitionBy("path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    counted = cuts.mapInPandas(count, "path string, k long, quotes int, outside long, inside long")
    counted = counted.withColumn("in_string", F.coalesce(F.sum("quotes").over(w), F.lit(0)) % 2 == 1)
    counted = counted.withColumn("depth", F.coalesce(F.sum(F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))).over(w), F.lit(0)))

    def find(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f, ranges in _ranges(frames, size):
            marks, total = [], []
            for r, read, at, data, escapes in ranges:
                place, byte, depth, _ = nested(data, escapes, bool(r.in_string), int(r.depth))
                starts = np.flatnonzero((byte == 123) & (depth == level + 1))
                own = []
                for i in np.flatnonzero(((byte == 91) & (depth == level)) | ((byte == 93) & (depth == level - 1))).tolist():
                    spot = at + int(place[i])
                    name = _NAME.search(read(max(0, spot - KEY), min(spot, KEY))) if byte[i] == 91 and key is not None else None
                    wanted = byte[i] == 91 and (key is None or name is not None and name[1].decode("utf-8", "replace") == key)
                    own.append({"at": spot, "kind": 1 if wanted else 0 if byte[i] == 91 else -1, "before": int(np.searchsorted(starts, i))})
                marks.append(own)
                total.append(len(starts))
            yield f.assign(marks=marks, starts=total)[["path", "k", "in_string", "depth", "marks", "starts"]]

    kinds = "path string, k long, in_string boolean, depth long, marks array<struct<at:long,kind:int,before:int>>, starts long"
    found = counted.select("path", "k", "in_string", "depth").repartition("path", "k").mapInPandas(find, kinds)

    def settle(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k", ignore_index=True)
        opens = closes = None
        seen, at_open = 0, 0
        for r in f.itertuples():
            for m in r.marks:
                if m["kind"] == 1:
                    if opens is not None:
                        raise ValueError(f"{r.path}: the array {key!r} stands there twice")
                    opens, at_open = m["at"], seen + m["before"]
                elif m["kind"] == -1 and opens is not None and closes is None:
                    closes = m["at"]
            seen += r.starts
        if closes is None:
            raise ValueError(f"{f.path[0]}: there is no whole array {key!r}")
        before = f.starts.cumsum() - f.starts
        return f.assign(opens=opens, closes=closes, first=(before - at_open).clip(lower=0))[["path", "k", "in_string", "depth", "opens", "closes", "first"]]

    return found.groupBy("path").applyInPandas(settle, "path string, k long, in_string boolean, depth long, opens long, closes long, first long")


def elements(read: Read, at: int, size: int, in_string: bool, depth: int, opens: int, closes: int, level: int) -> Iterator[bytes]:
    """The objects of an array that start in a range, whole."""
    data = np.frombuffer(read(at, size), np.uint8)
    place, byte, deep, inside = nested(data, backslashes_before(read, at), in_string, depth)
    raw = data.tobytes()
    starts = place[(byte == 123) & (deep == level + 1)]
    ends = place[(byte == 125) & (deep == level)]
    starts = starts[(starts + at > opens) & (starts + at < closes)]
    follows = np.searchsorted(ends, starts)
    for s, e in zip(starts.tolist(), follows.tolist(), strict=True):
        if e < len(ends):
            yield raw[s : ends[e] + 1]
            continue
        parts, now, spot = [raw[s:]], int(deep[-1]), at + len(data)
        while True:
            more = np.frombuffer(read(spot, MORE), np.uint8)
            if not len(more):
                raise ValueError("the document ends inside an element")
            p, b, d, inside = nested(more, backslashes_before(read, spot), inside, now)
            stop = np.flatnonzero((b == 125) & (d == level))
            if len(stop):
                parts.append(more[: p[stop[0]] + 1].tobytes())
                break
            parts.append(more.tobytes())
            now, spot = int(d[-1]) if len(d) else now, spot + len(more)
        yield b"".join(parts)


def read_json_array(spark: SparkSession, path: str | list[str], key: str | None, size: int = RANGE, ranges: DataFrame | None = None) -> DataFrame:
    """file, ordinal (from 0), value (JSON text) of all objects in the array `key` of the outer object (None: the document is the array)."""
    level = 2 if key is not None else 1

    def cut(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                values, number, held = [], int(r.first), 0
                name = r.path.rsplit("/", 1)[-1]
                for raw in elements(opened(r.path), int(r.k) * size, size, bool(r.in_string), int(r.depth), int(r.opens), int(r.closes), level):
                    values.append(raw.decode("utf-8", "replace"))
                    held += len(raw)
                    if held > 4 * MORE:
                        yield pd.DataFrame({"file": name, "ordinal": np.arange(number, number + len(values)), "value": values})
                        values, number, held = [], number + len(values), 0
                yield pd.DataFrame({"file": pd.Series([name] * len(values), dtype=object), "ordinal": np.arange(number, number + len(values)), "value": pd.Series(values, dtype=object)})

    ranges = array_ranges(spark, path, key, size) if ranges is None else ranges
    return ranges.repartition("path", "k").mapInPandas(cut, "file string, ordinal long, value string")


def read_large_lexicon(spark: SparkSession, path: str, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """As files.read_lexicon_json(), for documents of any size: (words with `ordinal`, one header row for each document), both with `file`.

    The header is what stands around the words, read by one task for each document."""
    ranges = array_ranges(spark, path, "words", size)
    words = read_json_array(spark, path, "words", size, ranges)
    words = words.select("file", "ordinal", F.from_json("value", WORD).alias("w")).select("file", "ordinal", "w.*")

    def around(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = []
            for p, a, b in zip(f.path, f.opens, f.closes, strict=True):
                read = opened(p)
                texts.append((read(0, int(a) + 1) + read(int(b), 1 << 40)).decode("utf-8", "replace"))
            yield pd.DataFrame({"file": [p.rsplit("/", 1)[-1] for p in f.path], "value": texts})

    header = ranges.where("k = 0").select("path", "opens", "closes").mapInPandas(around, "file string, value string")
    return words, header.select("file", F.from_json("value", LEXICON).alias("d")).select("file", "d.*").drop("words")
