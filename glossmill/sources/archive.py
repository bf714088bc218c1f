"""Gzip files read by many tasks: a seek index of places from which inflating can start, made and used by Spark.

Inflating can start at any deflate block, given the 32 KB of text before it. Tasks look for the first block behind
equal cuts of the compressed file (a block header that is consistent, and from which text can be inflated), or for the start of a member.
What lies before a block is not known yet, so a task inflates its stretch three times, behind three made-up windows from whose
differences follows which byte of the window each byte copies. Then the true windows are passed on from stretch to
stretch of a file, 32 KB each, and compared with what the stretch before inflates past its end, so that a false start fails the job.
The index (file, stretch, bit, place in the text, window) is a frame: write it once, read the archive by it as often as needed.

Stretches of a file meet in one group to pass windows on: 64 KB for each `stretch` bytes. Where a part has no such block
(stored data, say), the stretch before goes on. Files must be on a file system that pyarrow knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Compressed bytes of a stretch, bytes read at once, bytes of the largest line, bytes of the deflate window (fixed by the format).
STRETCH, PIECE, MOST_LINE, WINDOW = 32 << 20, 1 << 20, 64 << 20, 1 << 15
#: Bytes of text that are compared past the end of a stretch, and compressed bytes that are read first where few may be needed.
PAST, FEW = 512, 4096
#: Compressed bytes that a task looks through, at least a stretch, and bytes of text that it gives.
TASK, TASK_TEXT = 4 << 20, 16 << 20
Read = Callable[[int, int], bytes]


def opened(path: str) -> Read:
    """Reads (place, number) bytes of a file."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    f = system.open_input_file(inner)
    return lambda at, n: f.read_at(max(0, min(n, f.size() - at)), at) if at < f.size() else b""


def shifted(data: bytes, by: int) -> bytes:
    """The bits from `by` (below 8) on, one byte less."""
    if not by:
        return data[:-1]
    x = np.frombuffer(data, np.uint8).astype(np.uint16)
    return ((x[:-1] >> by) | (x[1:] << (8 - by)) & 255).astype(np.uint8).tobytes()


def is_member(head: bytes) -> bool:
    return len(head) >= 10 and head[:3] == b"\x1f\x8b\x08" and not head[3] & 0xE0


def inflating(read: Read, bit: int, window: bytes | None, end: int | None = None, first: int = PIECE) -> Iterator[tuple[bytes, bool]]:
    """The text from a block on to the end of the file, each part with whether it lies behind bit `end`; from a member's start where there is no window.

    Pieces of `first` bytes are read, then of twice as many up to PIECE, so that little is read in vain where few are taken. Up to seven bits
    behind `end` are fed before it, too few for any text."""
    at, by = bit >> 3, bit & 7
    raw, behind, step = window is not None, False, first
    d = zlib.decompressobj(31) if not raw else zlib.decompressobj(-15, window) if window else zlib.decompressobj(-15)
    while True:
        left = -(-(end - by - 8 * at) // 8) if end is not None and not behind else step
        if left <= 0:
            behind, step = True, first
            continue
        n = min(step, left)
        piece = read(at, n + 1)
        if not piece:
            return
        step = min(2 * step, PIECE)
        fed = shifted(piece if len(piece) > n else piece + b"\0", by)
        at += len(fed)
        while True:
            out = d.decompress(fed, 16 * n)
            if out:
                yield out, behind
            fed = d.unconsumed_tail
            if not fed and len(out) < 16 * n:
                break
        if not d.eof:
            continue
        # a member has ended; behind raw data the bits up to a whole byte, a check sum and a length
        at -= len(d.unused_data)
        if raw:
            at = next((x for x in (at + 8, at + 9) if by and is_member(read(x, 10))), at + 8)
        if not is_member(read(at, 10)):
            return
        d, raw, by = zlib.decompressobj(31), False, 0


def inflated(read: Read, bit: int, window: bytes | None, end: int | None = None, first: int = PIECE) -> Iterator[bytes]:
    """The text from a block on to bit `end` or the end of the file, as inflating() gives it."""
    for out, behind in inflating(read, bit, window, end, first):
        if behind:
            return
        yield out


def _blocks(data: np.ndarray) -> np.ndarray:
    """Bits at which a dynamic block that isn't the last can start, by its header: counts in range, a complete code for code lengths."""
    n = (len(data) - 24) * 8
    if n <= 0:
        return np.zeros(0, np.int64)
    words = np.lib.stride_tricks.sliding_window_view(data, 8)[: len(data) - 8].copy().view("<u8")[:, 0]
    bits = lambda at, size: (words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << size) - 1)
    at = np.arange(n)
    at = at[bits(at, 3) == 4]
    at = at[(bits(at + 3, 5) <= 29) & (bits(at + 8, 5) <= 29)]
    codes = bits(at + 13, 4).astype(np.int64) + 4
    total = np.zeros(len(at), np.int64)
    for k in range(19):
        size = np.where(k < codes, bits(at + 17 + 3 * k, 3).astype(np.int64), 0)
        total += np.where(size > 0, 128 >> size, 0)
    return at[total == 128]


def first_start(read: Read, begin: int, end: int) -> tuple[int, bool] | None:
    """(bit, whether it is a member's) of the first place in a range of bytes from which text can be inflated."""
    unknown = b"\0" * WINDOW
    for at in range(begin, end, PIECE >> 3):
        # headers by chance are many, and most are refuted by a few bytes behind them, which are held already
        held = read(at, min(PIECE >> 3, end - at) + (PIECE >> 3))
        part = held[: min(PIECE >> 3, end - at) + 32]
        near = lambda x, n, at=at, held=held: held[x - at : x - at + n] if x - at + n <= len(held) else read(x, n)
        data = np.frombuffer(part, np.uint8)
        found = [(int(b), False) for b in _blocks(data)]
        m = part.find(b"\x1f\x8b\x08")
        while m >= 0:
            if is_member(part[m : m + 10]):
                found.append((8 * m, True))
            m = part.find(b"\x1f\x8b\x08", m + 1)
        for b, member in sorted(found):
            if at + (b >> 3) >= end:
                break
            try:
                size = 0
                for out in inflated(near, 8 * at + b, None if member else unknown, None, FEW):
                    size += len(out)
                    if size >= 4 * WINDOW:
                        break
                if size or member:
                    return 8 * at + b, member
            except zlib.error:
                continue
    return None


#: Windows behind which copies show where they come from: the low and the high part of the place, and the complement of the low one.
_PLACES = np.arange(WINDOW)
MADE_UP = [(_PLACES & 255).astype(np.uint8).tobytes(), (_PLACES >> 8).astype(np.uint8).tobytes(), (255 - (_PLACES & 255)).astype(np.uint8).tobytes()]


def sourced(parts: list[bytes]) -> np.ndarray:
    """Of three texts behind MADE_UP: each byte, or 256 plus the place in the window that it copies."""
    low, high, other = (np.frombuffer(p, np.uint8).astype(np.int32) for p in parts)
    return np.where(low != other, 256 + low + (high << 8), low)


def filled(codes: np.ndarray, window: bytes) -> bytes:
    if not (codes >= 256).any():
        return codes.astype(np.uint8).tobytes()
    w = np.frombuffer(window.rjust(WINDOW, b"\0"), np.uint8)
    return np.where(codes < 256, codes, w[np.maximum(codes - 256, 0)]).astype(np.uint8).tobytes()


def _measure(read: Read, bit: int, end: int | None, member: bool) -> dict:
    """Length of a stretch's text, its first bytes, its last ones and those behind its end, as sourced() has them."""
    texts, size = [], 0
    for made in [None] if member else MADE_UP:
        head, tail, past, size = b"", b"", b"", 0
        for out, behind in inflating(read, bit, made, end, FEW):
            if behind:
                past += out
                if len(past) >= PAST:
                    break
                continue
            head = (head + out)[:PAST] if len(head) < PAST else head
            tail = (tail + out)[-WINDOW:]
            size += len(out)
        texts.append((head, tail, past[:PAST]))
    three = texts * 3 if member else texts
    return {"size": size} | {name: sourced([t[k] for t in three]).astype(np.uint16).tobytes() for k, name in enumerate(("head", "tail", "past"))}


INDEX = "path string, stretch int, bit long, end long, member boolean, size long, place long, window binary"


def gzip_index(spark: SparkSession, path: str | list[str], stretch: int = STRETCH) -> DataFrame:
    """Per stretch of each file: path, stretch (from 0), bit, end (null at the file's end), member, size and place of its text, and the window before it."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    # by number, as rows that are small but dear would else be taken together again
    tasks = int(files.agg(F.sum(F.ceil(F.col("length") / max(stretch, TASK)))).first()[0] or 1)  # one number
    cuts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / stretch))).alias("k"))

    def find(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(p, int(k), (0, True) if k == 0 else first_start(opened(p), k * stretch, min(n, (k + 1) * stretch))) for p, n, k in zip(f.path, f.length, f.k, strict=True)]
            yield pd.DataFrame([(p, k, *s) for p, k, s in found if s], columns=["path", "k", "bit", "member"])

    starts = cuts.repartition(tasks, "path", "k").mapInPandas(find, "path string, k long, bit long, member boolean")
    w = Window.partitionBy("path").orderBy("bit")
    starts = starts.withColumn("end", F.lead("bit").over(w)).withColumn("stretch", F.row_number().over(w) - 1)

    def measure(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [dict(zip(("path", "stretch", "bit", "end", "member"), r, strict=True)) for r in zip(f.path, f.stretch, f.bit, (None if pd.isna(e) else int(e) for e in f.end), f.member, strict=True)]
            out = pd.DataFrame([r | _measure(opened(r["path"]), r["bit"], r["end"], r["member"]) for r in rows])
            yield out.astype({"end": "Int64"}) if len(out) else out

    kinds = "path string, stretch int, bit long, end long, member boolean, size long, head binary, tail binary, past binary"
    measured = starts.repartition(tasks, "path", "stretch").mapInPandas(measure, kinds)

    def link(f: pd.DataFrame) -> pd.DataFrame:
        window, place, past, out = b"", 0, None, []
        for r in f.sort_values("stretch").itertuples():
            codes = lambda x: np.frombuffer(x, np.uint16).astype(np.int32)
            head = filled(codes(r.head), window)
            if past is not None and head[: len(past)] != past[: len(head)]:
                raise ValueError(f"{r.path}: no block starts at bit {r.bit}; take another stretch than {stretch}")
            out.append((r.path, r.stretch, r.bit, r.end, r.member, r.size, place, window))
            past = filled(codes(r.past), window)
            window = (window + filled(codes(r.tail), window))[-WINDOW:]
            place += r.size
        return pd.DataFrame(out, columns=["path", "stretch", "bit", "end", "member", "size", "place", "window"]).astype({"end": "Int64"})

    return measured.groupBy("path").applyInPandas(link, INDEX)


def stretch_lines(read: Read, bit: int, member: bool, size: int, window: bytes) -> Iterator[tuple[int, bytes]]:
    """(place in the stretch's text, line) of the lines that start in a stretch, the last one read on past its end; line ends as in Spark's text source but a bare carriage return."""
    at, rest, held = 0, [], 0
    skip = bool(window) and window[-1:] != b"\n"  # inside a line that started before

    def line(raw: bytes) -> bytes:
        return raw[:-1] if raw.endswith(b"\r") else raw

    for out in inflated(read, bit, None if member else window, None, 4 * FEW):
        rest.append(out)
        held += len(out)
        if held > MOST_LINE:
            raise ValueError(f"a line of over {MOST_LINE} bytes")
        if b"\n" not in out:
            continue
        *whole, last = b"".join(rest).split(b"\n")
        for raw in whole:
            if at >= size:
                return
            if not skip:
                yield at, line(raw)
            skip = False
            at += len(raw) + 1
        rest, held = [last], len(last)
        if at >= size:
            return
    if held and not skip and at < size:
        yield at, line(b"".join(rest))


def read_gzip_lines(index: DataFrame) -> DataFrame:
    """file, place (of the line in the file's text, in bytes), value of all lines of the files of an index; a stretch is a unit of work. The index is read twice: for its sizes, and for the work; store it first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                places, lines, held = [], [], 0
                name = r["path"].rsplit("/", 1)[-1]

                def batch() -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([pa.array([name] * len(lines), pa.string()), pa.array(places, pa.int64()), pa.array(lines, pa.string())], names=["file", "place", "value"])

                for at, raw in stretch_lines(opened(r["path"]), r["bit"], r["member"], r["size"], r["window"]):
                    places.append(r["place"] + at)
                    lines.append(raw.decode("utf-8", "replace"))
                    held += len(raw)
                    if held > 4 * PIECE:
                        yield batch()
                        places, lines, held = [], [], 0
                yield batch()

    tasks = int(index.agg(F.ceil(F.least(F.count("*"), F.sum("size") / TASK_TEXT))).first()[0] or 1)  # one number
    return index.repartition(tasks, "path", "stretch").mapInArrow(run, "file string, place long, value string")


def read_gzip_jsonl(index: DataFrame, schema: str) -> DataFrame:
    """As files.read_jsonl(), from an index: `ordinal` is (file, place), which sorts as the files by name and the lines in them, however the files were cut."""
    lines = read_gzip_lines(index).where(~F.col("value").rlike(r"^\s*$"))
    ordinal = F.struct(F.col("file"), F.col("place")).alias("ordinal")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j"), ordinal).select("j.*", "ordinal")
