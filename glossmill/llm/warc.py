"""WARC archives and a globally ordered capture index.

Rows are written as gzipped WARC records, many to an archive; of records with equal payloads the one
with the smallest id is a response and the others revisit it. The archives are a Parquet table
(archive, content) in a shared folder, so that executors need no common disk but the cluster's.
Reading parses the archives again, record by record. Each archive gives a run of captures, sorted there
once by url key and time and numbered in that order; the runs are dealt by key range, into ranges of
about RANGE_ROWS captures each however large the table, and merged within each range by a loser tree.
The bodies are never shuffled by their digest, so a payload that a third of all pages have is no hot key.

Defined cases: a null payload or url counts as empty; equal ids with equal payloads are both
responses, and share a record id, which names id and payload; a record without an id revisits an equal
payload that has one, else it is a response; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import BROADCAST_ROWS, checkpoint

#: Bytes at which an archive is closed.
ARCHIVE_BYTES = 4 << 20
#: Captures in a key range, about: what one task merges.
RANGE_ROWS = 200_000
#: Bytes that the reader feeds to the decompressor at once.
STEP = 1 << 16
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, lower-cased, without scheme, www, port and fragment."""
    rest = re.sub(r"^[a-zA-Z][\w+.-]*://", "", url).split("#", 1)[0]
    m = re.match(r"([^/?]*)(.*)$", rest, re.S)
    host, path = m[1].lower(), m[2].lower()
    host = re.sub(r":\d+$", "", re.sub(r"^www\d*\.", "", host))
    return ",".join(reversed(host.split("."))) + ")" + (path or "/")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def record(page_id: int | None, url: str, payload: bytes, sha: str, size: int, refers_to: int | None, place: object = "") -> bytes:
    """One gzip member that holds one WARC/1.1 record. `place` tells records apart that are otherwise alike."""
    kind = "response" if refers_to is None else "revisit"
    own = record_id(page_id, sha) if refers_to is None and page_id is not None else record_id(page_id, url, sha, place)
    when = (EPOCH + timedelta(seconds=(page_id or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
    clean = re.sub(r"[\r\n]", "", url)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {size}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {when}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{sha}", "Content-Type: application/http;msgtype=response", f"Page-Id: {'' if page_id is None else page_id}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha)}", f"Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each member of an archive."""
    at = 0
    while at < len(content):
        z, parts, end = zlib.decompressobj(31), [], at
        while not z.eof:  # in steps, so that what follows the record is not copied for each
            if end >= len(content):
                raise ValueError("an archive ends within a record")
            parts.append(z.decompress(content[end : end + STEP]))
            end += STEP
        data = b"".join(parts)
        size = min(end, len(content)) - len(z.unused_data) - at
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
        yield at, size, headers, rest[: int(headers["Content-Length"])]
        at += size


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> None:
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.encode(F.col(body_col).cast("string"), "UTF-8"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("sha", F.sha1("body"))
    same = rows.where(F.octet_length("body") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first")
    if same.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(same), "sha", "left")
    else:  # ids and digests meet first; the bodies then move once, by id and digest, which is no hot key
        first = rows.select("id", "sha").distinct().join(same, "sha").select(F.col("id").alias("own"), F.col("sha").alias("own_sha"), "first")
        rows = rows.join(first, F.col("id").eqNullSafe(F.col("own")) & (F.col("sha") == F.col("own_sha")), "left")
    rows = rows.select("id", "url", "body", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = place = 0
        task = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            content = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.gz"]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for k in range(batch.num_rows):
                i, url, body, first = (c[k].as_py() for c in batch.columns)
                held.append(record(i, url, body, digest(body), len(body), first, f"{task} {place}"))
                place += 1
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    rows.mapInArrow(pack, "archive string, content binary").write.mode("errorifexists").parquet(folder)


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the archives: page_id, url_key, captured, archive, at, size, payload_bytes, payload_digest, record_type, refers_to, place (in the archive's run).

    The digest of a response is that of the payload read; a revisit has the one its header states."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url_key", "captured", "archive", "at", "size", "payload_bytes", "payload_digest", "record_type", "refers_to", "place"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                out = []
                for at, size, head, block in records(content.as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    revisit = head["WARC-Type"] == "revisit"
                    sha = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and digest(payload) != sha:
                        raise ValueError(f"{name}: the payload at {at} does not have the digest stated")
                    n = int(re.search(rb"Content-Length: (\d+)", http)[1])
                    number = lambda key: int(head[key]) if head.get(key) else None  # noqa: B023, E731
                    out.append((number("Page-Id"), url_key(head["WARC-Target-URI"]), head["WARC-Date"], name.as_py(), at, size, n, sha, head["WARC-Type"], number("Refers-To-Page-Id")))
                out.sort(key=lambda r: (r[1], r[2], r[0] is not None, r[0] or 0))  # the run of this archive
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*zip(*out, strict=True), range(len(out))], kinds, strict=True)], names=names)

    return spark.read.parquet(folder).select("archive", "content").mapInArrow(parse, "page_id long, url_key string, captured string, archive string, at long, size long, payload_bytes long, payload_digest string, record_type string, refers_to long, place long")


class LoserTree:
    """A k-way merge of sorted runs: inner nodes keep the loser of their match, the root the winner."""

    def __init__(self, runs: list[list]) -> None:
        self.runs, self.k = runs, max(1, len(runs))
        self.place = [0] * self.k
        self.losers = [-1] * self.k
        self.winner = self._play(1) if runs else 0

    def _head(self, run: int) -> tuple:
        rows = self.runs[run]
        return (0, rows[self.place[run]], run) if self.place[run] < len(rows) else (1, run)

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._head(a) < self._head(b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator:
        while self.runs and self.place[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield self.runs[run][self.place[run]]
            self.place[run] += 1
            node = (run + self.k) // 2
            while node:
                if self._head(self.losers[node]) < self._head(run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def merge_index(captures: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The captures in global order of url key, capture time and id: partition after partition, and within each.

    The number of key ranges follows from the number of captures, which bounds what a task holds."""
    names = captures.columns
    ranges = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // range_rows))

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        # the captures of a run stand in the order in which its archive sorted them
        order = pc.sort_indices(rows, sort_keys=[("archive", "ascending"), ("place", "ascending")])
        rows = rows.take(order).combine_chunks()
        key = list(zip(rows["url_key"].to_pylist(), rows["captured"].to_pylist(), [(x is not None, x or 0) for x in rows["page_id"].to_pylist()], range(rows.num_rows), strict=True))
        cut = [0, *(k for k in range(1, len(key)) if runs[k] != runs[k - 1]), len(key)] if (runs := rows["archive"].to_pylist()) else []
        merged = [k[3] for k in LoserTree([key[a:b] for a, b in zip(cut, cut[1:], strict=False)])]
        yield from rows.take(pa.array(merged)).combine_chunks().to_batches(max_chunksize=10_000)

    return captures.repartitionByRange(ranges, F.col("url_key"), F.col("captured"), F.col("page_id")).mapInArrow(merge, captures.schema).select(*names)


def archive_pages(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write, read back and index: one row per page, in the global order of the capture index."""
    spark = pages.sparkSession
    if folder is None:
        checkpoint(spark.range(1))
        folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder, id_col, url_col, body_col, min_bytes)
    return merge_index(checkpoint(read_captures(spark, folder))).withColumnRenamed("page_id", id_col)
