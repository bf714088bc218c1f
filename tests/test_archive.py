"""Gzip archives read by stretches, against whole reads."""

import gzip
import io
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glossmill.sources import archive as Z

rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]


def lines(n, longest=60):
    return "".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, longest))) + rng.choice(["\n", "\n", "\r\n", "é\n"]) for _ in range(n)).encode()


def small_blocks(data, level=6, memory=1):
    """One member with many blocks."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31, memory)
    return c.compress(data) + c.flush()


FILES = {
    "plain": small_blocks(lines(3000)),
    "large": gzip.compress(lines(20_000), 9),
    "members": b"".join(gzip.compress(lines(rng.randint(1, 400))) for _ in range(40)),
    "mixed": small_blocks(lines(1500)) + gzip.compress(b"") + small_blocks(lines(1500), 1, 2) + b"\0" * 20,
    "noise": small_blocks(bytes(rng.randrange(256) for _ in range(60_000)).replace(b"\n", b" ") + b"\n" + lines(500)),
    "open_end": gzip.compress(lines(2000) + b"no end"),
    "empty": gzip.compress(b""),
    "one_line": small_blocks(lines(1, 30_000)),
    "flat": small_blocks(b"a" * 3_000_000 + b"\nb\n"),
}


def reader(data):
    return lambda at, n: data[at : at + n]


def test_text_from_any_start_found():
    for name, data in FILES.items():
        whole = b"".join(Z.inflated(reader(data), 0, None))
        assert whole == gzip.GzipFile(fileobj=io.BytesIO(data)).read(), name
        ends = 0
        for begin in range(7_000, len(data), 23_000):
            found = Z.first_start(reader(data), begin, len(data))
            if not found:
                continue
            bit, member = found
            before = b"".join(Z.inflated(reader(data), 0, None, bit))
            rest = b"".join(Z.inflated(reader(data), bit, None if member else before[-Z.WINDOW :]))
            assert before + rest == whole and bit >= 8 * begin, name
            ends += 1
        assert ends or name in ("empty", "flat", "noise"), name


@pytest.mark.parametrize("stretch", [9_000, 50_000, 10_000_000])
def test_lines_and_places_for_any_stretch(spark, tmp_path, stretch):
    for name, data in FILES.items():
        (tmp_path / f"{name}.gz").write_bytes(data)
    Z.gzip_index(spark, str(tmp_path), stretch).write.parquet(str(tmp_path) + "-index")  # once, to be read as often as needed
    index = spark.read.parquet(str(tmp_path) + "-index")
    got: dict = {}
    for r in Z.read_gzip_lines(index).collect():
        got.setdefault(r.file, []).append((r.place, r.value))
    for name, data in FILES.items():
        text, want, at = gzip.GzipFile(fileobj=io.BytesIO(data)).read(), [], 0
        for raw in text.split(b"\n"):
            if at < len(text):
                want.append((at, raw.removesuffix(b"\r").decode("utf-8", "replace")))
            at += len(raw) + 1
        assert sorted(got.get(f"{name}.gz", [])) == want, name
    if stretch == 9_000:
        n = {r.f: r.n for r in index.groupBy(F.element_at(F.split("path", "/"), -1).alias("f")).agg(F.count("*").alias("n")).collect()}
        assert n["plain.gz"] > 5 and n["members.gz"] > 5 and n["large.gz"] > 5


def test_jsonl_by_index_equals_the_plain_reader(spark, tmp_path):
    from glossmill.sources import files as I

    rows = spark.range(3000).select("id", F.concat(F.lit("wörd"), F.col("id")).alias("word"))
    rows.repartition(2).write.json(str(tmp_path / "d"), compression="gzip")
    schema = "id long, word string"
    a = Z.read_gzip_jsonl(Z.gzip_index(spark, str(tmp_path / "d" / "*.gz"), 2_000), schema).orderBy("ordinal").drop("ordinal").collect()
    b = I.read_jsonl(spark, str(tmp_path / "d"), schema).orderBy("ordinal").drop("ordinal").collect()
    assert a == b and len(a) == 3000


def test_little_is_read_for_small_stretches():
    data, read = FILES["large"] * 3, []

    def counted(at, n):
        read.append(len(data[at : at + n]))
        return data[at : at + n]

    begin, size = 150_000, 20_000
    bit, member = Z.first_start(counted, begin, begin + size)
    found = sum(read)
    end, _ = Z.first_start(reader(data), begin + size, len(data))
    read.clear()
    measured = Z._measure(counted, bit, end, member)
    assert found < 400_000 and sum(read) < 3 * ((end - bit) // 8 + 40_000)  # a megabyte for each header by chance and six for each stretch, before
    before = b"".join(Z.inflated(reader(data), 0, None, bit))
    upto = b"".join(Z.inflated(reader(data), 0, None, end))
    assert measured["size"] == len(upto) - len(before)


def test_stretches_are_dealt_to_many_tasks(spark, tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    for k in range(6):
        (tmp_path / "a" / f"{k}.gz").write_bytes(FILES["plain"])
    monkeypatch.setattr(Z, "TASK_TEXT", 50_000, raising=False)
    Z.gzip_index(spark, str(tmp_path / "a"), 9_000).write.parquet(str(tmp_path / "index"))
    lines_ = Z.read_gzip_lines(spark.read.parquet(str(tmp_path / "index")))
    assert lines_.select(F.spark_partition_id()).distinct().count() > 8  # one, before: small rows were taken together
