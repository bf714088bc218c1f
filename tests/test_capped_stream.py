"""The capped stream equals the capped batch filter for any cut into batches."""

import json
import os
import random

import pandas as pd
import pyarrow as pa
import pytest

from glossmill.operators import evidence as E
from glossmill.sources import files as I
from glossmill.streaming import capped as C

rng = random.Random(6)
LANGS, TERMS = ["ja", "cmn", "fr"], ["銀行", "", "bank", "岸"]


def entry():
    some = lambda n: [{"code": rng.choice(LANGS), "word": rng.choice(TERMS), "sense": rng.choice([None, "a bank"])} for _ in range(rng.randint(0, n))]
    return {"word": rng.choice(["bank", "shore", "", "row"]), "pos": rng.choice(["noun", None]), "lang_code": rng.choice(["en", "en", "en", "de"]), "senses": [{"id": "s1", "glosses": ["a bank"], "translations": some(4)}], "translations": some(6)}


@pytest.mark.parametrize("files_per_batch", [2, 100])
def test_stream_equals_batch_for_any_cut(spark, tmp_path, files_per_batch):
    rng.seed(9)
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(7):
        path = folder / f"f{k}.json"
        path.write_text("".join(json.dumps(entry(), ensure_ascii=False) + "\n" for _ in range(20)), encoding="utf-8")
        os.utime(path, (1_700_000_000 + k * 60,) * 2)
    entries = I.with_ordinal(spark.read.schema(E.ENTRY_SCHEMA).json(str(folder)))
    every, _ = E.filter_evidence(entries, "w", "en", "v", per_entry=3, total=10**9)
    total, out = every.count() - 40, str(tmp_path / "out")
    query = C.stream_capped(C.read_entries(spark, str(folder), files_per_batch), out, "w", "en", "v", per_entry=3, total=total)
    query.awaitTermination()
    assert query.exception() is None
    kept, _ = E.filter_evidence(entries, "w", "en", "v", per_entry=3, total=total)
    columns = ["evidence_id", "word", "lang", "term", "scope", "sense_index", "hint", "ambiguity"]
    batch = sorted(map(repr, kept.select("ordinal.file", *columns).collect()))
    stream = sorted(map(repr, spark.read.parquet(f"{out}/rows").select("ordinal.file", *columns).collect()))
    assert stream == batch and len(batch) == total


def test_counters_are_forgotten_by_event_time(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    one = {"word": "bank", "pos": "noun", "lang_code": "en", "senses": [{"id": "s", "glosses": ["g"]}], "translations": [{"code": "ja", "word": "銀行"}]}
    # the third file moves the watermark past the timer, which is seen with the fourth
    for k, day in enumerate((0, 1, 100, 101, 200)):
        path = folder / f"f{k}.json"
        path.write_text(json.dumps(one if k not in (2, 3) else one | {"word": "other"}) + "\n")
        os.utime(path, (1_700_000_000 + day * 86_400,) * 2)
    out = str(tmp_path / "out")
    C.stream_capped(C.read_entries(spark, str(folder), 1), out, "w", "en", "v", keep_days=10, late="1 day").awaitTermination()
    got = sorted((r.file, r.source_entry_id[-1]) for r in spark.read.parquet(f"{out}/rows").selectExpr("ordinal.file", "source_entry_id").collect())
    assert got == [("f0.json", "0"), ("f1.json", "1"), ("f2.json", "0"), ("f3.json", "1"), ("f4.json", "0")]


def test_counters_see_no_records():
    class Held:
        def __init__(self):
            self.value, self.timers = None, []

        exists = lambda self: self.value is not None
        get = lambda self: self.value
        update = lambda self, value: setattr(self, "value", value)
        getValueState = lambda self, name, schema: self
        listTimers = lambda self: iter(self.timers)
        deleteTimer = lambda self, t: self.timers.remove(t)
        registerTimer = lambda self, t: self.timers.append(t)

    ts = pa.array([1_700_000_000_000_000] * 1000, pa.timestamp("us"))
    rows = pa.RecordBatch.from_arrays([pa.array(["bank"] * 999 + ["shore"]), pa.array(["f1"] * 600 + ["f0"] * 400), ts], names=["key", "file", "ts"])
    parts = pd.concat(b.to_pandas() for b in C.counted([rows, rows]))
    assert len(parts) == 6 and parts.n.sum() == 2000  # 2000 rows with their records, before
    held, counter = Held(), C.Occurrences(5)
    counter.init(held)
    bank = parts[parts.key == "bank"]
    for already in (0, 1998):
        (out,) = counter.handleInputRows(("bank",), iter([bank[:1], bank[1:]]), None)
        assert out.to_dict("list") == {"key": ["bank"] * 2, "file": ["f0", "f1"], "first": [already, already + 798]} and held.timers == [1_700_000_000_005]


def test_records_of_one_key_in_many_blocks(spark, tmp_path):
    folder, out = tmp_path / "in dir", str(tmp_path / "out")
    folder.mkdir()
    one = lambda n: {"word": "bank", "pos": "noun", "lang_code": "en", "pageid": n, "senses": [{"id": "s", "glosses": ["g"]}], "translations": [{"code": "ja", "word": "銀行"}]}
    for k in range(3):
        (folder / f"f{k}.json").write_text("".join(json.dumps(one(100 * k + i)) + "\n" for i in range(100)))
    with_blocks = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(with_blocks)
    spark.conf.set(with_blocks, "4k")
    try:
        query = C.stream_capped(C.read_entries(spark, str(folder), 2), out, "w", "en", "v", total=250)
        query.awaitTermination()
    finally:
        spark.conf.set(with_blocks, was)
    assert {len(p["sources"]) for p in query.recentProgress} == {1}  # both branches read the same files
    rows = spark.read.parquet(f"{out}/rows").selectExpr("page_id", "source_entry_id", "ordinal.block").collect()
    assert sorted((r.page_id, int(r.source_entry_id.rsplit(":", 1)[1])) for r in rows) == [(n, n) for n in range(250)]
    assert len({r.block for r in rows}) > 2
