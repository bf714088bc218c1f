"""Term banks as files: a Python data source that writes numbered JSON arrays, all of them or none.

A bank is a file `term_bank_<n>.json` with `size` rows, the last one with the rest. Rows come numbered and dealt so that a bank is in one
task. Tasks write files under names of their own attempt, so tasks that run twice don't meet; the commit checks that banks follow on
each other without a gap and that all but the last are full, writes the index beside them, and only then gives the
files their names. If a task fails, the abort removes what there is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.order import global_numbers
from .shared import checkpoint

BANK = 10_000
SCHEMA = "bank long, place long, value string"


def _system(path: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))


@dataclass
class Written(WriterCommitMessage):
    """Banks that a task has written: number, rows, and the name of the file."""

    banks: list[tuple[int, int, str]] = field(default_factory=list)


class BankWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size, self.index = options["path"].rstrip("/"), int(options.get("size", BANK)), options.get("index", "{}")
        self.attempt = uuid.uuid4().hex

    def write(self, iterator: Iterator[Any]) -> Written:
        system, folder = _system(self.path)
        out, task = Written(), uuid.uuid4().hex
        try:
            for bank, rows in groupby(iterator, lambda r: r[0]):
                name, n, last = f"_{self.attempt}-{task}-{bank}", 0, None
                out.banks.append((bank, 0, name))
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{folder}/{name}", compression=None) as f:
                    for _, place, value in rows:
                        if last is not None and place <= last:
                            raise ValueError(f"the rows of bank {bank} are not in order")
                        f.write((b"[" if n == 0 else b",") + value.encode())
                        n, last = n + 1, place
                    f.write(b"]")
                out.banks[-1] = (bank, n, name)
        except BaseException:
            self._remove([out])
            raise
        return out

    def _remove(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, folder = _system(self.path)
        for name in (b[2] for m in messages if m for b in m.banks):
            if system.get_file_info(f"{folder}/{name}").type == fs.FileType.File:
                system.delete_file(f"{folder}/{name}")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        banks = sorted(b for m in messages if m for b in m.banks)
        bad = [n for k, (n, rows, _) in enumerate(banks, 1) if n != k or rows > self.size or (rows < self.size and k < len(banks))]
        if bad:
            self._remove(messages)
            raise ValueError(f"banks must follow on each other and be full: {bad[:5]}")
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(f"{folder}/index.json", compression=None) as f:
            f.write(self.index.encode())
        for n, _, name in banks:
            system.move(f"{folder}/{name}", f"{folder}/term_bank_{n}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._remove(messages)


class TermBanks(DataSource):
    """df.write.format("term_banks").mode("append").save(path), of rows (bank, place, value), each bank in one task and in order."""

    @classmethod
    def name(cls) -> str:
        return "term_banks"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: Any, overwrite: bool) -> BankWriter:
        if overwrite:
            raise ValueError("banks are written to a new folder")
        return BankWriter(dict(self.options))


def bank_rows(rows: DataFrame, entry: list[str], within: list[str], value: Column, size: int = BANK) -> DataFrame:
    """bank (from 1), place (from 0, over all banks), sequence (of the entry, from 1), value: rows in the order of their entries, each bank exactly full.

    value: a column over the rows and `sequence`. An entry's rows may go on in the next bank."""
    w = Window.partitionBy(*entry)
    numbered = rows.withColumn("_at", F.row_number().over(w.orderBy(*within)) - 1)
    counts = checkpoint(rows.groupBy(*entry).agg(F.count("*").alias("_rows")))  # a number an entry, read four times
    before = global_numbers(counts, entry, {"_entry": F.lit(1), "_before": F.col("_rows")}).select(*entry, (F.col("_entry") + 1).alias("sequence"), "_before")
    out = numbered.join(before, entry).withColumn("place", F.col("_before") + F.col("_at"))
    return out.select((F.floor(F.col("place") / size) + 1).cast("long").alias("bank"), F.col("place").cast("long").alias("place"), F.col("sequence").cast("long").alias("sequence"), value.alias("value"))


def term_value(text: Column, reading: Column, tags: Column, rules: Column, score: Column, glossary: Column, sequence: Column) -> Column:
    """One row of a bank as JSON: an array of texts, a number, the glosses, the sequence and a last empty text."""
    texts = F.to_json(F.array(*(F.coalesce(c, F.lit("")) for c in (text, reading, tags, rules))))
    return F.concat(F.substring(texts, F.lit(1), F.length(texts) - 1), F.lit(","), score.cast("string"), F.lit(","), F.to_json(F.coalesce(glossary, F.array().cast("array<string>"))), F.lit(","), sequence.cast("string"), F.lit(',""]'))


def write_term_banks(banked: DataFrame, path: str, index: dict | None = None, size: int = BANK, tasks: int | None = None) -> None:
    """banked: rows of bank_rows(). Writes a new folder of term_bank_<n>.json, and index.json with what is given."""
    spark = banked.sparkSession
    spark.dataSource.register(TermBanks)
    dealt = banked.select("bank", "place", "value")
    dealt = (dealt.repartition(tasks, "bank") if tasks else dealt.repartition("bank")).sortWithinPartitions("bank", "place")
    dealt.write.format("term_banks").mode("append").option("size", str(size)).option("index", json.dumps(index or {}, ensure_ascii=False, sort_keys=True)).save(path)
