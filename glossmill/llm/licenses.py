"""License scans by diagonal voting.

The rolling hashes of all 3-word runs of all texts are joined with the positions of the license
templates' runs. A hit votes for the diagonal (text position minus template position); votes are
summed by text, template and diagonal, diagonals that lie within `slack` words are merged into one
span, and the spans are verified on the words of the text, which gives each its share of the
template. Short phrases must stand in full; longer templates count from `threshold` on.

Words: A-Z lower-cased, then runs of all but ASCII other than letters and digits.

Defined cases: null and empty texts have no words and no labels; texts under three words match
nothing; rows without an id, and rows that repeat one, are judged each by its own text; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tiling import one

GRAM = 3
#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Further templates, label and wording as their publishers print them.
TEMPLATES = [
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0 universal"),
]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, threshold: float = 0.8, slack: int = 2, full_below: int = 7) -> DataFrame:
    """Per row: id, n_words, spans array<struct(label, template, first, last, votes, share)>; template indexes BASE, then `templates`.

    A template of fewer than `full_below` words counts only where its words stand in full and in a row."""
    known = [(label, phrase) for phrase, label in BASE] + (TEMPLATES if templates is None else templates)
    words = [one(phrase) for _, phrase in known]
    for label, w in zip(known, words, strict=True):
        if len(w[0]) < GRAM:
            raise ValueError(f"the template of {label[0]} has fewer than {GRAM} words")
    places = [(int(v), t, p) for t, w in enumerate(words) for p, v in enumerate(K.grams(w[0], GRAM).view(np.int64))]
    spark = docs.sparkSession
    where = F.broadcast(spark.createDataFrame(places, "hash long, template int, place int"))  # as many rows as the templates given have words

    def runs_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, data in K.chunks(batch):
                h, _, _, row = K.word_hashes(data, off, K.ALNUM)
                g = K.grams(h, GRAM)
                g = np.concatenate([g, np.zeros(len(h) - len(g), np.uint64)])  # the last two of a row may cross into the next; verified later
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cut), pa.array(g.view(np.int64)))], names=["row", "runs"])

    # ids may be null or repeat: votes belong to a row's id and text together
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("row", F.xxhash64("id", "text"))
    runs = texts.select("row", "text").mapInArrow(runs_of, "row long, runs array<long>").select("row", F.posexplode("runs").alias("pos", "hash"))
    hits = runs.join(where, "hash").select("row", "template", (F.col("pos") - F.col("place")).alias("diagonal"))
    votes = hits.groupBy("row", "template", "diagonal").agg(F.count("*").cast("int").alias("votes"))
    listed = votes.groupBy("row").agg(F.collect_list(F.struct("template", "diagonal", "votes")).alias("votes"))

    def merged(found: list[dict]) -> list[tuple[int, list[int], int]]:
        """(template, diagonals, votes) of neighbouring diagonals of one template."""
        out: list[tuple[int, list[int], int]] = []
        for v in sorted(found, key=lambda v: (v["template"], v["diagonal"])):
            t, d = v["template"], v["diagonal"]
            if out and out[-1][0] == t and d - out[-1][1][-1] <= slack and len(words[t][0]) >= full_below:
                out[-1] = t, [*out[-1][1], d], out[-1][2] + v["votes"]
            else:
                out.append((t, [d], v["votes"]))
        return out

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, off, data in K.chunks(batch):
                start, end, row = K.words(data, off, K.ALNUM)
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                found = batch.column(2).slice(lo, hi - lo)
                out = []
                for k in range(hi - lo):
                    spans = []
                    if found[k].is_valid:
                        n, base = int(cut[k + 1] - cut[k]), int(cut[k])
                        for t, diagonals, votes in merged(found[k].as_py()):
                            h, ts, te, text = words[t]
                            if len(diagonals) == 1 and votes < len(h) - GRAM + 1 and len(h) < full_below:
                                continue
                            matched: set[int] = set()
                            at: list[int] = []
                            for d in diagonals:
                                for j in range(max(0, -d), min(len(h), n - d)):
                                    i = base + d + j
                                    if K.LOWER[data[start[i] : end[i]]].tobytes() == text[ts[j] : te[j]]:
                                        matched.add(j)
                                        at.append(d + j)
                            share = len(matched) / len(h)
                            if share >= (1.0 if len(h) < full_below else threshold):
                                spans.append({"label": known[t][0], "template": t, "first": min(at), "last": max(at), "votes": votes, "share": share})
                    out.append(spans)
                kind = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("votes", pa.int32()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(cut)), pa.array(out, kind)], names=["id", "n_words", "spans"])

    schema = "id long, n_words long, spans array<struct<label:string,template:int,first:long,last:long,votes:int,share:double>>"
    return texts.join(listed, "row", "left").select("id", "text", "votes").mapInArrow(verify, schema).withColumnRenamed("id", id_col)


def license_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest share of a template)."""
    s = scan_licenses(docs, id_col, text_col)
    base = F.filter("spans", lambda x: x["template"] < len(BASE))
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda x: x["label"]))), ",")
    first = F.transform(base, lambda x: x["first"])
    return s.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
