"""A JSON document read by ranges, against a parser."""

import json
import random

import pytest

from glossmill.sources import documents as D

rng = random.Random(3)
ODD = ['"', "\\", "\\\\", '\\"', "{", "}", "[", "]", "é", "語", "words", '"words": [', ":", "\n", "x"]


def text():
    return "".join(rng.choice(ODD) for _ in range(rng.randint(0, 12)))


def value(depth=0):
    kind = rng.randint(0, 4 if depth < 3 else 1)
    if kind == 0:
        return text()
    if kind == 1:
        return rng.randint(-5, 5)
    if kind == 2:
        return [value(depth + 1) for _ in range(rng.randint(0, 3))]
    return {text() + str(k): value(depth + 1) for k in range(rng.randint(0, 3))}


def documents():
    out = {}
    for n in range(4):
        words = [{"id": str(k), "v": value()} for k in range(rng.randint(0, 40))]
        doc = {"tags": {text(): text(), "words": ["no"]}, "list": [value() for _ in range(3)], "words": words, "end": [text()], "last": {"words": [{"not": 1}]}}
        out[f"d{n}.json"] = (json.dumps(doc, ensure_ascii=n % 2 == 0, indent=None if n < 2 else 1), words)
    out["empty.json"] = ('{"words" : [ ], "x": "\\\\"}', [])
    return out


@pytest.mark.parametrize("size", [5, 64, 1000, 1 << 20])
def test_elements_of_any_range(spark, tmp_path, size):
    docs = documents()
    for name, (raw, _) in docs.items():
        (tmp_path / name).write_text(raw, encoding="utf-8")
    if size == 5:  # each byte range by hand, without Spark
        for raw, words in docs.values():
            data = raw.encode()
            read = lambda at, n, data=data: data[at : at + n]
            whole = D.nested(D.np.frombuffer(data, D.np.uint8), 0, False, 0)
            place, byte, depth, _ = whole
            opens = next(int(p) for p, b, d in zip(place, byte, depth, strict=True) if b == 91 and d == 2 and data[: int(p)].rstrip().endswith(b":") and D._NAME.search(data[: int(p)])[1] == b"words")
            closes = next(int(p) for p, b, d in zip(place, byte, depth, strict=True) if b == 93 and d == 1 and p > opens)
            got, in_string, deep = [], False, 0
            for at in range(0, len(data), size):
                got += [json.loads(x) for x in D.elements(read, at, size, in_string, deep, opens, closes, 2)]
                part = D.np.frombuffer(read(at, size), D.np.uint8)
                _, _, d, in_string = D.nested(part, D.backslashes_before(read, at), in_string, deep)
                deep = int(d[-1]) if len(d) else deep
            assert got == words
        return
    rows = D.read_json_array(spark, str(tmp_path), "words", size).collect()
    for name, (_, words) in docs.items():
        mine = sorted((r.ordinal, r.value) for r in rows if r.file == name)
        assert [k for k, _ in mine] == list(range(len(words))) and [json.loads(v) for _, v in mine] == words


def test_whole_arrays_and_missing_ones(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"a": "]}"}, {"a": [{"b": 1}]}, 3]')
    assert [json.loads(r.value) for r in D.read_json_array(spark, str(tmp_path / "a.json"), None, 6).orderBy("ordinal").collect()] == [{"a": "]}"}, {"a": [{"b": 1}]}]
    for bad in ('{"other": []}', '{"words": [1'):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(Exception, match="no whole array"):
            D.read_json_array(spark, str(tmp_path / "b.json"), "words", 6).count()


def test_large_lexicon_equals_the_plain_reader(spark, tmp_path):
    from glossmill.sources import files as I

    words = [{"id": str(k), "kanji": [{"text": f"語{k}", "common": k % 2 == 0, "tags": ["a"]}], "kana": [{"text": '"\\', "common": True}], "sense": [{"partOfSpeech": ["n"], "related": [["x", 1]], "gloss": [{"lang": "eng", "text": text()}]}]} for k in range(200)]
    doc = {"version": "1", "languages": ["eng"], "dictDate": "d", "commonOnly": False, "tags": {"n": "noun"}, "words": words}
    (tmp_path / "lex.json").write_text(json.dumps(doc, ensure_ascii=False, separators=(",", ":")))  # nested JSON kept as text is compact in one reader
    a, ha = I.read_lexicon_json(spark, str(tmp_path / "lex.json"))
    b, hb = D.read_large_lexicon(spark, str(tmp_path / "lex.json"), 700)
    assert a.orderBy("ordinal").collect() == b.drop("file").withColumn("ordinal", b.ordinal.cast("int")).orderBy("ordinal").select(a.columns).collect()
    assert ha.collect() == hb.drop("file").collect()
