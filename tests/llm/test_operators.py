"""Each operator against brute force, on small tables with nulls, blanks, ties, repeats, long texts and clashing columns."""

import base64
import hashlib
import random
import re
import tempfile
import zlib

import pytest

DOCS = "doc_id long, text string, id string, seeds string, text_ string"
rng = random.Random(7)
SYLLABLES = "ka to mi ren sol var del ing est ou th er on né ñu 京".split()


def prose(n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) + rng.choice(["", "", "", ",", ".", ".\n"]) for _ in range(n))


def corpus():
    base, passage = prose(120), prose(40)
    texts = [base, base, base.replace(base.split()[60], "changed"), base + " " + prose(8), None, "", "   ", "one two", "One  TWO", "a" * 300, "a" * 170, passage + " " + prose(50), prose(30) + "\n" + passage, prose(60) + passage[:200], "é" * 60 + passage, prose(4000)]
    w = base.split()
    for k in range(6):
        v = list(w)
        for j in rng.sample(range(len(v)), k):
            v[j] = "x" + str(k)
        texts.append(" ".join(v))
    rows = [(i, t, "clash", "clash", None) for i, t in enumerate(texts)]
    return rows + [rows[0], (3, texts[3], None, None, "y"), (None, base, "c", "c", "c"), (None, None, None, None, None)]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


# --- 1 ------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, docs, none):
    import public_tokenizers as P
    import tiktoken

    from glossmill.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = sorted(map(repr, bpe.digest_documents(docs, path, P.PATTERN).collect()))
    want = []
    for i, t, *_ in ROWS:
        ids = enc.encode_ordinary(t or "")
        row = (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest(), len(t or ""))
        want.append("Row(doc_id=%r, n_tokens=%r, ids_sha256=%r, decoded_sha256=%r, n_chars=%r)" % row)
    assert got == sorted(want)
    assert bpe.digest_documents(none, path, P.PATTERN).count() == 0
    full = bpe.encode_documents(docs.limit(4), path, P.PATTERN).collect()
    assert all(enc.decode(r.ids) == r.decoded for r in full)


def test_bpe_space_runs_and_streams():
    import public_tokenizers as P
    import tiktoken

    from glossmill.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    c = bpe.codec(path, P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for t in ["  a\n\n b", "x  y", "a \t b ", " lead", "trail ", "don't we'll  'tis", "\x1c a", "12 345\n6", "🎉 日本 語", "é́ x", "a" * 999]:
        assert c.encode(t) == ",".join(map(str, enc.encode_ordinary(t))), t
    assert list(c.encode_all(["", "a b", "", " c", "a b"])) == [",".join(map(str, enc.encode_ordinary(t))) for t in ("", "a b", "", " c", "a b")]
    s = bpe.Utf8Stream()
    raw = "a é 京 🎉".encode()
    assert "".join(s.feed(raw[k : k + 1]) for k in range(len(raw))) + s.close() == "a é 京 🎉"
    assert s.feed(b"\xf0\x9f") + s.close() == "�"
    for k in range(300):  # cut anywhere, valid or not, as the whole is decoded
        raw = bytes(rng.choice(b"a\x80\xbf\xc3\xe0\xa0\x9f\xed\xf0\x90\xf4\x8f\xff") for _ in range(rng.randint(0, 9)))
        assert "".join(s.feed(raw[k : k + 1]) for k in range(len(raw))) + s.close() == raw.decode("utf-8", "replace"), raw


def test_bpe_pieces_read_together_and_alone(monkeypatch):
    """Against the definition of merging, with states thrown away now and then, long pieces and long pending strings."""
    import public_tokenizers as P

    from glossmill.llm import bpe

    one = bpe.Transducer(bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
    many = bpe.Many(one)
    pieces = [bytes(rng.choice(b"abcdeinrst ") for _ in range(rng.randint(1, 30))) for _ in range(400)] + [bytes(rng.randrange(256) for _ in range(rng.randint(1, 12))) for _ in range(300)] + [b" " * k for k in (1, 7, 30, 60)] + [b"-" * 45, b"=" * 47, "京都".encode() * 5, b"tentententententent" * 2]
    want = [",".join(map(str, [one.ranks[p]] if one.ranks.get(p) in one.apart else one.merged(p))) for p in pieces]
    keep = [k for k, p in enumerate(pieces) if p not in one.ranks]  # tokens are looked up before
    for size in (1 << 30, 0):
        monkeypatch.setattr(bpe, "MANY_BYTES", size)
        for lo in range(0, len(keep), 250):
            part = keep[lo : lo + 250]
            assert many.encode([pieces[k] for k in part]) == [want[k] for k in part]
    monkeypatch.setattr(bpe, "STATE_BYTES", 3000)
    assert [",".join(map(str, one.encode(p))) for p in pieces] == want


def test_bpe_long_texts_without_spaces_are_not_kept():
    import public_tokenizers as P

    from glossmill.llm import bpe

    c = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)) for _ in range(20)]
    out = list(c.encode_all(texts))
    assert [b"".join(b for b, _ in c.decode(o)).decode() for o in out] == texts
    assert not any(t in c.new or t in c.old for t in texts) and c.transducer.held <= bpe.STATE_BYTES + 4000


def test_bpe_keeps_states_in_little_and_cuts_words_without_the_pattern(monkeypatch):
    import public_tokenizers as P
    import tiktoken

    from glossmill.llm import bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    c = bpe.Codec(bpe.read_ranks(path), P.PATTERN)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    find, found = c.find, []
    c.find = lambda cut: found.append(cut) or find(cut)
    words = ["".join(rng.choice("abcdeinrst") for _ in range(rng.randint(3, 12))) for _ in range(4000)]
    text = " ".join(w + rng.choice(["", "", ",", "."]) for w in words)
    assert c.encode("a " + text) == ",".join(map(str, enc.encode_ordinary("a " + text))) and len(found) <= 1
    for odd in ["foo\n", "a foo\n b", "a foo b\n", "foo\n", "", " ", "  ", " foo", "foo ", "\n foo", "a\x85 b", "a \x1cb", "don' t", "a ' 's b"]:
        assert c.encode(odd) == ",".join(map(str, enc.encode_ordinary(odd))), odd
    many = c.many
    pieces = [(" " + w).encode() for w in words]
    monkeypatch.setattr(bpe, "MANY_BYTES", 600 * many.n)  # enough for all states with their moves
    want = many.encode(pieces)
    make, made = many.make, []
    many.make = lambda key: made.append(len(key)) or make(key)
    assert many.encode(pieces) == want and not made  # nothing was thrown away


def test_numbers_by_key():
    import numpy as np

    from glossmill.llm import bpe

    known, given = {}, np.random.default_rng(1)
    numbers = bpe.Numbers(8)
    for _ in range(30):
        key = np.setdiff1d(np.unique(given.integers(0, 5000, 100)) << 8, np.array(list(known), np.int64))
        number = np.arange(len(known), len(known) + len(key))
        numbers.add(key, number)
        known.update(zip(key.tolist(), number.tolist()))
        asked = given.integers(0, 5000, 300) << 8
        assert numbers.find(asked).tolist() == [known.get(x, -1) for x in asked.tolist()]


# --- 2 ------------------------------------------------------------------------------------------


def brute_repeats(rows):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            if i is not None:
                first[b[k : k + 50]] = min(first.get(b[k : k + 50], i), i)
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        drop = [False] * len(b)
        for k in range(len(b) - 49):
            if i is not None and first[b[k : k + 50]] < i:
                drop[k : k + 50] = [True] * 50
        spans = sum(x and (k == 0 or not drop[k - 1]) for k, x in enumerate(drop))
        out.append((i, len(b), sum(drop), spans, hashlib.sha256(bytes(c for c, x in zip(b, drop) if not x)).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("kind", [{}, {"hot": 2}, {"bits": 5, "pack_bytes": 4000}, {"hot": 3, "pack_bytes": 2000}, {"hot": 2, "bits": 4, "pack_bytes": 3000}])
def test_suffix_dedup(spark, docs, none, kind):
    """Also with windows dealt one by one, many packs, and hashes so short that nearly all collide."""
    from glossmill.llm import suffix

    got = suffix.dedup_substrings(docs, **kind).drop("kept").collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_repeats(ROWS)
    assert suffix.dedup_substrings(none, **kind).count() == 0


def test_suffix_dedup_of_many_repeated_passages(spark):
    """Passages in most documents, between other words, some twice in a document, some in rows with the same id."""
    from glossmill.llm import suffix

    r = random.Random(3)
    passages = [prose(r.randint(8, 40)) for _ in range(6)]
    rows = [(r.randint(0, 90), " ".join(x for _ in range(r.randint(1, 5)) for x in (prose(r.randint(0, 9)), r.choice(passages)[r.randint(0, 30) :]))) for _ in range(120)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_repeats(rows)
    for kind in ({}, {"hot": 20, "pack_bytes": 3000}, {"hot": 20, "bits": 6, "pack_bytes": 3000}):
        got = suffix.dedup_substrings(frame, texts_too=False, **kind).drop("kept").collect()
        assert sorted(repr(tuple(x)) for x in got) == want


def test_suffix_dedup_carries_columns_and_whole_code_points(spark):
    from glossmill.llm import suffix

    rows = [(1, "é" * 40 + "x", "a"), (1, "é" * 40 + "y", "b"), (2, "zé" + "é" * 40, None)]
    got = suffix.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string, kept string"), carry=("text",)).toDF(*"abcdefg").collect()
    assert sorted((r.a, r.f, r.g) for r in got) == [(1, rows[0][1], rows[0][1]), (1, rows[1][1], rows[1][1]), (2, "z", rows[2][1])]


def test_suffix_sort_orders_and_survives_collisions():
    import numpy as np

    from glossmill.llm import suffix

    r = np.random.default_rng(1)
    rows = r.integers(97, 99, (300, 12)).astype(np.uint8)
    group = np.sort(r.integers(0, 4, 300)).astype(np.uint64)
    for bits in (64, 3, 1):
        order, shared = suffix.Extensions(rows, bits).sorted(group)
        text = [(int(group[k]), rows[k].tobytes()) for k in order]
        assert text == sorted(text)
        for k in range(1, 300):
            a, b = text[k - 1], text[k]
            assert shared[k] == (-1 if a[0] != b[0] else next((i for i in range(12) if a[1][i] != b[1][i]), 12))


def test_anchors_of_long_texts_do_not_depend_on_segments(monkeypatch):
    import numpy as np

    from glossmill.llm import suffix

    data = np.random.default_rng(2).integers(97, 100, 5000).astype(np.uint8)
    off = np.array([0, 30, 2500, 2500, 5000])
    whole = suffix.anchors(data, off)
    monkeypatch.setattr(suffix, "SEGMENT", 300)
    assert all((x == y).all() for x, y in zip(whole, suffix.anchors(data, off), strict=True))


# --- 3 ------------------------------------------------------------------------------------------


def test_decontamination(spark, docs, none):
    from glossmill.llm import tiling

    item = prose(30)
    w = item.split()
    swapped = " ".join(w[15:] + w[:15])
    half = " ".join(w[:12])
    rows = [(1, prose(20) + " " + item + " " + prose(20)), (2, prose(10) + " " + swapped), (3, half + " " + prose(40)), (4, prose(50)), (5, None), (6, ""), (7, "tiny item"), (None, item)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("items", tiling.F.lit(1))
    bench = spark.createDataFrame([(10, item), (11, prose(25)), (12, None), (13, ""), (14, "Tiny, item!")], "item_id long, text string")
    got = {r.doc_id: r for r in tiling.decontaminate(d, bench).collect()}
    assert {k: (r.contaminated, r.item_ids) for k, r in got.items()} == {1: (True, [10]), 2: (True, [10]), 3: (False, []), 4: (False, []), 5: (False, []), 6: (False, []), 7: (True, [14]), None: (True, [10])}
    assert got[2].n_tiles == 2 and got[2].coverage == 1.0 and 0 < got[3].coverage < 0.8
    assert tiling.decontaminate(none, bench).count() == 0
    assert tiling.decontaminate(d, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_equals_tiling_every_document_with_every_item(spark):
    from glossmill.llm import tiling

    r = random.Random(11)
    draw = lambda n: [r.choice("abcdefghijkl") * r.randint(1, 2) for _ in range(n)]
    items = [draw(n) for n in (24, 24, 30, 9, 4, 2, 1)]
    texts = [draw(n) for n in (0, 3, 10, 40, 80, 80)]
    for w in items[:4]:
        for size in (3, 4):  # pieces in another order, with a word between
            cut = [w[k : k + size] for k in range(0, len(w), size)]
            r.shuffle(cut)
            texts.append([x for c in cut for x in [*c, "zz"]])
        texts.append([x if k % 5 != 4 else "zz" for k, x in enumerate(w)])
    docs = [(k, " ".join(t)) for k, t in enumerate(texts)]
    bench = [(k, " ".join(w)) for k, w in enumerate(items)]
    want = {}
    for k, text in docs:
        found = []
        for n, other in bench:
            item = tiling.one(other)
            t = tiling.tiles(tiling.one(text), item, min(3, len(item[0])))
            found.append((sum(x for _, _, x in t) / len(item[0]), len(t), n))
        share, count, _ = max(found)
        want[k] = ([n for s, _, n in found if s >= 0.8], share, count)
    got = tiling.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {x.doc_id: (x.item_ids, x.coverage, x.n_tiles) for x in got.collect()} == want
    assert all(0 in want[k][0] for k in (6, 7))


def test_tiles_do_not_overlap_and_prefer_long_runs():
    from glossmill.llm import tiling

    doc, item = tiling.one("a b c d x a b c d e f g"), tiling.one("a b c d e f g q a b c")
    got = sorted(tiling.tiles(doc, item, 3))
    assert (0, 5, 7) in got and sum(k for _, _, k in got) == 10


# --- 4 ------------------------------------------------------------------------------------------


def test_media_round_trip(spark, docs, none):
    from glossmill.llm import webp

    got = webp.read_media(webp.store_media(docs)).collect()
    assert len(got) == len(ROWS)
    want = {}
    for i, t, *_ in ROWS:
        b = (t or "").encode()
        p = b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))
        want.setdefault(i, []).append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) in want[r.doc_id]
    assert webp.read_media(webp.store_media(none)).count() == 0


# --- 5 ------------------------------------------------------------------------------------------


def test_licenses(spark, none):
    from glossmill.llm import licenses

    rows = [(1, "Under the MIT License. under the mit license"), (2, "Apache License, Version 2.0 and CC BY-NC 4.0"), (3, "under the mit"), (4, None), (5, ""), (6, "GNU General Public License, version 3"), (7, "cc by cc by nc under the mit license" + " x" * 5000), (8, "redistribution and use in source or binary forms with or without modification are permitted provided that the following conditions are met"), (1, "nothing"), (None, "cc by nc")]
    got = licenses.license_digest(spark.createDataFrame(rows, "doc_id long, text string").withColumn("template", licenses.F.lit(0))).collect()
    pat = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = []
    for i, t in rows:
        w = pat.findall(lower(t))
        hit = [(j, label) for p, label in licenses.BASE for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        want.append(repr((i, len(w), len(hit), min((h[0] for h in hit), default=None), max((h[0] for h in hit), default=None), ",".join(sorted({h[1] for h in hit})))))
    assert sorted(repr((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got) == sorted(want)
    assert {r.doc_id: r.labels for r in got if r.doc_id in (6, 8)} == {6: "gpl", 8: "bsd"}
    assert licenses.license_digest(none).count() == 0


def test_license_templates_against_all_diagonals(spark):
    """Brute force over words: per template the diagonals with a common run of three words, neighbours merged, and the share of its words on them."""
    from glossmill.llm import licenses

    r = random.Random(5)
    texts = []
    for _ in range(60):
        _, phrase = r.choice(licenses.TEMPLATES)
        w = phrase.split()
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(w))
            w[k : k + 1] = r.choice([[], [w[k], "zz"], ["zz"], [w[k].upper()]])
        texts.append(" ".join([*prose(r.randint(0, 6)).split(), *w, "and", *r.choice(licenses.BASE)[0].split()[: r.randint(2, 4)]]))
    texts += [texts[0] + " " + texts[1], texts[2] * 2]
    pat = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    known = [(label, phrase) for phrase, label in licenses.BASE] + licenses.TEMPLATES

    def labels(text):
        d, out = pat.findall(lower(text)), set()
        for label, phrase in known:
            t = phrase.split()
            hits = sorted({i - j for j in range(len(t) - 2) for i in range(len(d) - 2) if d[i : i + 3] == t[j : j + 3]})
            groups = []
            for k in hits:
                if groups and len(t) >= 7 and k - groups[-1][-1] <= 2:
                    groups[-1].append(k)
                else:
                    groups.append([k])
            for g in groups:
                share = len({j for k in g for j in range(len(t)) if 0 <= j + k < len(d) and d[j + k] == t[j]}) / len(t)
                if share >= (0.8 if len(t) >= 7 else 1.0):
                    out.add(label)
        return ",".join(sorted(out))

    rows = [(k % 40, t) for k, t in enumerate(texts)]
    got = licenses.license_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((i, labels(t)) for i, t in rows)
    assert sorted((x.doc_id, x.labels) for x in got) == want and len({w for _, w in want}) > 8


# --- 6 ------------------------------------------------------------------------------------------


def test_warc(spark):
    from glossmill.llm import warc

    rows = [(3, "http://www.B.example/x", "<p>same"), (1, "http://a.example/y?q=1#f", "<p>same"), (2, None, None), (4, "https://c.example", ""), (5, "http://a.example/y?q=1", "line\r\n\r\nbreak"), (5, "http://a.example/y?q=1", "line\r\n\r\nbreak"), (6, "u\nrl", "né 京"), (None, "http://z.example/", "<p>same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("archive", warc.F.lit("x")).repartition(3)
    got = warc.archive_pages(pages).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        ref = first.get(h or "") if i != first.get(h or "") else None
        want.append(repr((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if ref is None else "revisit", ref)))
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == sorted(want)
    keys = [(r.url_key, r.captured) for r in got]
    assert keys == sorted(keys)
    assert warc.archive_pages(pages.where("false")).count() == 0
    # beyond the bound of a broadcast, and with many small ranges and archives
    bound = warc.BROADCAST_ROWS, warc.ARCHIVE_BYTES
    try:
        warc.BROADCAST_ROWS = 0
        folder = tempfile.mkdtemp() + "/w"
        warc.write_archives(pages, folder)
        again = warc.merge_index(warc.read_captures(spark, folder), range_rows=2).collect()
    finally:
        warc.BROADCAST_ROWS, warc.ARCHIVE_BYTES = bound
    assert sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in again) == sorted(want)
    assert [(r.url_key, r.captured) for r in again] == keys
    heads = [h for row in spark.read.parquet(folder).collect() for _, _, h, _ in warc.records(bytes(row.content))]
    ids = {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    assert all(h["WARC-Refers-To"] in ids for h in heads if h["WARC-Type"] == "revisit") and len({h["WARC-Record-ID"] for h in heads}) == len(rows) - 1


def test_loser_tree():
    from glossmill.llm.warc import LoserTree

    for k in range(8):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(LoserTree(runs)) == sorted(x for r in runs for x in r)


# --- 7 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(spark, docs, none, percent):
    from glossmill.llm import minhash

    sets = {}
    for i, t, *_ in ROWS:
        w = re.findall("[^\x20\x09-\x0d]+", lower(t))
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = minhash.near_duplicates(docs, percent=percent).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(repr((i, len(sets[i]) if i is not None else len({tuple(w[j : j + 5]) for w in [lower(t).split()] for j in range(max(1, len(w) - 4)) if w}), comp.get(i), i is None or comp[i] == i)) for i, t, *_ in ROWS)
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_large_star(spark, monkeypatch):
    """The head's pairs are dealt to many tasks."""
    from glossmill.llm import minhash

    monkeypatch.setattr(minhash, "STAR", 3)
    base = prose(100).split()
    rows = [(k, " ".join(base if k == 0 else [*base[:k], f"w{k}", *base[k + 1 :]])) for k in range(40)] + [(99, prose(60))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()}
    assert got == {**dict.fromkeys(range(40), 0), 99: 99}


def test_blocks_and_posterior():
    import numpy as np

    from glossmill.llm import minhash

    least = minhash.least_matches(0.85, 1e-6)
    assert least == sorted(least) and 0 < least[-1] < 0.85 * minhash.HASHES
    a = np.zeros((3, minhash.HASHES), np.uint16)
    b = a.copy()
    b[1] = 1
    assert minhash.survives(a, b, least).tolist() == [0, 2]


def test_large_buckets_are_cut_into_blocks(spark, monkeypatch):
    from glossmill.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 3)
    rows = [(7, 10, k, k % 4, bytes(2 * minhash.LONG)) for k in range(10)]
    members = spark.createDataFrame(rows, "bucket long, n long, rep long, comp long, sig binary")
    got = {tuple(r) for r in minhash.across(members, 85, 1e-6).collect()}
    assert got == {(a, b) for a in range(10) for b in range(a + 1, 10) if a % 4 != b % 4}


def test_components(spark):
    from glossmill.llm.frames import components

    edges = [(k, k + 1) for k in range(1, 30)] + [(100, 50), (50, 70), (70, 60), (9, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 31) if k > 1}, 100: 50, 70: 50, 60: 50}


# --- 8 ------------------------------------------------------------------------------------------


def test_toxicity(spark, none):
    from glossmill.llm import toxicity

    rows, labels = [], []
    for i in range(300):
        t = prose(40 if i % 7 else 150)
        bad = i % 3 == 0
        if bad:
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(["vileword", "slurword"])
            t = " ".join(w)
        rows.append((i, t))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, prose(2000) + " slurword"), (None, "a slurword here")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxic", toxicity.F.lit(0))
    lab = spark.createDataFrame(labels + [(0, None), (900, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(d, toxicity.train(d, lab)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(300))
    right = sum(got[i].predicted == (i % 3 == 0) for i in held) / len(held)
    assert right > 0.9 and got[902].predicted == 1 and got[900].score == got[901].score == 0.0
    assert toxicity.train(d, lab.where("toxic = 0")) is None
    assert toxicity.score_documents(none, None).count() == 0


def test_toxicity_reads_every_byte():
    import numpy as np

    from glossmill.llm import kernels as K
    from glossmill.llm import toxicity as T

    texts = ["plain words, incomprehensibilities", "", "京都の寺は古い" * 5, "a\u00a0long\u00a0joined\u00a0run", "ñ" * 31, "x" * 100, "😀😀😀 überraschungsgäste", "Привет" * 4, "it’s"]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0] + [len(t) for t in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    h, start, end, row = T.pieces(data, off)
    seen = np.zeros(len(data), bool)
    for a, b, i in zip(start.tolist(), end.tolist(), row.tolist(), strict=True):
        data[a:b].tobytes().decode()
        assert 0 < b - a <= 8 and off[i] <= a and b <= off[i + 1]
        seen[a : min(a + 4, b)] = seen[max(a, b - 4) : b] = True
    assert (seen == K.ALNUM[data]).all() and (np.diff(start) > 0).all()
    assert int(K.gram(h[:1])) and (row == 2).sum() == 35 and len(np.unique(h[row == 2])) == 7
    # a change in the middle of a long word, or far inside unspaced text, changes what the model reads
    for a, b in (("abcdefghijkl", "abcdeXghijkl"), ("京" * 40, "京" * 20 + "寺" + "京" * 19)):
        x, y = (steps[which] for t in (a, b) for steps, which, _ in [T.inputs(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), np.zeros(0, np.uint64))])
        assert x.shape == y.shape and (x != y).any()
    steps, which, _ = T.inputs(data, off, np.zeros(0, np.uint64))
    for a, b, k in zip(start.tolist(), end.tolist(), which.tolist(), strict=True):  # each byte, lower-cased, at its place
        assert bytes((steps[k, 3:] - 256 * np.arange(8)).astype(np.uint8)).rstrip(b"\0") == K.LOWER[data[a:b]].tobytes()
    assert T.STRIDE * 2 <= T.WINDOW


def test_gradient_against_finite_differences():
    import numpy as np

    from glossmill.llm import toxicity as T

    r = np.random.default_rng(0)
    m = T.Model(np.arange(5, dtype=np.uint64), np.zeros(5, np.float32))
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64) + r.standard_normal(m.p[k].shape) * 0.3
    steps = np.concatenate([np.stack([r.integers(0, 6, 20), r.integers(0, T.CHARS, 20), r.integers(0, T.CHARS, 20)], axis=1), r.integers(0, 256, (20, T.MOST)) + 256 * np.arange(T.MOST)], axis=1)
    which = r.integers(0, 20, 50)
    first, length, y, weight = np.array([0, 10, 18]), np.array([32, 20, 7]), np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.6, 1.0])
    rows = steps[which[np.minimum(first + np.arange(T.WINDOW)[:, None], 49)]]

    def loss():
        m.tables = None
        z = m.logits(steps, which, first, length).astype(float)
        return float(np.mean(weight * np.log1p(np.exp(-np.where(y > 0, z, -z)))))

    g = m.gradient(rows, length, y, weight)
    for name, v in g.items():
        for at in np.argsort(-np.abs(v).ravel())[:6]:
            place = np.unravel_index(at, v.shape)
            old = m.p[name][place]
            m.p[name][place] = old + 2e-3
            up = loss()
            m.p[name][place] = old - 2e-3
            down = loss()
            m.p[name][place] = old
            assert abs((up - down) / 4e-3 - v[place]) < 2e-3 + 0.02 * abs(v[place]), (name, place)
    before, moments = loss(), {}
    for _ in range(25):
        m.step(m.gradient(rows, length, y, weight), 0.01, moments)
    assert loss() < 0.6 * before


# --- 9 ------------------------------------------------------------------------------------------


def test_main_text(spark):
    from glossmill.llm import htmlcut

    page = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site name</h1><ul class="menu"><li><a href=x>Home</a></ul></header>
    <div class="cookie-notice"><p>We use cookies to make this site better for all of you, dear readers.</p></div>
    <main><article><h1>Head&amp;line</h1><p>First   long paragraph of <b>the</b> article,<br>with&nbsp;a break &lt;here&gt; and more words.</p><script>var x="</p>";</script><!-- no <p>comment</p> -->
    <p>Second one, also with quite a few words in it, and a <a href=y>link</a>.<div class="ad">Buy now, it is the best offer you will ever get today!</div><p>Short end.</article></main>
    <aside><p>Related stories that you may like to read as well, if you have the time.</p></aside>
    <section class="comments"><p>I think that this article is wrong in many ways, says a reader.</p></section><form>Your name <input> <textarea>x</textarea></form><footer>&copy; 2024</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>unclosed <script>var a"), (5, "x", "just plain words, without any markup at all, long enough to stand."), (1, "u", page)]
    got = htmlcut.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", htmlcut.F.lit("z"))).collect()
    text = {r.page_id: r.text for r in got}
    assert text[1] == "Head&line\nFirst long paragraph of the article, with a break <here> and more words.\nSecond one, also with quite a few words in it, and a link.\nShort end."
    assert text[2] == text[3] == "" and "var a" not in text[4] and text[5].startswith("just plain")
    assert all(r.n_chars == len(r.text) for r in got) and len(got) == 6


@pytest.mark.parametrize("names", ['<article class="post share-enabled">', '<main id="has-sidebar">', '<body class="no-comments with-banner">', '<article class="sidebar">', '<div class="no-ads"><article>', '<article id=\'post-1\' data-x="a>b">'])
def test_class_names_do_not_drop_articles(names):
    from glossmill.llm.htmlcut import main_text

    body = "<h1>Some title here</h1><p>A first paragraph, with enough words to be one.</p><ul><li><a href=a>One item</a></li><li><a href=b>Another</a></li></ul><p>And an end.</p>"
    want = "Some title here\nA first paragraph, with enough words to be one.\nOne item\nAnother\nAnd an end."
    page = f"<body><nav><ul><li><a href=x>Home</a></li></ul></nav>{names}{'' if 'article' in names or 'main' in names else '<article>'}{body}</article></main></div>{{}}</body>"
    for rest in ('<div class="comments-area"><p>I think this is wrong, says a reader.</p></div>', '<div id="site-footer"><p>All the rights are reserved by us.</p></div>', '<ul class="nav-items"><li>Up</li></ul>', '<div class="ad"><p>Buy it now, it is the best you will get.</p></div>'):
        assert main_text(page.replace("{}", rest)) == want


def test_broken_markup_takes_linear_time():
    import time

    from glossmill.llm.htmlcut import main_text

    text = "Enough words for one paragraph, which must be found."
    for bad in ('<a href="x', "<p title='", "<!", "<!-- ", "< ", "<a ", '<a "<" ', "<div>", "</i>", "<b>", "<script", "&lt;", "<a 'x\" "):
        page = f"<article><p>{text}</p></article>" + bad * (1_000_000 // len(bad))
        began = time.process_time()
        out = main_text(page)
        assert time.process_time() - began < 20 and text in out, bad


def test_minimum_cut_against_all_labelings():
    from glossmill.llm.htmlcut import min_cut

    for _ in range(60):
        n = rng.randint(1, 7)
        cost = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]
        price = lambda k: sum(max(c, 0) if not k[i] else max(-c, 0) for i, c in enumerate(cost)) + sum(w for a, b, w in edges if k[a] != k[b])  # noqa: E731, B023
        best = min(price([m >> i & 1 == 1 for i in range(n)]) for m in range(2**n))
        assert abs(price(min_cut(cost, edges)) - best) < 1e-6


# --- 10 -----------------------------------------------------------------------------------------


def test_url_rules(spark):
    from glossmill.llm import urlrules

    rows = [(1, "http://x.example.net/en/1"), (2, "https://EXAMPLE.net/de/2"), (3, "http://example.com/de"), (4, "http://a.example.com/de/5?q"), (5, "ftp://b.org/fr/#x"), (6, None), (7, "no scheme"), (8, "http://spam-farm.example.com/en/9"), (9, "http://good.example.com/en/9?utm=1"), (10, "http://net?x"), (1, "http://x.example.net/en/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("tokens", urlrules.F.lit(1))
    labelled = spark.createDataFrame([(f"http://spam-{k}.example.com/en/{k}", True) for k in range(30)] + [(f"http://ok{k}.example.com/en/{k}", False) for k in range(60)] + [(None, True)], "url string, blocked boolean")
    got = {r.page_id: r for r in urlrules.judge_urls(pages, labelled).collect()}
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {
        1: ("x.example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/de/2", "net/", "block"), 3: ("example.com", "/de", None, "allow"), 4: ("a.example.com", "/de/5", "example.com/de/", "block"),
        5: ("b.org", "/fr/", "org/fr/", "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("spam-farm.example.com", "/en/9", None, "block"), 9: ("good.example.com", "/en/9", None, "allow"), 10: ("net", "", None, "allow"),
    }
    assert "spam" in got[8].mined
    assert urlrules.judge_urls(pages.where("false"), labelled.where("false")).count() == 0


def test_url_rules_learn_from_quality_alone_and_keep_long_antecedents(spark, tmp_path):
    from glossmill.llm import entry, urlrules

    # the given list blocks every labelled /de/ page, but quality says nothing against /de/
    rows = [(k, f"http://a{k}.example.com/de/{k}") for k in range(40)] + [(k, f"http://b{k}.example.org/en/{k}") for k in range(40, 80)] + [(k, f"http://c{k}.example.org/de/{k}") for k in range(80, 90)]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k, 1) for k in range(90)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: r for r in entry.op10_url_rules(spark, str(tmp_path)).collect()}
    assert all(got[k].verdict == "block" and got[k].rule == "example.com/de/" for k in range(40))
    assert all(got[k].verdict == "allow" and got[k].mined is None for k in range(40, 90))

    # only all four words together are bad, so that no shorter rule is sure enough
    words = ["ab", "cd", "ef", "gh"]
    bad = [("http://x/" + "/".join(words), True)] * 20
    good = [("http://x/" + "/".join(w for w in words if w != left), False) for left in words for _ in range(20)]
    rules, _ = urlrules.mine_rules(spark.createDataFrame(bad + good, "url string, blocked boolean"))
    assert [sorted(r["items"]) for r in rules.collect()] == [["p:ab", "p:cd", "p:ef", "p:gh"]]


def test_url_rules_against_all_token_sets(spark):
    """Brute force: every set of tokens that stands in a labelled url, its rows, confidence and lift; minimal ones block."""
    from itertools import combinations

    from glossmill.llm import urlrules

    r = random.Random(11)
    hosts, words = ["a.org", "b-c.org", "d.com"], ["aa", "bb", "cc", "dd"]
    url = lambda: f"{r.choice(['http', 'https'])}://{r.choice(hosts)}/" + "/".join(r.sample(words, r.randint(0, 3))) + r.choice(["", "?k=1", "?k=1&m=2"])
    bad = lambda u: ("aa" in u and "cc" in u or "d.com" in u and "k=" in u) != (r.random() < 0.06)
    labelled = [(u, bad(u)) for u in (url() for _ in range(160))] + [("http://a.org/bb", None), (None, True)]
    pages = [(k, u) for k, u in enumerate([url() for _ in range(150)] + ["http://d.com/zz?k=1", None, "aa/cc"])]

    def toks(u):
        scheme, _, rest = u.partition("://")
        host, tail = re.match("([^/?]*)(.*)", rest).groups()
        path, _, query = tail.partition("?")
        out = {"s:" + scheme} | {"h:" + x for x in host.split(".")} | {"w:" + y for x in host.split(".") if "-" in x for y in x.split("-")}
        return out | {"p:" + x for x in path.split("/") if x} | {"q:" + x.split("=")[0] for x in query.split("&") if x}

    known = [(toks(u), b) for u, b in labelled if u and b is not None]
    n, base = len(known), sum(b for _, b in known) / len(known)
    need = max(0.005, urlrules.LEAST_ROWS / n)
    good = []
    for s in {s for t, _ in known for k in range(1, len(t) + 1) for s in combinations(sorted(t), k)}:
        rows = [b for t, b in known if set(s) <= t]
        if sum(rows) / n >= need and sum(rows) / len(rows) >= 0.8 and sum(rows) / len(rows) / base >= 1.5:
            good.append(set(s))
    good = [s for s in good if not any(g < s for g in good)]
    assert len(good) > 2
    want = {k: any(g <= toks(u) for g in good) if u and "://" in u else False for k, u in pages}
    got = urlrules.judge_urls(spark.createDataFrame(pages, "page_id int, url string"), spark.createDataFrame(labelled, "url string, blocked boolean"), given=[("allow", "nowhere/")]).collect()
    assert {x.page_id: x.verdict == "block" for x in got} == want


def test_url_rules_with_long_shared_paths_and_few_labels(spark):
    from glossmill.llm import urlrules

    shared = "http://x.org/" + "/".join(f"w{chr(97 + k)}" for k in range(25))
    labelled = [(f"{shared}/{k}", True) for k in range(20)] + [(f"http://y{k}.org/a", False) for k in range(80)] + [("http://once.org/b", True)]
    frame = spark.createDataFrame(labelled, "url string, blocked boolean")
    rules, items = urlrules.mine_rules(frame)
    assert [r["items"] for r in rules.collect()] == [["h:x"]] and items.where("item = 'h:x'").count() == 26
    assert urlrules.mine_rules(frame.where("url not like '%x.org%'"))[0].count() == 0
    pages = spark.createDataFrame([(1, "http://z.org/wc"), (2, "http://once.org/b"), (3, "http://" + "q" * 100_000)], "page_id int, url string")
    assert {r.page_id: r.verdict for r in urlrules.judge_urls(pages, frame).collect()} == {1: "block", 2: "allow", 3: "allow"}


# --- pipeline -----------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    copy = prose(80)
    item = prose(30)
    texts = [prose(60) for _ in range(40)] + [copy, " ".join("other" if k == 40 else w for k, w in enumerate(copy.split())), prose(20) + " " + item, None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(45)) - {41, 42}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(5), str(tmp_path)).columns == corpus_pipeline.COLUMNS


ODD = [(5, "a first text, " + "x" * 60, "en", "s", 74), (5, "another text, with other words in it and more of them", "en", "s", 53), (5, "a first text, " + "x" * 60, "en", "s", 74), (6, "y" * 9 + "x" * 60, None, None, None), (7, None, "en", "s", 0), (8, "", "en", None, 0), (None, "z " * 80, "en", "s", 160), (None, "z " * 80, "fr", "t", 160)]


@pytest.mark.parametrize("stage", range(4))
def test_pipeline_stages_keep_odd_rows(spark, tmp_path, stage):
    """Repeated and null ids, null and empty texts, columns with the operators' own names, and empty tables."""
    import corpus_pipeline

    spark.createDataFrame([(1, "nothing of this stands anywhere at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(5, 1, 0), (900, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("id", "kept", "row", "hash", "pack", "score"):
        frame = frame.withColumn(extra, corpus_pipeline.F.lit("x"))
    name, run = corpus_pipeline.STAGES[stage]
    got = run(spark, frame, str(tmp_path))
    assert got.columns == corpus_pipeline.COLUMNS and run(spark, frame.where("false"), str(tmp_path)).count() == 0
    rows = sorted(map(repr, map(tuple, got.collect())))
    want = list(ODD)
    if name == "near_duplicates":  # no two differ by their words
        want = ODD
    if name == "repeats":
        want[3] = (6, "y" * 9, None, None, 9)
    assert rows == sorted(map(repr, want))
