"""Spelling variants, host rules and hard negatives against brute force, on small tables with nulls, blanks, ties, repeats, long texts and clashing columns."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.llm import bond, quality, spelling
from glossmill.llm.fmindex import Index

rng = random.Random(23)

# --- spelling -----------------------------------------------------------------------------------

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def some(letters, lo, hi):
    return "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))


def test_index_finds_every_neighbour_behind_a_half():
    for trial in range(120):
        words = sorted({some("ab" if trial % 3 else "abcé", 1, 7) for _ in range(rng.randint(1, 40))})
        index = Index(words)
        for rightwards in (True, False):
            exact = np.array([rng.randint(0, len(w)) for w in words])
            q, other, same = index.near(np.arange(len(words)), exact, rightwards)
            want = []
            for i, u in enumerate(words):
                for k, v in enumerate(words):
                    half = v[: exact[i]] == u[: exact[i]] if rightwards else exact[i] == 0 or v[-exact[i] :] == u[-exact[i] :]
                    if near(u, v) and len(v) >= len(u) and half:
                        want.append((i, k, next((n for n, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), len(u))))
            assert sorted(zip(q.tolist(), other.tolist(), same.tolist(), strict=True)) == want


def groups(counts, ratio=10):
    form, around = {}, {w: [v for v in counts if near(w, v)] for w in counts}
    for w, near_ones in around.items():
        best = min(near_ones, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(around[w]), counts[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("half_words,shard_words", [(25_000, 50_000), (3, 40)])
def test_groups_equal_brute_force(spark, half_words, shard_words):
    words = {some("abc", 1, 6) for _ in range(150)} | {"commonp" + some("xyz", 1, 4) for _ in range(60)} | {some("xyz", 1, 4) + "ommonend" for _ in range(60)} | {"x" * 300, "x" * 301, "x" * 299 + "y", "ÿ×÷à", "𠮷b"}
    counts = {w: rng.choice([2, 2, 3, 20, 30, 400, 4000]) for w in words}
    rows = spark.createDataFrame([(w, n, "clash", 1) for w, n in counts.items()], "word string, n int, key string, shard int").repartition(3)
    got = spelling.group_spellings(rows, shard_words=shard_words, half_words=half_words).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == groups(counts)


def test_ties_and_chains(spark):
    counts = {"abcdefg": 2, "abcdefh": 20, "abcdefi": 20, "abcdehh": 200, "abcdegg": 19}
    rows = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert {tuple(r) for r in spelling.group_spellings(rows).collect()} == groups(counts)
    assert not spelling.group_spellings(rows.limit(0)).count()


def test_words_of_texts_and_their_damage(spark):
    texts = ["Élanger Wörterbuch wörterbuch ABCDEFG abcdefg", None, "", "a-b c×d÷efghij short", "Ābcdefgh日本abcdefghi", "abcdefg " * 3000, "x" * 50_000]
    docs = [(k, t, "clash", "c") for k, t in enumerate(texts * 9)] + [(None, texts[0], "c", None), (3, texts[3], "c", None), (3, texts[3], "c", None)]
    got = spelling.count_words(spark.createDataFrame(docs, "doc_id long, text string, word string, run string"), damage=31).collect()
    count: collections.Counter = collections.Counter()
    for i, t, _, _ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(UP)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                count[run] += 1
    assert {r.word: r.n for r in got} == {w: n for w, n in count.items() if n >= 2}


# --- hosts --------------------------------------------------------------------------------------


def measured(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    inside = {p for k in range(len(words) - 2) if seen[tuple(words[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside)


def host_corpus():
    prose = lambda n: " ".join(some("abcdefgh", 2, 8) for _ in range(n))
    texts = [prose(60), prose(60) + " # * $ % & | < >", prose(10), "same line\n" * 40, "a b c " * 60, None, "", " \n\t", "é ü 語　x " * 30, prose(55) + "\n" + "\n".join(["| | | row"] * 30), "w " * 51, prose(20_000), " ".join(prose(2) for _ in range(60)), "x" * 100_000]
    rows = []
    for host, shift in (("good", 0), ("bad", 7), (None, 3), ("one", 1)):
        for k in range(40 if host != "one" else 1):
            rows.append((len(rows), texts[9] if host == "bad" and k % 2 else texts[(k * 5 + shift) % len(texts)], host, "clash", k))
    return [*rows, (None, texts[0], "good", None, None), rows[0]]


def test_host_rules_equal_brute_force_and_sql(spark):
    rows = host_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, host string, n_words int").repartition(4)
    got = quality.judge_documents(docs).collect()
    m = [(i, h or "", *measured(t)) for i, t, h, _, _ in rows]
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    assert sorted(map(repr, ((r.doc_id, r.host, *(r[c] for c in names)) for r in got))) == sorted(map(repr, m))
    for r in got:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and (not base or not r.kept)
        soft = [k for k, f in (("symbols", 10 * r.n_symbols > r.n_words), ("lines", 100 * r.n_dup_lines > 30 * r.n_lines), ("lengths", r.n_words > 0 and not 3 * r.n_words <= r.word_chars <= 12 * r.n_words)) if f]
        held = set(r.held_to.split(",")) - {""}
        assert held == {k for k in ("symbols", "lines", "lengths") if r[f"rate_{k}"] >= 0.05}
        assert r.kept == (not base and not held & set(soft))
    # the shrunk rate of symbols, as the formula says it
    n, f = collections.Counter(h for _, h, *_ in m), collections.Counter(h for _, h, w, _, s, *_ in m if 10 * s > w)
    total, mean = len(m), sum(f.values()) / len(m)
    spread = mean * (1 - mean)
    share = (sum(f[h] ** 2 / n[h] for h in n) - total * mean**2 - (len(n) - 1) * spread) / ((total - sum(x * x for x in n.values()) / total) * spread)
    strength = max(0.0, min(1 / share - 1, total)) if share > 1e-9 else total
    assert all(math.isclose(r.rate_symbols, (f[r.host] + strength * mean) / (n[r.host] + strength), abs_tol=2e-6) for r in got)
    # and all of it in SQL
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    want = con.sql(quality.SQL)
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in want.columns)) for r in got)
    assert not quality.judge_documents(docs.limit(0)).count()


def test_clean_documents_stay_on_any_host(spark):
    clean = " ".join(some("abcdefgh", 3, 8) for _ in range(80))
    junk = "$ | # & " * 30 + " ".join(str(k) for k in range(200))
    rows = [(k, clean if k % 10 == 0 else junk, "poor") for k in range(100)] + [(100 + k, clean, "fine") for k in range(100)]
    got = {r.doc_id: r for r in quality.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept == (t == clean) for i, t, _ in rows)
    assert "symbols" in got[0].held_to and got[100].held_to == ""


# --- vectors ------------------------------------------------------------------------------------


def moved(i, label):
    return F.when(i % 7 == 0, (label + 1) % 10).otherwise(label)


def negatives(rows, scale=256):
    taken = []
    for i, v, y in rows:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        taken.append((i, [math.floor(float(np.float32(x)) * scale) for x in v], (y + 1) % 10 if i % 7 == 0 else y))
    out = []
    for i, q, y in taken:
        if i % 50:
            continue
        score = lambda v: sum(a * b for a, b in zip(q, v, strict=False))
        best = sorted((-score(v), k) for k, v, l in taken if l == y and k != i)[:5]
        others = sorted((-score(v), k) for k, v, l in taken if l != y)
        for no, (p, k) in enumerate(best, 1):
            inside = [(-s, j) for s, j in others if 50 * -p <= 100 * -s <= 95 * -p][:3]
            out += [(i, k, r, j, -p, s, no) for r, (s, j) in enumerate(inside, 1)]
    return sorted(out)


def vectors(n, dims, rng=np.random.default_rng(4)):
    v = rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return [(k, [float(np.float32(x)) for x in v[k]], int(rng.integers(0, 10))) for k in range(n)]


@pytest.mark.parametrize("block,group", [(65_536, 512), (37, 3)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(bond, "BLOCK_ROWS", block)
    monkeypatch.setattr(bond, "LEAST_BLOCK_ROWS", min(block, bond.LEAST_BLOCK_ROWS))
    monkeypatch.setattr(bond, "GROUP_ANCHORS", group)
    rows = vectors(420, 24)
    same = rows[3][1]
    rows += [(500 + k, same, k % 3) for k in range(40)]  # ties
    rows += [(600, None, 1), (601, [], 1), (602, [None, 1.0], 1), (603, [math.nan] * 24, 1), (604, [math.inf] * 24, 2), (605, same, None), (None, same, 1), (650, [], 3), (700, same[:5], 2), (701, same + [1.0], 2), (750, [0.0] * 24, 5), (-50, same, 4)]
    rows += [rows[10], (800, same, 1), (800, [-x for x in same], 1), (850, [3e38] * 24, 9), (851, [-3e38, 3e38] * 12, 9), (852, [1e9] * 24, 8)]
    # what lies beyond the bound on components is left to the kernel's own arithmetic below
    small = [r for r in rows if r[0] not in (850, 851, 852)]
    frame = lambda x: spark.createDataFrame([(i, v, y, "clash") for i, v, y in x], "vec_id long, embedding array<float>, label int, anchor string").repartition(3)
    mine = lambda x: sorted(tuple(r) for r in bond.hard_negatives(frame(x), is_anchor=lambda i: i % 50 == 0, mislabel=moved).collect())
    assert mine(small) == negatives(small)
    assert len(mine(rows)) >= len(negatives(small)) - 60  # large numbers don't fail
    assert mine(small[:0]) == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(np.float32(x)) for x in rng.integers(-(2**40), 2**40, 6)], int(rng.integers(0, 3))) for k in range(120)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in bond.hard_negatives(d, is_anchor=lambda i: i % 50 == 0, mislabel=moved, scale=1).collect())
    limit = lambda x: max(-(2**63), min(2**63 - 1, x))
    assert got == [(*r[:4], limit(r[4]), limit(r[5]), r[6]) for r in negatives(rows, 1)] and got
