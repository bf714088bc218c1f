"""Tries, automata and segmentation against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossmill.functions import lattice as A
from glossmill.functions import segment as G

HAN = "軟件網絡視頻信息"
rng = random.Random(11)


def some(letters, lo, hi):
    return "".join(rng.choice(letters) for _ in range(rng.randint(lo, hi)))


def places(words, text):
    return sorted((k, k + len(w), w) for w in words if w for k in range(len(text) - len(w) + 1) if text.startswith(w, k))


def test_trie_and_automaton_find_all_places():
    for trial in range(150):
        letters = ["ab", "abc", HAN, "aé𠮷" + HAN][trial % 4]
        words = sorted({some(letters, 1, 6) for _ in range(rng.randint(0, 40))} | {""})
        rng.shuffle(words)
        texts = [some(letters + "z。", 0, 60) for _ in range(rng.randint(0, 5))] + ["", "a" * 50]
        codes, begin = A.code_points(texts)
        want = sorted((begin[i] + a, begin[i] + b, w) for i, t in enumerate(texts) for a, b, w in places(words, t))
        m = A.Automaton(words)
        for start, end, word in (A.Trie(words).walk(codes), m.scan(codes, chunk=7), m.scan(codes)):
            assert sorted(zip(start.tolist(), end.tolist(), (words[w] for w in word), strict=True)) == want


def test_ten_thousand_terms():
    words = sorted({some("abcdefghij", 2, 7) for _ in range(14_000)})[:10_000]
    assert len(words) == 10_000
    text = some("abcdefghij ", 4000, 4000)
    listed = set(words)
    want = sorted((a, b, text[a:b]) for a in range(len(text)) for b in range(a + 2, min(a + 7, len(text)) + 1) if text[a:b] in listed)
    start, end, word = A.Automaton(words).scan(A.code_points([text])[0])
    assert sorted(zip(start.tolist(), end.tolist(), (words[w] for w in word), strict=True)) == want


def best_cut(text, costs):
    """All segmentations of a text of Han characters and marks: the least (cost, words, starts from the last word on)."""
    found = []
    for cuts in itertools.product((False, True), repeat=max(0, len(text) - 1)):
        at = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(text)]
        total = 0
        for a, b in itertools.pairwise(at):
            w = text[a:b]
            price = 0 if w == "。" else min(costs.get(w, 10**9), A.UNKNOWN if b - a == 1 else 10**9)
            total += price
        if total < 10**9:
            found.append((total, len(at), at[-2::-1], at))
    return min(found)[3] if text else [0]


def test_segmentation_is_the_cheapest_of_all():
    for _ in range(120):
        costs = {some(HAN[:4], 1, 4): rng.randint(1, 9) * 300 for _ in range(12)}
        cutter = A.Lattice(list(costs), list(costs.values()))
        texts = [some(HAN[:5] + "。", 0, 9) for _ in range(6)]
        row, start, end, wordy = cutter.segment(texts)
        for i, t in enumerate(texts):
            mine = [*start[row == i].tolist(), len(t)]
            assert mine == best_cut(t, costs) if t else mine == [0]
            assert all(w == (t[a] != "。") for a, w in zip(start[row == i], wordy[row == i], strict=True))


def test_scripts_with_spaces_are_never_cut():
    cutter = A.Lattice(["app", "軟件", "Tシ"], [1, 1, 1])
    texts = ["apple app軟件2台", "カタカナ語", "", "x" * 3000 + "軟件"]
    row, start, end, wordy = cutter.segment(texts)
    cut = [[t[a:b] for a, b, w in zip(start[row == i], end[row == i], wordy[row == i], strict=True) if w] for i, t in enumerate(texts)]
    assert cut == [["apple", "app", "軟件", "2", "台"], ["カタカナ", "語"], [], ["x" * 3000, "軟件"]]


def regional_by_hand(text, policy, words):
    """One term after the other, as the rules say it."""
    out = []
    bounds = {a: b for a, b in itertools.pairwise(words)}
    for p in policy:
        k = text.find(p["term"])
        while k >= 0:
            e = k + len(p["term"])
            end = bounds.get(k, -1)
            good = end == e or end > e and p.get("prefix")
            lo, hi = k, e
            while lo and text[lo - 1] not in "，,。！？!?；;\n":
                lo -= 1
            while hi < len(text) and text[hi] not in "，,。！？!?；;\n":
                hi += 1
            good = good and (not p.get("context") or any(c in text[lo:hi] for c in p["context"]))
            covered = text in (p.get("allowed") or ())
            for a in p.get("allowed") or ():
                j = text.find(a)
                while j >= 0:
                    covered = covered or j <= k and e <= j + len(a)
                    j = text.find(a, j + len(a))
            if good and not covered:
                out.append((k, -len(p["term"]), p["term"]))
            k = text.find(p["term"], e)
    return sorted(out)


def test_regional_terms_against_rules_by_hand():
    for _ in range(120):
        letters = HAN[:4]
        terms = sorted({some(letters, 1, 3) for _ in range(5)})
        policy = [{"term": t, "replacement": t + "!", "prefix": rng.random() < 0.4, "context": [some(letters, 1, 2)] if rng.random() < 0.3 else None, "allowed": [some(letters, 2, 4) for _ in range(rng.randint(0, 2))]} for t in terms]
        costs = {some(letters, 1, 3): rng.randint(1, 9) * 300 for _ in range(10)}
        cutter = A.Lattice(list(costs), list(costs.values()))
        texts = [some(letters + "。", 0, 9) for _ in range(6)]
        for text, found in zip(texts, G.RegionalTerms(policy, cutter).matches(texts), strict=True):
            assert [(m["index"], -len(m["term"]), m["term"]) for m in found] == regional_by_hand(text, policy, best_cut(text, costs))


def test_learned_costs_split_texts_as_they_are_used(spark):
    words = spark.createDataFrame([("軟件",), ("件網",), ("網絡",), ("軟件",), (None,), ("",)], "word string")
    texts = spark.createDataFrame([("軟件網絡",)] * 5 + [("軟件。網絡",)] * 5 + [("件網",), (None,), ("",)], "text string").repartition(3)
    cutter = A.learn_lattice(words, texts)
    # 10 uses each of the outer words, one of the inner one after the second round; each has one more
    n = {"軟件": 11, "網絡": 11, "件網": 2}
    assert dict(zip(cutter.trie.words, cutter.costs.tolist(), strict=True)) == {w: int(np.floor(100 * np.log(24 / k) + 0.5)) for w, k in n.items()}
    got = A.segment_words(texts.dropDuplicates(), "text", cutter).orderBy(F.length("text").desc_nulls_last(), "text").collect()
    assert [[w.word for w in r.words] for r in got] == [["軟件", "。", "網絡"], ["軟件", "網絡"], ["件網"], [], []]
    with pytest.raises(ValueError):
        A.learn_lattice(words, texts, most_words=2)


def test_sentences_use_headwords():
    cutter = A.Lattice(["食べる", "食べ物", "は", "を", "見る", "花見"], [500, 500, 100, 100, 500, 300])
    rows = [("食べ物を食べる", "食べる", True), ("大食べ物だ", "食べ", False), ("食べ物だ", "食べ", True), ("花見だ", "見る", False), ("昨日パンを食べました。", "食べる", True), ("パンを食べないで", "食べる", True), ("は見ない", "見る", True), ("", "見る", False), ("見る", "", False), ("大花見て", "見る", False), ("を食べ", "食べ", True)]
    assert G.sentences_use([s for s, _, _ in rows], [h for _, h, _ in rows], cutter) == [w for _, _, w in rows]


def test_few_code_points_are_worked_on_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(A, "SLICE", 50, raising=False)
    texts = ["", "天地" * 5, "玄" * 120, "", "黄天地", "地玄" * 20] * 30
    assert [t for part in A.slices(texts) for t in texts[part]] == texts
    assert all(sum(map(len, texts[part])) <= 50 or part.stop - part.start == 1 for part in A.slices(texts)) and not list(A.slices([]))
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").coalesce(1)
    n = {r.word: r.n for r in A.counted_words(df, "t", ["天地", "玄"]).collect()}
    assert n == {w: sum(t.count(w) for t in texts) for w in ("天地", "玄")}


def test_turns_are_dealt_by_number(spark, monkeypatch):
    from glossmill.plans import running

    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/conversations.parquet").count()
    monkeypatch.setattr(running, "TASK_TURNS", n // 5, raising=False)
    dealt = running.turns(spark, sf)
    assert dealt.count() == n and dealt.select(F.spark_partition_id()).distinct().count() > 4


def test_lattices_of_shares_cut_as_one_of_all_words(spark):
    letters = HAN[:4] + "は。るい"
    for marks in ("", "。"):
        heads = [some(HAN[:4] + marks, 1, 3) + rng.choice("るい") for _ in range(6)]
        ends = ["った", "ない", "ます", "くて", "る", "い"]
        said = ["".join(rng.choice([h, h[:-1] + rng.choice(ends), some(letters, 0, 3)]) for h in rng.choices(heads, k=6)) for _ in range(150)] + ["", None]
        rows = [(k, k % 60, s, [rng.choice(heads), None, "", rng.choice(heads), "外る"] if k % 20 else None) for k, s in enumerate(said)]
        words = [*heads, "は", *(some(HAN[:4] + marks, 1, 2) for _ in range(8))]
        df = spark.createDataFrame(rows, "id long, share long, s string, heads array<string>")
        known = spark.createDataFrame([(w,) for w in [*words, None, ""]], "word string")
        whole = A.learn_lattice(known, df, text="s", rounds=1)
        want = {k: G.sentences_use([s or ""] * len(hs or []), [h or "" for h in hs or []], whole) for k, _, s, hs in rows}
        got = {r.id: r.used for r in G.headwords_used(df, "s", "heads", known, "share").collect()}
        assert got == want and sum(map(sum, want.values())) > 100


def test_sentences_are_cut_by_more_words_than_are_sent(spark, monkeypatch):
    from glossmill.plans import running

    sf = "/root/testdata/sf0.001"
    want = running.japanese_sentence_uses(spark, sf).groupBy("used").count().orderBy("used").collect()
    monkeypatch.setattr(A.learn_lattice, "__defaults__", (*A.learn_lattice.__defaults__[:-1], 10))
    monkeypatch.setattr(running, "SHARE_TURNS", 7, raising=False)
    assert running.japanese_sentence_uses(spark, sf).groupBy("used").count().orderBy("used").collect() == want


def test_sieve_misses_no_word(spark):
    words = sorted({some("ab" + HAN, 1, 5) for _ in range(300)} | {"𠮷"})
    sieve = A.learn_sieve(spark.createDataFrame([(w,) for w in words], "word string").repartition(3), len(words))
    texts = [some("abc。𠮷" + HAN, 0, 40) for _ in range(20)]
    found = list(sieve.found(texts))
    assert sorted(w for w in found if w in words) == sorted(w for t in texts for _, _, w in places(words, t))
    assert sum(w not in words for w in found) < len(found) / 10
    assert not list(A.learn_sieve(spark.createDataFrame([], "word string"), 0).found(texts))
