"""The checks that need running text cut into words: regional terms and Japanese sentences.

Texts are prefiltered by built-in expressions where that is cheap. In the Arrow helpers, terms are found by one pass of an
automaton over the batch, whatever their number, and only rows with a term are cut into words, by the least costs
of a lattice (lattice.py). Without a lattice the words of the policy or the headword itself are all that is known. Where
known words grow with the texts, each share of the texts has a lattice of those it can hold.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import checkpoint
from . import rules as R
from .lattice import LISTED, SLICE, Automaton, Lattice, code_points, learn_sieve, learned_costs, slices

CLAUSE = re.compile("[，,。！？!?；;\n]")
FOUND = "array<struct<term:string,replacement:string,index:int>>"
#: Terms up to which a regular expression picks the rows that the helper sees.
FEW_TERMS = 100


class RegionalTerms:
    """policy, one dict for each term: term, replacement, prefix (true if a longer word may go on), context (the clause must have one of these,
    if any are given), allowed (phrases that excuse a term in them; a text that is one of them is excused anyway)."""

    def __init__(self, policy: list[dict], lattice: Lattice | None = None) -> None:
        self.policy = {p["term"]: p for p in policy}
        self.phrases = {a for p in policy for a in p.get("allowed") or ()}
        self.automaton = Automaton(sorted(self.policy.keys() | self.phrases))
        self.lattice = lattice or Lattice(self.automaton.words, [LISTED] * len(self.automaton.words))

    def matches(self, texts: list[str]) -> list[list[dict]]:
        """For each text its matches by place, longer terms first: places of a term that don't overlap, counted from the left, that start with a
        word and end with it (or inside it, with `prefix`), in the right context, and that no allowed phrase covers."""
        out: list[list[dict]] = [[] for _ in texts]
        codes, begin = code_points(texts)
        start, end, word = self.automaton.scan(codes)
        row = np.searchsorted(begin, start, "right") - 1
        order = np.lexsort((start, word, row))
        places: dict[int, dict[str, list[tuple[int, int]]]] = {}
        for r, w, a, b in zip(row[order].tolist(), word[order].tolist(), (start - begin[row])[order].tolist(), (end - begin[row])[order].tolist(), strict=True):
            own = places.setdefault(r, {}).setdefault(self.automaton.words[w], [])
            if not own or own[-1][1] <= a:
                own.append((a, b))
        rows = [r for r, own in places.items() if own.keys() & self.policy.keys()]
        which, first, last, wordy = self.lattice.segment([texts[r] for r in rows])
        ends = {(rows[k], a): b for k, a, b, w in zip(which.tolist(), first.tolist(), last.tolist(), wordy.tolist(), strict=True) if w}
        for r in rows:
            for term in places[r].keys() & self.policy.keys():
                for a, b in places[r][term]:
                    stop = ends.get((r, a), -1)
                    if stop == b or stop > b and self.policy[term].get("prefix"):
                        if self._wanted(texts[r], term, a, b) and not self._excused(texts[r], places[r], term, a, b):
                            out[r].append({"term": term, "replacement": self.policy[term]["replacement"], "index": a})
        return [sorted(m, key=lambda x: (x["index"], -len(x["term"]), x["term"])) for m in out]

    def _wanted(self, text: str, term: str, a: int, b: int) -> bool:
        context = self.policy[term].get("context")
        if not context:
            return True
        after = CLAUSE.search(text, b)
        clause = CLAUSE.split(text[:a])[-1] + text[a : after.start() if after else len(text)]
        return any(c in clause for c in context)

    def _excused(self, text: str, places: dict[str, list[tuple[int, int]]], term: str, a: int, b: int) -> bool:
        allowed = self.policy[term].get("allowed") or ()
        return text in allowed or any(x <= a and b <= y for p in allowed for x, y in places.get(p, ()))


def find_regional_terms(df: DataFrame, text: str, policy: list[dict], name: str = "regional", lattice: Lattice | None = None) -> DataFrame:
    """Adds array<struct(term, replacement, index)>, empty for a null text; places are counted in code points. The policy may have any number of terms that fits in memory."""
    sent = df.sparkSession.sparkContext.broadcast(RegionalTerms(policy, lattice))

    @F.pandas_udf(FOUND)
    def scan(s: pd.Series) -> pd.Series:
        texts = [x or "" for x in s]
        return pd.Series([m for part in slices(texts) for m in sent.value.matches(texts[part])], dtype=object)

    if len(policy) > FEW_TERMS:
        return df.withColumn(name, scan(F.col(text)))
    may = F.col(text).rlike("|".join(re.escape(p["term"]) for p in policy) or "(?!)")
    return df.withColumn(name, F.when(may, scan(F.when(may, F.col(text)))).otherwise(F.array().cast(FOUND)))


_RULES = [(s, r) for _, s, r, _ in R.japanese_suffixes()]
_LONGEST = max(len(r) for _, r in _RULES)
#: Words behind which an inflected word can start.
PARTICLES = frozenset(["は", "が", "を", "に", "へ", "と", "で", "も", "や", "か", "から", "まで", "より"])


@lru_cache(100_000)
def inflected_forms(headword: str) -> list[str]:
    """Texts that one suffix rule bends back to the headword, and that a window over the sentence can hold."""
    out = {headword[: len(headword) - len(r)] + s for s, r in _RULES if headword.endswith(r) and len(headword) > len(r)}
    return sorted(x for x in out if x != headword and len(x) <= max(12, len(headword) + 8))


def _all_places(text: str, part: str) -> list[int]:
    out, k = [], text.find(part)
    while k >= 0:
        out.append(k)
        k = text.find(part, k + 1)
    return out


def _bent(sentence: str, headword: str) -> Iterator[tuple[int, int]]:
    """Where inflected forms of the headword start and end in the sentence."""
    if headword[:-_LONGEST] in sentence:  # forms keep all but the end of the headword
        for form in inflected_forms(headword):
            yield from ((k, k + len(form)) for k in _all_places(sentence, form))


def sentences_use(sentences: list[str], headwords: list[str], lattice: Lattice) -> list[bool]:
    """Whether a headword is used in a sentence: as a word, between places where words end, behind a particle or a mark, or inflected so that the
    headword in place of the inflected form is a word. Equal texts are cut once; of a bent sentence only the clause is, if no word reaches over a mark."""

    def words_of(texts: list[str], own: list[str]) -> list[list[tuple[int, int, bool]]]:
        keys = [(t, "" if w in lattice.names or w not in t else w) for t, w in zip(texts, own, strict=True)]
        cut: dict[tuple[str, str], list[tuple[int, int, bool]]] = {k: [] for k in keys}
        each = list(cut)
        for part in slices([t for t, _ in each]):
            some = each[part]
            for r, a, b, w in zip(*(x.tolist() for x in lattice.segment([t for t, _ in some], [o for _, o in some])), strict=True):
                cut[some[r]].append((a, b, w))
        return [cut[k] for k in keys]

    out = [False] * len(sentences)
    asked = [i for i, (s, h) in enumerate(zip(sentences, headwords, strict=True)) if s and h]
    bent: list[tuple[int, str]] = []

    def settle() -> None:
        for (i, s), words in zip(bent, words_of([s for _, s in bent], [headwords[i] for i, _ in bent]), strict=True):
            out[i] = out[i] or any(w and s[a:b] == headwords[i] for a, b, w in words)
        bent.clear()

    size = 0
    for i, words in zip(asked, words_of([sentences[i] for i in asked], [headwords[i] for i in asked]), strict=True):
        s, h = sentences[i], headwords[i]
        places = _all_places(s, h)
        if places:
            bounds = {0, len(s)} | {x for a, b, _ in words for x in (a, b)}
            starts = {0} | {b for a, b, w in words if not w or s[a:b] in PARTICLES}
            out[i] = any(k in starts or k in bounds and k + len(h) in bounds for k in places)
        if out[i]:
            continue
        for k, e in _bent(s, h):
            before, after = s[:k], s[e:]
            if not lattice.marked and not CLAUSE.search(h):
                before, after = CLAUSE.split(before)[-1], CLAUSE.split(after, maxsplit=1)[0]
            bent.append((i, before + h + after))
            size += len(bent[-1][1])
            if size > SLICE:
                settle()
                size = 0
    settle()
    return out


def japanese_sentence_contains(sentence: Column, headword: Column, lattice: Broadcast | None = None) -> Column:
    """Whether the headword is used in the sentence (see sentences_use); false if either is null or empty. lattice: a broadcast Lattice, else headwords are the only words known."""
    known = None if lattice else Lattice([], [])

    @F.pandas_udf(T.BooleanType())
    def uses(s: pd.Series, h: pd.Series) -> pd.Series:
        texts, heads = [x or "" for x in s], [x or "" for x in h]
        return pd.Series([u for part in slices(texts) for u in sentences_use(texts[part], heads[part], lattice.value if lattice else known)], dtype=bool)

    # inflected forms keep all but the end of the headword
    may = F.contains(sentence, F.substring(headword, F.lit(1), F.greatest(F.length(headword) - _LONGEST, F.lit(0))))
    return F.coalesce(F.when(may, uses(F.when(may, sentence), headword)), F.lit(False))


def headwords_used(df: DataFrame, sentence: str, headwords: str, words: DataFrame, share: str, name: str = "used") -> DataFrame:
    """Adds array<boolean>: for each headword of an array whether it is used in the sentence (see sentences_use); false for nulls and empty texts.

    words (`word`): all words that are known, with costs as from one round of learn_lattice over the sentences. There may be as many as there are
    sentences: nobody holds them all. Rows with the same number in `share` get a lattice of their own, of those words that their sentences, and
    these with a headword in place of an inflected form, can hold; a cut by it is that by all words. df should be dealt by `share`, and is read twice."""
    known = checkpoint(words.where(F.length("word") > 0).select("word").distinct())
    n_known = known.count()
    sieve = df.sparkSession.sparkContext.broadcast(learn_sieve(known, n_known))

    def asked(t: pa.Table) -> tuple[list[str], list[list[str]]]:
        return [s or "" for s in t[sentence].to_pylist()], [[h or "" for h in hs or ()] for hs in t[headwords].to_pylist()]

    def find(t: pa.Table) -> pa.Table:
        texts, heads = asked(t)
        n: Counter[str] = Counter()
        reach = max(sieve.value.lengths, default=1) - 1
        for part in slices(texts):
            n.update(sieve.value.found(texts[part]))
            bent = list({s[max(0, k - reach) : k] + h + s[e : e + reach] for s, hs in zip(texts[part], heads[part], strict=True) if s for h in hs if h for k, e in _bent(s, h)})
            for some in slices(bent):
                for w in sieve.value.found(bent[some]):
                    n.setdefault(w, 0)
        number = t[share][0].as_py() if len(t) else None
        return pa.table({"share": pa.array([number] * len(n), pa.int64()), "word": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64())})

    found = df.select(F.col(share).cast("long").alias(share), sentence, headwords).groupBy(share).applyInArrow(find, "share long, word string, n long")
    found = checkpoint(found.join(known, "word"))  # what passed the sieve and is no word goes
    total = n_known + (found.agg(F.sum("n")).first()[0] or 0)
    priced = found.select("share", "word", (1 + F.sum("n").over(Window.partitionBy("word"))).alias("n"))

    def use(t: pa.Table, own: pa.Table) -> pa.Table:
        lattice = Lattice(own["word"].to_pylist(), learned_costs(own["n"].to_numpy(), total))
        texts, heads = asked(t)
        flat, used = [(s, h) for s, hs in zip(texts, heads, strict=True) for h in hs], []
        for part in slices([s for s, _ in flat]):
            used += sentences_use([s for s, _ in flat[part]], [h for _, h in flat[part]], lattice)
        ends = np.cumsum([0, *map(len, heads)])
        return t.append_column(name, pa.array([used[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.list_(pa.bool_())))

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.BooleanType()))])
    return df.groupBy(share).cogroup(priced.groupBy("share")).applyInArrow(use, schema)
