"""Words of running text: term lists as double-array tries and automata, and segmentation by least cost.

All of it works on whole Arrow batches: the texts of a batch are one array of code points, with a mark between
them, and every place, chunk or piece is advanced side by side in numpy. A list of words is built once, on the
driver, broadcast, and bounded by a parameter; texts stay where they are. Lists that grow with the texts are not
sent: what of them a share of the texts can hold is found by a sieve of fixed size (segment.headwords_used).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a list that may be broadcast.
MOST_WORDS = 1_000_000
MARK = "\0"
#: Code points that are worked on side by side, unless one text has more: a place takes some hundred bytes of arrays.
SLICE = 200_000


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, a mark behind each text, and where each text starts (one more than there are texts)."""
    joined = np.frombuffer("".join(t + MARK for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    start = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=start[1:])
    return joined, start


def slices(texts: list[str]) -> Iterator[slice]:
    """Runs of texts of at most SLICE code points, so that memory doesn't follow the rows of a batch."""
    lo = size = 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > SLICE:
            yield slice(lo, k)
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield slice(lo, len(texts))


class Trie:
    """Words as a double array: from state s, letter c leads to base[s] + c if check[] there is s."""

    def __init__(self, words: list[str]) -> None:
        """words: distinct; they are numbered as given. Empty ones, and any with a mark, are never found."""
        self.words = words
        order = sorted((w, i) for i, w in enumerate(words) if w and MARK not in w)
        points = sorted({ord(c) for w, _ in order for c in w})
        self.table = np.zeros(0x110000, np.int32)
        self.table[points] = np.arange(1, len(points) + 1)
        self.longest = max((len(w) for w, _ in order), default=1)
        self.length = np.array([len(w) for w in words] or [0], np.int64)
        letter = {chr(p): k for k, p in enumerate(points, 1)}
        base, check, word = [1], [0], [-1]

        def grow(n: int) -> None:
            base.extend([0] * (n - len(base)))
            check.extend([-1] * (n - len(check)))
            word.extend([-1] * (n - len(word)))

        queue, free = [(0, 0, len(order), 0)], 1
        self.parents: list[tuple[int, int, int]] = []  # state, letter, parent; from the root outwards
        for state, lo, hi, depth in queue:
            if lo < hi and len(order[lo][0]) == depth:
                word[state] = order[lo][1]
                lo += 1
            if lo == hi:
                continue
            cuts, k = [], lo
            while k < hi:
                c, first = order[k][0][depth], k
                while k < hi and order[k][0][depth] == c:
                    k += 1
                cuts.append((letter[c], first, k))
            place, tries = max(1, free - cuts[0][0]), 0
            grow(place + cuts[-1][0] + 1)
            while any(check[place + c] != -1 for c, _, _ in cuts):
                place += 1
                tries += 1
                grow(place + cuts[-1][0] + 1)
            if tries > 32:  # the array is dense up to here
                free = place
            while free < len(check) and check[free] != -1:
                free += 1
            base[state] = place
            for c, first, end in cuts:
                check[place + c] = state
                self.parents.append((place + c, c, state))
                queue.append((place + c, first, end, depth + 1))
        grow(len(base) + len(points) + 1)
        self.base, self.check, self.word = (np.array(x, np.int64) for x in (base, check, word))

    def walk(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end, word of all places of all words, walked from every place at once."""
        letters = np.append(self.table[codes], 0)
        at = np.flatnonzero(letters)
        state, found, depth = np.zeros(len(at), np.int64), [], 0
        while len(at):
            letter = letters[at + depth]
            to = self.base[state] + letter
            go = np.flatnonzero((letter > 0) & (self.check[to] == state))
            at, state, depth = at[go], to[go], depth + 1
            hit = np.flatnonzero(self.word[state] >= 0)
            found.append((at[hit], at[hit] + depth, self.word[state[hit]]))
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in range(3))


class Automaton(Trie):
    """An Aho-Corasick automaton as arrays: where a state has no letter, fail[] leads on; also[] is the next shorter word that ends there (0: none)."""

    def __init__(self, words: list[str]) -> None:
        super().__init__(words)
        fail, also = [0] * len(self.base), [0] * len(self.base)
        base, check, word = self.base.tolist(), self.check.tolist(), self.word.tolist()
        for state, c, parent in self.parents:
            f = fail[parent]
            while f and check[base[f] + c] != f:
                f = fail[f]
            to = base[f] + c
            fail[state] = to if parent and check[to] == f else 0
            also[state] = fail[state] if word[fail[state]] >= 0 else also[fail[state]]
        self.fail, self.also = np.array(fail, np.int64), np.array(also, np.int64)

    def scan(self, codes: np.ndarray, chunk: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end, word of all places of all words, in one pass over the text: chunks are read side by side, each from as far before it as the longest word can reach."""
        n, warm = len(codes), self.longest - 1
        letters = self.table[codes]
        at = np.arange(0, n, max(chunk, 4 * warm))
        end = np.append(at[1:], n)
        state, found = np.zeros(len(at), np.int64), []
        for k in range(-warm, int((end - at).max(initial=0))):
            place = at + k
            lane = np.flatnonzero((place >= 0) & (place < end))
            letter = letters[place[lane]]
            state[lane[letter == 0]] = 0
            lane, letter = lane[letter > 0], letter[letter > 0]
            while len(lane):
                s = state[lane]
                to = self.base[s] + letter
                ok = self.check[to] == s
                state[lane[ok]] = to[ok]
                left = np.flatnonzero(~ok & (s > 0))
                state[lane[left]] = self.fail[s[left]]
                lane, letter = lane[left], letter[left]
            if k >= 0:
                lane = np.flatnonzero((at + k < end) & (state > 0))
                s = state[lane]
                s = np.where(self.word[s] >= 0, s, self.also[s])
                while (s > 0).any():
                    lane, s = lane[s > 0], s[s > 0]
                    w = self.word[s]
                    found.append((at[lane] + k + 1 - self.length[w], at[lane] + k + 1, w))
                    s = self.also[s]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *(f[k] for f in found)]) for k in range(3))


#: Kinds of code points: no word; letters and digits of scripts that part words by spaces; Han and hiragana; katakana.
NO_WORD, SPACED, UNSPACED, KATAKANA = range(4)
#: The ranges of the last two kinds, ends included.
UNSPACED_RANGES = [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3041, 0x309F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
KATAKANA_RANGES = [(0x30A1, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)]


def kinds(codes: np.ndarray) -> np.ndarray:
    points, which = np.unique(codes, return_inverse=True)

    def kind(p: int) -> int:
        for k, ranges in ((UNSPACED, UNSPACED_RANGES), (KATAKANA, KATAKANA_RANGES)):
            if any(a <= p <= b for a, b in ranges):
                return k
        return SPACED if unicodedata.category(chr(p))[0] in "LMN" else NO_WORD

    return np.array([kind(int(p)) for p in points], np.int8)[which]


#: What a path pays for a word outside the list, and for one that is known but was not counted; the parts of a unit that fewer words are worth.
UNKNOWN, LISTED, PER_WORD = 2500, 1200, 1 << 20


class Lattice:
    """Splits text into the words of least cost.

    Every place of a listed word is an edge at the word's cost; a code point of an unspaced script, and a whole run of katakana, is an edge at
    UNKNOWN; a run of letters and digits of other scripts is one word that nothing cuts; all else is a mark of its own, no word. Of paths of equal
    cost the one of fewer words is taken, then the one whose last words are longer."""

    def __init__(self, words: list[str], costs: list[int]) -> None:
        self.trie, self.names, self.costs = Trie(words), frozenset(words), np.array(costs or [0], np.int64)
        self.marked = bool((kinds(np.flatnonzero(self.trie.table)) == NO_WORD).any())  # whether a mark is in any word

    def edges(self, codes: np.ndarray, own: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """start, end and cost of all edges, and the kinds of the code points. own: more places of known words."""
        kind, n = kinds(codes), len(codes)
        inner = np.zeros(n + 1, bool)  # places inside a run that nothing cuts
        inner[1:n] = (kind[1:] == SPACED) & (kind[:-1] == SPACED)
        change = np.flatnonzero(np.diff(kind, prepend=-1))
        ends = np.append(change[1:], n) if n else change
        runs = np.isin(kind[change], (SPACED, KATAKANA)) if n else np.zeros(0, bool)
        single = np.flatnonzero(kind != SPACED)
        start, end, word = self.trie.walk(codes)
        price = self.costs[word]
        if own:
            a, b = np.array(own, np.int64).T
            start, end, price = np.concatenate([start, a]), np.concatenate([end, b]), np.concatenate([price, np.full(len(a), LISTED)])
        fits = ~inner[start] & ~inner[end] & ~((end - start == 1) & (kind[start] == NO_WORD))
        start, end = start[fits], end[fits]
        cost = [price[fits], np.where(kind[single] == NO_WORD, 0, UNKNOWN), np.full(int(runs.sum()), UNKNOWN)]
        return np.concatenate([start, single, change[runs]]), np.concatenate([end, single + 1, ends[runs]]), np.concatenate(cost) * PER_WORD + 1, kind

    def cut(self, codes: np.ndarray, own: list[tuple[int, int]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places where words start or end (from 0 to the number of code points), as a bitmap, and the kinds of the code points.

        The text falls apart where no edge crosses; the pieces between go through the recurrence side by side."""
        n = len(codes)
        start, end, cost, kind = self.edges(codes, own or [])
        depth = np.zeros(n + 2, np.int64)
        np.add.at(depth, start + 1, 1)
        np.add.at(depth, end, -1)
        apart = np.cumsum(depth)[: n + 1] == 0
        first = np.flatnonzero(apart)
        of = first[np.cumsum(apart) - 1]  # the last such place up to each place
        away = end - of[start]
        order = np.lexsort((start, end, away))
        start, end, cost, away = start[order], end[order], cost[order], away[order]
        best, back = np.zeros(n + 1, np.int64), np.arange(n + 1)
        bounds = np.searchsorted(away, np.arange(1, int(away.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if lo == hi:
                continue
            total = np.where(apart[start[lo:hi]], 0, best[start[lo:hi]]) + cost[lo:hi]
            head = np.flatnonzero(np.diff(end[lo:hi], prepend=-1))
            least = np.minimum.reduceat(total, head)
            good = np.flatnonzero(total == np.repeat(least, np.diff(np.append(head, hi - lo))))
            at, which = np.unique(end[lo:hi][good], return_index=True)  # the first has the longest last word
            best[at], back[at] = least, start[lo:hi][good[which]]
        mark, here = apart.copy(), first[1:]
        while len(here):
            here = back[here]
            mark[here] = True
            here = here[~apart[here]]
        return mark, kind

    def segment(self, texts: list[str], own: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """row, start, end (in the row, in code points), and whether it is a word. own: for each text one more word that is known in it, at LISTED unless the list has it."""
        codes, begin = code_points(texts)
        more = []
        for b, t, w in zip(begin.tolist(), texts, own or (), strict=False):
            if w and w not in self.names:
                k = t.find(w)
                while k >= 0:
                    more.append((b + k, b + k + len(w)))
                    k = t.find(w, k + 1)
        mark, kind = self.cut(codes, more)
        place = np.flatnonzero(mark)
        start, end = place[:-1], place[1:]
        row = np.searchsorted(begin, start, "right") - 1
        real = start < begin[row + 1] - 1  # all but the marks behind texts
        start, end, row = start[real], end[real], row[real]
        return row, start - begin[row], end - begin[row], kind[start] != NO_WORD


def counted_words(df: DataFrame, text: str, words: list[str], lattice: Lattice | None = None) -> DataFrame:
    """word, n: how often each listed word stands in the texts: everywhere (without a lattice), or among the words of least cost. Counts of a batch are added up before they are shuffled."""
    spark = df.sparkSession
    sent = spark.sparkContext.broadcast((lattice.trie if lattice else Trie(words), lattice))

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie, cutter = sent.value
        for f in frames:
            texts, n = [t for t in f.t if t], np.zeros(len(trie.words), np.int64)
            for part in slices(texts):
                codes, _ = code_points(texts[part])
                start, end, word = trie.walk(codes)
                if cutter:
                    mark, _ = cutter.cut(codes)
                    inside = np.cumsum(mark)
                    fits = mark[start] & mark[end] & (inside[end] - inside[start] == 1)
                    word = word[fits]
                n += np.bincount(word, minlength=len(trie.words))
            seen = np.flatnonzero(n)
            yield pd.DataFrame({"word": [trie.words[i] for i in seen], "n": n[seen]})

    return df.select(F.col(text).cast("string").alias("t")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


#: Bits of a sieve for each word of its list, and at most (16 MB: of what is no word, one in 3,600 passes with 3 million words, one in 120 with 10 million).
BITS_A_WORD, SIEVE_BITS = 32, 1 << 27
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes:
    """Hashes of any stretches of code points, from sums that are made once."""

    def __init__(self, codes: np.ndarray) -> None:
        def powers(base: int) -> np.ndarray:
            out = np.full(len(codes) + 1, base, np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mixed(codes.astype(np.uint64) + np.uint64(1)) * powers(_BASE)[:-1], out=self.sums[1:])
        self.back = powers(pow(_BASE, -1, 1 << 64))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


#: Bits that a word sets.
SPOTS = 3


def _spot(hashes: np.ndarray, k: int, bits: int) -> np.ndarray:
    """The k-th bit of each hash; bits: a power of 2."""
    return (hashes + np.uint64(k) * (hashes >> np.uint64(32) | np.uint64(1))) & np.uint64(bits - 1)


class Sieve:
    """Finds the places in texts that may hold a word of a list, by its words' lengths, last code points and a bitmap of their hashes: no word is missed, some that are none pass."""

    def __init__(self, lengths: list[int], last: list[str], slots: np.ndarray) -> None:
        self.lengths, self.last, self.slots = sorted(lengths), np.zeros(0x110000, bool), slots
        self.last[[ord(c) for c in last]] = True

    def found(self, texts: list[str]) -> Iterator[str]:
        """What stands at each such place."""
        codes, begin = code_points(texts)
        joined, hashes, bits = "".join(t + MARK for t in texts), _Hashes(codes), 64 * len(self.slots)
        stop = np.flatnonzero(self.last[codes])
        room = stop + 1 - begin[np.searchsorted(begin, stop, "right") - 1]
        for n in self.lengths:
            fits = room >= n
            stop, room = stop[fits], room[fits]
            at, h = stop + 1 - n, hashes.of(stop + 1 - n, stop + 1)
            for k in range(SPOTS):
                spot = _spot(h, k, bits)
                held = (self.slots[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)
                at, h = at[held], h[held]
            yield from (joined[a : a + n] for a in at.tolist())


def learn_sieve(words: DataFrame, n: int) -> Sieve:
    """A sieve of the n distinct words (`word`), which are read three times; only its bits, lengths and code points come to the driver."""
    bits = min(SIEVE_BITS, 1 << max(6, (BITS_A_WORD * n).bit_length()))

    def mark(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            codes, begin = code_points(f.word.tolist())
            h = _Hashes(codes).of(begin[:-1], begin[1:] - 1)
            spots = np.unique(np.concatenate([_spot(h, k, bits) for k in range(SPOTS)]))
            slot, first = np.unique(spots >> np.uint64(6), return_index=True)
            if len(slot):
                yield pd.DataFrame({"slot": slot.astype(np.int64), "bits": np.bitwise_or.reduceat(np.uint64(1) << (spots & np.uint64(63)), first).view(np.int64)})

    marked = words.select("word").mapInPandas(mark, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots = np.zeros(bits // 64, np.int64)
    slots[marked["slot"].to_numpy()] = marked["bits"].to_numpy()
    lengths = [r.n for r in words.select(F.length("word").alias("n")).distinct().collect()]
    last = [r.c for r in words.select(F.right("word", F.lit(1)).alias("c")).distinct().collect()]  # as many as there are code points at most
    return Sieve(lengths, last, slots.view(np.uint64))


def learned_costs(n: np.ndarray, total: int) -> list[int]:
    return np.floor(100 * np.log(total / n) + 0.5).astype(np.int64).tolist()


def learn_lattice(words: DataFrame, texts: DataFrame, word: str = "word", text: str = "text", rounds: int = 2, most_words: int = MOST_WORDS) -> Lattice:
    """A lattice of the distinct words, each at 100 * ln(N / n), rounded, where n is one more than how often the texts use it and N the sum over all words.

    The first round counts all places, each further one those of the path of least cost by the costs so far. The list must not have more than `most_words`."""
    listed = words.where(F.length(word) > 0).select(F.col(word).alias("word")).distinct()
    if listed.limit(most_words + 1).count() > most_words:
        raise ValueError(f"a word list that is broadcast may have {most_words} words")
    names = sorted(r.word for r in listed.collect())
    lattice = None
    for _ in range(rounds):
        n = dict.fromkeys(names, 1)
        for r in counted_words(texts, text, names, lattice).collect():  # as many rows as there are words at most
            n[r.word] += r.n
        total = sum(n.values())
        lattice = Lattice(names, learned_costs(np.array([n[w] for w in names], np.int64), total))
    return lattice or Lattice(names, [0] * len(names))


def segment_words(df: DataFrame, text: str, lattice: Lattice, name: str = "words") -> DataFrame:
    """Adds array<struct(word, start, end, word_like)>, empty for a null text; places are counted in code points."""
    sent = df.sparkSession.sparkContext.broadcast(lattice)

    @F.pandas_udf("array<struct<word:string,start:int,end:int,word_like:boolean>>")
    def split(s: pd.Series) -> pd.Series:
        texts = [t or "" for t in s]
        out: list[list[dict]] = [[] for _ in texts]
        for part in slices(texts):
            row, start, end, wordy = sent.value.segment(texts[part])
            for r, a, b, w in zip((row + part.start).tolist(), start.tolist(), end.tolist(), wordy.tolist(), strict=True):
                out[r].append({"word": texts[r][a:b], "start": a, "end": b, "word_like": w})
        return pd.Series(out)

    return df.withColumn(name, split(F.col(text)))
