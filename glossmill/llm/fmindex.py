"""A bidirectional FM-index over a delimited list of words, searched for all queries side by side in numpy.

The text is `$w1$w2$...$`, read as a ring. A pattern's occurrences are an interval of suffix ranks in the text and
one in the reversed text, of one size; a letter before the pattern steps in the first and one behind it in the
second, and the other interval follows by how many smaller letters stand at the step. Wavelet matrices count letters.
"""

from __future__ import annotations

import numpy as np

#: Queries searched side by side.
TOGETHER = 20_000


def rotations(text: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Starts of the ring's rotations in the order of their first `depth` letters, by prefix doubling from packed letters."""
    n, size = len(text), max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for k in range(size):
        key = (key << bits) | np.roll(text, -k)
    while True:
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if size >= depth or rank[order[-1]] == n - 1:
            return order
        key = rank * n + np.roll(rank, -size)
        size *= 2


class Wavelet:
    """Counts of letters before places of a sequence, by one bit of the letter after the other."""

    def __init__(self, letters: np.ndarray, bits: int) -> None:
        self.zeros = []
        for b in range(bits - 1, -1, -1):
            clear = (letters >> b) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(clear)]).astype(np.int32))
            letters = np.concatenate([letters[clear], letters[~clear]])
        found, first = np.unique(letters, return_index=True)
        self.start = np.zeros(1 << bits, np.int64)
        self.start[found] = first

    def one(self, lo: np.ndarray, hi: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of a letter for each interval: its number before the interval and in it, and that of smaller letters in it."""
        smaller = np.zeros(len(lo), np.int64)
        for k, z in enumerate(self.zeros):
            is_one = (letter >> (len(self.zeros) - 1 - k)) & 1 == 1
            a, b = z[lo], z[hi]
            smaller += np.where(is_one, b - a, 0)
            lo, hi = np.where(is_one, lo - a + z[-1], a), np.where(is_one, hi - b + z[-1], b)
        return lo - self.start[letter], hi - lo, smaller

    def every(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """As one(), for all letters of each interval: which interval, letter, number before and in it, smaller ones in it."""
        who, letter, smaller = np.arange(len(lo)), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for z in self.zeros:
            a, b = z[lo], z[hi]
            left, right = np.flatnonzero(b > a), np.flatnonzero(hi - lo > b - a)
            both = np.concatenate([left, right])
            who, letter = who[both], np.concatenate([letter[left] * 2, letter[right] * 2 + 1])
            smaller = np.concatenate([smaller[left], smaller[right] + (b - a)[right]])
            lo, hi = np.concatenate([a[left], (lo - a)[right] + z[-1]]), np.concatenate([b[left], (hi - b)[right] + z[-1]])
        return who, letter, lo - self.start[letter], hi - lo, smaller


class Index:
    """words: distinct, not empty, without line feeds, in code-point order."""

    def __init__(self, words: list[str]) -> None:
        codes = np.frombuffer(("\n" + "\n".join(words) + "\n").encode("utf-32-le"), np.uint32)
        self.alphabet, text = np.unique(np.where(codes == 10, 0, codes), return_inverse=True)
        self.text = text.astype(np.int64)
        marks = np.flatnonzero(self.text == 0)
        self.start, self.length = marks[:-1] + 1, np.diff(marks) - 1
        bits = max(1, int(len(self.alphabet) - 1).bit_length())
        depth = int(self.length.max()) + 2
        self.before = np.concatenate([[0], np.cumsum(np.bincount(self.text, minlength=len(self.alphabet)))])
        self.order = rotations(self.text, bits, depth)
        back = self.text[::-1]
        other = rotations(back, bits, depth)
        self.left, self.right = Wavelet(self.text[self.order - 1], bits), Wavelet(back[other - 1], bits)
        # how many equal letters stand from each place on
        change = np.flatnonzero(np.diff(self.text)) + 1
        ends = np.append(change, len(self.text))
        self.run = ends[np.searchsorted(ends, np.arange(len(self.text)), "right")] - np.arange(len(self.text))

    def near(self, queries: np.ndarray, exact: np.ndarray, rightwards: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `queries`, word, common prefix) of the words that differ from a query, a word's number, by one replaced or one
        inserted letter (so no shorter ones) behind its first `exact` letters, or before its last ones if not rightwards. Each is found once."""
        parts = [self._near(queries[k : k + TOGETHER], exact[k : k + TOGETHER], rightwards) for k in range(0, len(queries), TOGETHER)]
        none = np.zeros(0, np.int64)
        found = [[p[c] + (k * TOGETHER if c == 0 else 0) for k, p in enumerate(parts)] for c in range(3)]
        return tuple(np.concatenate([none, *f]) for f in found)

    def _near(self, queries: np.ndarray, exact: np.ndarray, rightwards: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        steps = self.right if rightwards else self.left
        length, first = self.length[queries], self.start[queries]
        place = (lambda q, j: first[q] + j) if rightwards else (lambda q, j: first[q] + length[q] - 1 - j)
        # undamaged patterns: query, interval where steps are made, its twin, size; all have read j letters behind the mark
        q = np.arange(len(queries))
        x, y = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        size = np.full(len(q), self.before[1])
        pool = [np.zeros(0, np.int64) for _ in range(6)]  # patterns with their one error: query, letters read, interval, twin, size, common prefix
        found, j = [], 0
        while len(q) or len(pool[0]):
            if len(pool[0]):
                p, at, px, py, psize, same = pool
                letter = self.text[place(p, at)]
                ahead, psize, smaller = steps.one(px, px + psize, letter)
                px, py = self.before[letter] + ahead, py + smaller
                over = (psize > 0) & (at == length[p])
                if over.any():
                    forward = (py if rightwards else px)[over]
                    # a whole word between marks: its mark is the first letter of the pattern
                    found.append((p[over], np.searchsorted(self.start, self.order[forward] + 1), same[over]))
                go = np.flatnonzero((psize > 0) & ~over)
                pool = [p[go], at[go] + 1, px[go], py[go], psize[go], same[go]]
            if len(q):
                own = self.text[place(q, j)]
                ahead_only = j < exact[q]
                more = []
                k = np.flatnonzero(ahead_only)
                if len(k):
                    ahead, s, smaller = steps.one(x[k], x[k] + size[k], own[k])
                    more.append((q[k], self.before[own[k]] + ahead, y[k] + smaller, s))
                k = np.flatnonzero(~ahead_only)
                if len(k):
                    who, letter, ahead, s, smaller = steps.every(x[k], x[k] + size[k])
                    who = k[who]
                    nx, ny, nq, read = self.before[letter] + ahead, y[who] + smaller, q[who], own[who]
                    right_one = (letter == read) & (letter > 0)
                    more.append((nq[right_one], nx[right_one], ny[right_one], s[right_one]))
                    odd = np.flatnonzero((letter != read) & (letter > 0))
                    o = nq[odd]
                    if rightwards:
                        replaced = inserted = np.full(len(o), j)
                    else:
                        replaced = length[o] - 1 - j
                        at = length[o] - j  # an inserted letter can go on with equal letters behind it
                        here = self.text[first[o] + at] == letter[odd]
                        inserted = at + np.where(here, self.run[first[o] + at], 0)
                    inside = j < length[o]
                    new = [(o[inside], np.full(inside.sum(), j + 1), nx[odd][inside], ny[odd][inside], s[odd][inside], np.broadcast_to(replaced, len(o))[inside]), (o, np.full(len(o), j), nx[odd], ny[odd], s[odd], inserted)]
                    pool = [np.concatenate([pool[c], *(n[c] for n in new)]) for c in range(6)]
                q, x, y, size = (np.concatenate([m[c] for m in more]) for c in range(4))
                alive = np.flatnonzero((size > 1) & (j < length[q]))  # a pattern that one word has is that of the query itself
                q, x, y, size = q[alive], x[alive], y[alive], size[alive]
                j += 1
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate([f[c] for f in found]) for c in range(3))
