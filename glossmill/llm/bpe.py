"""Byte-level BPE encoding and decoding.

The merge table is compiled, as it is used, into a deterministic transducer. A state is the bytes
read since the last token sent, with the tokens that may precede what comes; a step reads a byte and emits the tokens on which all
continuations of the piece agree, so no state holds more bytes than a few token lengths. Tokens
follow from one fact about merges by rank: the encoding of a prefix is the encoding of a shorter
prefix and one more token, namely the only one that can stand next to that prefix's last token.

Texts are cut into pieces by a pattern; pieces never merge with each other. The new pieces of two MB of
text are read together, a byte of each at a time, with states and moves in arrays; long pieces are
read alone. Decoding goes token by token through an incremental UTF-8 state machine, so that a code
point may span tokens and chunks.

Defined cases: a null text counts as empty; an empty text has no ids; invalid UTF-8 (which no Spark
string holds) would decode to U+FFFD; rows may repeat and keep their multiplicity; columns other
than the id and the text are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Bytes, about, that a task keeps of cuts seen, of states that read one piece, of states that read many, and of token pairs; beyond, it starts anew.
PIECE_BYTES, STATE_BYTES, MANY_BYTES, PAIR_BYTES = 80 << 20, 16 << 20, 96 << 20, 32 << 20
#: Characters of the longest cut that is kept.
KEPT_CHARS = 64
#: Bytes of the longest piece that is read together with others, and of pending bytes then.
PIECE, PENDING = 48, 20
#: Bytes of text whose pieces are read together.
CHUNK = 2 << 20
#: Places, as a power of two, for pairs of tokens seen by pieces that are read together.
PAIR_BITS = 19
#: Tokens decoded in one step of the stream.
STREAM_TOKENS = 4096


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


KEY, END = -1, -2


class Transducer:
    """Lazily determinised: states and steps are made when a text first needs them."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        self.size = [len(self.text.get(i, b"")) for i in range(max(self.text) + 1)]
        self.one = [bytes([i]) for i in range(256)]
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: dict[tuple[int, bool], list] = {}
        #: Tokens that merging can't reach; they stand only as whole pieces.
        self.apart = {i for t, i in ranks.items() if len(t) > 1 and self.merged(t) != [i]}
        self.reached = {t: i for t, i in ranks.items() if i not in self.apart}
        self.clear()

    def clear(self) -> None:
        """A state is a dictionary: by byte the next state and the tokens sent; under KEY what it stands for, under END the tokens sent at the end."""
        self.states: dict[tuple, dict] = {}
        self.held = 0
        self.start = self.state(((-1,), b"", (0,)))

    def state(self, key: tuple) -> dict:
        known = self.states.get(key)
        if known is None:
            known = self.states[key] = {KEY: key}
            self.held += 900 + 60 * len(key[1])
        return known

    def merged(self, piece: bytes) -> list[int]:
        """By the definition: merge the pair of lowest rank, leftmost first, while there is one."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        none = len(self.ranks) + 1
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            if best == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def edge(self, token: int, right: bool) -> list[tuple[bytes, int, int]]:
        """The parts that stand at one end of a token while it is merged: text, rank when made, rank when taken."""
        known = self.edges.get((token, right))
        if known is None:
            text, known, upto = self.text[token], [], len(self.ranks)
            while True:
                known.append((text, self.ranks[text] if len(text) > 1 else -1, upto))
                if len(text) == 1:
                    break
                upto = self.ranks[text]
                cut = self.cut(text)
                text = text[cut:] if right else text[:cut]
            self.edges[token, right] = known
        return known

    def cut(self, text: bytes) -> int:
        """Where the last merge that makes a token joins its two parts."""
        parts = [text[i : i + 1] for i in range(len(text))]
        none = len(self.ranks) + 1
        while len(parts) > 2:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], none), i) for i in range(len(parts) - 1))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return len(parts[0])

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side: no merge across them comes before the parts are taken.

        Goes back in time, undoing whichever side was merged later, over the parts that ever stood side by side."""
        edges, get = self.edges, self.ranks.get
        ends, firsts = edges.get((left, True)) or self.edge(left, True), edges.get((right, False)) or self.edge(right, False)
        i = j = 0
        a, made_a, taken_a = ends[0]
        b, made_b, taken_b = firsts[0]
        known = True
        while True:
            rank = get(a + b)
            if rank is not None:
                when = made_a if made_a > made_b else made_b
                if rank > when:
                    when = rank
                if when < taken_a and when <= taken_b:
                    known = False
                    break
            if made_a > made_b:
                i += 1
                a, made_a, taken_a = ends[i]
            elif made_b >= 0:
                j += 1
                b, made_b, taken_b = firsts[j]
            else:
                break
        return known

    def fit(self, left: int, right: int) -> bool:
        """As fits(), remembered."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > PAIR_BYTES // 210:
                self.pairs.clear()
            known = self.pairs[left, right] = self.fits(left, right)
        return known

    def sent(self, last: tuple, end: int) -> tuple[int, ...]:
        """The tokens of the first `end` pending bytes."""
        out, size = [], self.size
        while end:
            token = last[end]
            out.append(token)
            end -= size[token]
        return tuple(out[::-1])

    def step(self, state: tuple, byte: int) -> tuple[tuple, tuple[int, ...]]:
        lasts, pending, live = state
        pending += self.one[byte]
        n, found, still = len(pending), None, []
        get, prefixes = self.reached.get, self.prefixes
        for k in live:
            text = pending[k:]
            if found is None:
                token = get(text)
                if token is not None:
                    left = lasts[k]
                    if left < 0 or self.fit(left, token):
                        found = token
            if text in prefixes:
                still.append(k)
        last = (*lasts, found)
        still.append(n)
        cut = still[0]
        if cut:
            # the last boundary that the encodings of all live prefixes share
            size = self.size
            for k in still[1:]:
                while k != cut:
                    if k > cut:
                        k -= size[last[k]]
                    else:
                        cut -= size[last[cut]]
        sent = self.sent(last, cut)
        if cut:
            last, pending = last[cut:], pending[cut:]
        if still[0] > cut:  # no token begins at the first boundary, so what stands before it no longer matters
            last = (-1, *last[1:])
        return (last, pending, tuple([k - cut for k in still])), sent

    def end(self, state: tuple) -> tuple[int, ...]:
        return self.sent(state[0], len(state[1]))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None and whole in self.apart:
            return [whole]
        state = self.start
        out: list[int] = []
        for byte in piece:
            move = state.get(byte)
            if move is None:
                if self.held > STATE_BYTES:
                    key = state[KEY]
                    self.clear()
                    state = self.state(key)
                key, sent = self.step(state[KEY], byte)
                move = state[byte] = (self.state(key), sent)
            state, sent = move
            if sent:
                out += sent
        tail = state.get(END)
        if tail is None:
            tail = state[END] = self.end(state[KEY])
        out += tail
        return out


U64 = np.uint64


class Numbers:
    """Numbers by 64-bit key, looked up many at a time: open addressing in two arrays, at most half full."""

    def __init__(self, room: int = 1 << 12) -> None:
        self.key, self.number, self.held = np.full(room, -1, np.int64), np.zeros(room, np.int32), 0

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(U64) * U64(K.BASE)) >> U64(65 - len(self.key).bit_length())).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        at = self.place(key)
        got = self.key[at]
        out = np.where(got == key, self.number[at], -1)
        on = np.flatnonzero((got != key) & (got != -1))
        while len(on):
            at[on] = (at[on] + 1) & (len(self.key) - 1)
            got = self.key[at[on]]
            hit = got == key[on]
            out[on[hit]] = self.number[at[on[hit]]]
            on = on[~hit & (got != -1)]
        return out

    def add(self, key: np.ndarray, number: np.ndarray) -> None:
        """Keys that differ and are not there yet."""
        self.held += len(key)
        if 2 * self.held > len(self.key):
            full = np.flatnonzero(self.key != -1)
            key, number = np.concatenate([self.key[full], key]), np.concatenate([self.number[full], number])
            room = 1 << (2 * self.held).bit_length()
            self.key, self.number = np.full(room, -1, np.int64), np.zeros(room, np.int32)
        at, on = self.place(key), np.arange(len(key))
        while len(on):
            free = on[self.key[at[on]] == -1]
            self.key[at[free]] = key[free]  # of several, one stays
            mine = self.key[at[on]] == key[on]
            done = on[mine]
            self.number[at[done]] = number[done]
            on = on[~mine]
            at[on] = (at[on] + 1) & (len(self.key) - 1)


class Grown:
    """An array that is added to at its end."""

    def __init__(self) -> None:
        self.data, self.n = np.zeros(1 << 12, np.int32), 0

    def add(self, x: np.ndarray) -> None:
        if self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + len(x), np.int32)])
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


class Many:
    """The transducer over many pieces at a time: a step reads one byte of each. States and moves are made when
    first needed, all those of a step together; they are the same as the Transducer's, kept in arrays."""

    START, DEAD = 0, 1

    def __init__(self, one: Transducer) -> None:
        self.one = one
        texts = sorted(one.prefixes | set(one.reached))
        up, down = K._POWERS[K.BASE].get(max(map(len, texts)) + PENDING + 2)
        self.up, self.down = up[: PENDING + 2], down[: PENDING + 2]
        size = np.array([len(t) for t in texts])
        value = np.frombuffer(b"".join(texts), np.uint8).astype(U64) + U64(1)
        first = np.cumsum(size) - size
        value *= up[np.arange(len(value)) - np.repeat(first, size)]
        h = np.add.reduceat(value, first).view(np.int64)
        if len(np.unique(h)) < len(h) or (h == -1).any():
            raise ValueError("two parts of tokens share a hash")
        self.part = Numbers()
        self.part.add(h, np.arange(len(h), dtype=np.int32))
        self.token = np.array([one.reached.get(t, -1) for t in texts], np.int32)
        self.prefix = np.array([t in one.prefixes for t in texts])
        self.size = np.array(one.size, np.int32)
        self.words = [str(i) for i in range(len(self.size))]
        self.forget()

    def clear(self) -> None:
        self.states, self.moves = Numbers(), Numbers()
        self.n = 2
        self.last = np.full((1024, PENDING + 1), -1, np.int32)
        self.pending = np.zeros((1024, PENDING), np.uint8)
        self.m = np.zeros(1024, np.int8)
        self.live = np.ones(1024, np.int64)
        #: By move: next state, place and number of the tokens sent.
        self.next, self.at, self.count, self.sent = Grown(), Grown(), Grown(), Grown()

    def held(self) -> int:
        """Bytes of all states and moves."""
        of = [self.last, self.pending, self.m, self.live, *(x.data for x in (self.next, self.at, self.count, self.sent)), *(y for x in (self.states, self.moves) for y in (x.key, x.number))]
        return sum(x.nbytes for x in of)

    def forget(self) -> None:
        self.clear()
        #: By place, the pair of tokens that fell there last, and whether they can stand side by side.
        self.pair, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = ((key.astype(U64) * U64(K.BASE)) >> U64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_fits[at]
        known = (self.pair[at] == key) | (left < 0)
        out[left < 0] = True
        if not known.all():
            new = np.flatnonzero(~known)
            asked, inverse = np.unique(key[new], return_inverse=True)
            fits = self.one.fits
            answer = np.array([fits(a, b) for a, b in zip((asked >> 32).tolist(), (asked & 0xFFFFFFFF).tolist(), strict=True)], bool)
            out[new] = answer[inverse]
            at = ((asked.astype(U64) * U64(K.BASE)) >> U64(64 - PAIR_BITS)).astype(np.int64)
            self.pair[at] = asked
            mine = self.pair[at] == asked  # of several that fall on a place, one stays
            self.pair_fits[at[mine]] = answer[mine]
        return out

    def make(self, key: np.ndarray) -> np.ndarray:
        """Moves for pairs of state and byte that have none; as Transducer.step()."""
        s, byte = key >> 8, key & 255
        n = len(s)
        each = np.arange(n)
        m, live, last, pending = self.m[s].astype(np.int64), self.live[s], self.last[s], self.pending[s]
        dead = (s == self.DEAD) | (m >= PENDING)
        m[dead], live[dead] = 0, 1
        end = m + 1
        pending[each, m] = byte
        pre = np.zeros((n, PENDING + 1), U64)
        np.cumsum((pending + U64(1)) * self.up[:PENDING], axis=1, out=pre[:, 1:])
        whole = pre[each, end]
        # the live places, row by row, and what stands from there to the end
        row, k = np.nonzero(live[:, None] >> np.arange(int(m.max()) + 1) & 1)
        part = self.part.find(((whole[row] - pre[row, k]) * self.down[k]).view(np.int64))
        some = np.flatnonzero(part >= 0)
        row, k, part = row[some], k[some], part[some]
        on = self.prefix[part]
        still = np.bincount(row[on], weights=np.ldexp(1.0, k[on]), minlength=n).astype(np.int64)
        token, found = self.token[part], np.full(n, -1, np.int32)
        on = np.flatnonzero(token >= 0)
        row, left, token = row[on], last[row[on], k[on]], token[on]
        beyond = np.searchsorted(row, each, "right")
        try_ = np.searchsorted(row, each)  # the longest that may stand there first
        open_ = each[try_ < beyond]
        while len(open_):
            at = try_[open_]
            good = self.fits(left[at], token[at])
            found[open_[good]] = token[at[good]]
            open_ = open_[~good]
            try_[open_] += 1
            open_ = open_[try_[open_] < beyond[open_]]
        last[each, end] = found
        still |= np.int64(1) << end
        least = np.log2((still & -still).astype(np.float64)).astype(np.int64)
        cut = least.copy()
        for k in range(1, int(end.max()) + 1):
            on = np.flatnonzero((least > 0) & (least < k) & ((still >> k) & 1 == 1))
            a, b = np.full(len(on), k), cut[on]
            while (apart := np.flatnonzero(a != b)).size:
                up = apart[a[apart] > b[apart]]
                down = apart[a[apart] < b[apart]]
                a[up] -= self.size[last[on[up], a[up]]]
                b[down] -= self.size[last[on[down], b[down]]]
            cut[on] = b
        row, tokens = self.back(last, cut)
        count = np.bincount(row, minlength=n).astype(np.int32)
        first = self.sent.n + np.cumsum(count) - count
        self.sent.add(tokens)
        place = np.arange(PENDING + 1)
        shifted = np.minimum(place + cut[:, None], PENDING)
        rest = (whole - pre[each, cut]) * self.down[cut]
        m = end - cut
        beyond = place > m[:, None]
        last, pending = last[each[:, None], shifted], pending[each[:, None], np.minimum(shifted[:, :-1], PENDING - 1)]
        last[least > cut, 0] = -1  # no token begins there, so what stands before it no longer matters
        last[beyond], pending[beyond[:, 1:]] = -1, 0
        live = still >> cut
        name = K.mix(live.astype(U64) + K.mix(rest + m.astype(U64)))
        for k in range(int(m.max()) + 1):
            name = np.where(k <= m, K.mix(name + last[:, k].astype(U64)), name)
        names, seen, inverse = np.unique(name.view(np.int64), return_index=True, return_inverse=True)
        to = self.states.find(names)
        fresh = np.flatnonzero(to < 0)
        if len(fresh):
            to[fresh] = self.n + np.arange(len(fresh))
            self.states.add(names[fresh], to[fresh])
            new = seen[fresh]
            more = self.n + len(new) - len(self.m)
            if more > 0:
                for x in ("last", "pending", "m", "live"):
                    old = getattr(self, x)
                    setattr(self, x, np.concatenate([old, np.zeros((more + len(old) // 4, *old.shape[1:]), old.dtype)]))
            part = slice(self.n, self.n + len(new))
            self.last[part], self.pending[part], self.m[part], self.live[part] = last[new], pending[new], m[new], live[new]
            self.n += len(new)
        to = to[inverse]
        to[dead] = self.DEAD
        made = np.arange(self.next.n, self.next.n + n)
        self.moves.add(key, made)
        self.next.add(to)
        self.at.add(first)
        self.count.add(count)
        return made

    def back(self, last: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row by row the tokens of the pending bytes up to an end."""
        rows, tokens, end, on, n = [], [], end.copy(), np.flatnonzero(end > 0), 0
        while len(on):
            token = last[on, end[on]]
            rows.append(on)
            tokens.append(token)
            end[on] -= self.size[token]
            on = on[end[on] > 0]
            n += 1
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        step = np.repeat(np.arange(n), [len(x) for x in rows])
        rows, tokens = np.concatenate(rows), np.concatenate(tokens)
        order = np.lexsort((-step, rows))
        return rows[order], tokens[order]

    def encode(self, pieces: list[bytes]) -> list[str]:
        """The ids of each piece, joined by commas."""
        if self.held() > MANY_BYTES:
            self.clear()
        size = np.array([len(p) for p in pieces])
        by = np.argsort(-size, kind="stable")
        size = size[by]
        wide = int(size[0]) if len(size) else 0
        grid = np.frombuffer(b"".join(pieces[k].ljust(wide, b"\0") for k in by.tolist()), np.uint8).reshape(len(by), wide)
        state, path = np.zeros(len(by), np.int64), np.full((len(by), wide), -1, np.int32)
        for k in range(wide):
            n = int(np.searchsorted(-size, -k, "left"))  # those longer than k
            key = state[:n] << 8 | grid[:n, k]
            move = self.moves.find(key)
            new = np.flatnonzero(move < 0)
            if len(new):
                asked, inverse = np.unique(key[new], return_inverse=True)
                move[new] = self.make(asked)[inverse]
            path[:n, k] = move
            state[:n] = self.next.data[move]
        ends, inverse = np.unique(state, return_inverse=True)
        row, tokens = self.back(self.last[ends], self.m[ends].astype(np.int64))
        tail = np.bincount(row, minlength=len(ends))
        flat = np.concatenate([self.sent.data[: self.sent.n], tokens])
        count = np.concatenate([np.where(path >= 0, self.count.data[path], 0), tail[inverse][:, None]], axis=1, dtype=np.int32)
        at = np.concatenate([self.at.data[path], (self.sent.n + np.cumsum(tail) - tail)[inverse][:, None]], axis=1, dtype=np.int32)
        total = count.sum(axis=1)
        some = np.flatnonzero(count)
        count, at = count.ravel()[some], at.ravel()[some]
        ids = flat[np.arange(int(count.sum())) + np.repeat(at - np.cumsum(count) + count, count)].tolist()
        words, lo = self.words, 0
        out = [""] * len(by)
        for k, n, s in zip(by.tolist(), total.tolist(), state.tolist(), strict=True):
            out[k] = ",".join([words[x] for x in ids[lo : lo + n]]) if s != self.DEAD else ",".join(map(str, self.one.encode(pieces[k])))
            lo += n
        return out


#: Characters that are a piece behind letters, if nothing follows.
MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
SAFE_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85]) (?=[^\s\x1c-\x1f\x85])").split


#: Fixed values, after the Unicode standard's table of well-formed UTF-8: class by byte. 0 ASCII and bytes that fit nowhere,
#: 1 80-8F, 2 90-9F, 3 A0-BF, 4 C2-DF, 5 E0, 6 E1-EC and EE-EF, 7 ED, 8 F0, 9 F1-F3, 10 F4.
UTF8_CLASS = bytes([0] * 128 + [1] * 16 + [2] * 16 + [3] * 32 + [0] * 2 + [4] * 30 + [5] + [6] * 12 + [7] + [6] * 2 + [8] + [9] * 3 + [10] + [0] * 11)
#: The state after a lead byte, by class; and after 80-8F, 90-9F and A0-BF, by state.
UTF8_LEADS = {4: 1, 5: 4, 6: 2, 7: 5, 8: 6, 9: 3, 10: 7}
UTF8_AFTER = [(0, 0, 0), (0, 0, 0), (1, 1, 1), (2, 2, 2), (0, 0, 1), (1, 1, 0), (0, 2, 2), (2, 0, 0)]
UTF8_NEXT = [[after[c - 1] if 1 <= c <= 3 else UTF8_LEADS.get(c, 0) for c in range(11)] for after in UTF8_AFTER]


class Utf8Stream:
    """Incremental UTF-8: what it is fed comes out as text as soon as code points are complete.

    A table says for each state and class of byte which state follows. State 0 stands between code points, 1 to 3
    are the bytes still due, 4 to 7 those after E0, ED, F0 and F4, whose next byte has a shorter range; what fits
    nowhere leads to state 0, and shows as U+FFFD. As any lead byte starts from state 0, the machine
    only has to run from the last lead byte of what it is fed."""

    def __init__(self) -> None:
        self.held = b""

    def feed(self, data: bytes) -> str:
        data = self.held + data
        tail = data[-4:].translate(UTF8_CLASS)
        state = start = 0
        for k, kind in enumerate(tail):
            before, state = state, UTF8_NEXT[state][kind]
            if state and (not before or kind > 3):
                start = k
        cut = len(data) - (len(tail) - start if state else 0)
        self.held = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encodes and decodes whole texts; ids as decimal text, joined by commas.

    A single space between other characters always begins a piece, so that texts are cut there
    first and what stands between two such spaces is looked up as a whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.transducer = Transducer(ranks)
        self.many = Many(self.transducer)
        self.find = regex.compile(pattern).findall
        #: Ids by cut, of the last two generations; a full one becomes the old one, from which what is still asked for comes back.
        self.new, self.old, self.held = {}, {}, 0
        #: The bytes of each id.
        self.bytes = pa.array([self.transducer.text.get(i, b"") for i in range(len(self.transducer.size))], pa.large_binary())

    def forget(self) -> None:
        """What was learned from texts goes, so that an idle worker holds no more than the tables of the vocabulary."""
        self.new, self.old, self.held = {}, {}, 0
        self.transducer.pairs.clear()
        self.transducer.clear()
        self.many.forget()
        K.release()

    @staticmethod
    def odd(cut: str) -> bool:
        """Whether a cut at every space is none: it is empty or has white space at an end (the first one behind its mark)."""
        return cut[-1:].isspace() or not cut or cut[0] != " " and cut[0].isspace()

    def learn(self, words: list[str], mixed: Iterable[str]) -> dict[str, str]:
        """The ids of cuts that are not known yet; words are of letters only, each one piece with the space before it."""
        find, ranks, known = self.find, self.transducer.ranks, self.new.get
        tailed, others = [], []
        for c in mixed:
            (tailed if c[-1:] in MARKS and c[:-1].isalpha() else others).append(c)  # a word and a mark are two pieces
        pieces = [find(c[1:] if c[:1] == " " else " " + c) for c in others]
        pieces += [(" " + c[:-1], c[-1]) for c in tailed]
        ids: dict[str, str] = {}
        place, later = dict(zip(words, range(len(words)), strict=True)), []
        rest = [" " + c for c in words]
        for piece in set().union(*pieces):
            word = piece[1:] if piece[0] == " " else ""
            before = known(word) if word else None
            if before is not None:
                ids[piece] = before
            elif word in place:
                later.append(piece)
            else:
                rest.append(piece)
        raws = [piece.encode() for piece in rest]
        wholes = list(map(ranks.get, raws))
        got = ["" if x is None else str(x) for x in wholes]  # a piece that is a token stays whole
        todo = [k for k, x in enumerate(wholes) if x is None]
        together = [k for k in todo if len(raws[k]) <= PIECE]
        for k, x in zip(together, self.many.encode([raws[k] for k in together]), strict=True):
            got[k] = x
        for k in todo:
            if len(raws[k]) > PIECE:
                got[k] = ",".join(map(str, self.transducer.encode(raws[k])))
        ids.update(zip(rest[len(words) :], got[len(words) :], strict=True))
        ids.update((piece, got[place[piece[1:]]]) for piece in later)
        get = ids.__getitem__
        out = dict(zip(words, got))  # those of words stand first
        out.update(zip([*others, *tailed], [",".join(map(get, x)) for x in pieces], strict=True))
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[str]:
        """The ids of each text, joined by commas; the new cuts of about CHUNK bytes are encoded together."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append((" " + text).split(" ")[1:])
            held[-1][0] = " " + held[-1][0]
            size += len(text)
            if size >= CHUNK:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[list[str]]) -> list[str]:
        """The texts cut at every space, the first cut of each marked by one: where all cuts are whole, each space stood
        between other characters and begins a piece. Other texts are cut again, only there. No odd cut is ever kept."""
        new, old = self.new, self.old
        back: dict[str, str] = {}

        def unknown() -> tuple[list[str], set[str]]:
            asked = set().union(*held).difference(new)
            if old:
                back.update((c, old[c]) for c in asked.intersection(old))
                asked.difference_update(back)
            words = list(filter(str.isalpha, asked))
            return words, asked.difference(words)

        words, mixed = unknown()
        wrong = set(filter(self.odd, mixed))
        if wrong:
            for k, parts in enumerate(held):
                if not wrong.isdisjoint(parts):
                    held[k] = SAFE_CUT(" ".join(parts)[1:])
                    held[k][0] = " " + held[k][0]
            words, mixed = unknown()
        new.update(back)
        learned = self.learn(words, mixed)
        new.update(learned)
        get = new.__getitem__
        out = [",".join(map(get, parts)) for parts in held]
        out = [x if x[:1] != "," else x[1:] for x in out]
        for c in [*mixed, *(c for c in words if len(c) > KEPT_CHARS)]:
            if len(c) > KEPT_CHARS or self.odd(c):
                del new[c]
        for x in (back, learned):
            self.held += 200 * len(x) + 2 * sum(map(len, x)) + sum(map(len, x.values()))
        if self.held > PIECE_BYTES // 2:
            self.old, self.new, self.held = new, {}, 0
        return out

    def encode(self, text: str) -> str:
        return next(self.encode_all([text]))

    def decode(self, ids: str) -> Iterator[tuple[bytes, str]]:
        """Chunks of bytes and of text."""
        stream = Utf8Stream()
        numbers = np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32)
        for k in range(0, len(numbers), STREAM_TOKENS):
            _, offsets, raw = self.bytes.take(pa.array(numbers[k : k + STREAM_TOKENS])).buffers()
            data = raw.to_pybytes()
            yield data, stream.feed(data)
        yield b"", stream.close()


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process, so that its states serve all tasks."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ids (array<int>), decoded (text after a round trip)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            ids, back = [], []
            for joined in c.encode_all(x.as_py() or "" for x in batch.column(1)):
                ids.append([int(x) for x in joined.split(",")] if joined else [])
                back.append("".join(t for _, t in c.decode(joined)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())], names=["id", "ids", "decoded"])
        c.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digest_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, n_chars (code points of the streamed text); no shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            n, ids_sha, back_sha, chars = [], [], [], []
            for joined in c.encode_all(x.as_py() or "" for x in batch.column(1)):
                n.append(joined.count(",") + 1 if joined else 0)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                sha, length = hashlib.sha256(), 0
                for data, out in c.decode(joined):
                    sha.update(data)
                    length += len(out)
                back_sha.append(sha.hexdigest())
                chars.append(length)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(back_sha), pa.array(chars, pa.int64())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars"])
        c.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars long")
    return out.withColumnRenamed("id", id_col)
