"""Exact removal of repeated 50-byte strings by a sparse, hash-compared suffix sort.

A byte goes if a 50-byte string over it also starts in a document with a smaller id.

1. The texts are dealt into packs of about 4 MB; all later steps work pack by pack.
2. Every 50-byte window has an anchor: its 26-byte gram of smallest hash. Equal windows have equal
   anchors at equal places, so only suffixes that start at anchors (one byte in thirteen) need
   sorting. A first pass finds the anchors that more than one document has. It only leaves suffixes
   out that can't repeat; it decides no removal.
3. Each pack sends the bytes around its shared anchors (up to 24 before, up to 50 from the anchor
   on), those that are equal byte by byte only once, with the smallest document.
4. Where the contexts of an anchor meet, its suffixes, and the reversed texts before it, are merge
   sorted; two suffixes are compared by a binary search for their longest common extension on prefix
   polynomial hashes. Extensions of neighbours are then read byte by byte; where a hash had lied, the
   group is sorted by its bytes. A window that starts o bytes before the anchor is equal in two
   contexts if their extensions reach o bytes back and 50 - o on: classes of the two sorted orders.
5. Anchors that stand very often (a passage in a third of all documents has another context in each
   document at its ends) are dealt window by window instead, first by groups of packs, then all
   together, so that no task gets all of a hot anchor. The windows go through the same sort.
6. A pack hears of each context which of its windows are first there; all others are repeats.

Defined cases: null and empty texts have nothing to remove; texts under 50 bytes neither; rows that
share an id never repeat each other; rows without an id keep everything and are no source; columns
that are not asked for are ignored; an empty table gives an empty result. Where a cut parts a code
point, its remaining bytes count as kept in the digest, and are dropped from the text `kept`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

LENGTH = 50
GRAM = 26
REACH = LENGTH - GRAM  # an anchor starts at most so far behind its window's start
WIDTH = LENGTH + REACH
#: Bytes of text in a pack, about; a longer text is alone in a pack, or with a few short ones.
PACK_BYTES = 4 << 20
#: Bytes of a text that are hashed together.
SEGMENT = 1 << 20
#: Anchors in one reducing group, about.
GROUP = 1_000_000
#: Places from which on an anchor is dealt window by window.
HOT = 8192
#: Contexts sorted together, about; never fewer than one anchor's.
SLICE = 100_000
#: Packs whose windows meet in the first of two steps.
SALTED_PACKS = 1024
U64 = np.uint64
LOW = 40


def _sliding(x: np.ndarray, k: int, f) -> np.ndarray:
    """f over all windows of k values, by doubling."""
    size, out = 1, x
    while size * 2 <= k:
        out = f(out[: len(out) - size], out[size:])
        size *= 2
    rest = k - size
    return f(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and hash of the anchors of all windows that lie within a row, by start."""
    n = len(data)
    edge = np.zeros(n + 1, np.int8)
    long = np.diff(off) >= LENGTH
    edge[off[:-1][long]] += 1
    edge[off[1:][long] - LENGTH + 1] -= 1
    valid = np.cumsum(edge, dtype=np.int8) > 0
    starts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U64)]
    pad = np.zeros(REACH, U64)
    for s in range(0, n - LENGTH + 1, SEGMENT):
        h = K.mix(K.rolling(K.prefix(data[s : s + SEGMENT + LENGTH - 1]), GRAM))
        least = _sliding(h, REACH + 1, np.minimum)  # by window start
        least = np.where(valid[s : s + len(least)], least, U64(0))
        most = _sliding(np.concatenate([pad, least, pad]), REACH + 1, np.maximum)  # by gram start
        at = np.flatnonzero(most == h)
        starts.append(at + s)
        hashes.append(h[at])
    at, once = np.unique(np.concatenate(starts), return_index=True)
    return np.searchsorted(off, at, "right") - 1, at, np.concatenate(hashes)[once]


def _masked(x: np.ndarray, bits: int) -> np.ndarray:
    return x if bits >= 64 else x & U64((1 << bits) - 1)


def _fingerprint(rows: np.ndarray) -> np.ndarray:
    """A hash of each row of bytes."""
    n, w = rows.shape
    wide = np.zeros((n, -(-w // 8) * 8), np.uint8)
    wide[:, :w] = rows
    out = np.zeros(n, U64)
    for word in np.ascontiguousarray(wide.view(U64).T):
        out = K.mix(out * U64(K.BASE) + word)
    return out


def _gram_hash(rows: np.ndarray) -> np.ndarray:
    """The anchors' hashes, from their bytes."""
    up, _ = K._POWERS[K.BASE].get(GRAM + 1)
    out = np.zeros(len(rows), U64)
    for k in range(GRAM):
        out += (rows[:, k].astype(U64) + U64(1)) * up[k]
    return K.mix(out)


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _of_five(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view(U64).ravel()


def _cuts(sorted_: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of the runs of equal values."""
    if len(sorted_):
        at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        yield from zip(sorted_[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_)], strict=True)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def combine(rows: np.ndarray, tag: np.ndarray, doc: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by tag in which equal rows stand together, by document, and where another row begins.

    Rows count as equal if all bytes are; where hashes collide, equal ones may come apart."""
    name = _masked(_fingerprint(rows), bits)
    order = np.lexsort((doc, name, tag))
    new = np.ones(len(order), bool)
    if len(order):
        t, f, r = tag[order], name[order], rows[order]
        new[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1]) | (r[1:] != r[:-1]).any(axis=1)
    return order, new


class Extensions:
    """Rows of bytes, each a suffix as far as it matters, compared by their longest common extension."""

    def __init__(self, rows: np.ndarray, bits: int = 64) -> None:
        self.rows, self.width = rows, rows.shape[1]
        up, _ = K._POWERS[K.BASE].get(self.width + 1)
        self.pre = np.zeros((len(rows), self.width + 1), U64)
        np.cumsum((rows.astype(U64) + U64(1)) * up[: self.width], axis=1, out=self.pre[:, 1:])
        if bits < 64:
            self.pre = K.mix(self.pre) & U64((1 << bits) - 1)

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common extensions by binary search on the prefix hashes."""
        lo, hi = np.zeros(len(i), np.int64), np.full(len(i), self.width)
        for _ in range(self.width.bit_length()):
            mid = (lo + hi + 1) >> 1
            same = self.pre[i, mid] == self.pre[j, mid]
            lo, hi = np.where(same, mid, lo), np.where(same | (lo >= hi), hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = self.common(i, j)
        k = np.minimum(n, self.width - 1)
        return (n < self.width) & (self.rows[i, k] < self.rows[j, k])

    def merge_sort(self, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within their groups; `group` is sorted. Runs of 1, 2, 4, ... are merged pairwise."""
        n = len(group)
        order = np.arange(n)
        if not n:
            return order
        first = np.searchsorted(group, group)
        size = np.searchsorted(group, group, "right") - first
        width = 1
        while width < size.max(initial=0):
            where = np.flatnonzero(size > width)
            place = where - first[where]
            run = place // width
            other = first[where] + (run ^ 1) * width  # the run to merge with
            stop = np.minimum(other + width, first[where] + size[where])
            lo, hi = np.minimum(other, stop), stop.copy()
            right = run % 2 == 1
            mine = order[where]
            while (open_ := np.flatnonzero(lo < hi)).size:
                mid = (lo[open_] + hi[open_]) // 2
                theirs, own, late = order[mid], mine[open_], right[open_]
                less = self.less(np.where(late, own, theirs), np.where(late, theirs, own))
                before = less ^ late  # equal ones: the left run first
                lo[open_] = np.where(before, mid + 1, lo[open_])
                hi[open_] = np.where(before, hi[open_], mid)
            to = first[where] + (run // 2) * 2 * width + place % width + (lo - np.minimum(other, stop))
            order[to] = mine
            width *= 2
        return order

    def shared_bytes(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each suffix and the one before it: how many bytes they share, read byte by byte; and whether they stand in order."""
        n, out, right = len(order), np.zeros(len(order), np.int64), np.ones(len(order), bool)
        for lo in range(1, n, 50_000):
            a, b = self.rows[order[lo - 1 : min(n, lo + 50_000) - 1]], self.rows[order[lo : lo + 50_000]]
            differ = a != b
            k = differ.argmax(axis=1)
            each = np.arange(len(k))
            found = differ[each, k]
            out[lo : lo + 50_000] = np.where(found, k, self.width)
            right[lo : lo + 50_000] = ~found | (a[each, k] < b[each, k])
        return out, right

    def sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order, and the bytes shared with the suffix before, -1 where a group begins; both hold whatever the hashes said."""
        order = self.merge_sort(group)
        n = len(order)
        same = np.zeros(n, bool)
        same[1:] = group[1:] == group[:-1]
        shared, right = self.shared_bytes(order)
        claimed = np.full(n, -1)
        claimed[1:] = self.common(order[:-1], order[1:])
        lied = same & (~right | (claimed != shared)) | (np.bincount(order, minlength=n) != 1)  # a merge by contrary answers can lose some
        for g in np.unique(group[lied]):  # a collision: by the bytes
            lo, hi = int(np.searchsorted(group, g)), int(np.searchsorted(group, g, "right"))
            order[lo:hi] = lo + np.lexsort(self.rows[lo:hi].T[::-1])
            shared[lo:hi] = self.shared_bytes(order[lo:hi])[0]
        return order, np.where(same, shared, -1)


def firsts(rows: np.ndarray, tag: np.ndarray, doc: np.ndarray, bits: int = 64) -> np.ndarray:
    """Which rows no row with the same tag and bytes and a smaller document stands against."""
    by = np.argsort(tag, kind="stable")
    order, shared = Extensions(rows[by], bits).sorted(tag[by])
    order = by[order]
    out = np.zeros(len(rows), bool)
    if len(order):
        new = shared < rows.shape[1]
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
        out[order] = doc[order] == least[np.cumsum(new) - 1]
    return out


def valid_places(rows: np.ndarray) -> np.ndarray:
    """By context and place: whether the window so far before the anchor lies within the text."""
    place = np.arange(REACH + 1)
    return (rows[:, WIDTH, None] >= place) & (rows[:, WIDTH + 1, None] >= LENGTH - place)


def fresh_places(rows: np.ndarray, doc: np.ndarray, bits: int = 64) -> np.ndarray:
    """For each context (its bytes, and how many of them precede and follow the anchor's start) a mask of the
    places whose windows stand in no smaller document. Groups are those of equal anchors."""
    out = np.zeros(len(rows), np.int64)
    gram = _masked(_gram_hash(rows[:, REACH : REACH + GRAM]), bits)
    by, new = combine(rows, gram, doc, bits)
    which = np.cumsum(new) - 1
    one = by[new]  # the smallest document of each context
    mask = np.zeros(len(one), np.int64)
    g, d = gram[one], doc[one]
    ok = valid_places(rows[one])
    bit = np.int64(1) << np.arange(REACH + 1)
    alone = np.ones(len(one), bool)
    alone[1:] &= g[1:] != g[:-1]
    alone[:-1] &= g[1:] != g[:-1]
    mask[alone] = (ok[alone] * bit).sum(axis=1)
    rest = np.flatnonzero(~alone)
    lo = 0
    while lo < len(rest):
        hi = int(np.searchsorted(g[rest], g[rest[min(len(rest), lo + SLICE) - 1]], "right"))
        part = rest[lo:hi]
        lo, n = hi, hi - lo
        context = rows[one[part], :WIDTH]
        on, on_shared = Extensions(np.ascontiguousarray(context[:, REACH:]), bits).sorted(g[part])
        back, back_shared = Extensions(np.ascontiguousarray(context[:, :REACH][:, ::-1]), bits).sorted(g[part])
        a, b = np.empty(n, np.int64), np.empty(n, np.int64)
        for place in range(REACH + 1):
            here = np.flatnonzero(ok[part, place])
            if not len(here):
                continue
            a[on] = np.cumsum(on_shared < LENGTH - place)
            b[back] = np.cumsum(back_shared < place)
            name = (a * (n + 1) + b)[here]
            order = np.argsort(name, kind="stable")
            start = np.concatenate([[True], name[order][1:] != name[order][:-1]])
            own = d[part[here[order]]]
            first = np.minimum.reduceat(own, np.flatnonzero(start))[np.cumsum(start) - 1]
            mask[part[here[order[own == first]]]] |= bit[place]
    out[by] = np.where(doc[by] == d[which], mask[which], 0)
    return out


class Pack:
    """The shared anchors of a pack's texts: their contexts, and for hot ones their windows, in an order that
    depends on nothing but the texts and the anchors, so that two passes number them alike."""

    def __init__(self, texts: pa.Table, shared: pa.Table, buckets: int, bits: int) -> None:
        texts = texts.combine_chunks()
        self.off, self.data = K.utf8(texts["text"].chunk(0) if texts.num_rows else pa.array([], pa.string()))
        self.ids = texts["id"].to_numpy()
        row, at, key = keyed_anchors(self.off, self.data, buckets, bits)
        known, hot = np.zeros(0, U64), np.zeros(0, bool)
        if shared.num_rows:
            known = np.concatenate([_of_five(a) | U64(b << LOW) for a, b in zip(shared["a"].to_pylist(), shared["bucket"].to_pylist(), strict=True)])
            hot = _joined(shared["hot"], np.bool_)
            by = np.argsort(known)
            known, hot = known[by], hot[by]
        to = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
        hit = np.flatnonzero(known[to] == key) if len(known) else np.zeros(0, np.int64)
        row, at, key, hot = row[hit], at[hit], key[hit], hot[to[hit]] if len(known) else np.zeros(0, bool)
        rows, doc = self.contexts(row, at), self.ids[row]
        order, new = combine(rows, key, doc, bits)
        #: By occurrence: its text, place, document, context; by context: bytes, bucket, smallest document.
        self.row, self.at, self.doc = row[order], at[order], doc[order]
        self.of = np.cumsum(new) - 1
        one = order[new]
        self.rows, self.bucket, self.first, self.hot = rows[one], (key[one] >> U64(LOW)).astype(np.int64), doc[one], hot[one]
        #: Windows of hot contexts: context and place; the combined window each belongs to; by window: bytes, place, bucket, smallest document.
        where = np.flatnonzero(self.hot)
        self.w_context, self.w_place = (x for x in np.nonzero(valid_places(self.rows[where])))
        self.w_context = where[self.w_context]
        windows = self.rows[self.w_context[:, None], (REACH - self.w_place)[:, None] + np.arange(LENGTH)]
        deal = (_fingerprint(windows) % U64(buckets)).astype(np.int64)
        order, new = combine(windows, (deal << 8 | self.w_place).astype(U64), self.first[self.w_context], bits)
        self.w_of = np.empty(len(order), np.int64)
        self.w_of[order] = np.cumsum(new) - 1
        one = order[new]
        self.windows, self.w_bucket, self.w_at, self.w_first = windows[one], deal[one], self.w_place[one], self.first[self.w_context[one]]

    def contexts(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """WIDTH bytes around each place, and how many of them before and from it on belong to the text."""
        out = np.zeros((len(at), WIDTH + 2), np.uint8)
        out[:, WIDTH] = np.minimum(at - self.off[row], REACH)
        out[:, WIDTH + 1] = np.minimum(self.off[row + 1] - at, LENGTH)
        k = np.arange(-REACH, LENGTH)
        for lo in range(0, len(at), 50_000):
            part = out[lo : lo + 50_000]
            cols = at[lo : lo + 50_000, None] + k
            within = (k >= -part[:, WIDTH, None].astype(np.int64)) & (k < part[:, WIDTH + 1, None])
            part[:, :WIDTH] = np.where(within, self.data[np.clip(cols, 0, len(self.data) - 1)], 0)
        return out

    def repeated_bytes(self, mask: np.ndarray, fresh_windows: np.ndarray) -> np.ndarray:
        """Which bytes of the pack go, given the first places of its sent contexts and which of its windows are first."""
        fresh = np.zeros(len(self.rows), np.int64)
        fresh[~self.hot] = mask
        places = np.arange(REACH + 1)
        own = self.doc == self.first[self.of]
        bits = valid_places(self.rows)[self.of]
        bits &= ~(own[:, None] & ((fresh[self.of][:, None] >> places) & 1).astype(bool))
        hot = np.flatnonzero(self.hot[self.of])
        if len(hot):  # windows in order of context and place
            begin = np.searchsorted(self.w_context, self.of[hot])
            count = np.searchsorted(self.w_context, self.of[hot], "right") - begin
            of = np.repeat(hot, count)
            w = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(len(of))
            first = fresh_windows[self.w_of[w]] & (self.doc[of] == self.w_first[self.w_of[w]])
            bits[of[first], self.w_place[w[first]]] = False
        which, place = np.nonzero(bits)
        start = self.at[which] - place
        edge = np.bincount(start, minlength=len(self.data) + 1) - np.bincount(start + LENGTH, minlength=len(self.data) + 1)
        return np.cumsum(edge)[:-1] > 0


def keyed_anchors(off: np.ndarray, data: np.ndarray, buckets: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and key of the anchors of some texts; a key is the bucket and 40 bits of the hash."""
    parts, lo, n = [], 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + K.CHUNK_BYTES, "right")) - 1)
        row, at, h = anchors(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        parts.append((row + lo, at + off[lo], h))
        lo = hi
    row, at, h = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))
    h = _masked(h, bits)
    return row, at, (h >> U64(LOW)) % U64(buckets) << U64(LOW) | h & U64((1 << LOW) - 1)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), texts_too: bool = True, hot: int = HOT, pack_bytes: int = PACK_BYTES, bits: int = 64) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, kept (the text without the repeats; null if not asked
    for), and the columns to carry along. `bits` of each hash are used; any number gives the same result."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)])
    total = rows.where("id is not null").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total >> 27)
    packs = max(1, -(-total // pack_bytes))
    buckets = max(tasks, total // (13 * GROUP))
    salts = max(1, packs // SALTED_PACKS)
    texts = rows.where("id is not null").withColumn("pack", F.pmod(F.xxhash64("id", "text"), F.lit(packs))).repartition(tasks, "pack")

    def find(texts: pa.Table) -> pa.Table:
        texts = texts.combine_chunks()
        off, data = K.utf8(texts["text"].chunk(0))
        row, _, key = keyed_anchors(off, data, buckets, bits)
        doc = texts["id"].to_numpy()[row]
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        end = np.append(start[1:], len(key))
        n = (np.minimum(end - start, 32767) | (doc[start] != doc[end - 1]) << 15).astype(np.uint16) if len(key) else np.zeros(0, np.uint16)
        key = key[start]
        out = [(b, _five(key[lo:hi]), n[lo:hi].tobytes()) for b, lo, hi in _cuts((key >> U64(LOW)).astype(np.int64))]
        b, a, n = zip(*out, strict=True) if out else ((), (), ())
        pack = texts["pack"][0].as_py()
        return pa.table({"bucket": pa.array(b, pa.int64()), "pack": pa.array([pack] * len(b), pa.int64()), "a": pa.array(a, pa.binary()), "n": pa.array(n, pa.binary())})

    def share(found: pa.Table) -> pa.Table:
        a = [_of_five(x) for x in found["a"].to_pylist()]
        of = np.repeat(np.arange(len(a)), [len(x) for x in a])
        a, n = np.concatenate(a), _joined(found["n"], np.uint16)
        order = np.argsort(a, kind="stable")
        start = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1]]))
        size = np.diff(np.append(start, len(a)))
        count = np.add.reduceat((n & 32767).astype(np.int64)[order], start)
        both = (size > 1) | (np.maximum.reduceat(n[order], start) >= 32768)
        shared, is_hot = np.empty(len(a), bool), np.empty(len(a), bool)
        shared[order], is_hot[order] = np.repeat(both, size), np.repeat(count >= hot, size)
        keep = np.flatnonzero(shared)
        out = [(k, _five(a[keep[lo:hi]]), is_hot[keep[lo:hi]].tobytes()) for k, lo, hi in _cuts(of[keep])]
        k, a, h = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"bucket": found["bucket"].take(pa.array(k, pa.int64())), "pack": found["pack"].take(pa.array(k, pa.int64())), "a": pa.array(a, pa.binary()), "hot": pa.array(h, pa.binary())})

    found = texts.groupBy("pack").applyInArrow(find, "bucket long, pack long, a binary, n binary")
    shared = found.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(share, "bucket long, pack long, a binary, hot binary").repartition(tasks, "pack")

    def send(texts: pa.Table, shared: pa.Table) -> pa.Table:
        K.release()  # of the pack before
        p = Pack(texts, shared, buckets, bits)
        pack = texts["pack"][0].as_py() if texts.num_rows else 0
        cold = np.flatnonzero(~p.hot)
        pressed = zstandard.ZstdCompressor(level=3).compress  # texts shuffle smaller so
        out = [(0, b, 0, lo, p.first[cold[lo:hi]].tobytes(), b"", pressed(p.rows[cold[lo:hi]].tobytes())) for b, lo, hi in _cuts(p.bucket[cold])]
        out += [(1, b, pack % salts, lo, p.w_first[lo:hi].tobytes(), p.w_at[lo:hi].astype(np.uint8).tobytes(), pressed(p.windows[lo:hi].tobytes())) for b, lo, hi in _cuts(p.w_bucket)]
        cols = list(zip(*out, strict=True)) if out else [()] * 7
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        return pa.table([*arrays[:3], pa.array([pack] * len(out), pa.int64()), *arrays[3:]], names=["kind", "bucket", "salt", "pack", "start", "doc", "place", "rows"])

    answer = "kind int, to long, bucket long, pack long, number binary, mask binary, doc binary, place binary, rows binary"
    names = ["kind", "to", "bucket", "pack", "number", "mask", "doc", "place", "rows"]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5)

    def answers(out: list[tuple]) -> pa.Table:
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 9, kinds, strict=True)], names=names)

    def judge(sent: pa.Table) -> pa.Table:
        K.release()
        doc = _joined(sent["doc"], np.int64)
        per = np.array([len(x) // 8 for x in sent["doc"].to_pylist()])
        of = np.repeat(np.arange(len(per)), per)
        number = (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per) + np.repeat(sent["start"].to_numpy(), per)).astype(np.int32)
        pack, bucket = sent["pack"].to_pylist(), sent["bucket"].to_pylist()
        rows = np.frombuffer(b"".join(map(zstandard.ZstdDecompressor().decompress, sent["rows"].to_pylist())), np.uint8)
        if not sent["kind"][0].as_py():
            mask = fresh_places(rows.reshape(-1, WIDTH + 2), doc, bits).astype(np.int32)
            keep = np.flatnonzero(mask)
            return answers([(0, pack[k], bucket[k], pack[k], number[keep[lo:hi]].tobytes(), mask[keep[lo:hi]].tobytes(), b"", b"", b"") for k, lo, hi in _cuts(of[keep])])
        rows, place = rows.reshape(-1, LENGTH), _joined(sent["place"], np.uint8)
        keep = np.flatnonzero(firsts(rows, _window_tag(rows, place, bits), doc, bits))
        return answers([(1, bucket[k], bucket[k], pack[k], number[at].tobytes(), b"", doc[at].tobytes(), place[at].tobytes(), rows[at].tobytes()) for k, lo, hi in _cuts(of[keep]) for at in [keep[lo:hi]]])

    def settle(judged: pa.Table) -> pa.Table:
        """The first windows of all groups of packs; what is settled already passes."""
        if not judged["kind"][0].as_py():
            return judged
        doc, number = _joined(judged["doc"], np.int64), _joined(judged["number"], np.int32)
        of = np.repeat(np.arange(judged.num_rows), [len(x) // 8 for x in judged["doc"].to_pylist()])
        rows, place = _joined(judged["rows"], np.uint8).reshape(-1, LENGTH), _joined(judged["place"], np.uint8)
        keep = np.flatnonzero(firsts(rows, _window_tag(rows, place, bits), doc, bits))
        pack = judged["pack"].to_pylist()
        return answers([(1, 0, 0, pack[k], number[keep[lo:hi]].tobytes(), b"", b"", b"", b"") for k, lo, hi in _cuts(of[keep])])

    sent = texts.groupBy("pack").cogroup(shared.groupBy("pack")).applyInArrow(send, "kind int, bucket long, salt long, pack long, start long, doc binary, place binary, rows binary")
    judged = sent.repartition(buckets, "kind", "bucket", "salt").groupBy("kind", "bucket", "salt").applyInArrow(judge, answer)
    settled = judged.groupBy("kind", "to").applyInArrow(settle, answer)
    fresh = settled.select("pack", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("hot"), "kind", "number", "mask").repartition(tasks, "pack")
    told = shared.select("pack", "bucket", "a", "hot", F.lit(2).alias("kind"), F.lit(None).cast("binary").alias("number"), F.lit(None).cast("binary").alias("mask")).unionByName(fresh)

    kept = [f.dataType.simpleString() for f in rows.schema.fields[2:]]
    schema = ", ".join(["id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string", *[f"carry_{k} {t}" for k, t in enumerate(kept)]])

    def cut(texts: pa.Table, told: pa.Table) -> pa.Table:
        K.release()
        kind = np.array(told["kind"].to_pylist(), np.int64)
        pick = lambda k: told.take(pa.array(np.flatnonzero(kind == k)))
        p = Pack(texts, pick(2), buckets, bits)
        mask, windows = np.zeros(int((~p.hot).sum()), np.int64), np.zeros(len(p.windows), bool)
        mask[_joined(pick(0)["number"], np.int32)] = _joined(pick(0)["mask"], np.int32)
        windows[_joined(pick(1)["number"], np.int32)] = True
        gone_at = p.repeated_bytes(mask, windows)
        out: list[list] = [[] for _ in range(5)]
        total = np.concatenate([[0], np.cumsum(gone_at)])
        for start, end in zip(p.off[:-1].tolist(), p.off[1:].tolist(), strict=True):
            data, gone, spans = p.data[start:end], int(total[end] - total[start]), 0
            drop = gone_at[start:end]
            if gone:
                spans = int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum())
            body = (data[~drop] if gone else data).tobytes()
            text = None
            if texts_too:
                text = _whole(data, drop) if gone else body.decode("utf-8", "ignore")
            for col, v in zip(out, (len(data), gone, spans, hashlib.sha256(body).hexdigest(), text), strict=True):
                col.append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        carried = [c for c in texts.column_names if c.startswith("carry_")]
        return pa.table([texts["id"], *(pa.array(c, k) for c, k in zip(out, types, strict=True)), *(texts[c] for c in carried)], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *carried])

    done = texts.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(cut, schema)
    lone = rows.where("id is null").select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), (F.col("text") if texts_too else F.lit(None).cast("string")).alias("kept"), *[f"carry_{k}" for k in range(len(carry))])
    return done.unionByName(lone).toDF(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *carry)


def _window_tag(rows: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    return _masked(_fingerprint(rows), bits) << U64(6) ^ place.astype(U64)


def _whole(data: np.ndarray, drop: np.ndarray) -> str:
    """The kept text, without code points that lost a byte."""
    first = (data & 0xC0) != 0x80
    point = np.cumsum(first) - 1
    lost = np.zeros(int(first.sum()) + 1, bool)
    lost[point[drop]] = True
    return data[~lost[point]].tobytes().decode("utf-8", "ignore")
