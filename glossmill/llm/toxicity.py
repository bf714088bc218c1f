"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word of at most MOST bytes is a step; longer ones are cut at code points into several, so that every
byte is read. A step enters as the sum of a word vector (known words only), of the vectors of its bytes, one
for each byte and place in the sequence, and of two of its first and its last four bytes together. A
forward and a backward gated recurrent layer read a window of words, attention pools their states, and
a logistic unit scores the window. Windows of WINDOW words start every STRIDE words and so overlap;
all windows of a text are scored and the highest counts.

Training takes a bounded sample of labelled rows (at most `sample` per class, texts of at most
`sample_chars` characters, chosen by a hash of the id among the labels) to one task, which returns the
model; everything else, all scoring, runs over all rows and whole texts. In training a toxic text is
represented by its highest window, a clean one by its highest and one more. Word vectors start with the
smoothed log odds of the words.

Defined cases: null, empty and blank texts score 0; several labels of one id count as their
maximum; without both classes the model scores all 0; windows that tie count alike; rows may repeat and
repeat their score; rows without an id are scored; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WINDOW, STRIDE = 32, 16
#: Bytes of a step.
MOST = 8
DIM, HIDDEN, WORDS, CHARS = 12, 8, 4096, 1024
#: Windows scored at once.
BATCH = 4096


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the word, start, end and text of each step; of its at most 8 bytes, the first and the last four are all."""
    start, end, row = K.words(data, off, K.ALNUM)
    n = len(data)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.subtract.at(edge, end, 1)
    within = np.cumsum(edge) > 0
    long = end - start > MOST
    edge[:] = 0
    np.add.at(edge, start[long], 1)
    np.subtract.at(edge, end[long], 1)
    # in long words, code points of three bytes and more, and the signs below U+00C0, stand alone
    at = np.flatnonzero((np.cumsum(edge)[:n] > 0) & ((data >= 0xE0) | (data == 0xC2)))
    after = at + np.where(data[at] >= 0xF0, 4, np.where(data[at] >= 0xE0, 3, 2))
    begin = np.zeros(n + 1, bool)
    begin[start] = True
    begin[at] = True
    begin[after] |= within[after]
    first = np.flatnonzero(begin)
    own = np.searchsorted(start, first, "right") - 1
    last = np.minimum(np.append(first[1:], n), end[own])[: len(first)]
    h = K.mix(K.spans(K.prefix(K.LOWER[data]), first, last))
    # what is still long is cut between code points
    count = np.where(last - first > MOST, -(-(last - first) // (MOST - 1)), 1)
    word = np.repeat(np.arange(len(first)), count)
    k = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    begin = first[word] + k * (MOST - 1)
    begin -= (data[begin] & 0xC0) == 0x80
    stop = np.where(k + 1 < count[word], np.append(begin[1:], n)[: len(word)], last[word])
    return h[word], begin, stop, row[own[word]]


def inputs(data: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct steps by their table rows (word, first bytes, last bytes, and MOST bytes by place); which of them each step is; and its text."""
    h, start, end, row = pieces(data, off)
    at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
    word = np.where(vocabulary[at] == h, at + 1, 0) if len(vocabulary) else np.zeros(len(h), np.int64)
    place = start[:, None] + np.arange(MOST)
    code = np.where(place < end[:, None], K.LOWER[data[np.minimum(place, max(0, len(data) - 1))]], 0).astype(np.uint8) if len(h) else np.zeros((0, MOST), np.uint8)
    name = K.mix(code.view(np.uint64).ravel() + K.mix(word.astype(np.uint64) * np.uint64(16) + (end - start).astype(np.uint64)))
    _, one, which = np.unique(name, return_index=True, return_inverse=True)
    low = K.prefix(K.LOWER[data])
    start, end = start[one], end[one]
    first = K.mix(K.spans(low, start, np.minimum(start + 4, end))) % np.uint64(CHARS)
    last = K.mix(K.spans(low, np.maximum(end - 4, start), end) + np.uint64(1)) % np.uint64(CHARS)
    steps = np.concatenate([np.stack([word[one], first.astype(np.int64), last.astype(np.int64)], axis=1), code[one] + 256 * np.arange(MOST)], axis=1)
    return steps, which, row


TABLES = ["word", "first", "last", *["byte"] * MOST]


def windows(row: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First step, length and text of each window; they overlap and cover all steps."""
    cut = np.searchsorted(row, np.arange(n_rows + 1))
    n = np.diff(cut)
    count = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - STRIDE)) // STRIDE)), 0)
    text = np.repeat(np.arange(n_rows), count)
    first = cut[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
    return first, np.minimum(WINDOW, cut[text + 1] - first), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Model:
    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, seed: int = 1) -> None:
        r = np.random.default_rng(seed)
        small = lambda *s: (r.standard_normal(s) * 0.2).astype(np.float32)
        self.vocabulary = vocabulary
        word = small(len(vocabulary) + 1, DIM) * np.float32(0.2)
        word[1:, 0] = odds
        self.p = {
            "word": word, "first": small(CHARS, DIM) * np.float32(0.2), "last": small(CHARS, DIM) * np.float32(0.2), "byte": small(256 * MOST, DIM) * np.float32(0.1),
            "w": small(2, DIM, 3 * HIDDEN), "u": small(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "att": small(2 * HIDDEN, HIDDEN), "att_v": small(HIDDEN), "out": small(2 * HIDDEN), "bias": np.zeros(1, np.float32),
        }
        self.tables: dict[str, np.ndarray] | None = None

    def pack(self) -> Model:
        """Input products of the table rows, for scoring: (rows, both directions)."""
        p = self.p
        self.tables = {t: np.concatenate([p[t] @ p["w"][0], p[t] @ p["w"][1]], axis=1) for t in set(TABLES)}
        self.tables["word"] += np.concatenate([p["b"][0], p["b"][1]], axis=1)
        return self

    def states(self, x: np.ndarray, length: np.ndarray, keep: list | None = None) -> np.ndarray:
        """x: (2, T, N, 3H) input products, the second in reversed time. Returns (T, N, 2H)."""
        u, (_, steps, n, _), H = self.p["u"], x.shape, HIDDEN
        h = np.zeros((2, n, H), u.dtype)
        out = np.zeros((2, steps, n, H), u.dtype)
        live = np.stack([np.arange(steps)[:, None] < length, np.arange(steps)[::-1, None] < length])[..., None]
        for t in range(steps):
            g = np.matmul(h, u)
            zr = _sigmoid(x[:, t, :, : 2 * H] + g[..., : 2 * H])
            z, r = zr[..., :H], zr[..., H:]
            c = np.tanh(x[:, t, :, 2 * H :] + r * g[..., 2 * H :])
            new = h + live[:, t] * ((1 - z) * (c - h))
            if keep is not None:
                keep.append((h, z, r, c, g[..., 2 * H :], live[:, t]))
            h = new
            out[:, t] = h
        return np.concatenate([out[0], out[1, ::-1]], axis=2)

    def pool(self, s: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        a = np.tanh(s @ self.p["att"])
        e = a @ self.p["att_v"]
        e = np.where(np.arange(len(s))[:, None] < length, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        weight = e / e.sum(axis=0)
        pooled = (weight[..., None] * s).sum(axis=0)
        return a, weight, pooled, pooled @ self.p["out"] + self.p["bias"]

    def logits(self, steps: np.ndarray, which: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        if self.tables is None:
            self.pack()
        own = self.tables["word"][steps[:, 0]]
        for k, t in enumerate(TABLES[1:], 1):
            own += self.tables[t][steps[:, k]]
        out = np.empty(len(first), np.float32)
        for lo in range(0, len(first), BATCH):
            f, n = first[lo : lo + BATCH], length[lo : lo + BATCH]
            x = own[which[np.minimum(f + np.arange(int(n.max()))[:, None], len(which) - 1)]]
            half = 3 * HIDDEN
            both = np.stack([x[..., :half], x[::-1, :, half:]])
            out[lo : lo + BATCH] = self.pool(self.states(both, n), n)[3]
        return out

    def gradient(self, rows: np.ndarray, length: np.ndarray, y: np.ndarray, weight_y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted logistic loss of some windows; rows: (WINDOW, windows, tables)."""
        p, H, T = self.p, HIDDEN, WINDOW
        e = sum(p[t][rows[..., k]] for k, t in enumerate(TABLES))
        both = np.stack([e, e[::-1]])
        x = np.matmul(both, p["w"][:, None]) + p["b"][:, None]
        keep: list = []
        s = self.states(x, length, keep)
        a, weight, pooled, logit = self.pool(s, length)
        d = (_sigmoid(logit) - y) * weight_y / len(y)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["out"], g["bias"] = pooled.T @ d, d.sum(keepdims=True)
        dp = d[:, None] * p["out"]
        ds = weight[..., None] * dp
        de = (s * dp).sum(axis=2)
        de = weight * (de - (weight * de).sum(axis=0))
        g["att_v"] = (a * de[..., None]).sum(axis=(0, 1))
        da = de[..., None] * p["att_v"] * (1 - a * a)
        g["att"] = np.einsum("tni,tnj->ij", s, da, optimize=True)
        ds += da @ p["att"].T
        dh_t = np.stack([ds[..., :H], ds[::-1, :, H:]])
        dh = np.zeros((2, len(y), H), np.float32)
        dx = np.zeros_like(x)
        for t in range(T - 1, -1, -1):
            h, z, r, c, gu, live = keep[t]
            dh = dh + dh_t[:, t]
            go = dh * live
            dc = go * (1 - z) * (1 - c * c)
            dz = go * (h - c) * z * (1 - z)
            dr = dc * gu * r * (1 - r)
            dg = np.concatenate([dz, dr, dc * r], axis=2)
            dx[:, t] = np.concatenate([dz, dr, dc], axis=2)
            g["u"] += np.matmul(h.transpose(0, 2, 1), dg)
            dh = dh - go * (1 - z) + np.matmul(dg, p["u"].transpose(0, 2, 1))
        g["w"] = np.einsum("dtni,dtnj->dij", both, dx, optimize=True)
        g["b"] = dx.sum(axis=(1, 2))[:, None]
        dxe = np.matmul(dx, p["w"].transpose(0, 2, 1)[:, None])
        demb = (dxe[0] + dxe[1, ::-1]).reshape(-1, DIM)
        for k, name in enumerate(TABLES):
            np.add.at(g[name], rows[..., k].ravel(), demb)
        return g

    def step(self, g: dict[str, np.ndarray], rate: float, moments: dict) -> None:
        p = self.p
        moments["n"] = n = moments.get("n", 0) + 1
        for k, v in g.items():
            m, q = moments.get(k, (np.zeros_like(v), np.zeros_like(v)))
            m, q = 0.9 * m + 0.1 * v, 0.99 * q + 0.01 * v * v
            moments[k] = m, q
            p[k] = (p[k] - rate * (m / (1 - 0.9**n)) / (np.sqrt(q / (1 - 0.99**n)) + 1e-6)).astype(np.float32)
        self.tables = None


def groups(raw: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First text, offsets and bytes of some texts at a time."""
    lo = 0
    while lo < len(raw):
        hi, size = lo + 1, len(raw[lo])
        while hi < len(raw) and size + len(raw[hi]) <= most:
            size += len(raw[hi])
            hi += 1
        yield lo, np.concatenate([[0], np.cumsum([len(t) for t in raw[lo:hi]])]).astype(np.int64), np.frombuffer(b"".join(raw[lo:hi]), np.uint8)
        lo = hi


def _logits_of(model: Model, ids: np.ndarray, which: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Logits of some windows in a row, from the steps between the first and the last of them alone."""
    lo, hi = int(first[0]), int((first + length).max())
    own, local = np.unique(which[lo:hi], return_inverse=True)
    return model.logits(ids[own], local, first - lo, length)


def fit(texts: list[str], toxic: np.ndarray, steps: int = 300, seed: int = 1) -> Model:
    raw = [t.encode() for t in texts]
    # smoothed log odds of a text being toxic, by the words in it
    pairs = []
    for lo, off, data in groups(raw):
        h, _, _, row = pieces(data, off)
        pairs.append(np.unique(np.stack([h, (row + lo).astype(np.uint64)]), axis=1))
    pairs = np.concatenate(pairs, axis=1)
    seen, inverse = np.unique(pairs[0], return_inverse=True)
    n = np.bincount(inverse, minlength=len(seen))
    bad = np.bincount(inverse, weights=toxic[pairs[1].astype(np.int64)], minlength=len(seen))
    odds = np.log((bad + 0.5) / (toxic.sum() + 1)) - np.log((n - bad + 0.5) / ((1 - toxic).sum() + 1))
    often = np.sort(np.lexsort((seen, -n))[:WORDS])
    often = often[n[often] >= 3]
    model = Model(seen[often], np.clip(odds[often] / 3, -1, 1).astype(np.float32), seed)
    # group by group, so that only the distinct steps and their numbers are held for all texts
    parts, at, begin = [], 0, 0
    for lo, off, data in groups(raw):
        known, which, row = inputs(data, off, model.vocabulary)
        first, length, text = windows(row, len(off) - 1)
        parts.append((known.astype(np.int16), (which + at).astype(np.int32), first + begin, length, text + lo))
        at += len(known)
        begin += len(which)
    ids, which, first, length, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    del pairs, inverse
    if not len(first):
        return model
    # at first a window counts by its likeliest word
    word = np.concatenate([[0.0], odds[often]])[ids[which, 0]]
    score = np.maximum.reduceat(np.concatenate([word, [0.0]]), np.stack([first, first + length], axis=1).ravel())[::2]
    r, moments = np.random.default_rng(seed), {}
    heavy = np.where(toxic[text] > 0, 1.0, 0.6).astype(np.float32)
    per_epoch = max(1, (len(np.unique(text)) + int((toxic == 0).sum())) // 128)
    for _ in range(min(40, max(3, -(-steps // per_epoch)))):
        order = np.lexsort((-score, text))
        top = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
        others = r.choice(len(first), min(len(first), len(top)), replace=False)
        chosen = np.concatenate([top, others[toxic[text[others]] == 0]])
        r.shuffle(chosen)
        for lo in range(0, len(chosen), 128):
            k = chosen[lo : lo + 128]
            rows = ids[which[np.minimum(first[k] + np.arange(WINDOW)[:, None], len(which) - 1)]]
            model.step(model.gradient(rows, length[k], toxic[text[k]].astype(np.float32), heavy[k]), 0.01, moments)
        score = np.concatenate([_logits_of(model, ids, which, first[k : k + 8192], length[k : k + 8192]) for k in range(0, len(first), 8192)])
    # one half stands where the two classes of the sample are told apart best
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, text, score)
    some = np.isfinite(best)
    values, y = np.sort(best[some]), toxic[some][np.argsort(best[some])]
    if y.any() and not y.all():
        wrong = np.concatenate([[0], np.cumsum(y)]) / y.sum() + (1 - np.concatenate([[0], np.cumsum(1 - y)]) / (1 - y).sum())
        least = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        k = int(least[len(least) // 2])
        mid = values[0] - 1 if k == 0 else values[-1] + 1 if k == len(values) else (values[k - 1] + values[k]) / 2
        model.p["bias"] = (model.p["bias"] - np.float32(mid)).astype(np.float32)
    return model.pack()


def held_out(id_column) -> F.Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 1500, sample_chars: int = 20_000, steps: int = 300) -> Model | None:
    """Fit on labelled rows that are not held out; None without both classes. No more than 2 * sample texts meet in the training task,
    and only the model, of fixed size, reaches the driver."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.where(~F.coalesce(held_out(F.col("id")), F.lit(True)))
    # the sample is chosen from the labels alone; its ids, at most 2 * sample, are broadcast, so that no text is shuffled to find it
    ranked = known.withColumn("h", F.xxhash64("id"))
    picked = F.broadcast(ranked.where("y = 0").orderBy("h", "id").limit(sample).unionByName(ranked.where("y = 1").orderBy("h", "id").limit(sample)))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where((F.length("text") > 0) & (F.length("text") <= sample_chars))
    texts = rows.join(picked, "id").groupBy("id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(((y, i, t) for b in batches for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
        toxic = np.array([r[0] for r in got], np.float64)
        if toxic.any() and not toxic.all():
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[2] for r in got], toxic, steps))], pa.binary())], names=["model"])
            K.release()

    made = texts.repartition(1).mapInArrow(run, "model binary").collect()  # at most one row
    return pickle.loads(made[0]["model"]) if made else None


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, held_out, score, predicted, n_windows, and the columns to carry along; no shuffle. The model, of fixed size, is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for lo, hi, off, data in K.chunks(batch, limit=1 << 19):
                best = np.full(hi - lo, -np.inf, np.float32)
                count = np.zeros(hi - lo, np.int64)
                if model is not None and len(data):
                    steps, which, row = inputs(data, off, model.vocabulary)
                    first, length, text = windows(row, hi - lo)
                    if len(first):
                        np.maximum.at(best, text, model.logits(steps, which, first, length))
                        count = np.bincount(text, minlength=hi - lo)
                score = 1 / (1 + np.exp(-np.clip(best, -60, 60).astype(np.float64)))
                score[~np.isfinite(best)] = 0.0
                own = [c.slice(lo, hi - lo) for c in batch.columns[:1] + batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count)], names=[*names, "score", "predicted", "n_windows"])
        K.release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)])
    names = [c for c in rows.columns if c != "text"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    out = rows.mapInArrow(run, f"{kinds}, score double, predicted int, n_windows long")
    return out.select(F.col("id").alias(id_col), F.coalesce(held_out(F.col("id")), F.lit(False)).alias("held_out"), "score", "predicted", "n_windows", *[F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)])
