import numpy as np
import pytest

from glossmill.llm import webp as W

rng = np.random.default_rng(3)


@pytest.mark.parametrize("rows", [1, 2, 5, 600])
def test_round_trip(rows):
    px = rng.integers(0, 256, (rows, 64, 3)).astype(np.uint8)
    for f in (W.encode(px), W.encode_many([px.ravel()])[0]):
        assert (W.decode(f)[..., :3] == px).all() and (W.decode(f)[..., 3] == 255).all()


def texts(n):
    words = [b" ".join(bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(rng.integers(1, 6))) for _ in range(40)]
    for _ in range(n):
        text = b" ".join(words[k] for k in rng.integers(0, 40, int(rng.choice([1, 5, 40, 100, 900], p=[0.1, 0.2, 0.4, 0.25, 0.05]))))
        yield np.frombuffer(text + b" " * (-len(text) % 192), np.uint8)


def test_many_pictures_together_are_those_read_one_by_one():
    payloads = [*texts(200), np.full(192, 32, np.uint8), np.frombuffer(b"ab" * 960, np.uint8), rng.integers(0, 256, 192 * 30).astype(np.uint8), np.cumsum(rng.integers(0, 3, 192 * 20)).astype(np.uint8)]
    media = W.store_many(payloads)
    alone = [np.concatenate([W.decode(f) for f in W.files(m)]) for m in media]
    assert all(a[..., :3].tobytes() == p.tobytes() for a, p in zip(alone, payloads, strict=True))
    assert all((a == b).all() for a, b in zip(W.decode_many(media), alone, strict=True))
    assert W.store_many(payloads[:5]) == media[:5] and W.store_many(payloads[::-1]) == media[::-1]  # equal texts, equal files, whatever stands beside them


def test_stored_pictures_use_references_codes_and_the_cache(monkeypatch):
    seen = {"reference": 0, "cache": 0, "literal": 0, "lengths": set()}
    read = W.Rows.read

    def spy(self, row, bits):
        e = read(self, row, bits)
        symbol, n = e >> 4, e & 15
        if self.length.shape[1] > 256:
            seen["reference"] += int(((symbol >= 256) & (symbol < 280)).sum())
            seen["cache"] += int((symbol >= 280).sum())
            seen["literal"] += int((symbol < 256).sum())
            seen["lengths"] |= set(n.tolist())
        return e

    monkeypatch.setattr(W.Rows, "read", spy)
    payloads = [np.concatenate(list(texts(12))) for _ in range(130)]
    media = W.store_many(payloads)
    W.decode_many(media)
    assert min(seen["reference"], seen["cache"], seen["literal"]) > 500 and len(seen["lengths"]) > 5
    assert sum(map(len, media)) < 0.6 * sum(map(len, payloads))


def test_pictures_of_any_kind_read_side_by_side():
    few = rng.integers(0, 256, (6, 4)).astype(np.uint8)
    made = []
    for k in range(120):
        px = few[rng.integers(0, 6, (3 + k % 7, 5 + k % 11))]
        side = rng.integers(0, 256, (-(-px.shape[0] // 8), -(-px.shape[1] // 8), 4)).astype(np.uint8)
        kinds = [[], [(W.SUBTRACT_GREEN, None, 0)], [(W.CROSS, side, 3)], [(W.PREDICTOR, side % 14, 3)]]
        made.append(W.encode_tokens(px, px.shape[1], kinds[k % 4], cache_bits=(0, 4, 9)[k % 3]))
    assert all((a == W.decode(f)).all() for a, f in zip(W.decode_many(made), made, strict=True))


def test_rows_of_codes():
    counts = rng.integers(0, 40, (50, 300)) * (rng.random((50, 300)) < 0.3)
    counts[0], counts[0, :2], counts[1] = 0, [1, 1 << 20], 0
    counts[1, 7], counts[2] = 5, 1 << np.minimum(np.arange(300), 40)
    n = W.fit_rows(counts)
    assert ((n > 0) == (counts > 0)).all() and n.max() <= 15
    for k in range(50):
        if k != 1:
            assert (1 << (15 - n[k][n[k] > 0])).sum() == 1 << 15
            assert (n[k] * counts[k]).sum() <= 1.1 * (W.fit(counts[k]) * counts[k]).sum() + 8
        assert (W.spell_rows(n)[k][n[k] > 0] == W.spell(n[k])[n[k] > 0]).all()


def test_tall_payload_becomes_several_files():
    payload = rng.integers(0, 256, (W.MOST_ROWS + 3) * 192).astype(np.uint8)
    media = W.store(payload)
    parts = list(W.files(media))
    assert len(parts) == 2
    assert np.concatenate([W.decode(p)[..., :3] for p in parts]).tobytes() == payload.tobytes()


@pytest.mark.parametrize("cache_bits", [0, 4, 9])
def test_back_references_cache_and_codes(cache_bits):
    few = rng.integers(0, 256, (6, 4)).astype(np.uint8)
    px = few[rng.integers(0, 6, (17, 23))]
    px[5:9] = px[0:4]
    assert (W.decode(W.encode_tokens(px, 23, cache_bits=cache_bits)) == px).all()


@pytest.mark.parametrize("n", [1, 2, 3, 9, 40])
def test_palette(n):
    colours = rng.integers(0, 256, (1, n, 4)).astype(np.uint8)
    index = rng.integers(0, n, (7, 13)).astype(np.uint8)
    per = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1
    padded = np.zeros((7, -(-13 // per) * per), np.uint8)
    padded[:, :13] = index
    packed = (padded.reshape(7, -1, per) << (np.arange(per) * (8 // per)).astype(np.uint8)).sum(axis=2).astype(np.uint8)
    coded = np.zeros((*packed.shape, 4), np.uint8)
    coded[..., 1] = packed
    coded[..., 3] = 255
    assert (W.decode(W.encode_tokens(coded, 13, [(W.PALETTE, colours, 0)])) == colours[0][index]).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictors_invert_what_a_pixelwise_rule_predicts(mode):
    px = rng.integers(0, 256, (9, 11, 4)).astype(int)

    def predicted(y, x):
        if not x and not y:
            return np.array([0, 0, 0, 255])
        if not y:
            return px[0, x - 1]
        if not x:
            return px[y - 1, 0]
        left, t, tl = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1]
        tr = px[y - 1, x + 1] if x + 1 < px.shape[1] else px[y, 0]
        p = left + t - tl
        m = (left + t) // 2
        near = left if abs(p - left).sum() < abs(p - t).sum() else t
        return [np.array([0, 0, 0, 255]), left, t, tr, tl, ((left + tr) // 2 + t) // 2, (left + tl) // 2, m, (tl + t) // 2, (t + tr) // 2, ((left + tl) // 2 + (t + tr) // 2) // 2, near, np.clip(p, 0, 255), np.clip(m + ((m - tl) / 2).astype(int), 0, 255)][mode]

    res = np.array([[(px[y, x] - predicted(y, x)) % 256 for x in range(11)] for y in range(9)]).astype(np.uint8)
    side = np.zeros((3, 3, 4), np.uint8)
    side[..., 1] = mode
    assert (W.decode(W.encode_tokens(res, 11, [(W.PREDICTOR, side, 2)])) == px).all()


def test_cross_colour_and_subtract_green():
    px = rng.integers(0, 256, (9, 11, 4)).astype(np.uint8)
    side = rng.integers(0, 256, (3, 3, 4)).astype(np.uint8)
    signed = lambda v: (int(v) + 128) % 256 - 128
    res = px.copy()
    for y in range(9):
        for x in range(11):
            f = side[y >> 2, x >> 2]
            r, g, b = (int(v) for v in px[y, x, :3])
            res[y, x, 0] = (r - (signed(f[2]) * signed(g) >> 5)) % 256
            res[y, x, 2] = (b - (signed(f[1]) * signed(g) >> 5) - (signed(f[0]) * signed(r) >> 5)) % 256
    assert (W.decode(W.encode_tokens(res, 11, [(W.CROSS, side, 2)])) == px).all()
    green = px.copy()
    green[..., 0] -= px[..., 1]
    green[..., 2] -= px[..., 1]
    assert (W.decode(W.encode_tokens(green, 11, [(W.SUBTRACT_GREEN, None, 0)])) == px).all()


def test_store_shortens_and_reads_back():
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(60)]
    prose = b" ".join(words[k] for k in rng.integers(0, 60, 400))
    smooth = np.cumsum(rng.integers(0, 3, 192 * 40)).astype(np.uint8).tobytes()
    colours = rng.integers(0, 256, (9, 3)).astype(np.uint8)
    for text, share in ((prose, 0.85), (prose * 40, 0.1), (b"abc" * 5000, 0.02), (colours[rng.integers(0, 9, 3000)].tobytes(), 0.25), (smooth, 0.9), (b"x", 1), (rng.integers(0, 256, 5000).astype(np.uint8).tobytes(), 1.3)):
        payload = np.full(-(-len(text) // 192) * 192, 32, np.uint8)
        payload[: len(text)] = np.frombuffer(text, np.uint8)
        media = W.store(payload)
        assert np.concatenate([W.decode(f)[..., :3] for f in W.files(media)]).tobytes() == payload.tobytes()
        assert len(media) < share * len(payload)


@pytest.mark.parametrize("mode", range(14))
def test_written_predictors_and_cross_colour_are_undone(mode):
    px = rng.integers(0, 256, (9, 11, 3)).astype(np.uint8)
    alpha = np.zeros((9, 11, 1), np.uint8)
    back = W.undo_predictor(np.concatenate([W.residuals(px)[mode], alpha], axis=2), np.full((1, 1), mode), 9)
    assert (back[..., :3] == px).all() and (back[..., 3] == 255).all()
    res, side = W.crossed(px)
    assert (W.undo_cross(np.concatenate([res, alpha], axis=2), np.array([[[*side, 255]]], np.uint8), 9)[..., :3] == px).all()


def test_damage_is_an_error():
    with pytest.raises(ValueError):
        W.decode(b"RIFFxxxxWEBQ")
    with pytest.raises(ValueError):
        W.decode(W.encode(rng.integers(0, 256, (4, 64, 3)).astype(np.uint8))[:200])
    media = W.store_many(list(texts(120)))
    for cut in (200, 60, 30):
        with pytest.raises(ValueError):
            W.decode_many([*media[:-1], media[50][:cut]])


def test_code_tables_take_little_while_they_are_made():
    import tracemalloc

    length = W.fit_rows(rng.integers(0, 1 << 12, (2000, 1304)) * (rng.random((2000, 1304)) < 0.1))
    tracemalloc.start()
    rows = W.Rows(length)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    bits = rng.integers(0, 1 << 15, 2000)
    got = rows.read(np.arange(2000), bits)
    for k in range(0, 2000, 40):
        code = rows.code(k)
        assert got[k] == code.look[int(bits[k]) & code.mask]


def test_stable_order():
    for key in (rng.integers(0, 50, 1000), rng.integers(0, 1 << 63, 1000), np.repeat(rng.integers(0, 1 << 63, 300), 3)[rng.permutation(900)], (1 << 63) + rng.integers(0, 4, 1000).astype(np.uint64), np.zeros(0, np.int64)):
        assert (W.stable_order(key) == np.argsort(key.astype(np.uint64), kind="stable")).all()
