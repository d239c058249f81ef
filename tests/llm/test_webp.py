"""The WebP codec: round trips of the encoder, and hand-made streams with every transform and tool."""

import struct

import numpy as np
import pytest

from rankwell.llm import webp
from rankwell.llm.media import decode_payload, encode_payload, feature, files, payload_of

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("kind", ["empty", "one", "text", "repeats", "few", "noise", "long run"])
def test_round_trip(kind):
    text = " ".join(RNG.choice(["the", "of", "tion", "ärger", "x"], 3000))
    raw = {"empty": b"", "one": b"a", "text": text.encode(), "repeats": text.encode()[:700] * 9, "few": bytes(RNG.integers(60, 64, 5000, dtype=np.uint8)), "noise": RNG.bytes(20_000), "long run": b"z" * 50_000}[kind]
    payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    media = encode_payload(payload)
    assert decode_payload(media) == (payload, 576, len(payload) // 576)
    assert media[:4] == b"RIFF" and encode_payload(payload) == media


def test_payload_and_feature():
    assert payload_of(None) == payload_of("") == b"\xff" * 576
    assert len(payload_of("é" * 288)) == 576 and len(payload_of("é" * 289)) == 1152
    p = np.frombuffer(payload_of("abc"), np.uint8)
    assert feature(p, 576, 1) == feature(p.copy(), 576, 1)


def argb(h, w):
    return RNG.integers(0, 1 << 32, h * w, dtype=np.uint32)


def put_argb(w, pixels, main):
    """All four channels, no colour cache."""
    g, r, b, a = (pixels >> s & 255 for s in (8, 16, 0, 24))
    webp._put_image(w, g.astype(np.int64), 1, [], (r.astype(np.int64), b.astype(np.int64), a.astype(np.int64)), main)


def container(w):
    body = b"\x2f" + w.bytes()
    body += bytes(len(body) % 2)
    return b"RIFF" + struct.pack("<I", 12 + len(body)) + b"WEBPVP8L" + struct.pack("<I", len(body)) + body


def header(w, width, height):
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 4)


def minus(p, q):
    out = 0
    for s in (0, 8, 16, 24):
        out |= ((p >> s & 255) - (q >> s & 255) & 255) << s
    return out


def residuals(pixels, width, height, modes, bits):
    px, across, out = pixels.tolist(), -(-width // (1 << bits)), []
    for y in range(height):
        for x in range(width):
            i = y * width + x
            if not i:
                p = webp.BLACK
            elif not y:
                p = px[i - 1]
            elif not x:
                p = px[i - width]
            else:
                right = px[i - width + 1] if x < width - 1 else px[y * width]
                p = int(webp.predict(int(modes[(y >> bits) * across + (x >> bits)]), px[i - 1], px[i - width], right, px[i - width - 1]))
            out.append(minus(px[i], p))
    return np.array(out, np.uint32)


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height, bits = 13, 9, 2
    pixels = argb(height, width)
    modes = RNG.integers(0, 14, 4 * 3, dtype=np.uint32)
    modes[:] = np.where(RNG.random(12) < 0.6, mode, modes)
    w = webp.Writer()
    header(w, width, height)
    w.put(1 | 0 << 1, 3)
    w.put(bits - 2, 3)
    put_argb(w, modes << 8 | 0xFF000000, False)
    w.put(0, 1)
    put_argb(w, residuals(pixels, width, height, modes, bits), True)
    assert (webp.decode(container(w))[2] == pixels).all()


def test_select_and_gradient_predictions():
    assert webp.predict(11, 0x10101010, 0x20202020, 0, 0x1F1F1F1F) == 0x10101010
    assert webp.predict(12, 0xFF00FF00, 0xFF00FF00, 0, 0x00000000) == 0xFF00FF00
    assert webp.predict(13, 0x08080808, 0x08080808, 0, 0x00000000) == 0x0C0C0C0C
    assert webp.predict(13, 0x00000000, 0x00000000, 0, 0x03030303) == 0


def test_cross_colour_and_green():
    width, height, bits = 10, 7, 2
    pixels = argb(height, width)
    elements = argb(2, 3)
    at = elements.reshape(2, 3)[np.arange(height) >> bits][:, np.arange(width) >> bits].ravel()
    s8 = lambda v: (v & 255).astype(np.uint8).view(np.int8).astype(np.int64)
    green, red, blue = s8(pixels >> 8), s8(pixels >> 16), (pixels & 255).astype(np.int64)
    new_red = (pixels >> 16 & 255).astype(np.int64) - (s8(at) * green >> 5) & 255
    new_blue = blue - (s8(at >> 8) * green >> 5) - (s8(at >> 16) * red >> 5) & 255
    crossed = pixels & 0xFF00FF00 | new_red.astype(np.uint32) << 16 | new_blue.astype(np.uint32)
    g = crossed >> 8 & 255
    less = crossed & 0xFF00FF00 | ((crossed >> 16 & 255) - g & 255) << 16 | (crossed & 255) - g & 255
    w = webp.Writer()
    header(w, width, height)
    w.put(1 | 1 << 1, 3)
    w.put(bits - 2, 3)
    put_argb(w, elements, False)
    w.put(1 | 2 << 1, 3)
    w.put(0, 1)
    put_argb(w, less, True)
    assert (webp.decode(container(w))[2] == pixels).all()


def test_cache_groups_and_references():
    """A colour cache, two code groups by tile, a near and an overlapping back-reference."""
    width, height, cache_bits = 8, 8, 3
    w = webp.Writer()
    header(w, width, height)
    w.put(0, 1)  # no transform
    w.put(1, 1)
    w.put(cache_bits, 4)
    w.put(1, 1)
    w.put(0, 3)  # tiles of 4 by 4
    which = np.array([0, 1, 1, 0], np.uint32) << 8
    put_argb(w, which, False)
    alphabet = 256 + 24 + 8
    codes = []
    for shift in (0, 7):
        lengths = np.zeros(alphabet, np.int64)
        symbols = [10 + shift, 20, 256 + 3, 256 + 1, *range(280, 284), *range(284, 288)]
        lengths[symbols] = webp.code_lengths(np.arange(1, len(symbols) + 1), 15)
        webp.put_prefix(w, lengths)
        for c in (30 + shift, 40, 255):
            webp._put_single(w, c)
        far = np.zeros(40, np.int64)
        far[[0, 1]] = 1
        webp.put_prefix(w, far)
        codes.append((webp.canonical(lengths), lengths, webp.canonical(far), far, shift))
    want, cache = [], [0] * 8
    slot = lambda p: (0x1E35A7BD * p & 0xFFFFFFFF) >> 29

    def emit(*pixels):
        for p in pixels:
            want.append(p)
            cache[slot(p)] = p

    n = 0
    while len(want) < 64:
        i = len(want)
        c, l, fc, fl, shift = codes[int(which[(i // width >> 2) * 2 + (i % width >> 2)] >> 8)]  # noqa: E741
        n += 1
        if i >= 10 and i + 4 <= 64 and n % 3 == 0:
            w.put(int(c[259]), int(l[259]))  # length 4
            k = n // 3 % 2
            w.put(int(fc[k]), int(fl[k]))  # one row up, or one to the left
            d = (width, 1)[k]
            for _ in range(4):
                emit(want[-d])
        elif i > 3 and n % 3 == 1:
            p = want[i - 2]
            k = slot(p)
            if cache[k] != p:
                p = cache[k]
            w.put(int(c[280 + k]), int(l[280 + k]))
            emit(p)
        else:
            s = (10 + shift, 20)[n % 2]
            w.put(int(c[s]), int(l[s]))
            emit(255 << 24 | (30 + shift) << 16 | s << 8 | 40)
    got = webp.decode(container(w))
    assert got[:2] == (8, 8) and got[2].tolist() == want


@pytest.mark.parametrize("colours", [1, 2, 4, 16, 17, 256])
def test_palettes(colours):
    values = RNG.permutation(256)[:colours].astype(np.uint8)
    samples = values[RNG.integers(0, colours, 31 * 13)]
    w, h, pixels = webp.decode(webp.encode_grey(samples, 31))
    assert (w, h) == (31, 13) and ((pixels >> 8 & 255) == samples).all()


@pytest.mark.parametrize("kind", ["fill", "text", "noise", "steps", "related channels"])
def test_colour_images(kind):
    """Predictor, cross-colour and cache: what is encoded comes back, by the decoder and by a plain reading of the tiles."""
    width, height = 16, 12
    n = 3 * width * height
    ramp = np.arange(n // 3)
    samples = {
        "fill": np.full(n, 255),
        "text": np.frombuffer((b"a short text, then fill; " * 4).ljust(n, b"\xff"), np.uint8),
        "noise": RNG.integers(0, 256, n),
        "steps": np.repeat(ramp // 2 % 256, 3),
        "related channels": np.stack([ramp * 3 % 128, ramp * 7 % 128, (ramp * 7 % 128) // 2], axis=1).ravel(),
    }[kind].astype(np.uint8)
    media = webp.encode_colour(samples, width)
    w, h, pixels = webp.decode(media)
    assert (w, h) == (width, height)
    assert pixels.astype("<u4").view(np.uint8).reshape(-1, 4)[:, 2::-1].ravel().tolist() == samples.tolist()
    assert (pixels >> 24 == 255).all()
    c = np.full((height, width, 4), 255, np.int64)
    c[..., 1:] = samples.reshape(height, width, 3)
    rest, modes = webp.less_predicted(c, webp.TILE)
    argb = (c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]).ravel()
    join = (rest[..., 0] << 24 | rest[..., 1] << 16 | rest[..., 2] << 8 | rest[..., 3]).ravel()
    assert residuals(argb, width, height, modes.ravel(), webp.TILE).tolist() == join.tolist()
    if kind == "related channels":
        assert webp.less_crossed(c, webp.TILE)[1].any()
    if kind == "fill":
        assert len(media) < 80


def test_which_image():
    """One row that is mostly fill is a colour image; its size does not exceed that of the grey one by much."""
    for raw in (b"", b"a", b"word " * 38, b"x" * 192):
        media = encode_payload(payload_of(raw.decode()))
        assert webp.decode(media)[:2] == (16, 12) and decode_payload(media) == (payload_of(raw.decode()), 576, 1)
    assert webp.decode(encode_payload(payload_of("x" * 193)))[:2] == (576, 1)


@pytest.mark.parametrize("over", [0, 1, 5000])
def test_far_repeats(over):
    """A repeat at and beyond the farthest back-reference, in a payload of two files."""
    head = bytes(RNG.integers(97, 123, 3000, dtype=np.uint8))
    noise = bytes(RNG.integers(32, 97, webp.FARTHEST - len(head) + over, dtype=np.uint8))
    payload = payload_of((head + noise + head).decode() + "z" * (576 * webp.MAX_SIDE - webp.FARTHEST))
    media = encode_payload(payload)
    parts = list(files(media))
    assert [webp.decode(f)[0] for f in parts] == [576, 576] and decode_payload(media) == (payload, 576, len(payload) // 576)


def test_broken_files():
    good = webp.encode_grey(RNG.integers(0, 200, 576 * 3, dtype=np.uint8), 576)
    for bad in (b"", b"RIFF", good[:60], b"X" + good[1:]):
        with pytest.raises(Exception):  # noqa: B017
            webp.decode(bad)


def test_near_distances():
    assert len(set(webp.NEAR)) == 120 and all(0 <= y < 8 and -7 <= x <= 8 and (y or x > 0) for x, y in webp.NEAR)
    assert len(webp.NEAR) == 120 and webp.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and webp.NEAR[-1] == (8, 7)
