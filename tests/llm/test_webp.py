import hashlib
import random
import zlib

import numpy as np
import pytest

from doclattice.llm import queries, webp


def image(rng, w, h, colours=None, stretch=False):
    if colours:
        table = rng.integers(0, 2**32, colours, dtype=np.uint64).astype(np.uint32)
        out = table[rng.integers(0, colours, w * h)]
    else:
        out = rng.integers(0, 2**32, w * h, dtype=np.uint64).astype(np.uint32)
    if stretch and w * h > 60:
        out[40:60] = out[10:30]
    return out


def samples(argb, w, h):
    return np.stack([argb >> s & 255 for s in (16, 8, 0, 24)], 1).astype(np.uint8).reshape(h, w, 4)


P, C, G, I = webp.PREDICTOR, webp.CROSS_COLOUR, webp.SUBTRACT_GREEN, webp.PALETTE


@pytest.mark.parametrize("transforms", [(), (P,), (C,), (G,), (P, C), (G, P, C), (P, C, G), (I,), (I, P)])
@pytest.mark.parametrize("cache", [0, 1, 6, 11])
def test_round_trip(transforms, cache):
    rng = np.random.default_rng(len(transforms) * 100 + cache)
    for w, h, colours in ((1, 1, 2), (7, 5, 2), (9, 8, 4), (33, 17, 16), (40, 23, 100), (31, 29, None)):
        if I in transforms and (colours is None):
            continue
        argb = image(rng, w, h, colours, stretch=True)
        cells = ((h + 7) // 8, ((w if I not in transforms else -(-w // (1 << webp.bundle_bits(len(np.unique(argb)))))) + 7) // 8)
        modes, elements = rng.integers(0, 14, cells), rng.integers(0, 2**24, cells)
        file = webp.encode(argb, w, h, transforms, cache, modes=modes, elements=elements)
        assert (webp.decode(file) == samples(argb, w, h)).all(), (w, h)


def test_every_predictor_mode():
    rng = np.random.default_rng(5)
    argb = image(rng, 19, 13)
    for mode in range(14):
        file = webp.encode(argb, 19, 13, (P,), modes=np.full((2, 3), mode))
        assert (webp.decode(file) == samples(argb, 19, 13)).all()
    assert webp.predict(11, 0x10203040, 0x10203050, 0, 0x10203050) == 0x10203040
    assert webp.predict(12, 0xFF000000, 0xFF00FF00, 0, 0) == 0xFF00FF00 and webp.predict(13, 0xFF000000, 0xFF000000, 0, 0xFF0000FF) == 0xFF000000


def test_groups_of_codes():
    rng = np.random.default_rng(6)
    argb = image(rng, 30, 20, 40, stretch=True)
    file = webp.encode(argb, 30, 20, cache_bits=4, groups=(3, rng.integers(0, 3, (3, 4))))
    assert (webp.decode(file) == samples(argb, 30, 20)).all()


def test_near_distances():
    assert len(webp.NEAR) == 120 and webp.NEAR[:8] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2)] and webp.NEAR[-1] == (8, 7)
    assert webp.distance_of(1, 50) == 50 and webp.distance_of(2, 50) == 1 and webp.distance_of(121, 50) == 1


def test_hand_made_file():
    """2 x 1 pixels, simple codes, green 1 then 0 and alpha 255."""
    bits = "10001100" "0" "0" "0"  # below: no transform, no cache, no groups; written out by value
    w = webp.Writer()
    w.put(0x2F | 1 << 8 | 0 << 22 | 1 << 36, 40)
    for v, n in ((0, 1), (0, 1), (0, 1), (1, 1), (1, 1), (0, 1), (0, 1), (1, 8), (1, 1), (0, 1), (0, 1), (0, 1), (1, 1), (0, 1), (1, 1), (7, 8), (1, 1), (0, 1), (1, 1), (255, 8), (1, 1), (0, 1), (0, 1), (0, 1), (1, 1), (0, 1)):
        w.put(v, n)
    data = w.bytes()
    file = b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    assert bits and webp.decode(file).tolist() == [[[0, 1, 7, 255], [0, 0, 7, 255]]]


def test_broken_files_are_refused():
    file = webp.store(b"some text " * 300)
    rng = random.Random(2)
    for n in (0, 5, 15, 20, 30, 60, len(file) // 2):
        with pytest.raises(webp.BadImage):
            webp.decode(file[:n])
    for _ in range(300):
        bad = bytearray(file)
        bad[rng.randrange(20, len(bad))] ^= 1 << rng.randrange(8)
        try:
            webp.decode(bytes(bad))
        except webp.BadImage:
            pass


def texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij é") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    out = ["", "a", "x" * 63, "x" * 64, "x" * 65, "Ther " * 3000, "\x00" * 70, "ab\n" * 9]
    return out + [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 40, 300, 2000, 9000)] + ["".join(chr(rng.randrange(1, 50000)) for _ in range(5000))]


def test_payloads():
    for t in texts():
        data = t.encode()
        pixels = webp.decode(webp.store(data))
        want = data + b"\0" * (webp.payload_size(len(data)) - len(data))
        assert webp.payload_of(pixels, len(data)) == want and len(want) % 64 == 0 < len(want)
    assert webp.shape_of(64) == (16, 1) and webp.shape_of(64 * 16385) == (32, 8193)
    big = b"0123456789" * 160_000
    assert webp.payload_of(webp.decode(webp.store(big)), len(big))[: len(big)] == big


def test_columns_and_query(spark, sf_dir):
    queries.prepare(spark)
    rows = [(None, t, 1, "x") for t in texts()] + [(1, None, 1, "x")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, feature string")
    got = webp.read_column(webp.store_column(df)).collect()
    assert len(got) == len(rows) and all(bytes(r.pixels)[: r.n_bytes] == (r.text or "").encode() for r in got)
    assert webp.read_column(webp.store_column(df.limit(0))).count() == 0
    assert webp.read_column(spark.createDataFrame([(b"no",), (None,)], "media binary")).collect()[0].pixels is None
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op2_lossless_webp(spark, sf_dir).collect()
    assert len(out) == len(text)
    for r in out:
        data = text[r.doc_id].encode()
        payload = data + b"\0" * (webp.payload_size(len(data)) - len(data))
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()


def by_hand(mode, element, pixel, width=2, height=2):
    """A file put together bit by bit from the format's text: predictor, then cross-colour, one block each, and one stored pixel everywhere, so that all codes have one symbol."""
    bits = []

    def put(value, n):
        bits.extend(value >> k & 1 for k in range(n))

    def one_symbol(symbol):
        put(1, 1)  # simple
        put(0, 1)  # one symbol
        put(1, 1)  # of eight bits
        put(symbol, 8)

    def codes(alpha, red, green, blue):
        for symbol in (green, red, blue, alpha, 0):
            one_symbol(symbol)

    put(0x2F, 8)
    put(width - 1, 14)
    put(height - 1, 14)
    put(1, 1)
    put(0, 3)
    for kind, data in ((0, (255, 0, mode, 0)), (1, (255, *element))):
        put(1, 1)
        put(kind, 2)
        put(0, 3)  # blocks of 4 x 4
        put(0, 1)  # no cache
        codes(*data)
    put(0, 1)  # no more transforms
    put(0, 1)  # no cache
    put(0, 1)  # one group of codes
    codes(*pixel)
    bits += [0] * (-len(bits) % 8)
    data = bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))
    data += b"\0" * (len(data) & 1)
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data
    return b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk


@pytest.mark.parametrize("mode", [0, 1, 2, 7, 11, 12, 13])
@pytest.mark.parametrize("element, pixel", [((0, 0, 0), (3, 20, 40, 60)), ((32, 64, 16), (3, 20, 40, 60)), ((200, 250, 130), (0, 200, 250, 7))])
def test_predictor_and_cross_colour_by_hand(mode, element, pixel):
    signed = lambda v: v - 256 if v > 127 else v
    red_to_blue, green_to_blue, green_to_red = map(signed, element)
    a, r, g, b = pixel
    red = (r + (green_to_red * signed(g) >> 5)) & 255
    blue = (b + (green_to_blue * signed(g) >> 5) + (red_to_blue * signed(red) >> 5)) & 255
    rest = (a, red, g, blue)
    add = lambda x, y: tuple((u + v) & 255 for u, v in zip(x, y))
    first = add((255, 0, 0, 0), rest)
    left = top = add(first, rest)  # the first row follows the left pixel, the first column the upper one
    clamp = lambda v: max(0, min(255, v))
    average = tuple((x + y) // 2 for x, y in zip(left, top))
    half = tuple(clamp(m + int((m - t) / 2)) for m, t in zip(average, first))
    guess = {0: (255, 0, 0, 0), 1: left, 2: top, 7: average, 11: left, 12: tuple(clamp(x + y - z) for x, y, z in zip(left, top, first)), 13: half}[mode]
    last = add(guess, rest)
    got = webp.decode(by_hand(mode, element, pixel))
    want = [[first, left], [top, last]]
    assert got.tolist() == [[[p[1], p[2], p[3], p[0]] for p in row] for row in want]


def test_palette_is_decided_by_the_whole_payload():
    """The same pixels in another order take the same form: what stands first does not decide."""
    colours = [bytes([i, 255 - i, i // 2, 9]) for i in range(200)]
    mixed_first, plain_first = b"".join(colours) + colours[0] * 4000, colours[0] * 4000 + b"".join(colours)
    for data in (mixed_first, plain_first):
        file = webp.store(data)
        assert webp.payload_of(webp.decode(file), len(data))[: len(data)] == data
        bits = int.from_bytes(file[20:40], "little") >> 40
        assert bits & 7 == 1 | 3 << 1  # a transform, the palette


def test_images_of_one_code_are_read_as_by_the_general_way(monkeypatch):
    plain, seen = webp.scan_plain, []

    def both(bits, table, n):
        start = bits.at
        want = webp.scan(bits, [table] * 5, n, 16, 0, True)
        end, bits.at = bits.at, start
        got = plain(bits, table, n)
        assert (got == want).all() and bits.at == end
        seen.append(n)
        return got

    monkeypatch.setattr(webp, "scan_plain", both)
    rng = random.Random(6)
    for k in (65, 300, 1027, 4000, 9001):
        data = bytes(rng.choice(b"abcdefghij klmnop.") for _ in range(k))
        assert webp.payload_of(webp.decode(webp.store(data)), k).rstrip(b"\0") == data
    odd = np.random.default_rng(1).integers(0, 2**32, 45, dtype=np.uint64).astype(np.uint32)
    assert webp.decode(webp.encode(odd, 5, 9)).shape == (9, 5, 4)
    assert seen == [80, 1008, 2256, 45]
    file = webp.store(data)
    with pytest.raises(webp.BadImage):
        webp.decode(file[: len(file) // 2])
