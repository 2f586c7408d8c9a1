import hashlib
import zlib

import numpy as np
import pytest

from wavequarry.llm.media_webp import (decode_images, features_of, media_digests, payload_of, payload_size, read_back, samples_of, store, store_texts, stored_images,
                                       transforms_for)
from wavequarry.llm.webp_codec import NEAR, WebPError, Writer, _put_image, canonical, code_lengths, decode, encode

#: A 1 x 1 image written by hand: no transform, five one-symbol codes (green 2, red 1, blue 3, alpha 255, distance 0).
def by_hand():
    bits = []
    put = lambda v, n: bits.extend(v >> k & 1 for k in range(n))
    put(0, 14), put(0, 14), put(1, 1), put(0, 3), put(0, 1), put(0, 1), put(0, 1)
    for s in (2, 1, 3, 255, 0):
        put(1, 1), put(0, 1), put(s > 1, 1), put(s, 8 if s > 1 else 1)
    body = b"\x2f" + np.packbits(bits, bitorder="little").tobytes()
    data = len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (len(data) + 8).to_bytes(4, "little") + b"WEBPVP8L" + data


def test_by_hand():
    assert decode(by_hand()).tolist() == [[0xFF010203]]
    assert len(NEAR) == len(set(NEAR)) == 120


def images():
    rng = np.random.default_rng(1)
    for shape in ((1, 1), (1, 9), (7, 1), (13, 17), (40, 33)):
        yield rng.integers(0, 1 << 32, shape, dtype=np.uint64).astype(np.uint32)
        yield (rng.integers(0, 256, shape) << 8).astype(np.uint32) | np.uint32(0xFF000000)
        yield rng.choice(np.array([5, 9, 0xFF00FF00], np.uint32), shape)
        yield np.tile(rng.integers(0, 1 << 24, (1, shape[1])).astype(np.uint32), (shape[0], 1))


@pytest.mark.parametrize("how", [{}, {"copies": False}, {"cache_bits": 4}, {"meta_bits": 2}, {"cache_bits": 6, "meta_bits": 3}])
def test_round_trips(how):
    rng = np.random.default_rng(2)
    for p in images():
        blocks = [-(-n // 4) for n in p.shape]
        kinds = [(), (("green",),), (("predictor", rng.integers(0, 14, blocks), 2), ("cross", rng.integers(0, 1 << 24, blocks), 2), ("green",))]
        kinds += [(("predictor", np.full(blocks, m), 2),) for m in range(14)]
        if len(np.unique(p)) <= 256:
            kinds.append((("palette",),))
        for transforms in kinds:
            assert (decode(encode(p, transforms, **how)) == p).all()


def test_codes():
    for counts in ([5, 1, 1, 1], [1] * 9, [0, 3, 0], [1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584]):
        lengths = code_lengths(np.array(counts), 15)
        used = lengths[lengths > 0].astype(int)
        assert len(used) == 1 or sum(2.0 ** -n for n in used) == 1
        codes = {format(int(c), f"0{n}b")[::-1] for c, n in zip(canonical(lengths), lengths) if n}
        assert all(a == b or not a.startswith(b) for a in codes for b in codes)


def test_damaged_files():
    good = store(payload_of("some words and some more words " * 9))
    for bad in (b"", b"RIFF", good[:30], good[:4] + b"1234" + b"JUNK" + good[12:], b"x" + good[1:]):
        with pytest.raises(WebPError):
            decode(bad)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = media_digests(odd_docs).collect()
    want = []
    for r in odd_docs.collect():
        p = payload_of(r["text"])
        assert len(p) % 64 == 0 and p.rstrip(b"\0") == (r["text"] or "").encode().rstrip(b"\0")
        want.append((r["doc_id"], len((r["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in rows)
    values = {}
    for r in rows:
        assert values.setdefault(r["payload_sha256"], tuple(r)[4:]) == tuple(r)[4:]
    assert media_digests(no_docs).count() == 0


def test_pixels(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id bigint, text string")
    out = {r["doc_id"]: r["image"] for r in decode_images(store_texts(docs)).collect()}
    assert (out[1]["width"], out[1]["height"]) == (64, 1) and out[1]["pixels"][:8] == b"\0a\0\xff\0b\0\xff" and out[1]["error"] is None
    odd = spark.createDataFrame([(b"no image",), (None,)], "media binary")
    got = [r["image"] for r in decode_images(odd).collect()]
    assert got[0]["error"] and got[1] is None


def test_large_payload_keeps_its_size():
    p = payload_of("ab" * 700_000)
    assert (decode(store(p)) >> 8 & 255).astype(np.uint8).tobytes() == p


@pytest.mark.parametrize("rows", [16_411, 16_417, 40_009])
def test_large_payload_that_no_width_divides(rows):
    text = "ab" * (32 * rows - 3)
    p = payload_of(text)
    assert len(p) == 64 * rows == payload_size(len(text))
    pixels = decode(store(p))
    assert samples_of(pixels, len(p)) == p and pixels.size > len(p)
    got = dict(x.split("=") for x in features_of(pixels, len(p)).split(";")[1:])
    assert float(got["zero"]) == round(6 / len(p), 6) and got["mean"] == f"{sum(p) / len(p):.6f}"


def test_large_text_in_a_table(spark):
    text = "ab" * (32 * 16_411)
    r = media_digests(spark.createDataFrame([(1, text), (2, "a")], "doc_id bigint, text string")).where("doc_id = 1").first()
    assert (r["payload_bytes"], r["payload_sha256"]) == (len(text), hashlib.sha256(text.encode()).hexdigest())


def file_of(width, height, head, data):
    """A file whose transforms ``head`` writes and whose coded pixels are ``data``, as they stand."""
    w = Writer()
    w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    head(w)
    w.put(0, 1)
    _put_image(w, data, True)
    body = b"\x2f" + w.bytes()
    body = len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    return b"RIFF" + (len(body) + 8).to_bytes(4, "little") + b"WEBPVP8L" + body


def predicted(mode, l, t, tr, tl):
    """The format's fourteen predictions, channel by channel, on lists of four."""
    avg = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda x: max(0, min(255, x))
    if mode == 11:
        p = [a + b - c for a, b, c in zip(l, t, tl)]
        return l if sum(abs(x - y) for x, y in zip(p, l)) < sum(abs(x - y) for x, y in zip(p, t)) else t
    return {0: [0, 0, 0, 255], 1: l, 2: t, 3: tr, 4: tl, 5: avg(avg(l, tr), t), 6: avg(l, tl), 7: avg(l, t), 8: avg(tl, t), 9: avg(t, tr),
            10: avg(avg(l, tl), avg(t, tr)), 12: [clamp(a + b - c) for a, b, c in zip(l, t, tl)],
            13: [clamp(a + int((a - c) / 2)) for a, c in zip(avg(l, t), tl)]}[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors_by_the_format(mode):
    rng = np.random.default_rng(mode)
    height, width = 6, 9
    residual = rng.integers(0, 1 << 32, (height, width), dtype=np.uint64).astype(np.uint32)
    modes = np.full((2, 3), mode << 8, np.uint32)
    modes[1, 1] = (mode + 5) % 14 << 8

    def head(w):
        w.put(1, 1), w.put(0, 2), w.put(0, 3)
        _put_image(w, modes)

    got = decode(file_of(width, height, head, residual))
    parts = lambda v: [v & 255, v >> 8 & 255, v >> 16 & 255, v >> 24]
    out = [[None] * width for _ in range(height)]
    for y in range(height):
        for x in range(width):
            if not y and not x:
                p = [0, 0, 0, 255]
            elif not y:
                p = out[y][x - 1]
            elif not x:
                p = out[y - 1][x]
            else:
                tr = out[y - 1][x + 1] if x + 1 < width else out[y][0]
                p = predicted(int(modes[y >> 2, x >> 2] >> 8), out[y][x - 1], out[y - 1][x], tr, out[y - 1][x - 1])
            out[y][x] = [(a + b) & 255 for a, b in zip(parts(int(residual[y, x])), p)]
    assert [[parts(int(v)) for v in row] for row in got] == out


def test_colour_transforms_by_the_format():
    rng = np.random.default_rng(3)
    height, width = 5, 7
    data = rng.integers(0, 1 << 32, (height, width), dtype=np.uint64).astype(np.uint32)
    element = np.array([[0x00C07F81]], np.uint32) | np.uint32(0xFF000000)  # negative and positive multipliers

    def head(w):
        w.put(1, 1), w.put(1, 2), w.put(1, 3)
        _put_image(w, element)
        w.put(1, 1), w.put(2, 2)

    signed = lambda v: v - 256 if v > 127 else v
    delta = lambda t, c: (signed(t) * signed(c)) >> 5
    for got, v in zip(decode(file_of(width, height, head, data)).ravel().tolist(), data.ravel().tolist()):
        b, g, r, a = v & 255, v >> 8 & 255, v >> 16 & 255, v >> 24
        b, r = (b + g) & 255, (r + g) & 255  # the last transform written is undone first
        r = (r + delta(0x81, g)) & 255
        b = (b + delta(0x7F, g) + delta(0xC0, r)) & 255
        assert got == a << 24 | r << 16 | g << 8 | b


@pytest.mark.parametrize("colours", [2, 3, 16, 17])
def test_palettes_by_the_format(colours):
    rng = np.random.default_rng(colours)
    palette = rng.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    index = rng.integers(0, colours, (4, 11))
    each = 1 if colours <= 2 else 2 if colours <= 4 else 4 if colours <= 16 else 8
    per = 8 // each
    packed = [[sum(int(v) << each * k for k, v in enumerate(row[x:x + per])) << 8 for x in range(0, 11, per)] for row in index]
    steps = [int(palette[0])]
    for a, b in zip(palette.tolist(), palette.tolist()[1:]):
        steps.append(sum(((b >> k & 255) - (a >> k & 255) & 255) << k for k in (0, 8, 16, 24)))

    def head(w):
        w.put(1, 1), w.put(3, 2), w.put(colours - 1, 8)
        _put_image(w, np.array([steps], np.uint32))

    assert (decode(file_of(11, 4, head, np.array(packed, np.uint32))) == palette[index]).all()


def test_transforms_are_chosen_per_image():
    ramp = bytes((7 * k) % 256 for k in range(4096))
    for payload, kind in ((ramp, "predictor"), (payload_of("abab ab ba " * 60), "palette"), (payload_of("The quick brown fox jumps over the lazy dog; 1234567890! " * 9), None)):
        assert [t[0] for t in transforms_for(np.frombuffer(payload, np.uint8).reshape(-1, 64))] == ([kind] if kind else [])
        assert read_back(store(payload), len(payload))[0] == payload


def test_long_payloads_are_several_images():
    p = payload_of("some words é " * 3000)
    media = store(p, 64 * 100)
    assert len(stored_images(media)) == -(-len(p) // 6400) and read_back(media, len(p))[0] == p and read_back(media, len(p))[1].count("|") == len(stored_images(media)) - 1


def test_a_column_called_image_is_replaced(spark):
    df = spark.createDataFrame([(store(payload_of("a")), "x", 1), (None, "y", 2), (b"", "z", 3)], "media binary, image string, n int")
    out = decode_images(df)
    assert out.columns == ["media", "n", "image"]
    assert [(r["n"], r["image"] and r["image"]["width"]) for r in out.orderBy("n").collect()] == [(1, 64), (2, None), (3, None)]
    assert decode_images(df.where("n > 9")).count() == 0
