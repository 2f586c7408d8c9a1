"""FLAC: files of every kind of subframe from an encoder that is written here, bit by bit."""

import numpy as np
import pytest

from wavequarry.sources import flac
from wavequarry.sources.wav import WavError


class Bits:
    def __init__(self):
        self.s = []

    def put(self, v, n):
        self.s += [v >> k & 1 for k in range(n - 1, -1, -1)]

    def bytes(self):
        return np.packbits(np.array(self.s, np.uint8)).tobytes()


def residual(w, e, order, size, parts_log, k, wide):
    w.put(int(wide), 2)
    w.put(parts_log, 4)
    at = 0
    for p in range(1 << parts_log):
        n = (size >> parts_log) - (order if p == 0 else 0)
        own = e[at:at + n]
        at += n
        if k is None:  # escaped: plain numbers
            w.put(31 if wide else 15, 5 if wide else 4)
            bits = max([1, *(int(abs(v)).bit_length() + 1 for v in own)])
            w.put(bits, 5)
            for v in own:
                w.put(int(v) & (1 << bits) - 1, bits)
            continue
        w.put(k, 5 if wide else 4)
        for v in own:
            z = (int(v) << 1) ^ (int(v) >> 63)
            w.s += [0] * (z >> k) + [1]
            w.put(z & (1 << k) - 1, k)


def subframe(w, x, bits, kind, rng):
    size, wasted = len(x), 0
    while kind != "verbatim" and wasted < 4 and not (x >> wasted & 1).any() and x.any():
        wasted += 1
    code = {"constant": 0, "verbatim": 1}.get(kind) if isinstance(kind, str) else 8 + kind[1] if kind[0] == "fixed" else 31 + kind[1]
    w.put(0, 1)
    w.put(code, 6)
    w.put(int(wasted > 0), 1)
    if wasted:
        w.s += [0] * (wasted - 1) + [1]
    x, bits = x >> wasted, bits - wasted
    put = lambda v: w.put(int(v) & (1 << bits) - 1, bits)
    if kind == "constant":
        put(x[0])
    elif kind == "verbatim":
        for v in x:
            put(v)
    else:
        name, order, parts, k, wide = kind
        for v in x[:order]:
            put(v)
        if name == "fixed":
            e = np.diff(x, n=order) if order else x
        else:
            precision, shift = 7, 4
            c = rng.integers(-20, 20, order)
            w.put(precision - 1, 4)
            w.put(shift, 5)
            for v in c:
                w.put(int(v) & (1 << precision) - 1, precision)
            e = np.array([int(x[n]) - (sum(int(c[j]) * int(x[n - 1 - j]) for j in range(order)) >> shift) for n in range(order, size)])
        residual(w, e, order, size, parts, k, wide)


def number(v):
    if v < 0x80:
        return bytes([v])
    out = []
    while True:
        out.insert(0, 0x80 | v & 0x3F)
        v >>= 6
        if v < 1 << (6 - len(out)):
            return bytes([(0xFF << (7 - len(out))) & 0xFF | v, *out])


def encode(x, bits, block, kinds, stereo="independent", rate=48000, rng=None):
    frames, channels = x.shape
    rng = rng or np.random.default_rng(0)
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | frames).to_bytes(8, "big") + bytes(16)
    out = b"fLaC" + bytes([0, 0, 0, 34]) + info + bytes([0x81, 0, 0, 8]) + b"\xff\xf8padxx\xff"
    for f, at in enumerate(range(0, frames, block)):
        own = x[at:at + block].astype(np.int64)
        head = bytes([0xFF, 0xF8, 0x70, {"independent": channels - 1, "left": 8, "right": 9, "mid": 10}[stereo] << 4]) + number(f) + (len(own) - 1).to_bytes(2, "big")
        head += bytes([flac.crc8(head)])
        l, r = own[:, 0], own[:, -1]
        parts, wide = {"independent": ([own[:, c] for c in range(channels)], None), "left": ([l, l - r], 1), "right": ([l - r, r], 0), "mid": ([l + r >> 1, l - r], 1)}[stereo]
        w = Bits()
        for c, v in enumerate(parts):
            kind = kinds[(f + c) % len(kinds)]
            if kind == "constant" and (v != v[0]).any() or not isinstance(kind, str) and (len(v) % (1 << kind[2]) or len(v) >> kind[2] <= kind[1]):
                kind = "verbatim"
            subframe(w, v, bits + (c == wide), kind, rng)
        body = head + w.bytes()
        out += body + flac.crc16(body).to_bytes(2, "big")
    return out


KINDS = ["constant", "verbatim", *(("fixed", k, k % 3, 5, False) for k in range(5)), ("fixed", 2, 1, None, False), ("lpc", 1, 0, 6, False), ("lpc", 3, 2, 9, True), ("lpc", 8, 1, None, True), ("fixed", 1, 0, 17, True)]


def whole(data):
    info = flac.parse_header(data)
    places = flac.frame_places(data, info)
    parts = [flac.decode_frame(data, a, info, b) for (_, a), b in zip(places, [*(p for _, p in places[1:]), None], strict=True)]
    assert [n for n, _ in parts] == [n for n, _ in places]
    return np.concatenate([x for _, x in parts])


@pytest.mark.parametrize(("stereo", "bits"), [("independent", 8), ("left", 16), ("right", 24), ("mid", 24), ("mid", 16)])
def test_every_kind_of_subframe(stereo, bits):
    rng = np.random.default_rng(bits)
    smooth = np.cumsum(rng.integers(-9, 10, (200, 2)), axis=0)
    loud = rng.integers(-(1 << bits - 2), 1 << bits - 2, (200, 2))
    for x in (np.clip(smooth, -(1 << bits - 2), (1 << bits - 2) - 1), loud, loud // 8 * 8, np.full((200, 2), -5), np.zeros((200, 2), int)):
        for kind in KINDS:
            if isinstance(kind, tuple) and kind[3] is not None and x is loud and bits > 8:
                kind = (*kind[:3], bits - 3 if not kind[4] else min(30, bits), kind[4] or bits - 3 > 14)
            assert np.array_equal(whole(encode(x, bits, 96, [kind], stereo, rng=rng)), x), (kind, bits)


def test_mono_and_six_channels_and_long_numbers():
    rng = np.random.default_rng(1)
    for channels in (1, 6):
        x = rng.integers(-2000, 2000, (16 * 140, channels))
        assert np.array_equal(whole(encode(x, 16, 16, [("fixed", 1, 0, 9, False)])), x)  # frame numbers over 127


def test_damage_is_an_error():
    x = np.random.default_rng(2).integers(-2000, 2000, (300, 2))
    data = encode(x, 16, 100, [("fixed", 2, 0, 10, False)])
    info = flac.parse_header(data)
    at = flac.frame_places(data, info)[1][1]
    bad = data[:at + 40] + bytes([data[at + 40] ^ 1]) + data[at + 41:]
    with pytest.raises(WavError):
        flac.decode_frame(bad, at, info)
    with pytest.raises(WavError, match="samples were found"):
        flac.frame_places(data[:at], info)
    for wrong in (b"RIFF", b"fLaC", data[:20]):
        with pytest.raises(WavError):
            flac.parse_header(wrong)


def test_files_are_split_by_frames(spark, tmp_path):
    rng = np.random.default_rng(3)
    (tmp_path / "sub").mkdir()
    x = {"a": rng.integers(-20000, 20000, (1000, 2)), "sub/b": rng.integers(-100, 100, (130, 1))}
    for name, v in x.items():
        (tmp_path / f"{name}.flac").write_bytes(encode(v, 16, 64, KINDS[:7], "mid" if v.shape[1] == 2 else "independent"))
    (tmp_path / "bad.flac").write_bytes(b"no")
    meta = {r["path"].rsplit("/", 1)[-1]: r for r in flac.read_metadata(spark, str(tmp_path)).collect()}
    assert (meta["a.flac"]["rate"], meta["a.flac"]["frames"], meta["a.flac"]["bits"], meta["bad.flac"]["error"]) == (48000, 1000, 16, "not a FLAC file")
    (tmp_path / "bad.flac").unlink()
    got = flac.read_signal(spark, str(tmp_path), ["FL", "FR"], per_task=3).toPandas()
    for name, v in x.items():
        for c, label in enumerate(["FL", "FR"][:v.shape[1]]):
            own = got[got["asset"].str.endswith(f"/{name}.flac") & (got["channel"] == label)].sort_values("n")
            assert own["n"].tolist() == list(range(len(v))) and np.array_equal(own["x"].to_numpy(), v[:, c] / 32768)
