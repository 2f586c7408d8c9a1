"""Files read by parts: any size of block or span gives what the whole file has, and parts that aren't wanted aren't read."""

import struct

import numpy as np
import pytest
from test_flac import KINDS, encode

from wavequarry.sources import flac, ranges, wav

NAMED = "path string, named string, first bigint, last bigint"


def table(df):
    return {k: own.sort_values("n") for k, own in df.toPandas().groupby(["asset", "channel"])}


def test_blocks_of_waves_and_slices(spark, tmp_path):
    x = np.random.default_rng(0).uniform(-1, 1, (1000, 2))
    name = "a b%20c.wav"
    (tmp_path / name).write_bytes(wav.wav_bytes(x, 8000, 24, ((b"bext", bytes(4001)),)))
    (tmp_path / "none.wav").write_bytes(wav.wav_bytes(x[:0], 8000, 24))
    for size in (1, 7, 999, 1000, 4096):
        got = table(wav.read_signal(spark, str(tmp_path), ["FL", "FR"], size=size)) if size > 1 else table(wav.read_signal(spark, str(tmp_path), ["FL", "FR"], size=1).where("n < 50"))
        assert {c for _, c in got} == {"FL", "FR"} and {a.rsplit("/", 1)[1] for a, _ in got} == {name}
        for (_, c), own in got.items():
            assert own["n"].tolist() == list(range(50 if size == 1 else 1000)) and np.abs(own["x"].to_numpy() - x[:len(own), "FL FR".split().index(c)]).max() < 1e-6
    path = next(a for a, _ in got)
    for first, last in ((None, 10), (990, None), (3, 21), (-5, 2), (995, 5000), (5, 5), (2000, None)):
        named = spark.createDataFrame([(path, "it", first, last)], NAMED)
        got = table(wav.read_signal(spark, str(tmp_path), None, named, size=8))
        want = list(range(max(0, first or 0), min(1000, 1000 if last is None else last)))
        assert [own["n"].tolist() for own in got.values()] == ([want] * 2 if want else []) and all(a == "it" for a, _ in got)


def test_only_wanted_bytes_are_read(spark, tmp_path):
    """A file of 6 GiB that is nearly all a hole: its end is read alone."""
    frames, tail = (6 << 30) // 4, np.array([[1, -2], [3, -4]], "<i2")
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(b"RF64" + b"\xff" * 4 + b"WAVE" + wav.chunk(b"ds64", struct.pack("<QQQI", frames * 4 + 72, frames * 4, frames, 0)) + wav.format_chunk(2, 48000, 16) + b"data" + b"\xff" * 4)
        start = f.tell()
        f.seek(start + (frames - 2) * 4)
        f.write(tail.tobytes())
    meta = wav.read_metadata(spark, str(tmp_path)).first()
    assert (meta["frames"], meta["rate"], meta["channels"], meta["length"]) == (frames, 48000, 2, start + frames * 4)
    named = spark.createDataFrame([(meta["path"], "it", frames - 3, None)], NAMED)
    got = table(wav.read_signal(spark, str(tmp_path), ["FL", "FR"], named))
    assert got["it", "FL"]["n"].tolist() == [frames - 3, frames - 2, frames - 1]
    assert [(got["it", c]["x"] * 32768).tolist() for c in ("FL", "FR")] == [[0, 1, 3], [0, -2, -4]]


@pytest.mark.parametrize(("span", "per_task"), [(40, 1), (101, 3), (1 << 20, 64)])
def test_spans_of_flac_and_slices(spark, tmp_path, span, per_task):
    x = np.random.default_rng(4).integers(-20000, 20000, (700, 2))
    (tmp_path / "a b.flac").write_bytes(encode(x, 16, 64, KINDS[:7], "mid"))
    got = table(flac.read_signal(spark, str(tmp_path), ["FL", "FR"], per_task, span=span))
    for (_, c), own in got.items():
        assert own["n"].tolist() == list(range(700)) and np.array_equal(own["x"].to_numpy() * 32768, x[:, "FL FR".split().index(c)])
    path = next(a for a, _ in got)
    for first, last in ((130, 131), (60, 140), (650, None), (800, None)):
        own = table(flac.read_signal(spark, str(tmp_path), ["FL", "FR"], per_task, spark.createDataFrame([(path, "it", first, last)], NAMED), span))
        want = list(range(first, min(700, last or 700)))
        assert [v["n"].tolist() for v in own.values()] == ([want] * 2 if want else [])


def test_damage_and_bad_headers_are_errors(spark, tmp_path):
    x = np.random.default_rng(5).integers(-2000, 2000, (300, 2))
    data = encode(x, 16, 100, [("fixed", 2, 0, 10, False)])
    cut = flac.frame_places(data, flac.parse_header(data))[2][1]
    (tmp_path / "cut.flac").write_bytes(data[:cut])
    with pytest.raises(Exception, match="samples were found"):
        flac.read_signal(spark, str(tmp_path)).count()
    (tmp_path / "bad.wav").write_bytes(b"RIFF")
    with pytest.raises(Exception, match="not a WAV file"):
        wav.read_signal(spark, str(tmp_path)).count()
    for body in (struct.pack("<HHIIHH", 1, 2, 8000, 32000, 3, 16), struct.pack("<HHIIHH", 1, 0, 8000, 0, 0, 16), b"\1\0"):
        with pytest.raises(wav.WavError):
            wav.parse_header(b"RIFF\0\0\0\0WAVE" + wav.chunk(b"fmt ", body) + wav.chunk(b"data", b"1234"))


def test_addresses(tmp_path):
    (tmp_path / "x%41 y").write_bytes(b"0123456789")
    assert ranges.read_part(f"file:{tmp_path}/x%41 y", 3, 6) == ranges.read_part(f"{tmp_path}/x%41 y", 3, 6) == b"345"
    assert ranges.read_part(f"file://{tmp_path}/x%41 y", 8, 60) == b"89"
    with pytest.raises(Exception, match="[Uu]nrecognized|[Uu]nknown|scheme"):
        ranges.read_part("nothing://host/x", 0, 1)
