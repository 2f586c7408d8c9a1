"""Files written by blocks."""

import os
import xml.etree.ElementTree as ET

import numpy as np
import pytest

from wavequarry.functions import dsp
from wavequarry.operators.upmix import Routing
from wavequarry.sources import blocks, wav

RATE = 48000


def frame(spark, assets, columns="asset string, channel string, n bigint, x double"):
    rows = [(a, c, n, float(v)) for (a, c), x in assets.items() for n, v in enumerate(x)]
    return spark.createDataFrame(rows, columns).repartition(4)


def samples(path):
    data = open(path, "rb").read()
    h = wav.parse_header(data)
    return wav.decode_pcm(data[h["start"]:h["start"] + h["frames"] * h["align"]], h["bits"], h["channels"]), h, data


def test_blocks_make_the_file_that_one_task_makes(spark, tmp_path):
    rng = np.random.default_rng(0)
    x = {(a, c): rng.uniform(-1.2, 1.2, n) for a, n in (("a", 333), ("sub/b", 64)) for c in ("FL", "FR", "C")}
    for bits in (16, 24, 32):
        out = blocks.write_waves(frame(spark, x), ["C", "FL", "FR"], RATE, str(tmp_path), bits, size=64).collect()
        for r in out:
            want = np.stack([x[r["asset"], c] for c in ("C", "FL", "FR")], axis=1)
            assert open(r["path"], "rb").read() == wav.wav_bytes(want, RATE, bits) and r["bytes"] == os.path.getsize(r["path"]) and r["tracks"] == 3 and r["frames"] == len(want)
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["a.wav", "b.wav"]


def test_bed_has_its_metadata_and_loudness(spark, tmp_path):
    labels = "FL FR C LFE SL SR".split()
    x = {("a", c): np.full(101, (k + 1) / 10) for k, c in enumerate(labels)}
    measured = spark.createDataFrame([("a", -18.25, None)], "asset string, lkfs double, dbtp double")
    path = blocks.write_beds(frame(spark, x), "5.1", RATE, str(tmp_path), measured, size=40).first()["path"]
    y, h, data = samples(path)
    assert np.allclose(y, np.tile((np.arange(6) + 1) / 10, (101, 1)), atol=1e-6) and h["rate"] == RATE
    assert [t for t, _ in wav.chunks_of(data)] == ["fmt ", "bext", "data", "axml", "chna", "dbmd"]
    body = data.index(b"bext") + 8
    assert int.from_bytes(data[body + 412:body + 414], "little", signed=True) == -1825


def test_errors_publish_nothing_and_leave_nothing(spark, tmp_path):
    x = {("a", "FL"): np.ones(50), ("a", "FR"): np.ones(49)}
    with pytest.raises(wav.WavError, match="same samples"):
        blocks.write_waves(frame(spark, x), ["FL", "FR"], RATE, str(tmp_path), size=20)
    with pytest.raises(wav.WavError, match="same samples"):
        blocks.write_waves(frame(spark, x), ["FL", "C"], RATE, str(tmp_path), size=20)
    with pytest.raises(Exception, match="leaves the output folder"):
        blocks.write_waves(frame(spark, {("../a", "FL"): np.ones(3), ("b", "FL"): np.ones(3)}), ["FL"], RATE, str(tmp_path), size=20)
    with pytest.raises(wav.WavError, match="kHz"):
        blocks.write_beds(frame(spark, x), "5.1", 44100, str(tmp_path))
    with pytest.raises(wav.WavError, match="no bed"):
        blocks.write_beds(frame(spark, x), "9.1", RATE, str(tmp_path))
    with pytest.raises(wav.WavError, match="4 GiB"):
        blocks.layout_of([["", ["FL"] * 12]], (1 << 32) // 36, RATE, 24, False, None, None)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_a_file_that_reads_back_wrong_is_not_published(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "parse_header", lambda *_: {"rate": 1, "channels": 1, "bits": 16, "frames": 0})
    with pytest.raises(wav.WavError, match="isn't what was asked"):
        blocks.write_waves(frame(spark, {("a", "FL"): np.ones(50)}), ["FL"], RATE, str(tmp_path), size=20)
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_stem_beds_with_filtered_low_end_and_passthrough(spark, tmp_path):
    rng = np.random.default_rng(1)
    stems = {("a", "Bass"): 0.3 * rng.standard_normal((200, 2)), ("a", "Vocals@front"): 0.3 * rng.standard_normal((150, 2)), ("b", "Bass"): 0.3 * rng.standard_normal((70, 2))}
    rows = [(a, s, n, float(l), float(r)) for (a, s), x in stems.items() for n, (l, r) in enumerate(x)]
    routes = spark.createDataFrame([("Bass", "LFE", 0.8), ("Bass", "FR", 0.65), ("Bass", "C", 0.2), ("Bass", "TFL", 0.1), ("Vocals@front", "FL", 2.5), ("Vocals@front", "LFE", 0.0)], "stem string, channel string, gain double")
    passed = frame(spark, {("a", "LFE"): 0.1 * np.ones(210), ("a", "C"): 0.2 * np.ones(210), ("a", "TFL"): np.ones(210)})
    out = {r["asset"]: r for r in blocks.write_stem_beds(spark.createDataFrame(rows, "asset string, stem string, n bigint, l double, r double"), routes, "5.1", RATE, str(tmp_path), passed, size=64).collect()}
    y, h, data = samples(out["a"]["path"])
    bass, voice = stems["a", "Bass"], stems["a", "Vocals@front"]
    low = lambda x: Routing().lfe * dsp.sos_filter(dsp.butterworth(4, 120, RATE), x)[0]
    want = [0.65 * bass[:, 1], 0.2 * bass.mean(axis=1), low(0.8 * bass.mean(axis=1)), 2.5 * voice[:, 0], np.full(210, 0.2), np.full(210, 0.1)]
    assert y.shape == (210, 6)
    for k, x in enumerate(want):
        assert np.abs(y[:len(x), k] - np.clip(x, -1, 1)).max() < 1e-6 and not y[len(x):, k].any()
    root = ET.fromstring(data[data.index(b"axml") + 8:][:dict(wav.chunks_of(data))["axml"]])
    assert [e.get("audioObjectName") for e in root.iter("audioObject")] == ["Bass Bed", "Vocals (front) Bed", "Passthrough Bed"]
    assert samples(out["b"]["path"])[0].shape == (70, 3)
    with pytest.raises(wav.WavError, match="no stem has a route"):
        blocks.write_stem_beds(spark.createDataFrame([("c", "Crowd", 0, 0.0, 0.0)], "asset string, stem string, n bigint, l double, r double"), routes, "5.1", RATE, str(tmp_path))


def test_real_samples_are_read(spark, tmp_path):
    import struct

    x = np.random.default_rng(2).standard_normal((90, 2))
    for bits, kind in ((32, "<f4"), (64, "<f8")):
        raw = x.astype(kind).tobytes()
        body = wav.chunk(b"fmt ", struct.pack("<HHIIHH", 3, 2, RATE, RATE * bits // 4, bits // 4, bits)) + wav.chunk(b"fact", b"\0" * 4) + wav.chunk(b"data", raw)
        (tmp_path / f"{bits}.wav").write_bytes(b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WAVE" + body)
    got = wav.read_signal(spark, str(tmp_path), ["FL", "FR"]).toPandas().sort_values(["asset", "channel", "n"])
    assert np.allclose(got[got["asset"].str.endswith("64.wav") & (got["channel"] == "FR")]["x"], x[:, 1])
    assert np.allclose(got[got["asset"].str.endswith("32.wav") & (got["channel"] == "FL")]["x"], x[:, 0].astype(np.float32))
