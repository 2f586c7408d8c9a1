import os

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from wavequarry.functions import dsp
from wavequarry.operators import folds, mastering, planning, windows
from wavequarry.sources import wav
from wavequarry.streaming import signals


def frame(spark, x, channel="FL", asset="a"):
    return spark.createDataFrame([(asset, channel, int(n), float(v)) for n, v in enumerate(x)], "asset string, channel string, n bigint, x double")


def response(sos, f, rate):
    z = np.exp(-2j * np.pi * np.atleast_1d(f) / rate)
    return np.abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos], axis=0))


def test_butterworth_magnitudes():
    for order in (1, 2, 3, 4):
        for kind in ("low", "high"):
            sos = dsp.butterworth(order, 1000, 48000, kind)
            assert np.allclose(response(sos, 1000, 48000), np.sqrt(0.5))
            assert np.allclose(response(sos, 0 if kind == "low" else 24000, 48000), 1)


def test_weighting_keeps_its_response_at_other_rates():
    a, b = dsp.k_weighting(48000), dsp.k_weighting(96000)
    f = np.array([50, 100, 1000, 4000, 8000.0])
    assert np.abs(20 * np.log10(response(a, f, 48000) / response(b, f, 96000))).max() < 0.25


def test_filters_and_transforms():
    rng = np.random.default_rng(0)
    x = rng.standard_normal(5000)
    h = rng.standard_normal(100)
    assert np.allclose(dsp.fir_filter(h, x), np.convolve(h, x)[:5000])
    s = dsp.butterworth(2, 3000, 48000)
    y1, state = dsp.sos_filter(s, x[:1234])
    assert np.allclose(np.concatenate([y1, dsp.sos_filter(s, x[1234:], state)[0]]), dsp.sos_filter(s, x)[0])
    back = dsp.istft(dsp.stft(x, 256, 64), 256, 64)
    assert np.abs(back[256:4600] - x[256:4600]).max() < 1e-9
    t = np.arange(4800) / 48000
    up = dsp.resample(np.sin(2 * np.pi * 500 * t), 48000, 44100)
    assert len(up) == 4410 and np.abs(up[300:-300] - np.sin(2 * np.pi * 500 * np.arange(4410) / 44100)[300:-300]).max() < 2e-3
    f, p = dsp.welch(np.sin(2 * np.pi * 3000 * t), 48000)
    assert abs(f[p.argmax()] - 3000) < 200
    flat = dsp.zero_phase(s, np.ones(200))
    assert np.allclose(flat, 1)


def test_eq_reaches_its_gain_and_half_form_its_half():
    points = [(20, 0), (1000, 6), (20000, 0)]
    full, half = dsp.fir_from_breakpoints(points, 48000), dsp.fir_from_breakpoints(points, 48000, 511, half=True)
    assert len(full) == 1023 and len(half) == 256
    at = lambda h: 20 * np.log10(abs(np.sum(h * np.exp(-2j * np.pi * 1000 / 48000 * np.arange(len(h))))))
    assert abs(at(full) - 6) < 0.3 and abs(at(half) - 3) < 0.3


def test_loudness_of_a_tone_and_gain_linearity(spark):
    t = np.arange(48000) / 48000
    tone = frame(spark, np.sin(2 * np.pi * 997 * t))
    got = mastering.loudness(tone, 48000).first()
    assert abs(got["lkfs"] + 3.01) < 0.05 and abs(got["dbtp"]) < 0.1
    half = mastering.loudness(tone.withColumn("x", F.col("x") / 2), 48000).first()
    assert abs(got["lkfs"] - half["lkfs"] - 6.0206) < 1e-3
    out = mastering.loudness(mastering.normalise(tone, 48000, -20.0), 48000).first()
    assert abs(out["lkfs"] + 20) < 1e-3
    assert mastering.loudness(frame(spark, np.zeros(48000)), 48000).first()["lkfs"] == -70.0
    done = mastering.Chain(48000, [(100, 0), (1000, 3), (10000, 0)], "glue", 0.95, -18.0).apply(tone)
    assert abs(mastering.loudness(done, 48000).first()["lkfs"] + 18) < 1e-2


def test_fold_equals_biquad(spark):
    x = np.random.default_rng(1).standard_normal(300)
    s = dsp.butterworth(2, 2000, 48000)[0]
    got = folds.biquad(frame(spark, x).drop("asset"), tuple(s[:3]), tuple(s[4:])).orderBy("n").toPandas()["y"]
    assert np.allclose(got, dsp.sos_filter(s[None], x)[0])


def test_wav_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    for bits in (16, 24, 32):
        x = rng.uniform(-1, 1, (700, 2))
        data = wav.wav_bytes(x, 44100, bits, ((b"bext", b"abc"),))
        h = wav.parse_header(data)
        assert (h["rate"], h["channels"], h["bits"], h["frames"]) == (44100, 2, bits, 700)
        assert np.abs(wav.decode_pcm(data[h["start"]:], bits, 2) - x).max() < 2.0 ** (2 - bits)
        assert [c[0] for c in wav.chunks_of(data)] == ["fmt ", "bext", "data"]
    with wav.atomic_path(str(tmp_path / "a.wav")) as p, open(p, "wb") as f:
        f.write(data)
    (tmp_path / "bad.wav").write_bytes(b"nothing")
    meta = {r["path"][-5:]: r for r in wav.read_metadata(spark, str(tmp_path)).collect()}
    assert meta["a.wav"]["frames"] == 700 and meta["d.wav"]["error"]
    (tmp_path / "bad.wav").unlink()
    sig = wav.read_signal(spark, str(tmp_path), ["FL", "FR"])
    assert sig.count() == 1400
    again = bytes(wav.encode_assets(sig, ["FL", "FR"], 44100, 32).first()["wav"])
    assert np.abs(wav.decode_pcm(again[wav.parse_header(again)["start"]:], 32, 2) - x).max() < 1e-8
    with pytest.raises(Exception, match="missing"):
        wav.encode_assets(sig, ["FL", "C"], 44100).collect()


def test_atomic_path_leaves_nothing_behind(tmp_path):
    with pytest.raises(RuntimeError), wav.atomic_path(str(tmp_path / "x.wav")):
        raise RuntimeError
    assert list(tmp_path.iterdir()) == []


def test_delay_edges_and_spans(spark):
    sig = frame(spark, range(1, 6)).drop("asset")
    shifted = lambda d: [r["y"] for r in windows.delay(sig, d).orderBy("n").collect()]
    assert shifted(0) == shifted(-1) == [1, 2, 3, 4, 5] and shifted(9) == [0] * 5
    spans = spark.createDataFrame([("a", 0, 3), ("a", 3, 5), ("a", 7, 9), ("a", 1, 2)], "channel string, s bigint, e bigint")
    assert sorted(map(tuple, windows.merge_spans(spans).collect())) == [("a", 0, 5), ("a", 7, 9)]
    assert sorted(map(tuple, windows.merge_spans(spans, 2).collect())) == [("a", 0, 9)]


def test_unknown_template_field_is_an_error(spark):
    df = spark.range(1).select(planning.expand_template(F.lit("{a}{b}"), a=F.lit("x")).alias("o"))
    with pytest.raises(Exception, match="unknown field b"):
        df.collect()


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.standard_normal(200)
    rows = [("FL" if k % 2 else "FR", k // 2, float(v)) for k, v in enumerate(x)]
    order = rng.permutation(len(rows))
    for k, part in enumerate(np.array_split(order, 5)):
        spark.createDataFrame([rows[i] for i in part], "channel string, n bigint, x double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("channel string, n bigint, x double").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = signals.to_table(signals.running_mean(stream, 0.85), "running", "append", str(tmp_path / "cp")).toPandas().sort_values(["channel", "n"])
    want = folds.ema(spark.createDataFrame(rows, "channel string, n bigint, x double"), 0.85).toPandas().sort_values(["channel", "n"])
    assert np.allclose(got["y"].to_numpy(), want["y"].to_numpy()) and len(got) == 200


def test_windows_of_a_stream(spark, tmp_path):
    events = signals.event_stream(spark, "/root/testdata/sf0.001")
    got = signals.to_table(signals.tumbling(events, "1 hour", "0 seconds"), "tumbled", "complete", str(tmp_path / "a"))
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert got.agg(F.sum("c")).first()[0] == batch.count()
    runs = signals.to_table(signals.sessions(signals.event_stream(spark, "/root/testdata/sf0.001"), "30 minutes", "0 seconds"), "sessions", "complete", str(tmp_path / "b"))
    assert runs.agg(F.sum("c")).first()[0] == batch.count()


def test_bed_files(spark):
    import struct
    import xml.etree.ElementTree as ET

    from wavequarry.catalog import OUTPUT_LAYOUTS
    from wavequarry.sources import adm

    labels = OUTPUT_LAYOUTS["5.1.2"].split()
    rows = [("a", c, n, (k + 1) / 10) for k, c in enumerate(labels) for n in range(32)]
    df = spark.createDataFrame(rows, "asset string, channel string, n bigint, x double")
    data = bytes(adm.package_beds(df, "5.1.2", 48000).first()["wav"])
    assert [t for t, _ in wav.chunks_of(data)] == ["fmt ", "bext", "axml", "chna", "dbmd", "data"]
    h = wav.parse_header(data)
    assert np.allclose(wav.decode_pcm(data[h["start"]:], 24, 8)[5], (np.arange(8) + 1) / 10, atol=1e-6)
    body = adm.bext_body(-23.456, None)
    assert len(body) == 604 and struct.unpack_from("<hHh", body, 412) == (-2346, 32767, 32767) and struct.unpack_from("<H", body, 346) == (2,)
    root = ET.fromstring(adm.axml_body([("5.1.2", labels)], 1.5, 48000, 24))
    assert len(root.findall("audioTrackUID")) == 8 and root.find("audioProgramme").get("end") == "00:00:01.50000"
    chna = adm.chna_body([labels])
    assert struct.unpack_from("<HH", chna) == (8, 8) and len(chna) == 4 + 8 * 40 and b"AT_00011001_01" in chna
    with pytest.raises(wav.WavError):
        adm.fixed_width("too long", 3)
    stems = spark.createDataFrame([("a", s, n, 0.5, -0.5) for s in ("Bass", "Vocals") for n in range(8)], "asset string, stem string, n bigint, l double, r double")
    out = bytes(adm.package_stems(stems, {"Vocals": {"FL": 1.0, "C": 0.7}, "Bass": {"FR": 2.0}}, 48000).first()["wav"])
    assert np.allclose(wav.decode_pcm(out[wav.parse_header(out)["start"]:], 24, 3)[0], [-1.0, 0.5, 0.0], atol=1e-6)


def test_bass_and_matching(spark):
    rate, t = 48000, np.arange(9600) / 48000
    low, high = np.sin(2 * np.pi * 40 * t), np.sin(2 * np.pi * 5000 * t)
    level = lambda df, c="FL": float(np.sqrt(np.mean(np.array([r["x"] for r in df.where(F.col("channel") == c).orderBy("n").collect()])[4800:] ** 2)))
    slow = np.sin(2 * np.pi * 10 * t)
    boosted = mastering.bass(frame(spark, slow), "boost", rate)
    assert abs(20 * np.log10(level(boosted) / np.sqrt(0.5)) - 2) < 0.6
    assert abs(20 * np.log10(level(mastering.bass(frame(spark, high), "boost", rate)) / np.sqrt(0.5))) < 0.05
    pair = frame(spark, low).union(frame(spark, -low, "FR"))
    assert level(mastering.bass(pair, "mono", rate)) < 0.1
    assert level(mastering.derive_lfe(pair, rate), "LFE") < 1e-9
    assert level(mastering.elevate(frame(spark, high), rate)) > 0.9
    noise = np.random.default_rng(5).standard_normal(48000)
    shaped = dsp.fir_filter(dsp.fir_from_breakpoints([(200, 0), (2000, 4), (20000, 0)], rate), noise)
    curve = dict(mastering.match_curve(noise, dsp.welch(shaped, rate, 8192)[1], rate))
    near = lambda hz: curve[min(curve, key=lambda f: abs(f - hz))]
    assert near(2000) - near(200) > 2 and all(abs(g) <= 2 for f, g in curve.items() if f < 120)


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def all_frames(spark):
    return {r["vec_id"]: np.array(r["embedding"], np.float32).astype(float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}


def test_sliding_median_of_all_frames(spark):
    got = {(r["vec_id"], r["bin"]): (r["med"], r["mask"]) for r in entry.queries()["sliding_median_full"](spark, SF).collect()}
    frames = all_frames(spark)
    assert len(frames) > 100 and set(got) == {(v, k) for v in frames for k in range(64)}
    for v, x in frames.items():
        med = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, 8, mode="reflect"), 17), axis=1)
        mask = np.clip((x - med) / (med + 1e-12), 0, 1)
        assert np.allclose([got[v, k] for k in range(64)], np.stack([med, mask], axis=1), atol=2e-6)


def test_whole_spectrum_of_all_frames(spark):
    got = {(r["vec_id"], r["bin"]): r["m"] for r in entry.queries()["dft_magnitude_full"](spark, SF).collect()}
    frames = all_frames(spark)
    assert set(got) == {(v, k) for v in frames for k in range(33)}
    for v, x in frames.items():
        assert np.allclose([got[v, k] for k in range(33)], np.abs(np.fft.rfft(x)), atol=2e-5)
