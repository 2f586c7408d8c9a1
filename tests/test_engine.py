"""Whole runs over folders, the command line, and the public names."""

import json

import numpy as np
import pytest
from test_flac import encode

import wavequarry
from wavequarry.__main__ import main, overlay, parser
from wavequarry.engine import Settings, excerpt, frame_size, reference_at, settings_from
from wavequarry.operators import mastering
from wavequarry.sources import wav

RATE = 8000


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rng = tmp_path_factory.mktemp("in"), np.random.default_rng(0)
    m = rng.standard_normal(6000) * 0.2
    (at / "two.wav").write_bytes(wav.wav_bytes(np.stack([m, 0.5 * m + 0.1 * rng.standard_normal(6000)], axis=1), RATE))
    (at / "one.wav").write_bytes(wav.wav_bytes(m[:4000], RATE))
    (at / "six.wav").write_bytes(wav.wav_bytes(rng.standard_normal((5000, 6)) * 0.1, RATE))
    (at / "bad.wav").write_bytes(b"nothing")
    (at / "packed.flac").write_bytes(encode(rng.integers(-3000, 3000, (5000, 2)), 16, 1000, [("fixed", 1, 0, 11, False)], rate=RATE))
    (at / "sub").mkdir()
    (at / "sub/deep.wav").write_bytes(wav.wav_bytes(rng.standard_normal((3000, 2)) * 0.1, RATE))
    return str(at)


def read(path):
    data = open(path, "rb").read()
    h = wav.parse_header(data)
    return wav.decode_pcm(data[h["start"]:h["start"] + h["frames"] * h["align"]], h["bits"], h["channels"]), h


def test_a_folder_is_upmixed_and_rejects_have_reasons(spark, folder, tmp_path, capsys):
    report = tmp_path / "report.json"
    code = main([folder, str(tmp_path / "out"), "--layout", "7.1", "--frame", "256", "--target", "-20", "--json", "--report", str(report), "--surround-gain", "0.7"], spark)
    rows = {r["asset"]: r for r in map(json.loads, capsys.readouterr().out.splitlines())}
    assert code == 1 and set(rows) == {"two", "one", "six", "bad", "packed"} and rows["bad"]["reason"] == "unreadable"
    assert json.loads(report.read_text())["succeeded"] == 4
    for name, frames in (("two", 6000), ("one", 4000), ("six", 5000), ("packed", 5000)):
        y, h = read(rows[name]["path"])
        assert (h["channels"], h["frames"], h["rate"], h["bits"]) == (8, frames, RATE, 24) and rows[name]["frames"] == frames
        long = spark.createDataFrame([("a", c, n, float(v)) for k, c in enumerate(wavequarry.OUTPUT_LAYOUTS["7.1"].split()) for n, v in enumerate(y[:, k])], "asset string, channel string, n bigint, x double")
        level = mastering.loudness(long, RATE).first()
        assert abs(level["lkfs"] + 20) < 0.2 or level["dbtp"] > -1.1
    assert main([folder, str(tmp_path / "out"), "--layout", "7.1"], spark) == 2  # the files are there
    assert "may not be overwritten" in capsys.readouterr().err


def test_beds_and_dry_runs(spark, folder, tmp_path, capsys):
    assert main([folder, str(tmp_path), "--recursive", "--dry-run", "--kind", "bed", "--layout", "5.1.4"], spark) == 1
    said = capsys.readouterr().out
    assert "sub/deep: " in said and "bad: unreadable" in said and not list(tmp_path.iterdir())
    out = wavequarry.run(spark, folder + "/sub", str(tmp_path), Settings("5.1.2", "bed", frame=256, preview=0.25)).collect()
    y, h = read(out[0]["path"])
    assert len(out) == 1 and (h["rate"], h["channels"], h["frames"]) == (48000, 8, 12000)


def test_a_preview_is_the_files_middle(spark):
    df = spark.createDataFrame([(6000,), (900,), (2001,)], "frames bigint")
    at = lambda **k: [tuple(r) for r in df.select(*excerpt(df["frames"], RATE, Settings(preview=0.25, **k))).collect()]
    assert at() == [(2000, 4000), (0, 2000), (0, 2000)] and at(preview_start=0.5) == [(4000, 6000), (0, 2000), (1, 2001)] and at(preview_start=-1.0)[0] == (0, 2000)
    assert [tuple(r) for r in df.select(*excerpt(df["frames"], RATE, Settings())).distinct().collect()] == [(None, None)]


def test_stems_matching_and_downmix(spark, folder, tmp_path, capsys):
    t = np.arange(8000)
    (tmp_path / "in").mkdir()
    for name in ("two", "six"):
        (tmp_path / f"in/{name}.wav").write_bytes(open(f"{folder}/{name}.wav", "rb").read())
    ref = tmp_path / "ref.wav"
    ref.write_bytes(wav.wav_bytes(np.stack([0.3 * np.sin(0.3 * t), 0.3 * np.sin(0.2 * t)], axis=1), 16000))

    def separator(x, rate, makes):
        return {k: x * (0.75 if k == makes[0] else 0.25 / (len(makes) - 1)) for k in makes}

    settings = Settings("5.1.2", stems="vocals, kick", loudness=False, limit=1.0, downmix=True, downmix_surround=0.5)
    rows = {r["asset"]: r for r in wavequarry.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), settings, separator).collect()}
    assert rows["six"]["reason"] == "stems of more than two channels" and rows["two"]["status"] == "ok"
    y, h = read(rows["two"]["path"])
    source, _ = read(f"{folder}/two.wav")
    assert (h["channels"], h["frames"]) == (8, 6000) and abs((y ** 2).sum() / (source ** 2).sum() - 1) < 1e-3  # no more and no less energy than the source
    mixed, h2 = read(rows["two"]["downmix"])
    labels = wavequarry.OUTPUT_LAYOUTS["5.1.2"].split()
    of = lambda c: y[:, labels.index(c)]
    want = np.stack([of(f"F{s}") + 0.5 ** 0.5 * of("C") + 0.5 * of(f"S{s}") for s in "LR"], axis=1)
    assert (h2["channels"], h2["bits"]) == (2, 24) and np.abs(mixed - want * (mixed[:, 0] @ want[:, 0]) / (want[:, 0] @ want[:, 0])).max() < 1e-5
    with pytest.raises(FileExistsError):
        wavequarry.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), settings)
    code = main([str(tmp_path / "in"), str(tmp_path / "out2"), "--layout", "7.1", "--frame", "256", "--no-loudness", "--match-reference", str(ref), "--no-match-spectrum", "--json"], spark)
    heard = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    plain = {r["asset"]: r for r in wavequarry.run(spark, str(tmp_path / "in"), str(tmp_path / "out3"), Settings("7.1", frame=256, loudness=False)).collect()}
    assert code == 0
    for r in heard:
        a, b = read(r["path"])[0], read(plain[r["asset"]]["path"])[0]
        quiet = np.abs(a) < 0.9  # below the limiter's knee
        gain = (a * b)[quiet].sum() / (b * b)[quiet].sum()
        assert quiet.mean() > 0.9 and 1.05 < gain <= 10 ** (6 / 20) + 1e-3 and np.abs(a - gain * b)[quiet].max() < 1e-4  # brought up to the reference, within 6 dB
    for wrong in ("none.wav", "in/../bad.wav"):
        (tmp_path / "bad.wav").write_bytes(b"no")
        with pytest.raises(ValueError, match="the reference"):
            reference_at(spark, str(tmp_path / wrong), RATE)
    with pytest.raises(ValueError, match="unknown stem"):
        Settings(stems="tuba")


def test_settings_and_overlays(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"config": {"layout": "7.1", "target": -14, "bits": 16}}))
    args = parser().parse_args(["in", "out", "--manifest", str(tmp_path / "m.json"), "--set", "intensity=3,lfe_order=2", "--target", "-23", "--no-plan"])
    s = settings_from(overlay(args))
    assert (s.layout, s.target, s.bits, s.intensity, s.plan, s.routing.lfe_order) == ("7.1", -23.0, 16, 1.0, False, 2)
    with pytest.warns(UserWarning, match="colour"):
        assert settings_from({"colour": 1}) == Settings()
    for wrong in ({"layout": "9.1"}, {"bits": "many"}, {"bits": 8}, {"kind": "tape"}, {"input_layout": "quad"}):
        with pytest.raises(ValueError):
            settings_from(wrong)
    with pytest.raises(SystemExit):
        parser().parse_args(["a", "b", "--rate", "0"])
    assert main(["--manifest-keys"]) == 0
    assert [frame_size(r) for r in (8000, 44100, 48000, 96000, 400000)] == [1024, 4096, 8192, 16384, 16384]


def test_public_names():
    assert all(getattr(wavequarry, n) is not None for n in wavequarry.__all__)
    with pytest.raises(AttributeError):
        wavequarry.nothing  # noqa: B018


def test_loudness_is_measured_again_after_the_gain(spark):
    from wavequarry.operators import chunks

    t = np.arange(8000) / RATE
    rows = [("a", c, n, float(v)) for c in ("FL", "FR") for n, v in enumerate(0.05 * np.sin(2 * np.pi * 997 * t))]
    rows += [("b", "FL", n, float(v)) for n, v in enumerate(0.9 * np.sign(np.sin(2 * np.pi * 200 * t)))] + [("c", "FL", n, 0.0) for n in range(8000)]
    packed = chunks.pack(spark.createDataFrame(rows, "asset string, channel string, n bigint, x double"), 3000)
    done, info = mastering.normalise_chunks(packed, RATE, -14.0, size=3000)
    got = {r["asset"]: r for r in info().collect()}
    assert abs(got["a"]["lkfs"] + 14) < 1e-6 and not got["a"]["tp_limited"] and abs(got["a"]["lkfs"] - got["a"]["pre_lkfs"] - got["a"]["gain_db"]) < 1e-6
    hot = mastering.normalise_chunks(packed, RATE, -2.0, size=3000)[1]()
    assert all(r["dbtp"] < -1 + 1e-6 for r in hot.collect()) and {r["asset"] for r in hot.where("tp_limited").collect()} == {"b"}
    assert got["c"]["gain_db"] == 0 and got["c"]["lkfs"] == -70
