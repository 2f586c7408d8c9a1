import json

import numpy as np
import pytest

from wavequarry.plans import manifest as m
from wavequarry.plans import stems


def registry():
    r = m.Registry()
    r.register("audio", rate=m.Field("config", "rate", int), gain=m.Field("config", "gain", float))
    r.register("engine", workers=m.Field("engine", "workers", int))
    return r


def test_merge_and_jobs(spark, tmp_path):
    doc = {"version": "1.0", "audio": {"rate": "48000", "gain": 1}, "engine": {"workers": 2}, "other": {"x": 1},
           "assets": [{"input": "a.wav", "output": "b.wav", "audio": {"gain": 2}}, {"input_dir": "d", "audio": {"rate": None}}]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(doc))
    got = m.jobs(m.load_manifest(str(path)), registry(), {"d": ["z/b.wav", "y/a.wav"]}, {"gain": 3.0, "rate": None})
    assert [j["input"] for j in got] == ["a.wav", "y/a.wav", "z/b.wav"]
    assert got[0]["config"] == {"rate": 48000, "gain": 3.0} and got[1]["config"] == {"gain": 3.0} and got[0]["engine"] == {"workers": 2}
    got[1]["config"]["gain"] = 0
    assert got[2]["config"]["gain"] == 3.0
    assert m.job_table(spark, got).count() == 3
    assert m.merged({"a": {"x": 1, "y": 2}, "b": 3}, {"a": {"x": 9}, "b": {"z": 1}}) == {"a": {"x": 9, "y": 2}, "b": {"z": 1}}


def test_bad_manifests(tmp_path):
    assert m.validate({"version": "1", "assets": [{}]}) == ["version", "assets[0].input"]
    assert m.validate({"version": "1.0.0", "assets": [{"input": "a", "stems": ["X"]}]}, frozenset({"Y"})) == ["assets[0].stems: X"]
    (tmp_path / "e.json").write_text(" ")
    assert m.load_manifest(str(tmp_path / "e.json")) == {}
    for bad in ("x.txt", "none.json"):
        with pytest.raises(m.ManifestError):
            m.load_manifest(str(tmp_path / bad))
    with pytest.raises(m.ManifestError):
        m.coerced(int, "x", "a.b")
    assert m.key_values("a=1, b=2,") == {"a": "1", "b": "2"}
    with pytest.raises(m.ManifestError):
        m.key_values("a")
    assert registry().keys() == ["audio.gain", "audio.rate", "engine.workers"]


def test_plans():
    names = lambda s: [(t.name, t.source, t.keeps) for t in stems.plan(s)]
    assert names(["vocals", "Bass", "vocals"]) == [("primary", "input", ("Vocals", "Bass"))]
    assert names(["Crowd", "Kick"]) == [("crowd", "input", ("Crowd",)), ("primary", "Without Crowd", ()), ("drums", "Drums", ("Kick",))]
    assert names(["Drums", "kick"]) == names(["kick"])
    assert names([]) == [("primary", "input", stems.PRIMARY)]
    assert names(["vocals", "backing-vocals"]) == [("primary", "input", ("Vocals",)), ("voices", "Vocals", ("Vocals", "Backing Vocals"))]
    assert names(["Backing Vocals"]) == [("primary", "input", ()), ("voices", "Vocals", ("Backing Vocals",))]
    for bad in ("violin", "vocals "):
        with pytest.raises(ValueError, match="unknown stem"):
            stems.plan([bad])
    assert stems.stems_hash(["Bass", "Vocals"]) == stems.stems_hash(["vocals", "bass"]) and stems.stems_hash([]) == stems.stems_hash(list(stems.PRIMARY))
    assert stems.stems_hash(["Drums", "kick"]) == stems.stems_hash(["kick"])
    assert stems.inference_hash(["Vocals"]) == stems.inference_hash(["Bass"]) != stems.inference_hash(["Vocals", "crowd"])


def test_separate_and_cache(spark, tmp_path):
    x = np.random.default_rng(0).standard_normal(400)
    sig = spark.createDataFrame([("a", "FL", k, float(v)) for k, v in enumerate(x)], "asset string, channel string, n bigint, x double")
    out = stems.separate(sig, stems.plan([]), 48000)
    total = out.groupBy("n").sum("x").orderBy("n").toPandas()["sum(x)"]
    assert np.allclose(total, x)
    cache = stems.StemCache(spark, str(tmp_path))
    assert cache.load("new", "old") is None
    cache.save("p", out, preview=True)
    assert cache.load("p") is None
    cache.save("old", out)
    assert cache.load("new", "old").count() == 2400
    with pytest.raises(Exception, match="needs Drums"):
        stems.separate(sig, [stems.Task("drums", "Drums", ("Kick",), ("Kick",))], 48000).collect()
