"""Batches, reports, sidecars, and separation on active spans."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavequarry.plans import batch, stems
from wavequarry.sources.wav import parse_header


def test_identities_and_resuming(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(b"12345")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.wav").write_bytes(b"1")
    (tmp_path / "c.txt").write_bytes(b"1")
    rows = batch.input_identity(spark, str(tmp_path), "*.wav", True).collect()
    assert sorted(r["size"] for r in rows) == [1, 5] and batch.input_identity(spark, str(tmp_path), "*.wav").count() == 1
    schema = "output string, size bigint, modified bigint, config_hash string"
    jobs = spark.createDataFrame([("x", 1, 2, "h"), ("y", 1, 2, "h"), ("z", 1, 2, "h"), ("w", 9, 9, "h")], schema)
    state = spark.createDataFrame([("x", 1, 2, "h"), ("y", 1, 3, "h"), ("z", 1, 2, "h")], schema)
    there = spark.createDataFrame([("x",), ("y",)], "output string")
    with pytest.raises(FileExistsError, match="y"):
        batch.resume(jobs, state, there)
    done, todo = batch.resume(jobs, state, there, overwrite=True)
    assert [r["output"] for r in done.collect()] == ["x"] and {r["output"] for r in todo.collect()} == {"y", "z", "w"}
    rate = spark.createDataFrame([(None, True, 44100), (None, False, 44100), (96000, True, 44100)], "a int, p boolean, s int")
    assert [r[0] for r in rate.select(batch.output_rate(F.col("a"), F.col("p"), F.col("s"))).collect()] == [48000, 44100, 96000]


def test_failures_stay_with_their_job(spark, tmp_path):
    jobs = spark.createDataFrame([(f"o{k}", k) for k in range(10)], "output string, k int")

    def work(job):
        if job["k"] % 4 == 0:
            raise ValueError(f"job {job['k']}")
        return {"twice": 2 * job["k"]}

    done = batch.run_batch(jobs, work)
    got = {r["output"]: r for r in done.collect()}
    assert got["o4"]["status"] == "failed" and got["o4"]["error"] == "ValueError: job 4" and json.loads(got["o3"]["result"]) == {"twice": 6}
    assert batch.totals(done, skipped=2) == {"total": 12, "succeeded": 7, "failed": 3, "skipped": 2}
    docs = [json.loads(r["json"]) for r in batch.results_json(done).collect()]
    assert sorted(d["output"] for d in docs) == sorted(got) and all(set(d) == {"output", "status", "error", "result"} for d in docs)
    assert batch.totals(batch.run_batch(jobs.where("k > 99"), work)) == {"total": 0, "succeeded": 0, "failed": 0, "skipped": 0}
    path = str(tmp_path / "report.json")
    batch.write_report({"b": 1, "a": None}, path)
    with open(path) as f:
        assert json.load(f) == {"a": None, "b": 1}
    with pytest.raises(TypeError):
        batch.write_report({"a": object()}, path)
    with open(path) as f:
        assert json.load(f) == {"a": None, "b": 1}


def test_downmix_sidecar_is_held_to_the_peak(spark):
    n = 4000
    x = np.sin(np.arange(n) * 0.05)
    rows = pd.concat([pd.DataFrame({"asset": a, "channel": c, "n": np.arange(n), "x": x * s}) for a, s in (("loud", 0.9), ("soft", 0.05)) for c in ("FL", "FR", "C", "SL", "SR", "LFE")])
    out = {r["asset"]: bytes(r["wav"]) for r in batch.downmix_sidecar(spark.createDataFrame(rows), 8000).collect()}
    peak = {}
    for a, data in out.items():
        h = parse_header(data)
        assert (h["channels"], h["frames"], h["rate"]) == (2, n, 8000)
        raw = np.frombuffer(data[h["start"]:h["start"] + n * 6], np.uint8).reshape(-1, 3).astype(np.int32)
        v = (raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8
        peak[a] = np.abs(v).max() / 2**23
    assert -1.3 < 20 * np.log10(peak["loud"]) <= -0.99 and abs(peak["soft"] - 0.05 * (1 + 2 * 0.7071)) < 1e-3


def test_only_active_spans_are_separated(spark):
    n = 300
    rng = np.random.default_rng(1)
    x = rng.standard_normal(n)
    signal = spark.createDataFrame(pd.concat([pd.DataFrame({"asset": a, "channel": "FL", "n": np.arange(n), "x": x}) for a in ("a", "b")]))
    spans = spark.createDataFrame([("a", "FL", 20, 80), ("a", "FL", 150, 300), ("b", "FL", 0, 300)], "asset string, channel string, s bigint, e bigint")
    sizes = []

    def halves(y, rate, makes):
        sizes.append(len(y))
        return {m: y / len(makes) for m in makes}

    got = stems.separate_active(signal, spans, stems.plan(["vocals", "bass"]), 8000, halves, fade=10).toPandas()
    assert len(got) == 2 * 2 * n
    for stem in ("Vocals", "Bass"):
        own = got[(got["asset"] == "a") & (got["stem"] == stem)].sort_values("n")["x"].to_numpy()
        want = np.zeros(n)
        for s, e in ((20, 80), (150, 300)):
            k = np.arange(e - s)
            want[s:e] = x[s:e] / 6 * np.minimum(1, np.minimum(k, e - s - 1 - k) / 9)
        assert np.allclose(own, want)


def test_stem_features(spark):
    rate, n = 8000, 16000
    t = np.arange(n)
    low, noise = np.sin(2 * np.pi * 100 * t / rate), np.random.default_rng(2).standard_normal(n)
    data = {"mono": (low, low), "opposed": (low, -low), "left": (noise, 0 * noise), "silent": (0 * low, 0 * low)}
    rows = pd.concat([pd.DataFrame({"asset": "a", "stem": k, "n": t, "l": l, "r": r}) for k, (l, r) in data.items()])
    got = {r["stem"]: r for r in stems.stem_features(spark.createDataFrame(rows), rate).collect()}
    assert abs(got["mono"]["width"]) < 1e-9 and got["opposed"]["width"] == 1.0 and got["left"]["width"] == 1.0 and got["silent"]["width"] == 0.5
    assert got["mono"]["lf"] > 0.99 and got["left"]["lf"] < 0.2 and got["silent"]["transient"] == 0.0
