"""Preflight, resuming, models, staged separation and the stem cache."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavequarry.plans import batch, models, stems

JOB = "input string, output string, format string, kind string, subtype string, asked_rate int, override string"


def test_preflight_gives_the_first_broken_rule(spark):
    meta = spark.createDataFrame([("stereo", 44100, 2, None), ("six", 48000, 6, None), ("seven", 48000, 7, None), ("bad", None, None, "not audio"), ("eight", 96000, 8, None)], "path string, rate int, channels int, error string")
    cases = [
        (("stereo", "o.wav", "5.1", "wav", "PCM_16", None, None), None, "stereo", 44100), (("gone", "gone", "5.1", "wav", "PCM_16", None, None), "missing", None, None),
        (("stereo", "stereo", "5.1", "wav", "PCM_16", None, None), "same path", "stereo", 44100), (("bad", "o", "5.1", "wav", "PCM_16", None, None), "unreadable", None, None),
        (("six", "o", "7.1", "wav", "PCM_16", None, "quad"), "unknown layout", "quad", 48000), (("six", "o", "7.1", "wav", "PCM_16", None, "stereo"), "channels differ", "stereo", 48000),
        (("seven", "o", "7.1.4", "wav", "PCM_16", None, None), "no layout", None, 48000), (("six", "o", "9.1", "wav", "PCM_16", None, None), "unknown output layout", "5.1", 48000),
        (("six", "o", "5.1", "wav", "PCM_16", None, None), "cannot upmix", "5.1", 48000), (("eight", "o", "5.1.4", "wav", "PCM_16", None, None), "cannot upmix", "7.1", 96000),
        (("eight", "o", "5.1.4", "wav", "PCM_16", None, "5.1.2"), None, "5.1.2", 96000), (("stereo", "o.wav", "5.1", "bed", "PCM_24", 44100, None), "bed rate", "stereo", 44100),
        (("stereo", "o.flac", "5.1", "bed", "PCM_16", None, None), "bed bits", "stereo", 48000), (("stereo", "o.flac", "5.1", "bed", "PCM_24", None, None), "bed suffix", "stereo", 48000),
        (("six", "o.WAV", "7.1.4", "bed", "PCM_24", 96000, None), None, "5.1", 96000)]
    jobs = spark.createDataFrame([c[0] for c in cases], JOB)
    got = {tuple(r[k] for k in ("input", "output", "format", "kind", "subtype", "asked_rate", "override")): (r["reason"], r["layout"], r["rate_out"]) for r in batch.preflight(jobs, meta).collect()}
    assert got == {c[0]: c[1:] for c in cases}


def test_resuming_looks_at_the_written_file(spark):
    jobs = spark.createDataFrame([(f"o{k}", 10, 5, "h") for k in range(5)], "output string, size int, modified int, config_hash string")
    state = spark.createDataFrame([("o0", 10, 5, "h", 48000, 6, 100), ("o1", 10, 5, "h", 48000, 6, 100), ("o2", 11, 5, "h", 48000, 6, 100), ("o3", 10, 5, "h", 48000, 6, 100)],
                                  "output string, size int, modified int, config_hash string, rate int, channels int, frames int")
    outputs = spark.createDataFrame([("o0", 48000, 6, 100), ("o1", 48000, 6, 99), ("o2", 48000, 6, 100)], "output string, rate int, channels int, frames int")
    done, todo = batch.resume(jobs, state, outputs, overwrite=True)
    assert [r["output"] for r in done.collect()] == ["o0"] and sorted(r["output"] for r in todo.collect()) == ["o1", "o2", "o3", "o4"]
    with pytest.raises(FileExistsError):
        batch.resume(jobs, state, outputs)


def test_listing_and_outputs_stay_inside(spark, tmp_path):
    for name in ("b.wav", "a/c.FLAC", "a/b.txt", "a.wav"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r["relative"] for r in batch.listing(spark, str(tmp_path), recursive=True).collect()] == ["a.wav", "a/c.FLAC", "b.wav"]
    assert [r["relative"] for r in batch.listing(spark, str(tmp_path)).collect()] == ["a.wav", "b.wav"]
    assert [r["relative"] for r in batch.listing(spark, str(tmp_path), True, "*.txt").collect()] == ["a/b.txt"]
    out = lambda x: spark.range(1).select(batch.output_inside(F.lit(x), "/out/").alias("o")).first()["o"]
    assert out("a/../b.wav") == "/out/a/../b.wav" and out("./x//y") == "/out/./x//y"
    for bad in ("../x", "a/../../b", "/etc/x"):
        with pytest.raises(Exception, match="leaves its folder"):
            out(bad)


class Fake:
    log: list = []

    def __init__(self, name, rate, batch, most=99):
        self.key, self.most = (name, rate, batch), most
        Fake.log.append(("open", *self.key))

    def separate(self, source):
        if self.key[2] > self.most:
            raise RuntimeError("CUDA error: out of memory")
        return self.key

    def close(self):
        Fake.log.append(("close", *self.key))


def test_models_are_opened_once_and_reopened_on_change():
    Fake.log = []
    with models.ModelPool(Fake) as pool:
        for _ in range(3):
            assert pool.separate("m", 44100, None) == ("m", 44100, 1)
        pool.separate("n", 44100, None)
        pool.separate("m", 48000, None)
    assert Fake.log == [("open", "m", 44100, 1), ("open", "n", 44100, 1), ("close", "m", 44100, 1), ("open", "m", 48000, 1), ("close", "n", 44100, 1), ("close", "m", 48000, 1)]


def test_batches_are_halved_until_they_fit_and_remembered():
    Fake.log = []
    pool = models.ModelPool(lambda n, r, b: Fake(n, r, b, most=1), "cuda", 16.0)
    assert pool.separate("m", 44100, None) == ("m", 44100, 1)
    assert [x[0] + str(x[3]) for x in Fake.log] == ["open4", "close4", "open2", "close2", "open1"]
    assert pool.separate("m", 44100, None)[2] == 1 and len(Fake.log) == 5
    with pytest.raises(RuntimeError, match="other"):
        models.ModelPool(lambda *_: (_ for _ in ()).throw(RuntimeError("other")), "cuda", 16.0).separate("m", 1, None)
    with pytest.raises(RuntimeError, match="memory"):
        models.ModelPool(lambda n, r, b: Fake(n, r, b, most=0), "cuda", 16.0).separate("m", 1, None)
    with pytest.raises(MemoryError):
        models.ModelPool(lambda *_: (_ for _ in ()).throw(MemoryError())).separate("m", 1, None)


def test_jobs_over_models_isolate_failures(spark):
    jobs = spark.createDataFrame([("m" if k % 2 else "n", k) for k in range(20)], "model string, k int")

    class Twice:
        def __init__(self, *_):
            self.n = 0

        def separate(self, k):
            if k == 7:
                raise ValueError("seven")
            self.n += 1
            return 2 * k

    got = models.run_models(jobs, Twice, lambda pool, j: {"k": j["k"], "out": pool.separate(j["model"], 44100, j["k"])}, "status string, k int, out int").collect()
    assert sorted((r["k"], r["out"]) for r in got if r["status"] == "ok") == [(k, 2 * k) for k in range(20) if k != 7]
    assert [r["status"] for r in got if r["status"] != "ok"] == ["ValueError: seven"]


def test_staged_separation_equals_the_one_pass_form_and_cleans_up(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = pd.concat([pd.DataFrame({"asset": a, "channel": c, "n": np.arange(300), "x": rng.standard_normal(300)}) for a in "ab" for c in ("FL", "FR")])
    signal = spark.createDataFrame(rows)
    tasks = stems.plan(["crowd", "vocals", "backing-vocals", "kick"])
    got, drop = stems.separate_staged(signal, tasks, 8000, str(tmp_path))
    key = ["asset", "channel", "stem", "n"]
    want = stems.separate(signal, tasks, 8000).toPandas().sort_values(key).reset_index(drop=True)
    mine = got.toPandas().sort_values(key).reset_index(drop=True)
    assert mine[key].equals(want[key]) and np.allclose(mine["x"], want["x"])
    left = {p.name for p in tmp_path.rglob("stem=*")}
    assert left == {f"stem={s}" for s in ("Crowd", "Vocals", "Backing Vocals", "Kick")}  # the last reader has deleted the rest
    drop()
    assert not list(tmp_path.rglob("*.parquet"))
    with pytest.raises(ValueError, match="no earlier stage"):
        stems.separate_staged(signal, [stems.Task("drums", "Drums", ("Kick",), ("Kick",))], 8000, str(tmp_path))


def test_cache_commits_stems_apart_and_validates(spark, tmp_path):
    cache = stems.StemCache(spark, str(tmp_path))
    rows = spark.createDataFrame([("Vocals", 0, 1.0), ("Hi-Hat", 0, 2.0)], "stem string, n bigint, x double")
    cache.save("k1", rows, modified=100.0)
    assert cache.load("none", "k1", modified=101.9).count() == 2 and cache.load("k1").count() == 2
    assert cache.load("k1", modified=102.5) is None
    cache.save("k2", rows, preview=True)
    assert cache.load("k2") is None
    cache.save("k1", rows.limit(1), modified=200.0)
    assert cache.load("k1", modified=200.0).count() == 1
    (tmp_path / "k3").mkdir()
    assert cache.load("k3", "k1") is None  # an entry without a mark is a miss, and stands before the older key
    for p in (tmp_path / "k1" / "stems").glob("*/_SUCCESS"):
        p.unlink()
    assert cache.load("k1") is None


def test_cache_hits_as_a_relation(spark):
    requests = spark.createDataFrame([(1, "a", "A", 10.0), (2, "b", "B", 10.0), (3, "c", "C", 10.0), (4, "d", "D", 10.0), (5, "e", "E", 10.0), (6, "f", "F", 10.0)], "id int, key string, legacy string, modified double")
    entries = spark.createDataFrame([("a", 11.5, ["x", "y"]), ("B", 8.0, ["x"]), ("c", 20.0, ["x"]), ("C", 10.0, ["x"]), ("d", 10.0, ["x", "y"]), ("f", 10.0, [])], "key string, modified double, stems array<string>")
    files = spark.createDataFrame([("a", "x"), ("a", "y"), ("B", "x"), ("c", "x"), ("C", "x"), ("d", "x")], "key string, stem string")
    got = {r["id"]: (r["hit"], r["via"]) for r in stems.cache_hits(requests, entries, files).collect()}
    assert got == {1: ("a", "new"), 2: ("B", "legacy"), 3: (None, "miss"), 4: (None, "miss"), 5: (None, "miss"), 6: (None, "miss")}


def test_stem_names(spark):
    tags = {"Vocals": "Vocals", "other": "Other", "Piano": "Piano", "lead vocals": "Lead Vocals"}
    names = {"x/song_(Vocals)_m.wav": "Vocals", "song_(other)_crowd_(Piano)_p.wav": "Piano", "(piano)_(OTHER).wav": "Other", "song (unknown).wav": None, "a_(vocals)_(x)_(vocals)_(noise).wav": "Vocals",
             "(Vocals)/none.wav": None, "s_(Lead Vocals)_m.wav": "Lead Vocals"}
    df = spark.createDataFrame([(n,) for n in names], "f string")
    assert {r["f"]: r["s"] for r in df.select("f", stems.stem_name(F.col("f"), tags).alias("s")).collect()} == names
    own = {r["f"]: r["s"] for r in df.select("f", stems.stem_name(F.col("f"), tags, {"vocals": "Crowd"}).alias("s")).collect()}
    assert own["x/song_(Vocals)_m.wav"] == "Crowd" and own["s_(Lead Vocals)_m.wav"] == "Lead Vocals"
