import numpy as np
import pytest
from pyspark.sql import functions as F

from wavequarry.functions import dsp
from wavequarry.operators import chunks, folds

SIZES = (16, 100)


def frame(spark, signals):
    rows = [(a, c, n, float(v)) for (a, c), x in signals.items() for n, v in enumerate(x)]
    return spark.createDataFrame(rows, "asset string, channel string, n bigint, x double").repartition(5)


def arrays(signal, name="x"):
    out = {}
    for r in signal.orderBy("n").collect():
        out.setdefault((r["asset"], r["channel"]), []).append(r[name])
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def signals():
    rng = np.random.default_rng(0)
    return {("a", "FL"): rng.standard_normal(777), ("a", "FR"): rng.standard_normal(64), ("b", "FL"): rng.standard_normal(1), ("b", "C"): rng.standard_normal(300)}


def test_chunks_go_there_and_back(spark, signals):
    for size in SIZES:
        packed = chunks.pack(frame(spark, signals), size)
        assert packed.count() == sum(-(-len(x) // size) for x in signals.values())
        back = arrays(chunks.unpack(packed, size))
        assert all(np.array_equal(back[k], x) for k, x in signals.items())


def test_a_missing_sample_is_silence(spark):
    packed = chunks.pack(spark.createDataFrame([("c", 0, 1.0), ("c", 2, 3.0), ("c", 4, 4.0)], "channel string, n bigint, x double"), 4)
    assert [(r["n"], r["x"]) for r in chunks.unpack(packed, 4).orderBy("n").collect()] == [(0, 1), (1, 0), (2, 3), (4, 4)]
    got = [(r["n"], round(r["x"], 9)) for r in chunks.unpack(chunks.fir(packed, [0, 0, 1], 4), 4).orderBy("n").collect()]
    assert got == [(0, 0), (1, 0), (2, 1), (4, 3)]


def test_fir_and_true_peak_equal_the_whole_channel(spark, signals):
    taps, phases = np.random.default_rng(1).standard_normal(45), dsp.true_peak_phases()
    for size in SIZES:  # shorter than the filter, too
        packed = chunks.pack(frame(spark, signals), size)
        got = arrays(chunks.unpack(chunks.fir(packed, taps, size), size))
        peaks = {(r["asset"], r["channel"]): r["peak"] for r in chunks.true_peaks(packed, size).collect()}
        for k, x in signals.items():
            assert np.abs(got[k] - np.convolve(taps, x)[:len(x)]).max() < 1e-12
            stuffed = np.zeros(4 * len(x))
            stuffed[::4] = x
            assert abs(peaks[k] - np.abs(np.convolve(stuffed, phases.T.ravel())).max()) < 1e-12


def test_true_peak_counts_what_the_filter_still_holds(spark):
    """The greatest value of a signal that ends on a step comes after its last sample."""
    x = np.concatenate([np.zeros(30), np.ones(8)])
    peak = chunks.true_peaks(chunks.pack(frame(spark, {("a", "FL"): x}), 19), 19).first()["peak"]
    assert peak > 1.05


def test_recursions_equal_the_fold_at_every_size(spark, signals):
    sections = dsp.butterworth(4, 3000, 48000)
    plain = {"biquad": lambda x: dsp.sos_filter(sections[:1], x)[0], "cascade": lambda x: dsp.sos_filter(sections, x)[0], "ema": _ema, "allpass": _allpass, "envelope": _envelope}
    systems = {"biquad": chunks.series(sections[:1]), "cascade": chunks.series(sections), "ema": folds.ema_system(0.85), "allpass": folds.allpass_system(0.7), "envelope": folds.envelope_system(0.4, 0.05)}
    for size in SIZES:
        packed = chunks.pack(frame(spark, signals), size).persist()
        for name, system in systems.items():
            for fan in (2,) if size == 16 else (1024,):
                got = arrays(chunks.unpack(chunks.linear(packed, system, size, fan), size))
                assert set(got) == set(signals)
                for k, x in signals.items():
                    assert np.abs(got[k] - plain[name](x)).max() < 1e-11, (name, size, fan, k)


def _ema(x):
    y = [x[0]]
    for v in x[1:]:
        y.append(0.85 * y[-1] + 0.15 * v)
    return np.array(y)


def _allpass(x):
    y, xp, yp = [], 0.0, 0.0
    for v in x:
        yp = -0.7 * v + xp + 0.7 * yp
        xp = v
        y.append(yp)
    return np.array(y)


def _envelope(x):
    a = b = 0.0
    y = []
    for v in x:
        a, b = a + 0.4 * (v - a), b + 0.05 * (v - b)
        y.append(max(a, b))
    return np.array(y)


def test_a_missing_chunk_is_silence_in_the_scan(spark):
    x = np.random.default_rng(2).standard_normal(500)
    x[100:300] = 0
    rows = [("a", "FL", n, float(v)) for n, v in enumerate(x) if not 100 <= n < 300]
    packed = chunks.pack(spark.createDataFrame(rows, "asset string, channel string, n bigint, x double"), 50)
    got = chunks.unpack(chunks.linear(packed, folds.ema_system(0.99), 50, 3), 50).orderBy("n").toPandas()
    want = [x[0]]
    for v in x[1:]:
        want.append(0.99 * want[-1] + 0.01 * v)
    assert np.abs(got["x"].to_numpy() - np.array(want)[got["n"].to_numpy()]).max() < 1e-12


def test_zero_phase_equals_the_whole_channel(spark, signals):
    sections = dsp.butterworth(2, 100, 4800)
    own = {**signals, ("c", "short"): np.arange(9.0), ("c", "just"): np.arange(10.0) ** 2, ("c", "split"): np.random.default_rng(4).standard_normal(65)}
    for size in (16, 1000):
        got = arrays(chunks.unpack(chunks.zero_phase(chunks.pack(frame(spark, own), size), sections, size), size))
        for k, x in own.items():
            assert np.abs(got[k] - dsp.zero_phase(sections, x)).max() < 1e-9, (size, k)


def test_no_plan_gathers_a_channel(spark, signals):
    """Every exchange of the passes over samples is keyed by the chunk as well."""
    packed = chunks.pack(frame(spark, signals), 64)
    for rows in (chunks.fir(packed, np.ones(5), 64), chunks.with_halo(packed, 5, 64)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning(" in line]
        assert exchanges and all("chunk" in line for line in exchanges)


def test_folds_keep_assets_apart(spark, signals):
    both = frame(spark, {("a", "FL"): signals["a", "FL"][:90], ("b", "FL"): signals["b", "C"][:90]})
    for fn in (lambda s: folds.ema(s, 0.85), folds.allpass, lambda s: folds.envelope(s, 0.4, 0.05), lambda s: folds.biquad(s, (0.2, 0.4, 0.2), (-0.3, 0.1))):
        together = arrays(fn(both), "y")
        for k in (("a", "FL"), ("b", "FL")):
            alone = arrays(fn(both.where(F.col("asset") == k[0])), "y")[k]
            assert np.array_equal(together[k], alone)
    frames = both.select("asset", "channel", "n", (F.col("x") * F.col("x")).alias("src"), F.lit(1.0).alias("out"))
    together = arrays(folds.energy_gain(frames, 0.6, 0.95), "gain")
    assert np.array_equal(together["b", "FL"], arrays(folds.energy_gain(frames.where("asset = 'b'"), 0.6, 0.95), "gain")["b", "FL"])
