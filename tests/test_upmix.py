"""The upmix engine: against whole-signal code from the definition, and the stream against the batch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavequarry.catalog import OUTPUT_LAYOUTS
from wavequarry.operators import upmix as up
from wavequarry.operators.frames import FrameEngine
from wavequarry.streaming.signals import to_table

RATE, SIZE = 8000, 64
HOP = SIZE // 4


def signals():
    rng = np.random.default_rng(1)
    for asset, n in (("a", 500), ("b", 211)):
        m = rng.standard_normal(n)
        yield asset, m + 0.3 * rng.standard_normal(n), m - 0.5 * rng.standard_normal(n)


def plain(l, r, layout):
    """Whole frames at once: masks from the frame engine, the rest from the definition, one channel at a time."""
    engine = FrameEngine(RATE, SIZE)
    tracked = [v for _, v in engine.push(l, r) + engine.flush()]
    pad = -len(l) % HOP + SIZE - HOP
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIZE) / SIZE)
    over = w / sum(np.roll(w * w, k * HOP) for k in range(4))
    whole = [np.concatenate([np.zeros(SIZE - HOP), x, np.zeros(pad)]) for x in (l, r)]
    hz = np.arange(SIZE // 2 + 1) * RATE / SIZE
    logistic = lambda at, width: 1 / (1 + np.exp(-(hz - at) * 4 / width))
    height = (0.15 + 0.85 * logistic(150, 150)) * (1 + 0.5 * logistic(3000, 2000))
    fall, rise, gain = np.exp(-HOP / (RATE * 0.02)), np.exp(-HOP / (RATE * 0.5)), 1.0
    out = {c: np.zeros(HOP * (len(tracked) - 1) + SIZE) for c in OUTPUT_LAYOUTS[layout].split()}
    for k, (gamma, direct, transient, harmonic) in enumerate(tracked):
        a, b = (np.fft.rfft(x[k * HOP:k * HOP + SIZE] * w) for x in whole)
        weight = direct * (1 - abs((abs(a) - abs(b)) / (abs(a) + abs(b) + 1e-10)))
        spread = (1 - gamma) * (1 - harmonic) * (0.15 + 0.85 * (1 - transient)) * logistic(250, 250)
        side = (a - b) / 2 * spread
        spectra = {"FL": a * (1 - weight / 4), "FR": b * (1 - weight / 4), "C": 0.85 * 0.85 * weight * (a + b) / 2, "LFE": 10**-0.5 * (a + b) / 2 / np.sqrt(1 + (hz / 120) ** 8),
                   "SL": 0.6 * side, "SR": -0.6 * side, "BL": 0.55 * side, "BR": -0.55 * side, "TFL": 0.55 * side * logistic(4000, 4000) * height,
                   "TFR": -0.55 * side * logistic(4000, 4000) * height, "TBL": 0.55 * side * height, "TBR": -0.55 * side * height}
        spectra = {c: spectra[c] for c in out}
        source, sent = sum(abs(a) ** 2) + sum(abs(b) ** 2), sum(sum(abs(s) ** 2) for s in spectra.values())
        g = 1.0
        if source > 1e-20 and sent > 1e-20:
            t = np.clip(np.sqrt(source / sent), 10**-0.3, 10**0.3)
            c = fall if t < gain else rise
            g = gain = c * gain + (1 - c) * t
        for c, s in spectra.items():
            out[c][k * HOP:k * HOP + SIZE] += np.fft.irfft(g * s, SIZE) * over
    for c in ("BL", "BR"):
        if c in out:
            y, xp, yp = [], 0.0, 0.0
            for v in out[c]:
                yp = -0.7 * v + xp + 0.7 * yp
                xp = v
                y.append(yp)
            out[c] = np.array(y)
    return {c: x[SIZE - HOP:SIZE - HOP + len(l)] for c, x in out.items()}


@pytest.mark.parametrize("layout", ["5.1", "7.1.4", "5.1.2"])
def test_engine_equals_the_definition_for_any_cut(layout):
    rng = np.random.default_rng(3)
    for _, l, r in signals():
        want = plain(l, r, layout)
        for cuts in ([], [1], sorted(rng.choice(len(l), 9).tolist()), list(range(0, len(l), 7))):
            engine, got = up.UpmixEngine(RATE, SIZE, layout), {}
            edges = [0, *cuts, len(l)]
            parts = [engine.push(l[a:b], r[a:b]) for a, b in zip(edges, edges[1:], strict=False)] + [engine.flush()]
            at = 0
            for start, y in parts:
                assert start == at or not y.shape[1]
                at += y.shape[1]
            got = np.concatenate([y for _, y in parts], axis=1)
            assert got.shape == (len(want), len(l))
            for k, c in enumerate(engine.channels):
                assert np.abs(got[k] - want[c]).max() < 1e-10, c


def test_after_the_flush_input_is_an_error_and_reset_starts_again():
    (_, l, r), *_ = signals()
    engine = up.UpmixEngine(RATE, SIZE, "7.1")
    first = [engine.push(l, r)[1], engine.flush()[1]]
    with pytest.raises(ValueError, match="flush"):
        engine.push(l, r)
    assert not engine.flush()[1].shape[1]
    engine.reset()
    again = [engine.push(l, r)[1], engine.flush()[1]]
    assert all(np.array_equal(x, y) for x, y in zip(first, again, strict=True))
    with pytest.raises(ValueError, match="as many"):
        up.UpmixEngine(RATE, SIZE, "7.1").push(l, r[:-1])


def test_without_trim_the_head_is_the_delay():
    (_, l, r), *_ = signals()
    late, trimmed = (up.UpmixEngine(RATE, SIZE, "5.1", trim=t) for t in (False, True))
    whole = np.concatenate([late.push(l, r)[1], late.flush()[1]], axis=1)
    short = np.concatenate([trimmed.push(l, r)[1], trimmed.flush()[1]], axis=1)
    assert np.array_equal(whole[:, SIZE - HOP:SIZE - HOP + len(l)], short)


def test_controls_bear_on_their_class():
    (_, l, r), *_ = signals()
    flat = up.UpmixEngine(RATE, SIZE, "7.1.4", linked=False)
    lively = up.UpmixEngine(RATE, SIZE, "7.1.4", linked=False, controls=lambda k: {"front": 2.0, "surround": 3.0, "height": 0.5, "detail": 1.0})
    a, b = flat.push(l, r)[1], lively.push(l, r)[1]
    for c, g in (("FL", 2), ("C", 1), ("LFE", 1), ("SL", 3 * 1.4125), ("BR", 1.4125), ("TBL", 0.5 * 1.4125)):
        assert np.allclose(b[flat.channels.index(c)], g * a[flat.channels.index(c)])


def test_stream_equals_batch(spark, tmp_path):
    rows, pairs, rng = [], [], np.random.default_rng(5)
    for asset, l, r in signals():
        edges = [0, *sorted(rng.choice(len(l), 11).tolist()), len(l)]
        rows += [(asset, k, l[a:b].tolist(), r[a:b].tolist(), b == len(l) and k == len(edges) - 2) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
        pairs.append(pd.DataFrame({"asset": asset, "n": np.arange(len(l)), "l": l, "r": r}))
    schema = "asset string, seq bigint, l array<double>, r array<double>, last boolean"
    order = rng.permutation(len(rows))
    for k, part in enumerate(np.array_split(order, 4)):
        spark.createDataFrame([rows[i] for i in part] + [rows[part[0]]], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = up.samples(to_table(up.upmix_stream(stream, RATE, SIZE, "5.1.4"), "upmixed", "append", str(tmp_path / "cp"))).toPandas()
    want = up.upmix(spark.createDataFrame(pd.concat(pairs)).repartition(3), RATE, SIZE, "5.1.4", block=100).toPandas()
    key = ["asset", "channel", "n"]
    got, want = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert len(got) == len(want) == 10 * 711 and got[key].equals(want[key])
    assert np.abs(got["x"] - want["x"]).max() < 1e-12
    for asset, l, r in signals():
        for c, y in plain(l, r, "5.1.4").items():
            assert np.abs(want[(want["asset"] == asset) & (want["channel"] == c)]["x"].to_numpy() - y).max() < 1e-10


def test_stored_spectra_are_routed_as_the_engine_does(spark):
    rng = np.random.default_rng(7)
    bins = 33
    left, right = (rng.standard_normal((2, bins)) + 1j * rng.standard_normal((2, bins)) for _ in range(2))
    tracked = rng.uniform(0, 1, (2, 4, bins))
    rows = [("a", k, b, left[k, b].real, left[k, b].imag, right[k, b].real, right[k, b].imag, *map(float, tracked[k, :, b])) for k in range(2) for b in range(bins)]
    rows = [(a, k, b, *map(float, more)) for a, k, b, *more in rows]
    frame = spark.createDataFrame(rows, "asset string, frame bigint, bin int, lr double, li double, rr double, ri double, gamma double, direct double, transient double, harmonic double")
    controls = spark.createDataFrame([("a", k, 1.5, 0.5, 2.0, 0.25, 0.1 * k) for k in range(2)], "asset string, frame bigint, front double, surround double, back double, height double, detail double")
    r = up.Routing(content=0.4)
    for layout in OUTPUT_LAYOUTS:
        for whole in (False, True):
            got = {(x["channel"], x["frame"], x["bin"]): complex(x["re"], x["im"]) for x in up.route_spectra(frame, layout, RATE / SIZE, r, whole, None if whole else controls).collect()}
            assert len(got) == len(OUTPUT_LAYOUTS[layout].split()) * 2 * bins
            for k in range(2):
                gamma, direct, transient, harmonic = tracked[k]
                masks = up.fixed_masks(np.arange(bins) * RATE / SIZE, r, np.exp, np.sqrt)
                if whole:
                    masks |= up.moving_masks(left[k], right[k], gamma, gamma, 0.0, 0.0, r, np.abs)
                    own = up.routed(up.whole_sends(layout, r), left[k], right[k], masks, r)
                    height = 0.55 * masks["elevation"] * left[k]
                    assert "TFL" not in own or np.allclose(own["TFL"], height)
                else:
                    masks |= up.moving_masks(left[k], right[k], gamma, direct, transient, harmonic, r, np.abs)
                    own = up.routed(up.sends(layout, r), left[k], right[k], masks, r, {"front": 1.5, "surround": 0.5, "back": 2.0, "height": 0.25, "detail": 0.1 * k})
                for c, values in own.items():
                    assert np.allclose([got[c, k, b] for b in range(bins)], values), (layout, whole, c)


def test_a_block_after_the_last_one_is_an_error(spark, tmp_path):
    schema = "asset string, seq bigint, l array<double>, r array<double>, last boolean"
    x = [0.5] * 40
    spark.createDataFrame([("a", 0, x, x, True), ("a", 1, x, x, False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="after the last one"):
        to_table(up.upmix_stream(stream, RATE, SIZE, "5.1"), "late", "append", str(tmp_path / "cp")).select(F.count("*")).collect()
