"""The frame engine: against formulas, and the stream against the batch."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavequarry.operators.frames import BANDS, EPS, FrameEngine, bands_of, frame_mask_stream, frame_masks
from wavequarry.streaming.signals import running_mean, to_table

RATE, SIZE = 8000, 64


def signals():
    rng = np.random.default_rng(1)
    for asset, n in (("a", 700), ("b", 333)):
        m = rng.standard_normal(n)
        yield asset, m + 0.3 * rng.standard_normal(n), m - 0.5 * rng.standard_normal(n)


def plain(l, r):
    """Coherence, transient and harmonic masks by definition, one bin at a time."""
    hop, bins = SIZE // 4, SIZE // 2 + 1
    pad = -len(l) % hop + SIZE - hop
    l, r = (np.concatenate([np.zeros(SIZE - hop), x, np.zeros(pad)]) for x in (l, r))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(SIZE) / SIZE)
    edges, hz = np.geomspace(20, RATE / 2, BANDS + 1), np.arange(bins) * RATE / 2 / (bins - 1)
    out, state, before, energy, mask = [], None, None, np.zeros(BANDS), None
    for k in range((len(l) - SIZE) // hop + 1):
        a, b = (np.fft.rfft(x[k * hop:k * hop + SIZE] * w) for x in (l, r))
        rows = np.zeros((4, bins))
        fresh = [(x * y.conjugate(), abs(x) ** 2, abs(y) ** 2) for x, y in zip(a, b)]
        if state is None:
            state = fresh
        else:
            nxt = []
            for (p, q, s), (x, y, z) in zip(state, fresh):
                gamma = min(1, abs(p) ** 2 / (q * s + EPS))
                c = 0.25 if (x * p.conjugate()).real / (abs(x) * abs(p) + EPS) >= gamma**0.5 else 0.75
                nxt.append((c * p + (1 - c) * x, 0.6 * q + 0.4 * y, 0.6 * s + 0.4 * z))
            state = nxt
        rows[0] = [min(1, abs(p) ** 2 / (q * s + EPS)) for p, q, s in state]
        rows[1] = [max(0, min(1, p.real / ((q * s) ** 0.5 + EPS))) for p, q, s in state]
        m = abs(a) + abs(b)
        if before is not None:
            scores, centres = [], []
            for i in range(BANDS):
                own = [j for j in range(bins) if edges[i] <= hz[j] < edges[i + 1]]
                flux = sum(max(0.0, m[j] - before[j]) for j in own)
                energy[i] = 0.85 * energy[i] + 0.15 * flux
                scores.append(min(1.0, flux / (2.5 * energy[i] + EPS)))
                centres.append((own[0] + own[-1]) / 2 if own else (edges[i] + edges[i + 1]) / 2 / (RATE / 2) * (bins - 1))
            rows[2] = np.interp(np.arange(bins), centres, scores)
        before = m
        h = m / 2
        mirrored = [abs(j) if j < bins else 2 * (bins - 1) - j for j in range(-8, bins + 8)]
        floor = np.array([np.median([h[mirrored[j + d]] for d in range(17)]) for j in range(bins)])
        raw = np.clip((h - floor) / (floor + EPS), 0, 1)
        mask = raw if mask is None else 0.7 * mask + 0.3 * raw
        rows[3] = mask
        out.append(rows)
    return np.stack(out)


def table_of(df):
    out = {}
    for asset, own in df.toPandas().groupby("asset"):
        own = own.sort_values(["frame", "bin"])
        out[asset] = own[["gamma", "direct", "transient", "harmonic"]].to_numpy().reshape(-1, SIZE // 2 + 1, 4).transpose(0, 2, 1)
    return out


def test_batch_by_definition(spark):
    pair = spark.createDataFrame(pd.concat([pd.DataFrame({"asset": a, "n": np.arange(len(l)), "l": l, "r": r}) for a, l, r in signals()]))
    got = table_of(frame_masks(pair, RATE, SIZE))
    for asset, l, r in signals():
        assert np.allclose(got[asset], plain(l, r), atol=1e-8)


@pytest.mark.parametrize("length", [1, 50, 1000])
def test_engine_gives_the_same_however_it_is_cut(length):
    _, l, r = next(signals())
    l, r = l[:300], r[:300]
    whole, cut = FrameEngine(RATE, SIZE), FrameEngine(RATE, SIZE)
    want = whole.push(l, r) + whole.flush()
    got = [f for k in range(0, len(l), length) for f in cut.push(l[k:k + length], r[k:k + length])] + cut.flush()
    assert [k for k, _ in got] == [k for k, _ in want] and all((a == b).all() for (_, a), (_, b) in zip(got, want))
    assert cut.flush() == []
    with pytest.raises(ValueError):
        cut.push(l, r)
    cut.reset()
    again = cut.push(l, r) + cut.flush()
    assert all((a == b).all() for (_, a), (_, b) in zip(again, want))


def test_stream_equals_batch(spark, tmp_path):
    rows, rng = [], np.random.default_rng(3)
    for asset, l, r in signals():
        at = [0, *sorted(rng.choice(np.arange(1, len(l)), 6, replace=False).tolist()), len(l)]
        rows += [(asset, k, l[a:b].tolist(), r[a:b].tolist(), b == len(l)) for k, (a, b) in enumerate(zip(at, at[1:]))]
    rng.shuffle(rows)
    rows += rows[:3]  # repeats
    schema = "asset string, seq bigint, l array<double>, r array<double>, last boolean"
    for k in range(0, len(rows), 6):
        spark.createDataFrame([tuple(x) for x in rows[k:k + 6]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = table_of(to_table(frame_mask_stream(stream, RATE, SIZE), "frame_masks", "append", str(tmp_path / "state")))
    for asset, l, r in signals():
        assert np.allclose(got[asset], plain(l, r), atol=1e-8)


def test_bands_cover_all_bins_from_20_hz():
    ranges, centres = bands_of(48000, 2049)
    own = [k for a, b in ranges for k in range(a, b)]
    assert own == list(range(2, 2048)) and (np.diff(centres) > 0).all()
    assert bands_of(8000, 9)[0][0] == (0, 0)


def test_a_lost_sample_is_given_up(spark, tmp_path):
    rows = [("c", n, float(n)) for n in range(30) if n != 4]
    spark.createDataFrame(rows, "channel string, n bigint, x double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel string, n bigint, x double").parquet(str(tmp_path / "in"))
    got = to_table(running_mean(stream, 0.5, most_waiting=10), "lost", "append", str(tmp_path / "state"))
    assert sorted(r["n"] for r in got.select(F.col("n")).collect()) == [n for n in range(30) if n != 4]
