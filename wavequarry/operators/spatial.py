"""Spatial plan of a stereo signal: frame features, a profile, and smooth controls.

Frames are a quarter second; every step is keyed by ``asset``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Weights of the mean features (w width, t transient, a air, d diffuse) in each profile's score, and each
# profile's front, surround, back and height multipliers.
SCORES = {
    "intimate": "(1 - w) * 55e-2 + (1 - d) * 45e-2",
    "rhythmic": "t * 75e-2 + a * 25e-2",
    "spacious": "d * 7e-1 + w * 3e-1",
    "live": "d * 55e-2 + w * 25e-2 + (1 - t) * 2e-1",
    "detailed": "a * 45e-2 + w * 3e-1 + (1 - t) * 25e-2",
}
BASES = {
    "balanced": (1.0, 1.0, 0.92, 1.0), "intimate": (1.06, 0.68, 0.55, 0.68), "rhythmic": (1.03, 0.88, 0.72, 1.05),
    "spacious": (0.96, 1.20, 1.12, 1.18), "live": (0.98, 1.16, 1.22, 0.96), "detailed": (1.02, 1.05, 0.92, 1.12),
}
#: A profile must lead the next one by so much.
MARGIN = 0.08
AIR_HZ = 4000.0
LEAST_SAMPLES = 8


def hop_of(rate: float) -> int:
    return max(1, int(rate * 0.25))


def _air(rate: float):
    """Share of the windowed magnitude spectrum from AIR_HZ up, from a frame's samples in order; none for no samples."""

    @F.pandas_udf("double")
    def of(frames: pd.Series) -> pd.Series:
        out = []
        for x in frames:
            x = np.asarray(x, np.float64)
            if not len(x):
                out.append(0.0)
                continue
            spectrum = np.abs(np.fft.rfft(x * np.hanning(len(x))))
            out.append(float(spectrum[np.fft.rfftfreq(len(x), 1 / rate) >= AIR_HZ].sum() / (spectrum.sum() + 1e-12)))
        return pd.Series(out, dtype=float)

    return of


def frame_features(pair: DataFrame, rate: float) -> DataFrame:
    """``(asset, k, activity, width, transient, air, diffuse)`` of ``pair(asset, n, l, r)``.

    A frame of fewer than eight samples has zeros and is no frame's predecessor. Air
    needs a spectrum only where the rate reaches AIR_HZ; below it is zero.
    """
    l, r, full = F.col("l"), F.col("r"), F.count("*") >= LEAST_SAMPLES
    wide = F.least(F.lit(1e0), F.greatest(F.lit(0e0), F.avg((l - r) * (l - r) / 4) / (F.avg(l * l + r * r) / 2 + 1e-12)))
    sums = [F.when(full, F.sqrt(F.avg((l + r) * (l + r) / 4)) + 1e-12).alias("rms"), F.when(full, wide).otherwise(0e0).alias("width")]
    if rate / 2 >= AIR_HZ:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", ((l + r) / 2).alias("m")))), lambda x: x["m"])
        sums.append(F.when(full, ordered).otherwise(F.array().cast("array<double>")).alias("mono"))
    frames = pair.groupBy("asset", F.expr(f"n div {hop_of(rate)}").alias("k")).agg(*sums)
    p90 = frames.groupBy("asset").agg(F.greatest(F.percentile(F.coalesce("rms", F.lit(0e0)), F.lit(0.9)), F.lit(1e-12)).alias("p90"))
    before = F.coalesce(F.last("rms", ignorenulls=True).over(W.partitionBy("asset").orderBy("k").rowsBetween(W.unboundedPreceding, -1)), F.lit(0e0))
    rise = F.when(F.col("rms").isNull(), 0e0).otherwise(F.greatest(F.lit(0e0), F.col("rms") - before) / (F.col("rms") + before + 1e-12))
    air = _air(rate)("mono") if rate / 2 >= AIR_HZ else F.lit(0e0)
    return frames.withColumn("transient", rise).withColumn("air", air).join(p90, "asset").select(
        "asset", "k", F.least(F.lit(1e0), F.coalesce("rms", F.lit(0e0)) / F.col("p90")).alias("activity"), "width", "transient", "air",
        (F.col("width") * (1 - F.col("transient"))).alias("diffuse"))


def profiles(features: DataFrame, requested: str = "auto") -> DataFrame:
    """K1: ``(asset, profile, confidence)``: the best score of the mean features if it leads by MARGIN, else balanced; a requested one has confidence 1."""
    if requested != "auto":
        if requested not in BASES:
            raise ValueError(f"no spatial profile {requested}")
        return features.select("asset").distinct().select("asset", F.lit(requested).alias("profile"), F.lit(1e0).alias("confidence"))
    means = features.groupBy("asset").agg(F.avg("width").alias("w"), F.avg("transient").alias("t"), F.avg("air").alias("a"), F.avg("diffuse").alias("d"))
    # of equal scores the earlier profile stands
    scored = F.array_sort(F.array(*(F.struct((-F.expr(e)).alias("low"), F.lit(k).alias("ord"), F.lit(n).alias("name")) for k, (n, e) in enumerate(SCORES.items()))))
    best = means.select("asset", F.slice(scored, 1, 2).alias("s")).select("asset", F.col("s")[0]["name"].alias("name"), (F.col("s")[1]["low"] - F.col("s")[0]["low"]).alias("confidence"))
    return best.select("asset", F.when(F.col("confidence") >= MARGIN, F.col("name")).otherwise("balanced").alias("profile"), "confidence")


def smoothed(frames: DataFrame, columns: list[str], sigma: float = 3.0) -> DataFrame:
    """Each column of ``frames(asset, k, ...)`` under a Gaussian of radius 4 sigma, the ends repeated."""
    radius = int(4 * sigma + 0.5)
    weight = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    kernel = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(w / sum(weight)).alias("w")) for d, w in zip(range(-radius, radius + 1), weight, strict=True)))
    top = frames.groupBy("asset").agg(F.max("k").alias("top"))
    near = (frames.select("asset", "k", F.explode(kernel).alias("x")).join(top, "asset")
            .select("asset", "k", F.col("x.w").alias("w"), F.least(F.greatest(F.col("k") + F.col("x.d"), F.lit(0)), F.col("top")).alias("j")))
    values = frames.select("asset", F.col("k").alias("j"), *columns)
    return near.join(values, ["asset", "j"]).groupBy("asset", "k").agg(*(F.sum(F.col("w") * F.col(c)).alias(c) for c in columns))


CONTROLS = ["front", "surround", "back", "height", "detail"]


def controls(pair: DataFrame, rate: float, requested: str = "auto", intensity: float = 1.0) -> DataFrame:
    """``(asset, k, front, surround, back, height, detail)``, smooth multipliers per frame; detail is zero but for the detailed profile."""
    features = frame_features(pair, rate)
    of = lambda i: F.element_at(F.create_map(*(F.lit(x) for n, b in BASES.items() for x in (n, b[i]))), F.col("profile"))
    t, air, sustain = F.col("transient"), F.col("air"), F.col("diffuse") * F.col("activity")
    raw = features.join(profiles(features, requested), "asset").select(
        "asset", "k", (of(0) * (1 + 0.05 * t)).alias("front"),
        (of(1) * (0.72 + 0.55 * sustain) * (1 - 0.35 * t)).alias("surround"),
        (of(2) * (0.65 + 0.65 * sustain) * (1 - 0.45 * t)).alias("back"),
        (of(3) * (0.72 + 0.45 * F.greatest(air, sustain)) * (1 - 0.2 * t)).alias("height"),
        F.when(F.col("profile") == "detailed", F.least(F.lit(1e0), F.greatest(F.lit(0e0), (air + F.col("width")) * 0.5 * (1 - t) * F.col("activity")))).otherwise(0e0).alias("detail"))
    much = min(1.0, max(0.0, intensity))
    return smoothed(raw, CONTROLS).select("asset", "k", *((1 + much * (F.col(c) - 1)).alias(c) for c in CONTROLS[:4]), (much * F.col("detail")).alias("detail"))
