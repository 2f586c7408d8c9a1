"""Mastering as transforms over ``(asset, channel, n, x)``."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.catalog import COMPRESSOR_PROFILES, EQ_PROFILES, STEM_EQ_PROFILES
from wavequarry.functions import dsp
from wavequarry.operators import chunks
from wavequarry.operators.folds import envelope_system
from wavequarry.operators.loudness import CHANNEL_WEIGHTS

#: Channels that pass what is done to the others.
LOW = ("LFE",)
_SIGNAL = "asset string, channel string, n bigint, x double"


def on_chunks(fn: Callable[[DataFrame], DataFrame], size: int = chunks.SIZE) -> Callable[[DataFrame], DataFrame]:
    """A step on chunk rows as one on samples."""
    return lambda signal: chunks.unpack(fn(chunks.pack(signal, size)), size)


def equalise(signal: DataFrame, points: list[tuple[float, float]], rate: float, amount: float = 1.0) -> DataFrame:
    """An EQ curve, blended with the dry signal; the low-frequency channel passes."""
    return on_chunks(lambda rows: equalise_chunks(rows, points, rate, amount))(signal)


def equalise_chunks(rows: DataFrame, points: list[tuple[float, float]], rate: float, amount: float = 1.0, size: int = chunks.SIZE) -> DataFrame:
    a = min(1.0, max(0.0, amount))
    return rows if not a else chunks.fir(rows, dsp.fir_from_breakpoints(points, rate), size, 1 - a, LOW)


def stem_eq(stems: DataFrame, profiles: dict[str, str], rate: float, taps: int = 511) -> DataFrame:
    """``stems(asset, channel, stem, n, x)`` through the EQ of their stem's profile, zones (after an @) as their stem; others pass.

    The filter is the minimum-phase one of half the length and the square root of the magnitude.
    """
    designs = {stem: dsp.fir_from_breakpoints(STEM_EQ_PROFILES[name], rate, taps, half=True) for stem, name in profiles.items()}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        return pdf.assign(x=dsp.fir_filter(designs[pdf["stem"].iloc[0].split("@")[0]], pdf["x"].to_numpy(np.float64)))

    cols = ["asset", "channel", "stem", "n", "x"]
    addressed = F.coalesce(F.substring_index("stem", "@", 1).isin(*designs), F.lit(False)) if designs else F.lit(False)
    shaped = stems.select(*cols).where(addressed).groupBy("asset", "channel", "stem").applyInPandas(run, "asset string, channel string, stem string, n bigint, x double")
    return stems.select(*cols).where(~addressed).unionByName(shaped)


def compress(signal: DataFrame, profile: str, rate: float) -> DataFrame:
    """One gain for all channels of an asset, from their joint level; the low-frequency channel passes."""
    return on_chunks(lambda rows: compress_chunks(rows, profile, rate))(signal)


def compress_chunks(rows: DataFrame, profile: str, rate: float, size: int = chunks.SIZE) -> DataFrame:
    """The channels of a chunk give its level; the level's two followers go on from chunk to chunk; the gains go back to the channels."""
    threshold, ratio, attack, release, knee, makeup = COMPRESSOR_PROFILES[profile]
    if ratio < 1:
        raise ValueError("a ratio is 1 at least")
    if ratio == 1:
        return rows
    fast, slow = (1 - np.exp(-1000.0 / (rate * ms)) for ms in (attack, release))
    rows = chunks.settled(rows)

    def joint(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        power, count = np.zeros(pdf["x"].map(len).max()), np.zeros(pdf["x"].map(len).max())
        for x in pdf.sort_values("channel")["x"]:
            power[:len(x)] += np.square(x)
            count[:len(x)] += 1
        return pd.DataFrame({"asset": [key[0]], "channel": ["level"], "chunk": [key[1]], "x": [np.sqrt(power / count + 1e-20)]})

    def gain(env):
        over = 20 * np.log10(np.maximum(env, 1e-10)) - threshold
        bend = over + knee / 2
        g = np.where(over < -knee / 2, 0.0, np.where(over > knee / 2, (1 / ratio - 1) * over, (1 / ratio - 1) * bend * bend / (2 * knee)))
        return 10 ** ((g + makeup) / 20)

    level = rows.where("channel <> 'LFE'").groupBy("asset", "chunk").applyInPandas(joint, chunks.CHUNKS)
    gains = chunks.mapped(chunks.linear(level, envelope_system(fast, slow), size), gain)
    both = rows.join(gains.select("asset", "chunk", F.col("x").alias("gain")), ["asset", "chunk"], "left")
    return chunks.mapped(both, lambda x, g, channel: x if channel in LOW or g is None else x * np.asarray(g)[:len(x)], "gain", "channel")


def loudness(signal: DataFrame, rate: int) -> DataFrame:
    """``(asset, lkfs, dbtp)`` of K-weighted, gated blocks, and the peak between samples."""
    return measure(chunks.pack(signal), rate)


def measure(rows: DataFrame, rate: int, size: int = chunks.SIZE) -> DataFrame:
    """``loudness`` of chunk rows: peaks from chunks with halos; each chunk gives its share of the energy of the blocks it meets."""
    rows = chunks.settled(rows)
    peaks = chunks.true_peaks(rows, size).groupBy("asset").agg((20e0 * F.log10(F.greatest(F.max("peak"), F.lit(1e-30)))).alias("dbtp"))
    return peaks.join(_integrated(rows, rate, size), "asset", "left").select("asset", F.coalesce("lkfs", F.lit(-70.0)).alias("lkfs"), "dbtp")


def integrated(signal: DataFrame, rate: int) -> DataFrame:
    """L1, L2: ``(asset, lkfs)`` without the peak; assets in which no block passes the gate are left out."""
    return _integrated(chunks.settled(chunks.pack(signal)), rate)


def _integrated(rows: DataFrame, rate: int, size: int = chunks.SIZE) -> DataFrame:
    block, hop = int(0.4 * rate), int(0.1 * rate)

    def shares(batches):
        for pdf in batches:
            parts = []
            for asset, channel, chunk, y in zip(pdf["asset"], pdf["channel"], pdf["chunk"], pdf["x"], strict=True):
                total, start = np.concatenate([[0.0], np.cumsum(np.square(y))]), chunk * size
                own = np.arange(max(0, (start - block) // hop + 1), (start + len(y) - 1) // hop + 1)
                low, high = np.maximum(own * hop - start, 0), np.minimum(own * hop + block - start, len(y))
                parts.append(pd.DataFrame({"asset": asset, "channel": channel, "block": own, "e": CHANNEL_WEIGHTS[channel] * (total[high] - total[low]) / block, "c": high - low}))
            yield pd.concat(parts) if parts else pd.DataFrame({"asset": [], "channel": [], "block": [], "e": [], "c": []})

    heard = chunks.linear(rows.where(F.col("channel").isin(*(c for c, w in CHANNEL_WEIGHTS.items() if w))), chunks.series(dsp.k_weighting(rate)), size, settle=False)
    each = (heard.mapInPandas(shares, "asset string, channel string, block bigint, e double, c bigint").where("c > 0")
            .groupBy("asset", "channel", "block").agg(F.sum("e").alias("e"), F.sum("c").alias("c")).where(F.col("c") == block))
    shortest = each.groupBy("asset", "channel").agg(F.max("block").alias("k")).groupBy("asset").agg(F.min("k").alias("k"))
    power = (each.groupBy("asset", "block").agg(F.sum("e").alias("p")).join(shortest, "asset").where("block <= k")
             .withColumn("l", -0.691 + 10 * F.log10(F.greatest("p", F.lit(1e-30)))).where("l >= -70"))
    gate = power.groupBy("asset").agg((-0.691 + 10 * F.log10(F.avg("p")) - 10).alias("gate"))
    return power.join(gate, "asset").where("l >= gate").groupBy("asset").agg((-0.691 + 10 * F.log10(F.avg("p"))).alias("lkfs"))


def normalise(signal: DataFrame, rate: int, target: float, peak: float = -1.0, cap: float = 30.0) -> DataFrame:
    """The gain to the target loudness, none where nothing could be measured, less what would exceed the peak."""
    return on_chunks(lambda rows: normalise_chunks(rows, rate, target, peak, cap)[0])(signal)


def gain_to(measured: DataFrame, target: float, peak: float = -1.0, cap: float = 30.0) -> DataFrame:
    """``(asset, pre_lkfs, gain_db, tp_limited)`` from ``measured(asset, lkfs, dbtp)``."""
    want = F.when(F.col("lkfs") <= -70, 0.0).otherwise(F.least(target - F.col("lkfs"), F.lit(cap)))
    excess = F.greatest(F.lit(0.0), F.col("dbtp") + want - peak)
    return measured.select("asset", F.col("lkfs").alias("pre_lkfs"), (want - excess).alias("gain_db"), (excess > 0).alias("tp_limited"))


def normalise_chunks(rows: DataFrame, rate: int, target: float, peak: float = -1.0, cap: float = 30.0, size: int = chunks.SIZE) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The rows at their gain, and what gives ``(asset, pre_lkfs, gain_db, tp_limited, lkfs, dbtp)``, the last two measured again on these rows."""
    rows = chunks.settled(rows)
    gains = chunks.settled(gain_to(measure(rows, rate, size), target, peak, cap))
    done = chunks.mapped(rows.join(gains.select("asset", "gain_db"), "asset"), lambda x, g: x * 10 ** (g / 20), "gain_db")
    return done, lambda: gains.join(measure(done, rate, size), "asset")


@dataclass
class Chain:
    """What is set runs, in this order: match, EQ, compressor, bass, soft limit, loudness.

    ``reference(k, n, x)``, k the channel's number, is what the signal is matched to. EQ is a
    curve or a profile's name. A profile that isn't known is an error, but for the compressor's, which is warned about and left out.
    """

    rate: int
    eq: list[tuple[float, float]] | str = field(default_factory=list)
    compressor: str | None = None
    limit: float | None = None
    target: float | None = None
    bass: str | None = None
    reference: DataFrame | None = None
    strength: float = 0.7
    most_db: float = 12.0
    by_spectrum: bool = True
    by_level: bool = True

    def apply(self, signal: DataFrame) -> DataFrame:
        if self.reference is not None:
            signal = match(signal, self.reference, self.rate, self.strength, self.most_db, spectrum=self.by_spectrum, level=self.by_level)
        if not (self.eq or self.bass or self.limit is not None or self.target is not None) and self.compressor not in COMPRESSOR_PROFILES:
            if self.compressor:
                warnings.warn(f"no compressor profile {self.compressor}", stacklevel=2)
            return signal
        rows = chunks.settled(chunks.pack(signal))
        done = self.on_rows(rows)
        return signal if done is rows else chunks.unpack(done)

    def on_rows(self, rows: DataFrame) -> DataFrame:
        """The chain on chunk rows, but for the matching: the samples are shuffled once, when they are packed."""
        if self.eq:
            rows = equalise_chunks(rows, EQ_PROFILES[self.eq] if isinstance(self.eq, str) else self.eq, self.rate)
        if self.compressor and self.compressor not in COMPRESSOR_PROFILES:
            warnings.warn(f"no compressor profile {self.compressor}", stacklevel=3)
        elif self.compressor:
            rows = compress_chunks(rows, self.compressor, self.rate)
        if self.bass:
            rows = bass_chunks(rows, self.bass, self.rate)
        if self.limit is not None:
            knee = self.limit
            rows = chunks.mapped(rows, lambda x: np.where(np.abs(x) > knee, np.sign(x) * (knee + (1 - knee) * np.tanh((np.abs(x) - knee) / max(1 - knee, 1e-12))), x))
        return normalise_chunks(rows, self.rate, self.target)[0] if self.target is not None else rows


def resample(signal: DataFrame, old: int, new: int) -> DataFrame:
    """F5 for each channel."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = dsp.resample(pdf.sort_values("n", kind="stable")["x"].to_numpy(np.float64), old, new)
        return pd.DataFrame({"asset": pdf["asset"].iloc[0], "channel": pdf["channel"].iloc[0], "n": np.arange(len(x)), "x": x})

    return signal.select("asset", "channel", "n", "x").groupBy("asset", "channel").applyInPandas(run, _SIGNAL)


# Sub and mid gain dB, mono cutoff Hz, exciter, low-frequency channel dB.
BASS_PROFILES = {"boost": (2.0, 1.0, None, False, 1.5), "cut": (-2.5, -1.5, None, False, -1.0), "mono": (0.0, 0.0, 100.0, False, 0.0), "enhance": (1.5, 0.5, 80.0, True, 1.0)}
SUB_HZ, MID_HZ = 80.0, 200.0
_SIDES = {"FL": "FR", "SL": "SR", "BL": "BR", "TFL": "TFR", "TBL": "TBR"}


def bass(signal: DataFrame, profile: str, rate: float) -> DataFrame:
    """Band gains below 80 and from 80 to 200 Hz, a mono low end, an exciter, and the low-frequency channel's trim."""
    return on_chunks(lambda rows: bass_chunks(rows, profile, rate))(signal)


def bass_chunks(rows: DataFrame, profile: str, rate: float, size: int = chunks.SIZE) -> DataFrame:
    sub_db, mid_db, mono_hz, excite, lfe_db = BASS_PROFILES[profile]
    sub, mid = dsp.butterworth(2, SUB_HZ, rate), np.concatenate([dsp.butterworth(2, MID_HZ, rate), dsp.butterworth(2, SUB_HZ, rate, "high")])
    g_sub, g_mid = 10 ** (sub_db / 20) - 1, 10 ** (mid_db / 20) - 1
    if sub_db:
        rows = chunks.linear(rows, chunks.series(sub, out=lambda low, x: x + g_sub * low), size, skip=LOW)
    if mid_db:
        rows = chunks.linear(rows, chunks.series(mid, out=lambda band, x: x + g_mid * band), size, skip=LOW)
    if mono_hz:
        lows = chunks.zero_phase(rows.where("channel <> 'LFE'"), dsp.butterworth(2, mono_hz, rate), size)
        twin = F.col("channel")
        for a, b in _SIDES.items():
            twin = F.when(F.col("channel") == a, b).when(F.col("channel") == b, a).otherwise(twin)
        other = lows.select("asset", F.col("channel").alias("twin"), "chunk", F.col("x").alias("other"))
        both = lows.withColumnRenamed("x", "low").withColumn("twin", twin).where("twin <> channel").join(other, ["asset", "twin", "chunk"])
        paired = rows.join(both.select("asset", "channel", "chunk", "low", "other"), ["asset", "channel", "chunk"], "left")

        def together(x, low, other):
            if low is None:
                return x
            n = min(len(low), len(other))
            return np.concatenate([x[:n] + (np.asarray(other)[:n] - np.asarray(low)[:n]) / 2, x[n:]])

        rows = chunks.mapped(paired, together, "low", "other")
    if excite:
        rows = chunks.linear(rows, chunks.series(sub, out=lambda low, x: x + 0.15 * np.tanh(3 * low)), size, skip=LOW)
    trim = 10 ** (lfe_db / 20)
    return chunks.mapped(rows, lambda x, channel: x * trim if channel in LOW else x, "channel") if lfe_db else rows


def elevate(signal: DataFrame, rate: float, low_hz: float = 150.0, low_gain: float = 0.15, high_hz: float = 3000.0, high_gain: float = 1.5) -> DataFrame:
    """less below the low corner, more above the high one; for height channels."""
    thin = chunks.series(dsp.butterworth(1, low_hz, rate), out=lambda low, x: x - (1 - low_gain) * low)
    airy = chunks.series(dsp.butterworth(2, high_hz, rate, "high"), out=lambda high, x: x + (high_gain - 1) * high)
    return on_chunks(lambda rows: chunks.linear(chunks.linear(rows, thin), airy))(signal)


def derive_lfe(signal: DataFrame, rate: float, cutoff: float = 120.0) -> DataFrame:
    """the low-passed sum of the front pair as a channel of its own."""
    mono = signal.where("channel IN ('FL', 'FR')").groupBy("asset", "n").agg((F.sum("x") / 2).alias("x"))
    return low_pass(mono.select("asset", F.lit("LFE").alias("channel"), "n", "x"), dsp.butterworth(4, cutoff, rate))


def low_pass(signal: DataFrame, sections: np.ndarray) -> DataFrame:
    """Every channel through second-order sections."""
    return on_chunks(lambda rows: chunks.linear(rows, chunks.series(sections)))(signal)


# By the reference's number of channels, which of them (or what mix of them) each output channel is held against.
PROXIES = {
    1: {},
    2: {"FL": "0", "FR": "1", "C": "mid", "LFE": "mid_lp", "SL": "0", "SR": "1", "BL": "0", "BR": "1", "TFL": "0", "TFR": "1", "TBL": "mid", "TBR": "mid"},
    6: {"FL": "0", "FR": "1", "C": "2", "LFE": "3", "SL": "4", "SR": "5", "BL": "4", "BR": "5", "TFL": "0", "TFR": "1", "TBL": "mid46", "TBR": "mid46"},
    8: {"FL": "0", "FR": "1", "C": "2", "LFE": "3", "BL": "4", "BR": "5", "SL": "6", "SR": "7", "TFL": "0", "TFR": "1", "TBL": "4", "TBR": "5"},
}
LOUDEST_DB, FLOOR, PROXY_LOW_HZ = 6.0, 1e-20, 80.0


def proxies_for(channels: int) -> dict[str, str]:
    """The table of the nearest number of channels, of two as near the smaller."""
    near = min(PROXIES, key=lambda k: (abs(k - channels), k))
    return PROXIES[near] or dict.fromkeys(PROXIES[2], "0")


def reference_spectra(reference: DataFrame, rate: float, size: int = 8192) -> dict[str, tuple[float, np.ndarray]]:
    """each proxy's level and Welch density: at most eight channels and three mixes of them, half ``size`` values each."""
    count = reference.agg(F.max("k")).first()[0] + 1
    mixes = {str(k): {k: 1.0} for k in range(count)} | {"mid": {0: 0.5, 1: 0.5} if count > 1 else {0: 1.0}}
    mixes |= {"mid_lp": mixes["mid"], "mid46": {4: 0.5, 5: 0.5} if count > 5 else {min(4, count - 1): 1.0}}
    wanted = set(proxies_for(count).values()) | {"mid"}
    rows = [(k, name, g) for name, own in mixes.items() if name in wanted for k, g in own.items()]
    mixed = reference.join(F.broadcast(reference.sparkSession.createDataFrame(rows, "k int, proxy string, gain double")), "k")
    mixed = mixed.groupBy("proxy", "n").agg(F.sum(F.col("x") * F.col("gain")).alias("x"))
    low = dsp.butterworth(2, PROXY_LOW_HZ, rate)

    def density(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("n", kind="stable")["x"].to_numpy(np.float64)
        if pdf["proxy"].iloc[0] == "mid_lp":
            x = dsp.sos_filter(low, x)[0]
        return pd.DataFrame({"proxy": [pdf["proxy"].iloc[0]], "level": [float(np.sqrt(np.mean(x * x) + FLOOR))], "psd": [dsp.welch(x, rate, size)[1].tolist()]})

    return {r["proxy"]: (r["level"], np.array(r["psd"])) for r in mixed.groupBy("proxy").applyInPandas(density, "proxy string, level double, psd array<double>").collect()}


def match(signal: DataFrame, reference: DataFrame, rate: float, strength: float = 0.7, most_db: float = 12.0, size: int = 8192,
          spectrum: bool = True, level: bool = True) -> DataFrame:
    """Each asset's level brought to the reference's within 6 dB, then each channel's spectral shape, blended by ``strength``.

    Levels are means of the channels' levels, without the LFE and low-passed proxies; the gain goes to all channels.
    """
    spectra = reference_spectra(reference, rate, size)
    table = proxies_for(sum(k.isdigit() for k in spectra) if len(spectra) > 2 else 1)
    proxy_of = lambda c: table.get(c, "mid")
    if level:
        rows = [(c, spectra[p][0]) for c in CHANNEL_WEIGHTS if c != "LFE" and (p := proxy_of(c)) != "mid_lp"]
        levels = signal.where("channel <> 'LFE'").groupBy("asset", "channel").agg(F.sqrt(F.avg(F.col("x") * F.col("x")) + FLOOR).alias("own"))
        levels = levels.join(F.broadcast(signal.sparkSession.createDataFrame(rows, "channel string, ref double")), "channel", "left")
        db = 20 * F.log10((F.avg("ref") + FLOOR) / (F.avg("own") + FLOOR))
        gain = levels.groupBy("asset").agg(F.greatest(F.lit(-LOUDEST_DB), F.least(F.lit(LOUDEST_DB), F.coalesce(db, F.lit(0e0)))).alias("db"))
        signal = signal.join(gain, "asset", "left").select("asset", "channel", "n", (F.col("x") * F.pow(F.lit(10e0), F.coalesce("db", F.lit(0e0)) / 20)).alias("x"))
    if not spectrum or strength <= 0:
        return signal
    wet = min(1.0, strength)

    def shape(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        x = pdf["x"].to_numpy(np.float64)
        taps = dsp.fir_from_breakpoints(match_curve(x, spectra[proxy_of(pdf["channel"].iloc[0])][1], rate, most_db, size), rate)
        return pdf.assign(x=(1 - wet) * x + wet * dsp.fir_filter(taps, x))

    return signal.select("asset", "channel", "n", "x").groupBy("asset", "channel").applyInPandas(shape, _SIGNAL)


def match_curve(target: np.ndarray, ref: np.ndarray, rate: float, most_db: float = 6.0, size: int = 8192, count: int = 40) -> list[tuple[float, float]]:
    """Breakpoints that carry the shape of the reference's density ``ref`` to the target.

    The dB ratio of both densities, smoothed over a quarter octave (by the first
    step of the logarithmic axis), without its mean from 80 Hz to 8 kHz, held to the
    limit and to 2 dB below 120 Hz.
    """
    f, tgt = dsp.welch(target, rate, size)
    n = min(len(ref), len(tgt))
    f, db = f[1:n], 10 * np.log10((ref[1:n] + 1e-20) / (tgt[1:n] + 1e-20))
    sigma = 0.25 / max(np.log2(f[1] / f[0]), 1e-10) if len(f) > 1 else 0.25
    half = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    db = np.convolve(np.pad(db, half, mode="reflect"), kernel / kernel.sum(), mode="valid")
    middle = (f >= 80) & (f <= 8000)
    if middle.any():
        db = db - db[middle].mean()
    db = np.clip(db, -most_db, most_db)
    db = np.where(f < 120, np.clip(db, -2, 2), db)
    at = np.geomspace(20, rate / 2, count)
    return list(zip(at.tolist(), np.interp(at, f, db).tolist(), strict=True))
