"""Delays, blocks, smoothing and spans over the signal relation (W*, S*, P1, P4, JN5, JN6, JN10)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wavequarry.functions import dsp


def _keys(df: DataFrame) -> list[str]:
    """What tells signals apart: asset and channel, as far as the relation has them."""
    return [c for c in ("asset", "channel") if c in df.columns]


def _along(df: DataFrame):
    return W.partitionBy(*_keys(df)).orderBy("n")


def delay(signal: DataFrame, samples: int) -> DataFrame:
    """Shifted by ``samples`` with zero fill; nothing to shift is a copy."""
    late = F.coalesce(F.lag("x", samples).over(_along(signal)), F.lit(0e0)) if samples > 0 else F.col("x")
    return signal.select(*_keys(signal), "n", "x", late.alias("y"))


def diffuse(signal: DataFrame, samples: int, dry: float = 0.45, wet: float = 0.55) -> DataFrame:
    """A blend with the delayed copy."""
    return delay(signal, samples).select(*_keys(signal), "n", (dry * F.col("x") + wet * F.col("y")).alias("y"))


def block_peaks(signal: DataFrame, window: int, hop: int) -> DataFrame:
    """The peak of every complete window, from one peak per hop."""
    per = window // hop
    own = _keys(signal)
    bins = signal.groupBy(*own, F.expr(f"n div {hop}").alias("bin")).agg(F.max(F.abs("x")).alias("p"), F.count("*").alias("c"))
    spread = bins.select(*own, "p", "c", F.explode(F.sequence(F.greatest(F.lit(0), F.col("bin") - (per - 1)), F.col("bin"))).alias("block"))
    return spread.groupBy(*own, "block").agg(F.max("p").alias("peak"), F.sum("c").alias("c")).where(F.col("c") == window).select(*own, "block", "peak")


def runs(active: DataFrame) -> DataFrame:
    """Maximal runs ``(channel, s, e)``, inclusive, of the blocks in ``active(channel, block)``; by asset too, if there is one."""
    own = _keys(active)
    isle = F.col("block") - F.row_number().over(W.partitionBy(*own).orderBy("block"))
    return active.withColumn("isle", isle).groupBy(*own, "isle").agg(F.min("block").alias("s"), F.max("block").alias("e")).select(*own, "s", "e")


def merge_spans(spans: DataFrame, gap: int = 0) -> DataFrame:
    """Half-open spans of a channel whose gap is at most ``gap`` become one."""
    own = _keys(spans)
    order = W.partitionBy(*own).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("s") > reach + gap), 1).otherwise(0))
    grouped = marked.withColumn("g", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return grouped.groupBy(*own, "g").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*own, "s", "e")


def expand_spans(spans: DataFrame, least: int, lengths: DataFrame) -> DataFrame:
    """Spans shorter than ``least`` grow around their centre, held to the signal, and are merged again."""
    short = F.col("e") - F.col("s") < least
    s = F.greatest(F.lit(0), F.expr(f"(s + e) div 2 - {least} div 2"))
    own = _keys(spans)
    grown = spans.join(lengths, own).select(
        *own, F.when(short, s).otherwise(F.col("s")).alias("s"), F.when(short, F.least("len", s + least)).otherwise(F.col("e")).alias("e"))
    return merge_spans(grown)


def active_spans(signal: DataFrame, window: int, hop: int, threshold_db: float, gap_blocks: int, pad: int, least: int) -> DataFrame:
    """Where the peak exceeds the threshold, as padded, merged and expanded sample spans."""
    loud = block_peaks(signal, window, hop).where(20e0 * F.log10(F.greatest("peak", F.lit(1e-12))) > threshold_db)
    own = _keys(signal)
    isles = runs(loud).select(*own, "s", (F.col("e") + 1).alias("e"))
    merged = merge_spans(isles, gap_blocks - 1)
    lengths = signal.groupBy(*own).agg((F.max("n") + 1).alias("len"))
    padded = merged.join(lengths, own).select(
        *own, F.greatest(F.lit(0), F.col("s") * hop - pad).alias("s"),
        F.least("len", (F.col("e") - 1) * hop + window + pad).alias("e"))
    return expand_spans(merge_spans(padded), least, lengths)


def in_spans(signal: DataFrame, spans: DataFrame, bucket: int = 256) -> DataFrame:
    """JN10: samples with the span they lie in, as an equi-join on buckets of samples."""
    cut = spans.withColumn("b", F.explode(F.sequence(F.expr(f"s div {bucket}"), F.expr(f"(e - 1) div {bucket}"))))
    own = _keys(signal)
    return signal.withColumn("b", F.expr(f"n div {bucket}")).join(cut, [*own, "b"]).where("n >= s AND n < e").select(*own, "n", "x", "s", "e")


def crossfade(signal: DataFrame, spans: DataFrame, fade: int) -> DataFrame:
    """Samples inside spans, faded linearly at both ends; of overlapping spans the later one stands."""
    f = F.least(F.lit(fade), F.expr("(e - s) div 2"))
    up, down = (F.col("n") - F.col("s")) / (f - 1), (F.col("e") - 1 - F.col("n")) / (f - 1)
    gain = F.when(f > 1, F.least(F.lit(1e0), up, down)).otherwise(F.lit(1e0))
    return (in_spans(signal, spans).withColumn("y", F.col("x") * gain).groupBy(*_keys(signal), "n").agg(F.max_by("y", "s").alias("y")))


def positive_flux(frames: DataFrame) -> DataFrame:
    """Rises from frame to frame in each bin, from ``frames(bin, frame, m)``; the first frame has none."""
    before = F.lag("m").over(W.partitionBy(*_keys(frames), "bin").orderBy("frame"))
    return frames.withColumn("flux", F.when(before.isNull(), 0e0).otherwise(F.greatest(F.lit(0e0), F.col("m") - before)))


def onset_density(frames: DataFrame, hop: int, rate: float) -> DataFrame:
    """``([asset, channel,] onsets, density, transient)`` of ``frames([asset, channel,] frame, bin, m)``.

    A frame's flux is the sum of its bins' rises over the frame before it, so the first has none; an onset is a flux above the mean by two
    deviations of all. The density is onsets a second over eight, one at most, and 0 for up to two frames; the transient share is that of fluxes
    over one and a half times the third quartile.
    """
    own = _keys(frames)
    before = F.lag("m").over(W.partitionBy(*own, "bin").orderBy("frame"))
    rise = F.when(before.isNotNull(), F.greatest(F.lit(0e0), F.col("m") - before))
    flux = frames.withColumn("x", rise).groupBy(*own, "frame").agg(F.sum("x").alias("x"))
    limits = flux.groupBy(*own).agg((F.avg("x") + 2 * F.stddev_pop("x")).alias("thr"), F.percentile("x", F.lit(0.75)).alias("p75"), F.count("*").alias("frames"))
    joined = flux.where("x IS NOT NULL").join(limits, own) if own else flux.where("x IS NOT NULL").join(F.broadcast(limits))  # one row without keys
    counted = joined.groupBy(*own).agg(F.count_if(F.col("x") > F.col("thr")).alias("onsets"), F.max("frames").alias("frames"), F.avg(F.when(F.col("x") > 1.5 * F.col("p75"), 1e0).otherwise(0e0)).alias("transient"))
    seconds = F.col("frames") * hop / rate
    return counted.select(*own, "onsets", F.when(F.col("frames") <= 2, 0e0).otherwise(F.least(F.lit(1e0), F.col("onsets") / seconds / 8)).alias("density"), "transient")


def trim_head(signal: DataFrame, late: int) -> DataFrame:
    """Without the first ``late`` samples, and padded with silence to the old length."""
    own = _keys(signal)
    early = signal.where(F.col("n") >= late).select(*own, (F.col("n") - late).alias("n"), "x")
    return signal.select(*own, "n").join(early, [*own, "n"], "left").select(*own, "n", F.coalesce("x", F.lit(0e0)).alias("x"))


def three_windows(signal: DataFrame, keys: list[str], most: int) -> DataFrame:
    """All of what is no longer than ``most`` samples, else a third of that from the start, the middle and the end."""
    third = most // 3
    length = signal.groupBy(*keys).agg((F.max("n") + 1).alias("len"))
    mid = F.expr(f"(len - {third}) div 2")
    n = F.col("n")
    inside = (F.col("len") <= most) | (n < third) | ((n >= mid) & (n < mid + third)) | (n >= F.col("len") - third)
    return signal.join(length, keys).where(inside).drop("len")


def overlap_add(frames: DataFrame, hop: int, synthesis: list[float] | None = None) -> DataFrame:
    """``frames([asset, channel,] frame, values)`` laid ``hop`` apart and summed, under a synthesis window if there is one."""
    v = F.col("v")
    if synthesis is not None:
        v = v * F.element_at(F.array(*(F.lit(float(w)) for w in synthesis)), F.col("i") + 1)
    return (frames.select(*_keys(frames), "frame", F.posexplode("values").alias("i", "v"))
            .groupBy(*_keys(frames), (F.col("frame") * hop + F.col("i")).cast("bigint").alias("n")).agg(F.sum(v).alias("y")))


def synthesis_window(size: int, hop: int) -> list[float]:
    """The periodic Hann window over the sum of its own shifted squares: with it at both ends, frames that overlap add up to the signal."""
    w = dsp.hann(size)
    return (w / sum(np.roll(w * w, k * hop) for k in range(size // hop))).tolist()


def preview(signal: DataFrame, length: int, start: int | None = None) -> DataFrame:
    """``length`` samples from ``start``, or around the middle."""
    own = _keys(signal)
    sizes = signal.groupBy(*own).agg(F.count("*").alias("len"))
    room = F.greatest(F.lit(0), F.col("len") - length)
    first = F.least(F.lit(start), room) if start is not None else F.least(F.greatest(F.lit(0), F.expr(f"len div 2 - {length} div 2")), room)
    return signal.join(sizes, own).withColumn("s", first).where(f"n >= s AND n < s + {length}").select(*own, "n", "x")


def fir(signal: DataFrame, taps: list[float]) -> DataFrame:
    """a short filter as a sum over lags; what lies before the start is zero."""
    along = _along(signal)
    y = sum((F.coalesce(F.lag("x", k).over(along), F.lit(0e0)) * float(h) for k, h in enumerate(taps)), F.lit(0e0))
    return signal.select(*_keys(signal), "n", y.alias("y"))


def stepped(samples: DataFrame, controls: DataFrame, hop: int) -> DataFrame:
    """JN5: each sample with the control of its asset's frame, the last one beyond the end: an as-of join made equal."""
    top = controls.groupBy("asset").agg(F.max("k").alias("top"))
    keyed = samples.join(top, "asset").withColumn("k", F.least(F.greatest(F.expr(f"n div {hop}"), F.lit(0)), F.col("top")))
    return keyed.join(controls, ["asset", "k"])


def interpolated(samples: DataFrame, controls: DataFrame, hop: int) -> DataFrame:
    """JN6: linear interpolation between ``controls(asset, k, v)`` at ``k * hop``, ends held: a frame meets the next one by its number."""
    following = controls.select("asset", (F.col("k") - 1).alias("k"), F.col("v").alias("nxt"))
    both = controls.join(following, ["asset", "k"], "left").withColumn("nxt", F.coalesce("nxt", F.col("v")))
    return stepped(samples, both, hop).withColumn("v", F.col("v") + (F.col("nxt") - F.col("v")) * F.least(F.lit(1e0), F.col("n") / hop - F.col("k"))).drop("nxt")
