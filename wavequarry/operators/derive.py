"""Channels of a layout that a multichannel signal lacks (JN8, JN7).

Gains, delays and early reflections are linear, so what a missing channel takes from the
input is a short table of taps (source, samples later, gain): one broadcast join and one
sum derive all channels at once. Filters follow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.catalog import OUTPUT_LAYOUTS
from wavequarry.functions import dsp
from wavequarry.operators.mastering import elevate, low_pass

# The centre's downmix coefficient, a reflection's dry and wet share and its delay, gains, delays of right-hand channels in ms.
CENTER = 0.7071067811865476
DRY, WET, REFLECTION_MS = 0.45, 0.55, 35.0
RIGHT_MS = {"SR": 23.0, "BR": 19.0, "TFR": 17.0, "TBR": 13.0}
DETAIL_GAIN = 0.4125

Taps = dict[tuple[str, int], float]


@dataclass(frozen=True)
class Gains:
    surround: float = 0.6
    back: float = 0.55
    height: float = 0.55
    lfe: float = 0.31622776601683794
    lfe_hz: float = 120.0


def _sum(*parts: tuple[float, Taps]) -> Taps:
    out: Taps = {}
    for gain, taps in parts:
        for key, g in taps.items():
            out[key] = out.get(key, 0.0) + gain * g
    return out


def _later(taps: Taps, samples: int) -> Taps:
    return {(c, k + samples): g for (c, k), g in taps.items()}


def rules(have: set[str], layout: str, rate: float, gains: Gains = Gains()) -> dict[str, Taps]:
    """Taps of each channel of ``layout`` that is not in ``have``, in dependency order: centre, LFE, sides, backs, heights."""
    want = OUTPUT_LAYOUTS[layout].split()
    ms = lambda x: int(rate * x / 1000)
    diffuse = lambda t: _sum((DRY, t), (WET, _later(t, ms(REFLECTION_MS))))
    right = lambda c, t: _later(t, ms(RIGHT_MS[c]))
    has: dict[str, Taps] = {c: {(c, 0): 1.0} for c in have}
    get = has.get
    if "C" not in has and "FL" in has and "FR" in has:
        has["C"] = _sum((CENTER / 2, has["FL"]), (CENTER / 2, has["FR"]))
    if "LFE" not in has and ("C" in has or "FL" in has):
        has["LFE"] = _sum((gains.lfe, get("C") or _sum((0.5, has["FL"]), (0.5, has["FR"]))))
    for side, sources in (("SL", ("FL", "BL")), ("SR", ("FR", "BR"))):
        source = next((has[c] for c in sources if c in has), None)
        if side not in has and source is not None:
            sent = diffuse(source)
            has[side] = _sum((gains.surround, sent if side == "SL" else right(side, sent)))
    for back, side in (("BL", "SL"), ("BR", "SR")):
        if back in want and back not in has and side in has:
            sent = diffuse(has[side])
            has[back] = _sum((gains.back, sent if back == "BL" else right(back, sent)))
    if "TFL" in want:
        sl, sr, bl, br = (get(c, {}) for c in ("SL", "SR", "BL", "BR"))
        if "FL" in has:
            front = _sum((0.5, has["FL"]), (0.3, sl)), _sum((0.5, has["FR"]), (0.3, sr))
        else:
            front = sl, sr or sl
        rear = (_sum((0.5, sl), (0.3, bl)), _sum((0.5, sr), (0.3, br))) if sl else front
        for (l, r), source in ((("TFL", "TFR"), front), (("TBL", "TBR"), rear)):
            for c, t in ((l, source[0]), (r, right(r, source[1]))):
                if c in want and c not in has:
                    has[c] = _sum((gains.height, t))
    return {c: has[c] for c in want if c not in have and c in has}


def tapped(signal: DataFrame, taps: dict[str, Taps]) -> DataFrame:
    """``(asset, channel, n, x)`` of the channels in ``taps`` before filters; what a delay pushes beyond the source's end is cut."""
    if not taps:
        return signal.where("false")
    table = [(source, target, later, gain) for target, own in taps.items() for (source, later), gain in own.items()]
    # before a delayed channel's first tap there is silence: its source, undelayed and without gain
    table += [(min(own)[0], target, 0, 0.0) for target, own in taps.items() if own and min(later for _, later in own) > 0]
    spark = signal.sparkSession
    ends = signal.groupBy("asset").agg(F.max("n").alias("end"))
    sent = (signal.join(F.broadcast(spark.createDataFrame(table, "channel string, target string, later bigint, gain double")), "channel")  # at most a few dozen taps
            .select("asset", F.col("target").alias("channel"), (F.col("n") + F.col("later")).alias("n"), (F.col("x") * F.col("gain")).alias("x")))
    summed = sent.groupBy("asset", "channel", "n").agg(F.sum("x").alias("x")).join(ends, "asset").where("n <= end").drop("end")
    return summed


def derive(signal: DataFrame, layout: str, have: set[str], rate: float, gains: Gains = Gains(), controls: DataFrame | None = None, hop: int = 1) -> DataFrame:
    """The channels of ``layout``: those of the input (``have``) as they are, the others derived; with ``controls``, under their envelope."""
    found = rules(have, layout, rate, gains)
    added = tapped(signal, found)
    low = dsp.butterworth(4, gains.lfe_hz, rate)
    heights = [c for c in found if c.startswith("T")]
    plain = added.where(~F.col("channel").isin("LFE", *heights))
    parts = [plain]
    if "LFE" in found:
        parts.append(low_pass(added.where("channel = 'LFE'"), low))
    if heights:
        parts.append(elevate(added.where(F.col("channel").isin(*heights)), rate))
    new = parts[0]
    for p in parts[1:]:
        new = new.unionByName(p)
    if controls is not None:
        new = under_envelope(new, controls, hop)
    return signal.where(F.col("channel").isin(*OUTPUT_LAYOUTS[layout].split())).select("asset", "channel", "n", "x").unionByName(new.select("asset", "channel", "n", "x"))


def under_envelope(signal: DataFrame, controls: DataFrame, hop: int) -> DataFrame:
    """JN7: each channel times its class's control, interpolated between frames; all but the front ones and the LFE also by the detail."""
    names = ["front", "surround", "back", "height", "detail"]
    following = controls.select("asset", (F.col("k") - 1).alias("k"), *(F.col(c).alias(f"{c}_next") for c in names))
    both = controls.join(following, ["asset", "k"], "left")
    top = controls.groupBy("asset").agg(F.max("k").alias("top"))
    at = signal.join(top, "asset").withColumn("k", F.least(F.expr(f"n div {hop}"), F.col("top"))).join(both, ["asset", "k"])
    part = F.least(F.lit(1e0), F.col("n") / hop - F.col("k"))
    line = lambda c: F.col(c) + (F.coalesce(f"{c}_next", c) - F.col(c)) * part
    c = F.col("channel")
    rear = F.when(c.isin("BL", "BR"), line("back")).when(c.isin("SL", "SR"), line("surround")).when(c.startswith("T"), line("height"))
    gain = F.when(c.isin("FL", "FR", "C"), line("front")).when(c == "LFE", 1e0).otherwise(rear * (1 + DETAIL_GAIN * line("detail")))
    return at.select("asset", "channel", "n", (F.col("x") * gain).alias("x"))
