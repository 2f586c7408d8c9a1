"""Stems to channels: routes by precedence, gains by content, constant power over what is really sent, and a low-frequency bus of its own (JN1 to JN4, X10, X11, F6, F10, W3).

Stems are chunk rows with two channels, ``L`` and ``R``; a stem's key is its name, or ``name@zone``.
What each stem sends to each channel is a small relation; samples meet it once, at the end.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavequarry import catalog
from wavequarry.functions import dsp
from wavequarry.operators import chunks, scalar
from wavequarry.operators.upmix import Routing

# Gains of stems without a zone; a pair's gain holds for left and right.
DEFAULT_PAIRS = {
    "Vocals": {"C": 0.70, "F": 0.28, "TF": 0.12},
    "Bass": {"F": 0.65, "C": 0.20, "LFE": 0.80},
    "Drums": {"C": 0.20, "F": 0.55, "S": 0.12, "LFE": 0.32, "TF": 0.12, "TB": 0.04},
    "Other": {"F": 0.38, "S": 0.34, "B": 0.15, "TF": 0.22, "TB": 0.14},
    "Guitar": {"F": 0.52, "S": 0.35, "B": 0.12, "TF": 0.12},
    "Piano": {"C": 0.18, "F": 0.55, "S": 0.22, "TF": 0.15},
    "Instrumental": {"C": 0.15, "F": 0.60, "S": 0.30, "B": 0.14, "LFE": 0.45, "TF": 0.15, "TB": 0.08},
    "Lead Vocals": {"C": 0.80, "F": 0.20, "TF": 0.08},
    "Backing Vocals": {"F": 0.45, "S": 0.22, "TF": 0.30, "TB": 0.12},
    "Kick": {"C": 0.30, "F": 0.55, "LFE": 0.85},
    "Snare": {"C": 0.35, "F": 0.60, "TF": 0.08},
    "Toms": {"C": 0.12, "F": 0.62, "S": 0.15, "LFE": 0.20},
    "Hi-Hat": {"F": 0.42, "TF": 0.40, "TB": 0.06},
    "Ride": {"F": 0.38, "TF": 0.45},
    "Crash": {"F": 0.35, "S": 0.15, "TF": 0.50, "TB": 0.08},
    "Crowd": {"S": 0.28, "B": 0.20, "TB": 0.15, "TF": 0.06},
}
# Delays of the diffused sends in ms, left and right, and how much of a send is the delayed copy.
DELAYS = {"surround": (31.0, 37.0), "height": (23.0, 29.0)}
WET = 0.55
VOICES = ("Vocals", "Lead Vocals", "Backing Vocals")
Routes = dict[str, dict[str, float]]


def default_routes() -> Routes:
    """The routes of ``DEFAULT_PAIRS``, channel by channel."""
    each = lambda p: (p,) if p in ("C", "LFE") else (f"{p}L", f"{p}R")
    return {stem: {c: g for p, g in own.items() for c in each(p)} for stem, own in DEFAULT_PAIRS.items()}


def effective(keys: DataFrame, zones: dict[str, Routes] | None = None, defaults: Routes | None = None, custom: Routes | None = None) -> DataFrame:
    """JN1, JN2: ``(stem, name, channel, gain)`` of the keys in ``keys(stem)``.

    A stem's base is its zone's entry, even an empty one, else the default of its name. Over it, channel by channel,
    go the custom gains of its key, or if there are none those of its name. What has neither goes nowhere.
    """
    spark, defaults = keys.sparkSession, default_routes() if defaults is None else defaults
    split = keys.select("stem").distinct().select("stem", F.regexp_replace("stem", "@[^@]*$", "").alias("name"), F.when(F.col("stem").contains("@"), F.substring_index("stem", "@", -1)).alias("zone"))
    known = spark.createDataFrame([(z, s, True) for z, own in (zones or {}).items() for s in own], "zone string, name string, own boolean")
    table = [(z, s, c, g) for z, own in {**(zones or {}), "": defaults}.items() for s, to in own.items() for c, g in to.items()]
    picked = split.join(known, ["zone", "name"], "left").withColumn("pick", F.when(F.col("own"), F.col("zone")).otherwise(F.lit("")))
    base = picked.join(_routes(spark, [(z, s, c, g) for z, s, c, g in table], "pick string, name string, channel string, gain double"), ["pick", "name"]).select("stem", "channel", F.col("gain").alias("base"))
    given = {k: v for k, v in (custom or {}).items() if v}
    named = split.withColumn("key", F.when(F.col("stem").isin(*given) if given else F.lit(False), F.col("stem")).otherwise(F.col("name")))
    over = named.join(_routes(spark, [(k, c, g) for k, own in given.items() for c, g in own.items()], "key string, channel string, gain double"), "key").select("stem", "channel", F.col("gain").alias("over"))
    merged = base.join(over, ["stem", "channel"], "full").select("stem", "channel", F.coalesce("over", "base").alias("gain"))
    return merged.join(split.select("stem", "name"), "stem").select("stem", "name", "channel", "gain")


def _routes(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def gains(routes: DataFrame, layout: str, r: Routing = Routing(), skip: tuple[str, ...] = (), features: DataFrame | None = None) -> DataFrame:
    """JN4, X10, X11: ``([asset,] stem, channel, gain)`` over the layout's channels.

    Each class has its gain. Channels in ``skip`` are passed through and get nothing; if the centre is one, half of what
    a voice would send there goes to each of its front channels. ``features(asset, stem, width, hf, lf, transient)`` move the
    gains of the stems that have them.
    """
    c, spark = F.col, routes.sparkSession
    labels = catalog.labels(spark).where(c("label").isin(*catalog.OUTPUT_LAYOUTS[layout].split())).select(c("label").alias("channel"), "class")
    back = c("channel").isin("BL", "BR")
    of_class = F.when(c("class") == "center", r.center).when(back, r.back).when(c("class") == "surround", r.surround).when(c("class") == "height", r.height).otherwise(1.0)
    middle = routes.where((c("channel") == "C") & c("name").isin(*VOICES)).select("stem", (c("gain") / 2).alias("middle"))
    out = routes.join(labels, "channel").join(middle, "stem", "left").where(~c("channel").isin(*skip) if skip else F.lit(True))
    redirected = F.when(c("channel").isin("FL", "FR"), F.coalesce("middle", F.lit(0.0))).otherwise(0.0) if "C" in skip else F.lit(0.0)
    out = out.select("stem", "channel", "class", (c("gain") * of_class + redirected).alias("gain"))
    if features is None:
        return out.drop("class")
    moved = scalar.content_scale(c("class"), c("width"), c("hf"), c("lf"), c("transient"))
    scaled = c("gain") * F.when(c("width").isNull(), 1.0).otherwise(1 + r.content * (moved - 1))
    stems = features.select("asset", "stem", "width", "hf", "lf", "transient")
    return stems.join(out, "stem").select("asset", "stem", "channel", scaled.alias("gain"))


def kind_of(channel: Column) -> Column:
    """Which of a stem's signals a channel takes."""
    return F.when(channel.isin("SL", "SR", "BL", "BR"), "surround").when(channel.startswith("T"), "height").otherwise("dry")


def side_of(channel: Column) -> Column:
    return F.when(channel.isin("C", "LFE"), "M").otherwise(F.substring(channel, -1, 1))


def constant_power(sent: DataFrame, energy: DataFrame) -> DataFrame:
    """JN3: ``sent(asset, stem, channel, gain)`` with the gains scaled so that each stem sends out the energy it has.

    ``energy(asset, stem, kind, side, e)`` is that of a stem's signals; the stem's own is its dry left and right. The LFE is
    neither counted nor scaled. A stem that sends nothing to speak of is left as it is.
    """
    placed = sent.withColumn("kind", kind_of(F.col("channel"))).withColumn("side", side_of(F.col("channel")))
    out = placed.where("channel <> 'LFE'").join(energy, ["asset", "stem", "kind", "side"]).groupBy("asset", "stem").agg(F.sum(F.col("gain") * F.col("gain") * F.col("e")).alias("out"))
    own = energy.where("kind = 'dry' AND side IN ('L', 'R')").groupBy("asset", "stem").agg(F.sum("e").alias("own"))
    scale = out.join(own, ["asset", "stem"]).select("asset", "stem", F.when(F.col("out") > 1e-20, F.sqrt(F.col("own") / F.col("out"))).otherwise(1.0).alias("scale"))
    scaled = F.when(F.col("channel") == "LFE", F.col("gain")).otherwise(F.col("gain") * F.coalesce("scale", F.lit(1.0)))
    return placed.join(scale, ["asset", "stem"], "left").select("asset", "stem", "channel", "kind", "side", scaled.alias("gain"))


def _echo(rows: DataFrame, rate: float, kind: str, size: int) -> DataFrame:
    """A part of each send comes again after the delay of its side."""
    late = {s: int(rate * ms / 1000) for s, ms in zip("LR", DELAYS[kind], strict=True)}
    most = max(late.values())

    def run(x, halo, channel):
        k = late[channel[-1]]
        return (1 - WET) * x + WET * np.concatenate([chunks.before_of(halo, most), x])[most - k:most - k + len(x)]

    return chunks.mapped(chunks.with_halo(rows, most, size), run, "halo", "channel")


def sends(stems: DataFrame, rate: float, needed: DataFrame, r: Routing = Routing(), size: int = chunks.SIZE) -> DataFrame:
    """``(asset, stem, kind, side, chunk, x)``: a stem's dry left, right and mean, and the surround and height sends of the stems that ``needed(asset, stem, kind)`` names.

    ``stems`` are chunk rows whose channel is the stem's key, a unit separator (0x1F), and ``L`` or ``R``.
    """
    split = F.split("channel", "\x1f")
    both = stems.select("asset", "chunk", "x", split[0].alias("stem"), split[1].alias("side"))
    wanted = lambda k: stems.join(needed.where(F.col("kind") == k).select("asset", F.col("stem").alias("own")).distinct(), (F.col("own") == split[0]) & (stems["asset"] == needed["asset"]), "left_semi")
    surround = chunks.linear(wanted("surround"), chunks.series(dsp.butterworth(2, r.bass_hz, rate, "high")), size)
    thin = chunks.series(dsp.butterworth(1, r.low_hz, rate), out=lambda low, x: x - (1 - r.low_gain) * low)
    airy = chunks.series(dsp.butterworth(2, r.shelf_hz, rate, "high"), out=lambda high, x: x + (r.shelf_gain - 1) * high)
    height = chunks.linear(chunks.linear(wanted("height"), thin, size), airy, size)
    out = both.select("asset", "stem", F.lit("dry").alias("kind"), "side", "chunk", "x")
    for kind, rows in (("surround", surround), ("height", height)):
        sent = _echo(rows, rate, kind, size)
        out = out.unionByName(sent.select("asset", split[0].alias("stem"), F.lit(kind).alias("kind"), split[1].alias("side"), "chunk", "x"))
    mean = both.groupBy("asset", "stem", "chunk").agg(F.max(F.when(F.col("side") == "L", F.col("x"))).alias("l"), F.max(F.when(F.col("side") == "R", F.col("x"))).alias("r"))
    return out.unionByName(mean.select("asset", "stem", F.lit("dry").alias("kind"), F.lit("M").alias("side"), "chunk", F.zip_with("l", "r", lambda a, b: (a + b) / 2).alias("x")))


def energies(sent: DataFrame) -> DataFrame:
    """``(asset, stem, kind, side, e)``: summed within each chunk, then over chunks."""
    own = F.aggregate("x", F.lit(0e0), lambda a, v: a + v * v)
    return sent.select("asset", "stem", "kind", "side", own.alias("e")).groupBy("asset", "stem", "kind", "side").agg(F.sum("e").alias("e"))


def route(stems: DataFrame, rate: float, layout: str, r: Routing = Routing(), zones: dict[str, Routes] | None = None, defaults: Routes | None = None, custom: Routes | None = None,
          skip: tuple[str, ...] = (), features: DataFrame | None = None, size: int = chunks.SIZE) -> DataFrame:
    """``(asset, channel, n, x)`` of the layout's channels, but for those in ``skip``, from ``stems(asset, stem, n, l, r)``.

    A channel that nothing goes to is silence of the asset's length. The LFE bus is the stems' mean at its gains, low-passed as a whole.
    """
    key = lambda side: F.concat("stem", F.lit(f"\x1f{side}"))
    long = stems.select("asset", "stem", "n", F.inline(F.array(*(F.struct(key(s).alias("channel"), F.col(c).alias("x")) for s, c in (("L", "l"), ("R", "r"))))))
    packed = chunks.settled(chunks.pack(long, size))
    keys = packed.select("asset", F.split("channel", "\x1f")[0].alias("stem")).distinct()
    plan = gains(effective(keys, zones, defaults, custom), layout, r, skip, keys.join(features, ["asset", "stem"], "left") if features is not None else None)
    plan = plan if features is not None else keys.join(plan, "stem").select("asset", "stem", "channel", "gain")
    plan = chunks.settled(plan)
    sent = sends(packed, rate, plan.select("asset", "stem", kind_of(F.col("channel")).alias("kind")), r, size)
    sent = chunks.settled(sent)
    powered = constant_power(plan, energies(sent))
    parts = sent.join(powered, ["asset", "stem", "kind", "side"]).select("asset", "channel", "chunk", "gain", "x")
    lengths = packed.groupBy("asset", "chunk").agg(F.max(F.size("x")).alias("len"))
    silent = lengths.select("asset", F.explode(F.array(*(F.lit(c) for c in catalog.OUTPUT_LAYOUTS[layout].split() if c not in skip))).alias("channel"), "chunk",
                            F.lit(0e0).alias("gain"), F.array_repeat(F.lit(0e0), F.col("len")).alias("x"))

    def together(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(pdf["x"].map(len).max())
        for g, own in zip(pdf["gain"], pdf["x"], strict=True):
            x[:len(own)] += g * np.asarray(own)
        return pd.DataFrame({"asset": [key[0]], "channel": [key[1]], "chunk": [key[2]], "x": [x]})

    mixed = chunks.settled(parts.unionByName(silent).groupBy("asset", "channel", "chunk").applyInPandas(together, chunks.CHUNKS))
    bus = chunks.series(dsp.butterworth(r.lfe_order, r.lfe_hz, rate), out=lambda low, _: r.lfe * low)
    low = chunks.linear(mixed.where("channel = 'LFE'"), bus, size, settle=False)
    return chunks.unpack(mixed.where("channel <> 'LFE'").unionByName(low), size)
