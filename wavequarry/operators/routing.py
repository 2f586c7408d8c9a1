"""Routing joins and downmixes (JN*, U5, U6, A13, A16, K6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HALF_POWER = 0.7071067811865476


def routes_for(stems: DataFrame, routes: DataFrame, known: DataFrame) -> DataFrame:
    """JN1, JN2: each stem's ``(channel, gain)``: its zone's, else the default of its stem.

    ``known(zone, stem)`` says which pairs a zone has at all: a pair that is known
    but has no routes goes nowhere; it isn't given the default.
    """
    marked = stems.join(known.withColumn("own", F.lit(True)), ["zone", "stem"], "left").withColumn(
        "pick", F.when(F.col("own"), F.col("zone")).otherwise(F.lit("default")))
    return marked.join(routes.withColumnRenamed("zone", "pick"), ["pick", "stem"]).drop("pick", "own")


def mix(routed: DataFrame, signal_cols: tuple[str, ...] = ("x",)) -> DataFrame:
    """JN3: what all stems send to each channel, summed per sample."""
    return routed.groupBy(*_asset(routed), "channel", "n").agg(*(F.sum(F.col("gain") * F.col(c)).alias(c) for c in signal_cols))


def constant_power(energy: DataFrame) -> DataFrame:
    """JN3: per stem, sqrt(energy / sum of gain squared * energy) over ``energy(key, e, gain)``."""
    return energy.groupBy("key").agg((F.sqrt(F.max("e") / F.sum(F.col("gain") * F.col("gain") * F.col("e")))).alias("scale"))


def _asset(signal: DataFrame) -> list[str]:
    return ["asset"] * ("asset" in signal.columns)


def downmix(signal: DataFrame, surround: float = HALF_POWER) -> DataFrame:
    """Left and right; the low-frequency and height channels are out, back folds into surround."""
    one = lambda c: F.coalesce(F.sum(F.when(F.col("channel") == c, F.col("x"))), F.lit(0e0))
    side = lambda s, b: one(s) + HALF_POWER * one(b)
    return (signal.where(F.col("channel").isin("FL", "FR", "C", "SL", "SR", "BL", "BR")).groupBy(*_asset(signal), "n")
            .agg((one("FL") + HALF_POWER * one("C") + surround * side("SL", "BL")).alias("l"),
                 (one("FR") + HALF_POWER * one("C") + surround * side("SR", "BR")).alias("r")))


def downmix_mono(signal: DataFrame, surround: float = 0.5) -> DataFrame:
    """U6."""
    gain = (F.when(F.col("channel").isin("FL", "FR"), HALF_POWER).when(F.col("channel") == "C", 1.0).when(F.col("channel").isin("SL", "SR"), surround)
            .when(F.col("channel").isin("BL", "BR"), surround * HALF_POWER))
    return signal.withColumn("g", gain).where("g IS NOT NULL").groupBy(*_asset(signal), "n").agg(F.sum(F.col("g") * F.col("x")).alias("m"))


def centroid(gains: DataFrame, labels: DataFrame) -> DataFrame:
    """Gain-weighted speaker position of each key, left and right apart; centre counts half on either side; else (0, 1, 0)."""
    placed = gains.join(F.broadcast(labels), "label").where("class <> 'lfe'")
    sides = F.when(F.col("label") == "C", F.array(F.lit("left"), F.lit("right"))).when(F.col("px") < 0, F.array(F.lit("left"))).otherwise(F.array(F.lit("right")))
    half = F.when(F.col("label") == "C", F.col("gain") / 2).otherwise(F.col("gain"))
    total = F.sum("w")
    at = lambda c, d: F.coalesce(F.when(total > 0, F.sum(F.col("w") * F.col(c)) / total), F.lit(d)).alias(c)
    return placed.withColumn("w", half).withColumn("side", F.explode(sides)).groupBy("key", "side").agg(at("px", 0e0), at("py", 1e0), at("pz", 0e0))


def source_anchor(signal: DataFrame, source: DataFrame, native: dict[str, str], strength: float) -> DataFrame:
    """Channels drawn towards their native ones in ``source(asset, channel, n, x)``, by ``strength`` from 0 to 1.

    ``native`` names each channel's native one; a source with a single channel stands for all of them. An anchored channel ends
    where the shorter of the two does; a channel without a native one, or whose native one the source lacks, is as it was, and so are all at strength 0.
    """
    if not 0 <= strength <= 1:
        raise ValueError("a strength is from 0 to 1")
    if not strength or not native:
        return signal.select("asset", "channel", "n", "x")
    spark = signal.sparkSession
    pairs = spark.createDataFrame(list(native.items()), "channel string, wanted string")
    found = source.groupBy("asset", "channel").agg(F.max("n").alias("top"))
    alone = found.groupBy("asset").agg(F.count("*").alias("k"), F.first("channel").alias("only")).where("k = 1").select("asset", "only")
    marked = (signal.select("asset", "channel", "n", "x").join(F.broadcast(pairs), "channel", "left").join(alone, "asset", "left")  # a dozen channels
              .withColumn("src", F.when(F.col("wanted").isNotNull(), F.coalesce("only", "wanted"))))
    ended = marked.join(found.withColumnRenamed("channel", "src"), ["asset", "src"], "left").where("top IS NULL OR n <= top")
    both = ended.join(source.select("asset", F.col("channel").alias("src"), "n", F.col("x").alias("sx")), ["asset", "src", "n"], "left")
    blended = (1 - strength) * F.col("x") + strength * F.coalesce("sx", F.lit(0e0))
    return both.select("asset", "channel", "n", F.when(F.col("top").isNull(), F.col("x")).otherwise(blended).alias("x"))
