"""Gated loudness over a signal relation (L1, L2, JN9, W1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Channel weights of the loudness standard; absent labels weigh 0.
CHANNEL_WEIGHTS = {"FL": 1.0, "FR": 1.0, "C": 1.0, "SL": 1.41, "SR": 1.41, "BL": 1.0, "BR": 1.0,
                   "TFL": 1.0, "TFR": 1.0, "TBL": 1.0, "TBR": 1.0}
ABSOLUTE_GATE = -70.0
RELATIVE_GATE = -10.0
OFFSET = -0.691


def channel_weight(channel: F.Column) -> F.Column:
    out = F.lit(0.0)
    for label, weight in CHANNEL_WEIGHTS.items():
        out = F.when(channel == label, F.lit(weight)).otherwise(out)
    return out


def _asset(df: DataFrame) -> list[str]:
    return ["asset"] * ("asset" in df.columns)


def block_energy(signal: DataFrame, block: int, hop: int) -> DataFrame:
    """Mean square of every complete overlapping block of each channel, by asset too if there is one.

    Each hop-wide bin is summed once and the bins are then dealt to the
    ``block / hop`` blocks they belong to, so only bins, not samples, multiply.
    """
    if block % hop:
        raise ValueError("block must be a multiple of hop")
    per, own = block // hop, [*_asset(signal), "channel"]
    bins = (
        signal.groupBy(*own, F.expr(f"n div {hop}").alias("bin"))
        .agg(F.sum(F.col("x") * F.col("x")).alias("e"), F.count("*").alias("c"))
    )
    spread = bins.withColumn(
        "block", F.explode(F.sequence(F.greatest(F.lit(0), F.col("bin") - (per - 1)), F.col("bin"))))
    return (
        spread.groupBy(*own, "block")
        .agg(F.sum("e").alias("e"), F.sum("c").alias("c"))
        .where(F.col("c") == block)
        .select(*own, "block", (F.col("e") / block).alias("ms"))
    )


def block_loudness(signal: DataFrame, block: int, hop: int) -> DataFrame:
    """Weighted power per block, over blocks that every measurable channel of the asset has."""
    own = _asset(signal)
    weighted = block_energy(signal, block, hop).withColumn("w", channel_weight(F.col("channel"))).where("w > 0")
    shortest = weighted.groupBy(*own, "channel").agg(F.count("*").alias("k")).groupBy(*own).agg(F.min("k").alias("blocks"))
    summed = weighted.groupBy(*own, "block").agg(F.sum(F.col("w") * F.col("ms")).alias("p"))
    return (
        _each(summed, shortest, own).where("block < blocks")
        .select(*own, "block", "p", _lkfs("p").alias("lkfs"))
    )


def integrated_loudness(signal: DataFrame, block: int = 40, hop: int = 10) -> DataFrame:
    """``([asset,] lkfs, gated_blocks)``: one row, or one for each asset; -70 where nothing passes the gate."""
    own = _asset(signal)
    blocks = block_loudness(signal, block, hop)
    loud = blocks.where(F.col("lkfs") >= ABSOLUTE_GATE)
    gate = loud.groupBy(*own).agg((_lkfs(F.avg("p")) + RELATIVE_GATE).alias("gate"))
    total = _each(loud, gate, own).where("lkfs >= gate").groupBy(*own).agg(F.avg("p").alias("mean_p"), F.count("*").alias("gated_blocks"))
    if own:  # an asset whose blocks are all below the gate, or that has none
        total = signal.select(*own).distinct().join(total, own, "left")
    return total.select(
        *own, F.round(F.coalesce(_lkfs("mean_p"), F.lit(-70e0)), 6).alias("lkfs"),
        F.coalesce("gated_blocks", F.lit(0)).cast("bigint").alias("gated_blocks"),
    )


def _lkfs(power) -> F.Column:
    return OFFSET + 10e0 * F.log10(F.greatest(power, F.lit(1e-30)))


def _each(rows: DataFrame, figures: DataFrame, own: list[str]) -> DataFrame:
    """Rows with their asset's figures; without assets there is one row of figures."""
    return rows.join(figures, own) if own else rows.join(F.broadcast(figures))
