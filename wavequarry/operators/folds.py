"""Order-dependent recursions (R*).

The linear ones are systems with a state (``chunks.Linear``): their chunks are filtered apart and a
scan over the chunks' summaries carries the states, so a channel of any length spreads over
tasks. The energy controller picks its coefficient by its own output, which no such scan can
carry; it runs over frames, not samples, one task for each asset and channel.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wavequarry.operators import chunks


def _keys(df: DataFrame) -> list[str]:
    return [c for c in ("asset", "channel") if c in df.columns]


def _through(signal: DataFrame, system: chunks.Linear, size: int) -> DataFrame:
    done = chunks.unpack(chunks.linear(chunks.pack(signal, size), system, size), size, "y")
    return done.select(*_keys(signal), "n", "y")


def ema_system(alpha: float) -> chunks.Linear:
    return chunks.Linear([[alpha]], [1 - alpha], [[alpha]], [1 - alpha], first=lambda x0: [x0])


def allpass_system(a: float) -> chunks.Linear:
    """The state is what the next sample gets of this one: x + a y."""
    return chunks.Linear([[a]], [1 - a * a], [[1.0]], [-a])


def envelope_system(fast: float, slow: float) -> chunks.Linear:
    return chunks.Linear(np.diag([1 - fast, 1 - slow]), [fast, slow], np.diag([1 - fast, 1 - slow]), [fast, slow], out=lambda a, b, _: np.maximum(a, b))


def ema(signal: DataFrame, alpha: float, size: int = chunks.SIZE) -> DataFrame:
    """``y = alpha * y + (1 - alpha) * x``, started at the first sample."""
    return _through(signal, ema_system(alpha), size)


def allpass(signal: DataFrame, a: float = 0.7, size: int = chunks.SIZE) -> DataFrame:
    """``y = -a x + x' + a y'``."""
    return _through(signal, allpass_system(a), size)


def envelope(level: DataFrame, fast: float, slow: float, size: int = chunks.SIZE) -> DataFrame:
    """The greater of two one-pole followers of ``level(channel, n, x)``."""
    return _through(level, envelope_system(fast, slow), size)


def biquad(signal: DataFrame, b: tuple[float, float, float], a: tuple[float, float], size: int = chunks.SIZE) -> DataFrame:
    """One section, direct form 2 transposed, from rest."""
    return _through(signal, chunks.series(np.array([[*b, 1.0, *a]])), size)


def energy_gain(frames: DataFrame, attack: float, release: float, limit_db: float = 6.0, quiet: float | None = 1e-20) -> DataFrame:
    """A gain that follows sqrt(source / routed) of ``frames([asset,] channel, n, src, out)``, held to the limit.

    Frames with an energy up to ``quiet`` pass and change nothing. Without ``quiet`` every frame counts: a silent
    source pulls to the lower limit, what has silence or no number under it to the upper one.
    """
    own, top = _keys(frames), 10 ** (limit_db / 20)
    come = [round(1 - alpha, 12) for alpha in (attack, release)]  # 0.05, not 1 - 0.95: a result may end on a half of the last digit that is kept

    def run(pdf):
        pdf = pdf.sort_values("n", kind="stable")
        src, out = pdf["src"].to_numpy(np.float64), pdf["out"].to_numpy(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.sqrt(src / out)
        targets = np.where(np.isnan(ratio), top, np.clip(ratio, 1 / top, top))
        passes = np.zeros(len(src), bool) if quiet is None else (src <= quiet) | (out <= quiet)
        gain, gains = 1.0, []
        for target, skip in zip(targets.tolist(), passes.tolist(), strict=True):
            if skip:
                gains.append(1.0)
                continue
            gain = attack * gain + come[0] * target if target < gain else release * gain + come[1] * target
            gains.append(gain)
        return pdf[[*own, "n"]].assign(gain=gains)

    fields = [T.StructField(k, T.StringType()) for k in own] + [T.StructField("n", T.LongType()), T.StructField("gain", T.DoubleType())]
    return frames.select(*own, "n", "src", "out").groupBy(*own).applyInPandas(run, T.StructType(fields))


def ema_last(values: Column, alpha: float) -> Column:
    """The last value of the running mean of an array, folded in the JVM."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda y, x: F.when(y.isNull(), x).otherwise(alpha * y + (1 - alpha) * x))
