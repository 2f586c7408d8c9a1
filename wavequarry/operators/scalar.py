"""Column expressions: gain laws, masks and quantisers (X*, IO8, IO11, IO12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR_DB = -120.0


def db_to_linear(db: Column) -> Column:
    """X1."""
    return F.pow(F.lit(10e0), db / 20e0)


def linear_to_db(x: Column) -> Column:
    """Floored at -120; nothing positive is the floor itself."""
    return F.when(x <= 0, F.lit(FLOOR_DB)).otherwise(F.greatest(20e0 * F.log10(x), F.lit(FLOOR_DB)))


def soft_limit(x: Column, threshold: float = 0.95) -> Column:
    """What exceeds the threshold is bent by tanh into the room that is left."""
    room = 1 - threshold
    bent = F.signum(x) * (threshold + room * F.tanh((F.abs(x) - threshold) / room))
    return F.when(F.abs(x) > threshold, bent).otherwise(x)


def sigmoid_mask(f: Column, cutoff: float, slope: float = 4.0) -> Column:
    """Rises through 1/2 at the cutoff."""
    return 1e0 / (1e0 + F.exp(-(f - cutoff) / (cutoff / slope)))


def lfe_mask(f: Column, cutoff: float, order: int) -> Column:
    """The magnitude of a Butterworth low-pass."""
    return 1e0 / F.sqrt(1e0 + F.pow(f / cutoff, F.lit(2e0 * order)))


def compressor_gain(env_db: Column, threshold: float, ratio: float, knee: float) -> Column:
    """Gain in dB, with a parabola over the knee, or a corner where it has no width."""
    over, slope = env_db - threshold, 1 / ratio - 1
    if knee <= 0:
        return F.when(over > 0, slope * over).otherwise(0e0)
    bend = over + knee / 2
    return F.when(over < -knee / 2, 0e0).when(over > knee / 2, slope * over).otherwise(slope * bend * bend / (2 * knee))


def rebalance(x: Column, n: Column, gain_db: float, ramp: int) -> Column:
    """A gain that sets in linearly; boosts of over 3 dB are clipped softly."""
    gain = 10 ** (gain_db / 20)
    applied = x * F.when(n < ramp, 1 + (gain - 1) * n / max(1, ramp - 1)).otherwise(F.lit(gain))
    return F.tanh(applied / 0.95) * 0.95 if gain_db > 3 else applied


def content_scale(channel_class: Column, w: Column, h: Column, b: Column, t: Column) -> Column:
    """How far a stem's width, highs, lows and transients move a channel's gain; 1 at (.5, .3, .2, .3)."""
    height = F.greatest(0.6 * h + 0.4 * t, 0.5 * w + 0.5 * (1 - t))
    return (
        F.when(channel_class == "lfe", 1 + 0.5 * (b - 0.2)).when(channel_class == "center", 1 + 0.35 * (0.5 - w))
        .when(channel_class == "height", 1 + 0.5 * (height - 0.6))
        .when(channel_class == "surround", 1 + 0.55 * (0.6 * w + 0.4 * (1 - t) - 0.58))
        .otherwise(1 + 0.3 * (0.55 * t + 0.45 * (1 - w) - 0.39))
    )


def blend(dry: Column, wet: Column, amount: float) -> Column:
    """The amount is held to 0 to 1."""
    a = min(1.0, max(0.0, amount))
    return dry * (1 - a) + wet * a


def pcm(x: Column, bits: int) -> Column:
    """IO12: clipped, scaled to ``bits`` and rounded half to even."""
    return F.rint(F.greatest(F.lit(-1e0), F.least(F.lit(1e0), x)) * float(2 ** (bits - 1) - 1)).cast("bigint")


def centi_units(v: Column) -> Column:
    """IO8: loudness in hundredths as 16 bits; unknown is 32767."""
    held = F.greatest(F.lit(-327.68), F.least(F.lit(327.66), v))
    return F.when(v.isNull(), F.lit(32767)).otherwise(F.rint(held * 100).cast("int"))


def clock(seconds: Column) -> Column:
    """IO11: HH:MM:SS.sssss."""
    ticks = F.rint(seconds * 100000).cast("bigint")
    whole = F.floor(ticks / 100000)
    part = ticks - whole * 100000
    two = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    return F.concat(two(F.floor(whole / 3600)), F.lit(":"), two(F.floor(whole / 60) % 60), F.lit(":"), two(whole % 60), F.lit("."),
                    F.lpad(part.cast("bigint").cast("string"), 5, "0"))


def fft_size(rate: Column, longest: int = 16384) -> Column:
    """The power of two from a tenth of a second up, by exact doubling."""
    least = F.floor(rate / 10.8)
    out = F.lit(longest)
    k = longest // 2
    while k >= 1:
        out = F.when(least <= k, F.lit(k)).otherwise(out)
        k //= 2
    return out
