"""Signals as rows of chunks, with halos for short memory and a scan of affine states for long memory.

A chunk row is ``(asset, channel, chunk, x)``: samples ``chunk * size`` and on, ``size`` of them but
for the last one. Rows are dealt by asset, channel and chunk, so one endless channel
spreads over the cluster, and no task holds more of it than a chunk and its halo.

* What looks back a bounded number of samples (a filter of taps, an interpolator) takes a halo:
  the end of the chunk before, or of as many as it needs.
* A linear recursion is an affine map of its state. Each chunk gives where it leads from rest;
  a scan over these summaries, a few numbers each, gives every chunk the state that it starts
  from, and a second pass over the chunks gives the samples.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavequarry.functions import dsp

#: Samples of a chunk.
SIZE = 1 << 16
#: Chunks whose summaries one task of the scan composes.
FAN = 1024
#: Samples that a linear system takes in one product of matrices.
STEP = 64

KEYS = ["asset", "channel"]
CHUNKS = "asset string, channel string, chunk bigint, x array<double>"


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once, for what reads it more than once, and its lineage cut.

    A checkpoint in the folder that ``spark.checkpoint.dir`` names, which outlives lost executors; unset, it is a temporary folder in local mode and an error on a cluster.
    """
    if getattr(df, "_settled", False):
        return df
    spark = df.sparkSession
    if not (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()):
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wavequarry-"))
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    out = df.checkpoint()
    out._settled = True
    return out


def pack(signal: DataFrame, size: int = SIZE) -> DataFrame:
    """Chunk rows of ``signal([asset,] channel, n, x)``; a sample that is missing is silence, which has no row where a chunk ends in it."""
    asset = F.col("asset") if "asset" in signal.columns else F.lit("").alias("asset")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["n"].to_numpy(np.int64) - key[2] * size
        x = np.zeros(at.max() + 1)
        x[at] = pdf["x"].to_numpy(np.float64)
        return pd.DataFrame({"asset": [key[0]], "channel": [key[1]], "chunk": [key[2]], "x": [x]})

    dealt = signal.select(asset, "channel", "n", F.expr(f"n div {size}").alias("chunk"), F.col("x").cast("double").alias("x"))
    return dealt.groupBy(*KEYS, "chunk").applyInPandas(run, CHUNKS)


def unpack(chunks: DataFrame, size: int = SIZE, name: str = "x") -> DataFrame:
    """Back to ``(asset, channel, n, name)``."""
    return chunks.select(*KEYS, "chunk", F.posexplode("x").alias("i", name)).select(*KEYS, (F.col("chunk") * size + F.col("i")).cast("bigint").alias("n"), name)


def with_halo(chunks: DataFrame, before: int, size: int = SIZE) -> DataFrame:
    """``chunks`` with ``halo``, up to ``before`` samples that come just before each, and ``last``, whether no chunk follows.

    One shuffle: a chunk is sent to itself, its end to the chunks after it, and its presence to the one before it.
    """
    empty = F.array().cast("array<double>")
    whole = F.when(F.size("x") < size, F.concat("x", F.array_repeat(F.lit(0e0), F.lit(size) - F.size("x")))).otherwise(F.col("x"))
    sent = [F.struct(F.lit(0).alias("j"), F.lit(0).cast("bigint").alias("to"), F.col("x").alias("x")), F.struct(F.lit(1).alias("j"), F.lit(-1).cast("bigint").alias("to"), empty.alias("x"))]
    for k in range(1, -(-before // size) + 1):
        part = min(size, before - (k - 1) * size)
        end = F.slice(whole, size - part + 1, part)
        sent.append(F.struct(F.lit(-k).alias("j"), F.lit(k).cast("bigint").alias("to"), end.alias("x")))
    dealt = chunks.select(*KEYS, "chunk", F.explode(F.array(*sent)).alias("s")).select(*KEYS, (F.col("chunk") + F.col("s.to")).alias("chunk"), F.col("s.j").alias("j"), F.col("s.x").alias("x"))
    pieces = F.sort_array(F.collect_list(F.when(F.col("j") < 0, F.struct("j", "x"))))
    return (dealt.groupBy(*KEYS, "chunk").agg(F.first(F.when(F.col("j") == 0, F.col("x")), ignorenulls=True).alias("x"),
                                              F.flatten(F.transform(pieces, lambda p: p["x"])).alias("halo"),
                                              (F.max("j") < 1).alias("last"))
            .where("x IS NOT NULL"))


def mapped(rows: DataFrame, fn: Callable[..., np.ndarray], *columns: str) -> DataFrame:
    """Chunk rows whose samples are ``fn(x, *columns)``."""

    def run(batches):
        for pdf in batches:
            out = [np.asarray(fn(np.asarray(x, np.float64), *more), np.float64) for x, *more in zip(pdf["x"], *(pdf[c] for c in columns), strict=True)]
            yield pd.DataFrame({"asset": pdf["asset"], "channel": pdf["channel"], "chunk": pdf["chunk"], "x": out})

    return rows.select(*KEYS, "chunk", "x", *(c for c in columns if c not in ("x", "chunk", *KEYS))).mapInPandas(run, CHUNKS)


def before_of(halo, taps: int) -> np.ndarray:
    """The ``taps`` samples before a chunk, silence where the signal has not begun."""
    halo = np.asarray(halo, np.float64)[-taps:] if taps else np.empty(0)
    return np.concatenate([np.zeros(taps - len(halo)), halo])


def fir(chunks: DataFrame, taps: np.ndarray, size: int = SIZE, dry: float = 0.0, skip: tuple[str, ...] = ()) -> DataFrame:
    """Each chunk through a filter of taps, of any number; ``dry`` of the signal stays besides (1 - dry) of the filtered one. Channels in ``skip`` pass."""
    taps = np.asarray(taps, np.float64)
    back = len(taps) - 1

    def run(x, halo, channel):
        if channel in skip:
            return x
        wet = dsp.fir_filter(taps, np.concatenate([before_of(halo, back), x]))[back:]
        return dry * x + (1 - dry) * wet if dry else wet

    return mapped(with_halo(chunks, back, size), run, "halo", "channel")


def true_peaks(chunks: DataFrame, size: int = SIZE) -> DataFrame:
    """``(asset, channel, peak)``, the greatest magnitude of the fourfold interpolation, with what the filter still holds at the end."""
    phases = dsp.true_peak_phases()
    back = phases.shape[1] - 1

    def run(batches):
        for pdf in batches:
            peaks = []
            for x, halo, last in zip(pdf["x"], pdf["halo"], pdf["last"], strict=True):
                padded = np.concatenate([before_of(halo, back), np.asarray(x, np.float64), np.zeros(back * bool(last))])
                seen = np.lib.stride_tricks.sliding_window_view(padded, back + 1)
                peaks.append(max((float(np.abs(seen[k:k + size] @ phases[:, ::-1].T).max()) for k in range(0, len(seen), size)), default=0.0))
            yield pd.DataFrame({"asset": pdf["asset"], "channel": pdf["channel"], "peak": peaks})

    found = with_halo(chunks, back, size).select(*KEYS, "x", "halo", "last").mapInPandas(run, "asset string, channel string, peak double")
    return found.groupBy(*KEYS).agg(F.max("peak").alias("peak"))


class Linear:
    """``s' = A s + B x``, ``y = C s + D x``: one input, ``len(D)`` outputs, from the state ``first(x0)``, or rest.

    ``out(*ys)`` makes one sequence of the outputs and of the input, given last; without it the first output is it.
    """

    def __init__(self, a, b, c, d, first: Callable[[float], list[float]] | None = None, out: Callable[..., np.ndarray] | None = None):
        self.a, self.b, self.c, self.d = np.atleast_2d(np.asarray(a, float)), np.asarray(b, float), np.atleast_2d(np.asarray(c, float)), np.atleast_1d(np.asarray(d, float))
        self.first, self.out = first, out
        reach = [np.eye(len(self.b))]
        for _ in range(STEP):
            reach.append(self.a @ reach[-1])
        self._jump = reach[STEP]
        self._end = np.stack([reach[STEP - 1 - k] @ self.b for k in range(STEP)])  # (STEP, states)
        self._from = np.stack([self.c @ reach[k] for k in range(STEP)])  # (STEP, outputs, states)
        impulse = np.stack([self.d, *(self.c @ reach[k] @ self.b for k in range(STEP - 1))])  # (STEP, outputs)
        lag = np.arange(STEP)[None, :] - np.arange(STEP)[:, None]
        self._near = np.where((lag >= 0)[..., None], impulse[np.maximum(lag, 0)], 0.0)  # (input, output place, outputs)

    def start(self, x: np.ndarray) -> np.ndarray:
        return np.zeros(len(self.b)) if self.first is None or not len(x) else np.asarray(self.first(float(x[0])), float)

    def states(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state at each whole step, and the state at the end."""
        whole = len(x) // STEP
        pushes = x[:whole * STEP].reshape(whole, STEP) @ self._end
        at = np.empty((whole, len(self.b)))
        for k, push in enumerate(pushes):
            at[k] = state
            state = self._jump @ state + push
        for v in x[whole * STEP:].tolist():
            state = self.a @ state + self.b * v
        return at, state

    def respond(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All outputs, one row each, and the state at the end."""
        at, end = self.states(x, state)
        whole = len(at)
        y = np.empty((len(self.d), len(x)))
        head = x[:whole * STEP].reshape(whole, STEP)
        for k in range(len(self.d)):
            y[k, :whole * STEP] = (head @ self._near[:, :, k] + at @ self._from[:, k].T).ravel()
        s = self._jump @ at[-1] + head[-1] @ self._end if whole else state
        for n in range(whole * STEP, len(x)):
            y[:, n] = self.c @ s + self.d * x[n]
            s = self.a @ s + self.b * x[n]
        return y, end

    def result(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        y, _ = self.respond(x, state)
        return self.out(*y, x) if self.out else y[0]


def series(sections: np.ndarray, **more) -> Linear:
    """Second-order sections, one after the other, as one system."""
    a, b, c, d = np.zeros((0, 0)), np.zeros(0), np.zeros((1, 0)), np.ones(1)
    for b0, b1, b2, _, a1, a2 in np.asarray(sections).tolist():
        own_a, own_b, own_c = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0]), np.array([[1.0, 0.0]])
        a = np.block([[a, np.zeros((len(b), 2))], [np.outer(own_b, c[0]), own_a]])
        b, c, d = np.concatenate([b, own_b * d[0]]), np.concatenate([b0 * c, own_c], axis=1), b0 * d
    return Linear(a, b, c, d, **more)


def beside(*systems: Linear, **more) -> Linear:
    """Systems fed with the same input, their outputs one after the other."""
    n, m = sum(len(s.b) for s in systems), sum(len(s.d) for s in systems)
    a, c, i, j = np.zeros((n, n)), np.zeros((m, n)), 0, 0
    for s in systems:
        a[i:i + len(s.b), i:i + len(s.b)], c[j:j + len(s.d), i:i + len(s.b)] = s.a, s.c
        i, j = i + len(s.b), j + len(s.d)
    return Linear(a, np.concatenate([s.b for s in systems]), c, np.concatenate([s.d for s in systems]), **more)


def carries(chunks: DataFrame, system: Linear, size: int = SIZE, fan: int = FAN, gaps: bool = True) -> DataFrame:
    """``(asset, channel, chunk, state)``: the state that each chunk of ``chunks`` starts from.

    Two levels: ``fan`` chunks' summaries are composed to one, these are scanned for each channel, and
    each is then spread over its chunks again. What is missing between chunks is silence; without
    ``gaps`` each follows the one before it, whatever their lengths.
    """

    def summarise(batches):
        for pdf in batches:
            ends = []
            for chunk, x in zip(pdf["chunk"], pdf["x"], strict=True):
                x = np.asarray(x, np.float64)
                ends.append(system.states(x, system.start(x) if chunk == 0 else np.zeros(len(system.b)))[1])
            yield pd.DataFrame({"asset": pdf["asset"], "channel": pdf["channel"], "chunk": pdf["chunk"], "end": ends, "len": [len(x) for x in pdf["x"]]})

    def walk(at: int, state: np.ndarray, starts, lengths, ends):
        """What each stretch starts from, and where all lead from ``at``; what is missing between them is silence."""
        states = []
        for start, length, end in zip(starts, lengths, ends, strict=True):
            state = np.linalg.matrix_power(system.a, start - at if gaps else 0) @ state
            states.append(state)
            state, at = np.linalg.matrix_power(system.a, length) @ state + np.asarray(end, float), start + length
        return states, state, at

    rest, many = np.zeros(len(system.b)), size * fan

    def compose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        _, end, at = walk(key[2] * many, rest, (pdf["chunk"] * size).tolist(), pdf["len"].tolist(), pdf["end"])
        return pd.DataFrame({"asset": [key[0]], "channel": [key[1]], "group": [key[2]], "end": [end], "len": [at - key[2] * many if gaps else int(pdf["len"].sum())]})

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("group")
        return pdf[[*KEYS, "group"]].assign(state=walk(0, rest, (pdf["group"] * many).tolist(), pdf["len"].tolist(), pdf["end"])[0])

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        start = int(pdf["group"].iloc[0]) * many
        return pdf[[*KEYS, "chunk"]].assign(state=walk(start, np.asarray(pdf["state"].iloc[0], float), (pdf["chunk"] * size).tolist(), pdf["len"].tolist(), pdf["end"])[0])

    kind = "asset string, channel string, {} bigint, {} array<double>"
    ends = chunks.select(*KEYS, "chunk", "x").mapInPandas(summarise, kind.format("chunk", "end") + ", len bigint").withColumn("group", F.expr(f"chunk div {fan}"))
    groups = ends.groupBy(*KEYS, "group").applyInPandas(compose, kind.format("group", "end") + ", len bigint")
    starts = groups.groupBy(*KEYS).applyInPandas(scan, kind.format("group", "state"))
    return ends.join(starts, [*KEYS, "group"]).groupBy(*KEYS, "group").applyInPandas(spread, kind.format("chunk", "state"))


def linear(chunks: DataFrame, system: Linear, size: int = SIZE, fan: int = FAN, gaps: bool = True, skip: tuple[str, ...] = (), settle: bool = True) -> DataFrame:
    """A linear recursion over every channel, by two passes over the chunks and a scan between them. Channels in ``skip`` pass.

    The chunks are computed once, and kept for the second pass, unless ``settle`` says that this has been done.
    """
    chunks = settled(chunks) if settle else chunks

    def run(x, chunk, state, channel):
        if channel in skip:
            return x
        return system.result(x, system.start(x) if chunk == 0 else np.asarray(state, float))

    return mapped(chunks.join(carries(chunks, system, size, fan, gaps), [*KEYS, "chunk"]), run, "chunk", "state", "channel")


def zero_phase(chunks: DataFrame, sections: np.ndarray, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """Forward and backward, over an odd extension of both ends and from its steady state; a signal no longer than the extension goes forward only. For signals without gaps."""
    pad = 3 * (2 * len(sections) + 1)
    if size <= pad:
        raise ValueError(f"chunks must be longer than {pad} samples")
    system = series(sections, first=lambda x0: np.concatenate(_steady(sections, x0)))
    chunks = settled(chunks)
    tops = chunks.groupBy(*KEYS).agg(F.max("chunk").alias("top"), F.max_by(F.size("x"), "chunk").alias("rest"))
    long = F.col("top") * size + F.col("rest") > pad
    known = with_halo(chunks, pad + 1, size).join(tops, KEYS)
    known = settled(known)
    short = linear(known.where(~long).select(*KEYS, "chunk", "x"), series(sections), size, fan, settle=False)

    def extend(x, chunk, halo, last):
        head = 2 * x[0] - x[pad:0:-1] if chunk == 0 and len(x) > pad else np.empty(0)
        end = np.concatenate([np.asarray(halo, float), x])
        tail = 2 * end[-1] - end[-2:-pad - 2:-1] if last else np.empty(0)
        return np.concatenate([head, x, tail])

    def turned(rows: DataFrame) -> DataFrame:
        back = mapped(rows, lambda x: x[::-1])
        return back.join(tops, KEYS).select(*KEYS, (F.col("top") - F.col("chunk")).alias("chunk"), "x")

    wide = mapped(known.where(long), extend, "chunk", "halo", "last")
    there = turned(linear(wide, system, size, fan, False))
    back = turned(linear(there, system, size, fan, False))

    def cut(x, chunk, top):
        return x[pad if chunk == 0 else 0:len(x) - pad if chunk == top else len(x)]

    return mapped(back.join(tops, KEYS), cut, "chunk", "top").unionByName(short)


def _steady(sections: np.ndarray, x0: float) -> list[np.ndarray]:
    """The states of sections that have long been fed with ``x0``."""
    out = []
    for s in np.asarray(sections):
        out.append(dsp.steady_state(s) * x0)
        x0 *= (s[0] + s[1] + s[2]) / (1 + s[4] + s[5])
    return out
