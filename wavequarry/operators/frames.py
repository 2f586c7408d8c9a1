"""Frame engine: spectra of a stereo signal and what is tracked from frame to frame in each bin (W10, R1 to R4, R10, R13, JN12).

One ``FrameEngine`` per asset serves the batch form (a sorted grouped map) and the stream
(state between micro-batches), so both give the same rows however the stream is cut.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavequarry.functions import dsp
from wavequarry.operators import chunks

# Weights of the old value in the running cross-spectrum (attack, release), auto-spectra, band flux and harmonic mask;
# the transient threshold's factor; bands; the median's half width.
ATTACK, RELEASE, AUTO, FLUX, HARMONIC = 0.25, 0.75, 0.6, 0.85, 0.7
SENSITIVITY, BANDS, HALF_WIDTH, EPS = 2.5, 10, 8, 1e-10

#: Coherence of spectra alone: frames of a chunk, frames that warm it up, rounds of correction, values that are walked at a time.
FRAMES, WARM, ROUNDS, WIDE = 2048, 256, 3, 1 << 18

SCHEMA = "asset string, frame bigint, bin int, gamma double, direct double, transient double, harmonic double"


def bands_of(rate: float, bins: int, count: int = BANDS) -> tuple[list[tuple[int, int]], np.ndarray]:
    """First and last bin (exclusive) of each logarithmic band from 20 Hz, and its centre; an empty band has the centre of its edges."""
    top = rate / 2
    hz, edges = np.arange(bins) * top / (bins - 1), np.geomspace(20, top, count + 1)
    ranges, centres = [], []
    for low, high in zip(edges, edges[1:], strict=False):
        own = np.flatnonzero((hz >= low) & (hz < high))
        ranges.append((int(own[0]), int(own[-1]) + 1) if len(own) else (0, 0))
        centres.append((own[0] + own[-1]) / 2 if len(own) else (low + high) / 2 / top * (bins - 1))
    return ranges, np.array(centres)


class FrameEngine:
    """Takes samples in blocks of any length; each whole hop gives a frame that ends with it, silence before the start."""

    def __init__(self, rate: float, size: int):
        if size % 4:
            raise ValueError("the hop must divide the frame")
        self.size, self.hop = size, size // 4
        self._window = dsp.hann(size)
        self._ranges, self._centres = bands_of(rate, size // 2 + 1)
        self.reset()

    def reset(self) -> None:
        self._rest, self._held = np.zeros((2, 0)), np.zeros((2, self.size))
        self.frame, self.flushed = 0, False
        self._shared = self._before = self._mask = None
        self._flux = np.zeros(BANDS)

    def push(self, l: np.ndarray, r: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """``(frame, values)`` of each frame that is now whole; values has a row for gamma, direct, transient and harmonic."""
        return [(k, values) for k, values, _, _ in self.push_spectra(l, r)]

    def push_spectra(self, l: np.ndarray, r: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """The same, with the frame's two spectra."""
        if self.flushed:
            raise ValueError("no input after the flush")
        if len(l) != len(r):
            raise ValueError("both sides must have as many samples")
        rest = np.concatenate([self._rest, np.stack([l, r])], axis=1)
        whole = rest.shape[1] // self.hop * self.hop
        self._rest = rest[:, whole:]
        return [self._step(rest[:, k:k + self.hop]) for k in range(0, whole, self.hop)]

    def flush(self) -> list[tuple[int, np.ndarray]]:
        """Silence up to a hop and then the frame's length but a hop, once."""
        return [(k, values) for k, values, _, _ in self.flush_spectra()]

    def flush_spectra(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        if self.flushed:
            return []
        pad = np.zeros(-self._rest.shape[1] % self.hop + self.size - self.hop)
        out = self.push_spectra(pad, pad)
        self.flushed = True
        return out

    def _step(self, hop: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        self._held = np.concatenate([self._held[:, self.hop:], hop], axis=1)
        left, right = np.fft.rfft(self._held * self._window, axis=1)
        out = self.frame, np.stack([*self._coherence(left, right), self._transient(left, right), self._harmonic(left, right)]), left, right
        self.frame += 1
        return out

    def _coherence(self, left, right):
        gamma, direct, self._shared = coherence_walk(left[None], right[None], self._shared)
        return gamma[0], direct[0]

    def _transient(self, left, right):
        """A band's rise against its running mean, which takes the rise in first; spread over bins by interpolation."""
        m = np.abs(left) + np.abs(right)
        if self._before is None:
            self._before = m
            return np.zeros(len(m))
        rise = np.maximum(0.0, m - self._before)
        self._before = m
        flux = np.array([rise[a:b].sum() for a, b in self._ranges])
        self._flux = FLUX * self._flux + (1 - FLUX) * flux
        return np.interp(np.arange(len(m)), self._centres, np.clip(flux / (SENSITIVITY * self._flux + EPS), 0, 1))

    def _harmonic(self, left, right):
        """Peaks over the median of 17 bins, smoothed."""
        m = (np.abs(left) + np.abs(right)) / 2
        floor = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(m, HALF_WIDTH, mode="reflect"), 2 * HALF_WIDTH + 1), axis=1)
        raw = np.clip((m - floor) / (floor + EPS), 0, 1)
        self._mask = raw if self._mask is None else HARMONIC * self._mask + (1 - HARMONIC) * raw
        return self._mask


def coherence_walk(left: np.ndarray, right: np.ndarray, state: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Gamma and direct of frames (rows of bins), and the state after them: running cross-spectrum and both auto-spectra.

    What agrees in phase with the running cross-spectrum comes in fast. The first frame without a state is the state.
    """
    back, a, b = right.conj(), np.abs(left), np.abs(right)
    new, fast, slow = left * back, (1 - ATTACK) * left * back, (1 - RELEASE) * left * back
    size, own_a, own_b = np.abs(new), (1 - AUTO) * a * a, (1 - AUTO) * b * b
    cross, autos = np.empty_like(new), np.empty((2, *a.shape))
    for k in range(len(new)):
        if state is None:
            state = new[k], a[k] * a[k], b[k] * b[k]
        else:
            lr, ll, rr = state
            seen = np.abs(lr)
            before = np.minimum(seen * seen / (ll * rr + EPS), 1.0)
            agree = (new[k] * lr.conj()).real / (size[k] * seen + EPS)
            state = np.where(agree >= np.sqrt(before), ATTACK * lr + fast[k], RELEASE * lr + slow[k]), AUTO * ll + own_a[k], AUTO * rr + own_b[k]
        cross[k], autos[0, k], autos[1, k] = state
    seen, both = np.abs(cross), autos[0] * autos[1]
    return np.clip(seen * seen / (both + EPS), 0, 1), np.clip(cross.real / (np.sqrt(both) + EPS), 0, 1), state


def _walked(pdf: pd.DataFrame, start: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """``coherence_walk`` over sorted rows, some at a time, from a state as bytes to the next."""
    state = tuple(np.frombuffer(start).reshape(3, -1)) if start else None
    step, gamma, direct = max(1, WIDE // len(pdf["l"].iloc[0])), [], []
    for k in range(0, len(pdf), step):
        l, r = (np.stack(pdf[c].iloc[k:k + step].to_list()).astype(np.float64) for c in "lr")
        g, d, state = coherence_walk(l, r, state)
        gamma.append(g)
        direct.append(d)
    return np.concatenate(gamma), np.concatenate(direct), np.concatenate(state).tobytes()


def _seam(key: tuple, pdf: pd.DataFrame, start: bytes) -> pd.DataFrame:
    return pd.DataFrame({"asset": [key[0]], "chunk": [key[1]], "start": [start], "end": [_walked(pdf, start)[2]]})


def _coherence_starts(rows: DataFrame, size: int, warm: int, rounds: int) -> DataFrame:
    """``(asset, chunk, start)``: the state, to the bit, that each chunk of ``rows(asset, chunk, frame, l, r)`` starts from, empty at the asset's start."""

    def guess(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame", kind="stable")
        lead, own = pdf[pdf["lead"]], pdf[~pdf["lead"]]
        if not len(own):
            return pd.DataFrame({"asset": [key[0]], "chunk": [key[1]], "start": [b""], "end": [b""]})  # no such chunk; taken out below
        return _seam(key, own, _walked(lead, b"")[2] if len(lead) else b"")

    def again(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        return _seam(key, pdf.sort_values("frame", kind="stable"), known["due"].iloc[0])

    def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = (None, None), b""
        for pdf in batches:
            for key, part in pdf.groupby(["asset", "chunk"], sort=False):
                if key[0] != at[0]:
                    state = b""
                if key != at:
                    yield pd.DataFrame({"asset": [key[0]], "chunk": [key[1]], "start": [state]})
                at, state = key, _walked(part, state)[2]

    keys, kind = ["asset", "chunk"], "asset string, chunk bigint, start binary, end binary"
    ends = rows.where(F.pmod("frame", F.lit(size)) >= size - warm).withColumn("chunk", F.col("chunk") + 1)
    led = rows.withColumn("lead", F.lit(False)).unionByName(ends.withColumn("lead", F.lit(True)))
    seams = chunks.settled(led.groupBy(*keys).applyInPandas(guess, kind).where("length(end) > 0"))
    due = F.coalesce(F.lag("end").over(W.partitionBy("asset").orderBy("chunk")), F.expr("X''"))
    for k in range(rounds + 1):
        wrong = chunks.settled(seams.select(*keys, "start", due.alias("due")).where("start <> due").select(*keys, "due"))
        if wrong.isEmpty():
            break
        if k < rounds:
            right = rows.join(wrong, keys, "left_semi").groupBy(*keys).cogroup(wrong.groupBy(*keys)).applyInPandas(again, kind)
            seams = chunks.settled(seams.join(wrong, keys, "left_anti").unionByName(right))
        else:
            left = rows.join(wrong, "asset", "left_semi").repartition("asset").sortWithinPartitions("asset", "frame")
            seams = seams.join(wrong, "asset", "left_anti").select(*keys, "start").unionByName(left.mapInPandas(in_order, "asset string, chunk bigint, start binary"))
    return seams.select(*keys, "start")


def coherence_of(pair: DataFrame, size: int = FRAMES, warm: int = WARM, rounds: int = ROUNDS) -> DataFrame:
    """``(asset, frame, bin, gamma, direct)`` of spectra ``pair(asset, frame, l, r)``, arrays of real bins, one or more.

    The coefficient depends on the state, so states can't be composed; but they forget. Each chunk of ``size`` frames is walked
    from a state that the ``warm`` frames before it give. Where that isn't, bit for bit, the state that the chunk before ends with,
    the chunk is walked again from that one, which may move its own end. What ``rounds`` of this don't settle (silence of many
    chunks) is walked in order, one task for each such asset, in batches. A last pass gives the frames from the right states.
    """
    if not 0 <= warm <= size:
        raise ValueError("the warm-up must lie within a chunk")
    rows = chunks.settled(pair.select("asset", F.col("frame").cast("bigint").alias("frame"), "l", "r").withColumn("chunk", F.expr(f"(frame - pmod(frame, {size})) div {size}")))
    starts = _coherence_starts(rows, size, warm, rounds)

    def run(key: tuple, pdf: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame", kind="stable")
        gamma, direct, _ = _walked(pdf, known["start"].iloc[0])
        return pd.DataFrame({"asset": key[0], "frame": pdf["frame"].to_numpy(), "gamma": list(gamma), "direct": list(direct)})

    done = rows.groupBy("asset", "chunk").cogroup(starts.groupBy("asset", "chunk")).applyInPandas(run, "asset string, frame bigint, gamma array<double>, direct array<double>")
    return done.select("asset", "frame", F.posexplode(F.arrays_zip("gamma", "direct")).alias("bin", "v")).select("asset", "frame", "bin", "v.gamma", "v.direct")


def _rows(asset: str, frames: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
    if not frames:
        return pd.DataFrame(columns=[x.split()[0] for x in SCHEMA.split(", ")])
    bins = frames[0][1].shape[1]
    values = np.concatenate([v for _, v in frames], axis=1)
    return pd.DataFrame({"asset": asset, "frame": np.repeat([k for k, _ in frames], bins), "bin": np.tile(np.arange(bins, dtype=np.int32), len(frames)),
                         "gamma": values[0], "direct": values[1], "transient": values[2], "harmonic": values[3]})


def frame_masks(pair: DataFrame, rate: float, size: int) -> DataFrame:
    """Batch: every bin of every frame of ``pair(asset, n, l, r)``, flush included. One task holds one asset."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n", kind="stable")
        engine = FrameEngine(rate, size)
        return _rows(pdf["asset"].iloc[0], engine.push(pdf["l"].to_numpy(np.float64), pdf["r"].to_numpy(np.float64)) + engine.flush())

    return pair.select("asset", "n", "l", "r").groupBy("asset").applyInPandas(run, SCHEMA)


def frame_mask_stream(blocks: DataFrame, rate: float, size: int, most_waiting: int = 1024) -> DataFrame:
    """Stream: the same from ``blocks(asset, seq, l, r, last)``, blocks of samples numbered without gaps; the one with ``last`` set is followed by the flush.

    A block that comes before its predecessors waits in the state; repeats are dropped. More than
    ``most_waiting`` of an asset's blocks in waiting is an error: one has been lost.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine, nxt, waiting = pickle.loads(state.get[0]) if state.exists else (FrameEngine(rate, size), 0, {})
        for pdf in batches:
            for seq, l, r, last in zip(pdf["seq"], pdf["l"], pdf["r"], pdf["last"], strict=True):
                if seq >= nxt:
                    waiting[int(seq)] = np.asarray(l, np.float64), np.asarray(r, np.float64), bool(last)
        frames = []
        while nxt in waiting:
            l, r, last = waiting.pop(nxt)
            nxt += 1
            frames += engine.push(l, r)
            if last:
                frames += engine.flush()
        if len(waiting) > most_waiting:
            raise ValueError(f"block {nxt} of {key[0]} has not come, and {len(waiting)} wait for it")
        state.update((pickle.dumps((engine, nxt, waiting)),))
        yield _rows(key[0], frames)

    return blocks.groupBy("asset").applyInPandasWithState(step, SCHEMA, "held binary", "append", GroupStateTimeout.NoTimeout)
