"""Spectra of a stereo pair to spectra and samples of a layout.

Where each channel's spectrum comes from is a small relation, ``sends``: a source, masks over the bins,
a gain and a control. It is evaluated on whatever has products and sums: on columns, real and
imaginary parts apart, over stored spectra (``route_spectra``), and on arrays of a frame in
``UpmixEngine``, which goes from samples to samples with all state between blocks.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wavequarry.catalog import OUTPUT_LAYOUTS
from wavequarry.functions import dsp
from wavequarry.operators import chunks
from wavequarry.operators.folds import allpass_system
from wavequarry.operators.frames import EPS, FrameEngine


@dataclass(frozen=True)
class Routing:
    """Fixed values, which a caller may change: extraction, gains by class, corners in Hz, and how much the content decides."""

    extraction: float = 0.85
    attenuation: float = 0.5
    center: float = 0.85
    lfe: float = 0.31622776601683794
    surround: float = 0.6
    back: float = 0.55
    height: float = 0.55
    lfe_hz: float = 120.0
    lfe_order: int = 4
    bass_hz: float = 250.0
    air_hz: float = 4000.0
    low_hz: float = 150.0
    low_gain: float = 0.15
    shelf_hz: float = 3000.0
    shelf_width: float = 2000.0
    shelf_gain: float = 1.5
    gate_least: float = 0.15
    content: float = 1.0
    detail: float = 0.4125


@dataclass(frozen=True)
class Send:
    """A channel's spectrum: a source times masks, a gain, and the control of its class; ``detail`` says that the detail control bears on it."""

    channel: str
    source: str
    masks: tuple[str, ...]
    gain: float
    control: str | None
    detail: bool = False


def sends(layout: str, r: Routing = Routing()) -> list[Send]:
    """The frame form's relation. ``side`` is half the difference, ``edis`` its negative; channels that the layout lacks have no row."""
    wide = ("bass", "diffuse")
    all_ = [Send("FL", "l", ("front",), 1.0, "front"), Send("FR", "r", ("front",), 1.0, "front"), Send("C", "mid", ("center",), r.center, None), Send("LFE", "mid", ("low",), r.lfe, None)]
    for left, right, more, gain, control in (("SL", "SR", (), r.surround, "surround"), ("BL", "BR", (), r.back, "back"),
                                             ("TFL", "TFR", ("air", "elevation"), r.height, "height"), ("TBL", "TBR", ("elevation",), r.height, "height")):
        all_ += [Send(left, "side", wide + more, gain, control, True), Send(right, "edis", wide + more, gain, control, True)]
    have = OUTPUT_LAYOUTS[layout].split()
    return [s for s in all_ if s.channel in have]


def whole_sends(layout: str, r: Routing = Routing()) -> list[Send]:
    """The whole-signal form's relation. Nothing is harmonic or transient there, the centre follows the
    coherence, front heights are the signal itself under the elevation mask, and there are no controls."""
    wide = ("bass", "width")
    all_ = [Send("FL", "l", ("front",), 1.0, None), Send("FR", "r", ("front",), 1.0, None), Send("C", "mid", ("center",), r.center, None), Send("LFE", "mid", ("low",), r.lfe, None)]
    for left, right, a, b, masks, gain in (("SL", "SR", "side", "edis", wide, r.surround), ("BL", "BR", "side", "edis", wide, r.back),
                                           ("TFL", "TFR", "l", "r", ("elevation",), r.height), ("TBL", "TBR", "side", "edis", (*wide, "elevation"), r.height)):
        all_ += [Send(left, a, masks, gain, None), Send(right, b, masks, gain, None)]
    have = OUTPUT_LAYOUTS[layout].split()
    return [s for s in all_ if s.channel in have]


def fixed_masks(hz, r: Routing, exp: Callable, sqrt: Callable) -> dict:
    """Masks that depend on the bin's frequency alone."""
    rise = lambda at, width: 1 / (1 + exp(-(hz - at) / (width / 4)))
    elevation = (r.low_gain + (1 - r.low_gain) * rise(r.low_hz, r.low_hz)) * (1 + (r.shelf_gain - 1) * rise(r.shelf_hz, r.shelf_width))
    return {"bass": rise(r.bass_hz, r.bass_hz), "air": rise(r.air_hz, r.air_hz), "elevation": elevation, "low": 1 / sqrt(1 + (hz / r.lfe_hz) ** (2 * r.lfe_order))}


def moving_masks(left, right, gamma, direct, transient, harmonic, r: Routing, magnitude: Callable) -> dict:
    """Masks from what is tracked in each bin: the front pair gives up what the centre takes, and what spreads is incoherent, noisy and sustained."""
    a, b = magnitude(left), magnitude(right)
    lean = (a - b) / (a + b + EPS)
    weight = direct * (1 - magnitude(lean))
    width = 1 - gamma
    gate = r.gate_least + (1 - r.gate_least) * (1 - transient)
    return {"center": r.extraction * weight, "front": 1 - r.attenuation / 2 * weight, "width": width,
            "diffuse": (1 - r.content) * width + r.content * (width * (1 - harmonic) * gate)}


def routed(relation: list[Send], left, right, masks: dict, r: Routing = Routing(), controls: dict | None = None) -> dict:
    """Each channel's value from the sources' values: a product for each row of the relation."""
    side = (left - right) * 0.5
    sources = {"l": left, "r": right, "mid": (left + right) * 0.5, "side": side, "edis": -side}
    out = {}
    for s in relation:
        v = sources[s.source] * s.gain
        for m in s.masks:
            v = v * masks[m]
        if controls and s.control:
            v = v * controls.get(s.control, 1.0)
        if controls and s.detail:
            v = v * (1 + r.detail * controls.get("detail", 0.0))
        out[s.channel] = v
    return out


def route_spectra(spectra: DataFrame, layout: str, bin_hz: float, r: Routing = Routing(), whole: bool = False, controls: DataFrame | None = None) -> DataFrame:
    """``(asset, frame, bin, channel, re, im)`` of every channel from ``spectra(asset, frame, bin, lr, li, rr, ri, gamma, direct, transient, harmonic)``.

    A frame's bins are rows, so nothing is shuffled, but for the ``controls(asset, frame, front, surround, back, height, detail)``
    that join it if they are given. ``whole`` takes the form for whole signals.
    """
    c = F.col
    flat = lambda a, b: F.sqrt(c(a) * c(a) + c(b) * c(b))
    size = {"l": flat("lr", "li"), "r": flat("rr", "ri")}
    still = F.lit(0.0)
    masks = fixed_masks(c("bin") * F.lit(float(bin_hz)), r, F.exp, F.sqrt)
    masks |= moving_masks("l", "r", c("gamma"), c("gamma" if whole else "direct"), still if whole else c("transient"), still if whole else c("harmonic"), r,
                          lambda x: size[x] if isinstance(x, str) else F.abs(x))
    names = ("front", "surround", "back", "height", "detail")
    if controls is not None and not whole:
        spectra = spectra.join(controls.select("asset", "frame", *names), ["asset", "frame"])
    own = {n: c(n) for n in names} if controls is not None and not whole else None
    relation = (whole_sends if whole else sends)(layout, r)
    re, im = (routed(relation, c(a), c(b), masks, r, own) for a, b in (("lr", "rr"), ("li", "ri")))
    rows = F.array(*(F.struct(F.lit(s.channel).alias("channel"), re[s.channel].alias("re"), im[s.channel].alias("im")) for s in relation))
    return spectra.select("asset", "frame", "bin", F.inline(rows))


def controller_weights(rate: float, hop: int) -> tuple[float, float]:
    """What the old gain keeps at each frame, when it falls (20 ms) and when it rises (500 ms)."""
    return float(np.exp(-hop / (rate * 0.020))), float(np.exp(-hop / (rate * 0.500)))


class UpmixEngine:
    """Stereo samples in blocks of any length to the samples of a layout, in order.

    Frames are routed, held to the source's energy by one gain for all channels (R5), laid over each other
    under the synthesis window (W11), and the back pair goes through an all-pass (R6). With ``trim`` the first
    ``size - hop`` samples, which are the frames' delay, are dropped, and the flush ends with the input's
    length (R12). ``controls(frame)`` gives the spatial plan's controls of a frame.
    """

    def __init__(self, rate: float, size: int, layout: str, r: Routing = Routing(), linked: bool = True, trim: bool = True, controls: Callable[[int], dict] | None = None):
        self.masks, self._r, self._trim, self._linked, self._controls = FrameEngine(rate, size), r, trim, linked, controls
        self._hop, self._size = self.masks.hop, size
        self._sends = sends(layout, r)
        self.channels = [s.channel for s in self._sends]
        self._fixed = fixed_masks(np.arange(size // 2 + 1) * rate / size, r, np.exp, np.sqrt)
        w = dsp.hann(size)
        self._synthesis = w / np.maximum(sum(np.roll(w * w, k * self._hop) for k in range(size // self._hop)), 1e-10)
        self._fall, self._rise = controller_weights(rate, self._hop)
        self._apart = allpass_system(0.7)
        self.reset()

    def reset(self) -> None:
        self.masks.reset()
        self._laid = np.zeros((len(self.channels), self._size))
        self._gain, self._taken, self._given = 1.0, 0, 0
        self._states = {c: np.zeros(1) for c in ("BL", "BR") if c in self.channels}

    def push(self, l: np.ndarray, r: np.ndarray) -> tuple[int, np.ndarray]:
        """Where the samples begin that are now whole, and these, a row for each channel."""
        self._taken += len(l)
        return self._give([self._step(k, v, a, b) for k, v, a, b in self.masks.push_spectra(l, r)])

    def flush(self) -> tuple[int, np.ndarray]:
        """What the frames still hold, once; no input after it."""
        out = self._give([self._step(k, v, a, b) for k, v, a, b in self.masks.flush_spectra()])
        if not self._trim:
            return out
        start, y = out
        return start, y[:, :max(0, self._taken - start)]

    def _give(self, hops: list[np.ndarray]) -> tuple[int, np.ndarray]:
        y = np.concatenate(hops, axis=1) if hops else np.zeros((len(self.channels), 0))
        start, late = self._given, self._size - self._hop if self._trim else 0
        self._given += y.shape[1]
        return max(0, start - late), y[:, max(0, late - start):]

    def _step(self, frame: int, tracked: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        masks = self._fixed | moving_masks(left, right, *tracked, self._r, np.abs)
        found = routed(self._sends, left, right, masks, self._r, self._controls(frame) if self._controls else None)
        spectra = np.stack([found[c] for c in self.channels])
        if self._linked:
            spectra = spectra * self._held(np.sum(np.abs(left) ** 2) + np.sum(np.abs(right) ** 2), np.sum(np.abs(spectra) ** 2))
        self._laid += np.fft.irfft(spectra, self._size, axis=1) * self._synthesis
        out = self._laid[:, :self._hop].copy()
        self._laid = np.concatenate([self._laid[:, self._hop:], np.zeros((len(self.channels), self._hop))], axis=1)
        for c, state in self._states.items():
            k = self.channels.index(c)
            y, self._states[c] = self._apart.respond(out[k], state)
            out[k] = y[0]
        return out

    def _held(self, source: float, out: float) -> float:
        if source <= 1e-20 or out <= 1e-20:
            return 1.0
        most = 10 ** (6 / 20)
        target = min(most, max(1 / most, (source / out) ** 0.5))
        keep = self._fall if target < self._gain else self._rise
        self._gain = keep * self._gain + (1 - keep) * target
        return self._gain


SAMPLES = "asset string, channel string, start bigint, x array<double>"


def _rows(asset: str, channels: list[str], start: int, y: np.ndarray) -> pd.DataFrame:
    if not y.shape[1]:
        return pd.DataFrame(columns=["asset", "channel", "start", "x"])
    return pd.DataFrame({"asset": asset, "channel": channels, "start": start, "x": list(y)})


def upmix(pair: DataFrame, rate: float, size: int, layout: str, r: Routing = Routing(), linked: bool = True, trim: bool = True, block: int = chunks.SIZE,
          controls: DataFrame | None = None, control_hop: int = 1) -> DataFrame:
    """Batch: ``(asset, channel, n, x)`` of ``pair(asset, n, l, r)``. The engine's state goes from frame to frame, so one task takes an asset.

    ``controls(asset, k, front, surround, back, height, detail)`` hold for the frames that begin in their ``control_hop`` samples, the last ones to the end (JN5).
    """

    def run(pdf: pd.DataFrame, plan: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(pdf):
            return _rows("", [], 0, np.zeros((0, 0)))
        pdf = pdf.sort_values("n", kind="stable")
        steps = plan.sort_values("k").drop(columns=["asset", "k"]).to_dict("records") if plan is not None and len(plan) else None
        at = (lambda frame: steps[min(frame * (size // 4) // control_hop, len(steps) - 1)]) if steps else None
        engine, asset = UpmixEngine(rate, size, layout, r, linked, trim, at), pdf["asset"].iloc[0]
        left, right = pdf["l"].to_numpy(np.float64), pdf["r"].to_numpy(np.float64)
        out = [_rows(asset, engine.channels, *engine.push(left[k:k + block], right[k:k + block])) for k in range(0, len(left), block)]
        out.append(_rows(asset, engine.channels, *engine.flush()))
        return pd.concat([x for x in out if len(x)]) if any(len(x) for x in out) else out[0]

    own = pair.select("asset", "n", "l", "r").groupBy("asset")
    if controls is None:
        return samples(own.applyInPandas(lambda pdf: run(pdf), SAMPLES))
    plan = controls.select("asset", "k", "front", "surround", "back", "height", "detail").groupBy("asset")
    return samples(own.cogroup(plan).applyInPandas(lambda pdf, steps: run(pdf, steps), SAMPLES))


def samples(rows: DataFrame) -> DataFrame:
    """``(asset, channel, n, x)`` of rows of samples."""
    return rows.select("asset", "channel", "start", F.posexplode("x").alias("i", "x")).select("asset", "channel", (F.col("start") + F.col("i")).cast("bigint").alias("n"), "x")


def upmix_stream(blocks: DataFrame, rate: float, size: int, layout: str, r: Routing = Routing(), linked: bool = True, trim: bool = True, most_waiting: int = 1024) -> DataFrame:
    """Stream: rows of samples, in order for each channel, from ``blocks(asset, seq, l, r, last)``, which are numbered without gaps; the one with ``last`` set is followed by the flush.

    All that goes from frame to frame is in the state, so a query that is started again from its checkpoint
    goes on where it was. A block that comes early waits there, repeats are dropped, a block after the last one is an error,
    and so are more than ``most_waiting`` blocks in waiting: one has been lost.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        engine, nxt, waiting, ended = pickle.loads(state.get[0]) if state.exists else (UpmixEngine(rate, size, layout, r, linked, trim), 0, {}, False)
        for pdf in batches:
            for seq, l, right, last in zip(pdf["seq"], pdf["l"], pdf["r"], pdf["last"], strict=True):
                if seq >= nxt:
                    if ended:
                        raise ValueError(f"block {seq} of {key[0]} comes after the last one")
                    waiting[int(seq)] = np.asarray(l, np.float64), np.asarray(right, np.float64), bool(last)
        out = []
        while nxt in waiting and not ended:
            l, right, ended = waiting.pop(nxt)
            nxt += 1
            out.append(_rows(key[0], engine.channels, *engine.push(l, right)))
            if ended:
                out.append(_rows(key[0], engine.channels, *engine.flush()))
        if ended and waiting:
            raise ValueError(f"block {min(waiting)} of {key[0]} comes after the last one")
        if len(waiting) > most_waiting:
            raise ValueError(f"block {nxt} of {key[0]} has not come, and {len(waiting)} wait for it")
        state.update((pickle.dumps((engine, nxt, waiting, ended)),))
        yield from (x for x in out if len(x))

    return blocks.groupBy("asset").applyInPandasWithState(step, SAMPLES, "held binary", "append", GroupStateTimeout.NoTimeout)

