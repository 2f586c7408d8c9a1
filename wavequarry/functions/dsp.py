"""Filter design and transforms in NumPy: what the array libraries at hand don't have."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def butterworth(order: int, cutoff: float, rate: float, kind: str = "low") -> np.ndarray:
    """Second-order sections ``(b0, b1, b2, 1, a1, a2)`` of a digital Butterworth filter.

    Analogue poles on the unit circle, scaled to the prewarped cutoff, by the bilinear transform.
    """
    warped = 2 * rate * np.tan(np.pi * cutoff / rate)
    k = np.arange(order)
    poles = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    poles = warped * poles if kind == "low" else warped / poles
    z = (2 * rate + poles) / (2 * rate - poles)
    zero = -1.0 if kind == "low" else 1.0
    upper = sorted((p for p in z if p.imag > 1e-12), key=abs)
    real = [p.real for p in z if abs(p.imag) <= 1e-12]
    sections = [([1.0, -2 * zero, 1.0], [1.0, -2 * p.real, abs(p) ** 2]) for p in upper]
    sections += [([1.0, -zero, 0.0], [1.0, -p, 0.0]) for p in real]
    at = 1.0 if kind == "low" else -1.0  # unit gain at the far end of the pass band
    out = []
    for b, a in sections:
        g = np.polyval(a, at) / np.polyval(b, at)
        out.append([*(np.array(b) * g), *a])
    return np.array(out)


def sos_filter(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Direct form 2 transposed, section after section; the state goes on to the next chunk."""
    y = np.asarray(x, np.float64)
    state = np.zeros((len(sections), 2)) if state is None else state.copy()
    for k, (b0, b1, b2, _, a1, a2) in enumerate(sections.tolist()):
        s1, s2 = state[k].tolist()
        out = []
        for v in y.tolist():
            w = b0 * v + s1
            s1, s2 = b1 * v - a1 * w + s2, b2 * v - a2 * w
            out.append(w)
        y, state[k] = np.array(out), (s1, s2)
    return y, state


def steady_state(section: np.ndarray) -> np.ndarray:
    """The state of a section that has long been fed ones."""
    b0, b1, b2, _, a1, a2 = section
    y = (b0 + b1 + b2) / (1 + a1 + a2)
    s2 = b2 - a2 * y
    return np.array([b1 - a1 * y + s2, s2])


def zero_phase(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over an odd extension, from the steady state."""
    pad = 3 * (2 * len(sections) + 1)
    if len(x) <= pad:
        return sos_filter(sections, x)[0]
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    for _ in range(2):
        start, state = ext[0], []
        for s in sections:
            state.append(steady_state(s) * start)
            start *= (s[0] + s[1] + s[2]) / (1 + s[4] + s[5])
        ext = sos_filter(sections, ext, np.array(state))[0][::-1]
    return ext[pad:-pad]


# The two sections of the loudness weighting at 48 kHz.
K_WEIGHTING_48K = (
    (1.53512485958697, -2.69169618940638, 1.19839281085285, 1.0, -1.69065929318241, 0.73248077421585),
    (1.0, -2.0, 1.0, 1.0, -1.99004745483398, 0.99007225036621),
)


@lru_cache(maxsize=16)
def _k_weighting(rate: int) -> tuple:
    if rate == 48000:
        return K_WEIGHTING_48K
    return tuple(tuple(retarget(np.array(s), 48000, rate)) for s in K_WEIGHTING_48K)


def k_weighting(rate: int) -> np.ndarray:
    """exact at 48 kHz, elsewhere carried over by the inverse and forward bilinear transform."""
    return np.array(_k_weighting(int(rate)))


def retarget(section: np.ndarray, old: float, new: float) -> np.ndarray:
    """A section with the same analogue prototype at another rate: z of the old rate as a ratio of polynomials in the new one's."""
    k = new / old
    up, down = np.array([1 + k, 1 - k]), np.array([1 - k, 1 + k])

    def carried(c):
        return c[0] * np.convolve(up, up) + c[1] * np.convolve(up, down) + c[2] * np.convolve(down, down)

    b, a = carried(section[:3]), carried(section[3:])
    return np.concatenate([b, a]) / a[0]


def frequency_sampled(taps: int, freqs: np.ndarray, gains: np.ndarray) -> np.ndarray:
    """A linear-phase filter (odd taps) through gains given at frequencies from 0 to 1 (half the rate), Hamming-windowed."""
    points = 1 + 2 ** int(np.ceil(np.log2(taps)))
    grid = np.linspace(0, 1, points)
    shift = np.exp(-1j * (taps - 1) / 2 * np.pi * grid)
    h = np.fft.irfft(np.interp(grid, freqs, gains) * shift)
    return h[:taps] * np.hamming(taps)


def minimum_phase(h: np.ndarray, half: bool = False) -> np.ndarray:
    """A minimum-phase filter by the folded cepstrum: with the magnitude of ``h``, or its square root and half the length."""
    n = 2 ** int(np.ceil(np.log2(2 * (len(h) - 1) / 0.01)))
    mag = np.abs(np.fft.fft(h, n))
    mag += 1e-7 * mag[mag > 0].min()
    cep = np.fft.ifft((0.5 if half else 1.0) * np.log(mag)).real
    fold = np.zeros(n)
    fold[0] = fold[n // 2] = 1
    fold[1:n // 2] = 2
    out = np.fft.ifft(np.exp(np.fft.fft(cep * fold))).real
    return out[: len(h) // 2 + len(h) % 2] if half else out[: len(h)]


def fir_from_breakpoints(points: list[tuple[float, float]], rate: float, taps: int = 1023, half: bool = False) -> np.ndarray:
    """an EQ curve of (Hz, dB) breakpoints as a minimum-phase filter; the ends carry on to 0 and half the rate."""
    nyquist = rate / 2
    inner = sorted((f, d) for f, d in points if 0 < f < nyquist)
    if not inner:
        raise ValueError("no breakpoint between 0 and half the rate")
    f = np.array([0.0, *(p[0] for p in inner), nyquist]) / nyquist
    g = 10 ** (np.array([inner[0][1], *(p[1] for p in inner), inner[-1][1]]) / 20)
    keep = np.concatenate([[True], np.diff(f) > 1e-9])
    return minimum_phase(frequency_sampled(taps, f[keep], g[keep]), half)


def fir_filter(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """convolution, cut to the length of ``x``, in blocks of bounded size."""
    block = max(4096, 4 * len(h))
    n = 1 << int(np.ceil(np.log2(block + len(h) - 1)))
    spectrum, out = np.fft.rfft(h, n), np.zeros(len(x) + len(h) - 1)
    for at in range(0, len(x), block):
        part = x[at:at + block]
        y = np.fft.irfft(np.fft.rfft(part, n) * spectrum, n)[: len(part) + len(h) - 1]
        out[at:at + len(y)] += y
    return out[: len(x)]


def resample(x: np.ndarray, old: int, new: int, lobes: int = 10) -> np.ndarray:
    """polyphase by the reduced ratio, through a Kaiser-windowed sinc; ceil(n * up / down) samples."""
    g = int(np.gcd(old, new))
    up, down = new // g, old // g
    if up == down:
        return x.copy()
    wide = max(up, down)
    half = lobes * wide
    h = np.sinc(np.arange(-half, half + 1) / wide) * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    n = -(-len(x) * up // down)
    t = np.arange(n) * down + half  # places in the stuffed signal, after the filter's delay
    out = np.zeros(n)
    first = t // up
    for k in range(-(-len(h) // up)):
        tap = t % up + k * up
        j = first - k
        ok = (tap < len(h)) & (j >= 0) & (j < len(x))
        out[ok] += h[tap[ok]] * x[j[ok]]
    return out


def hann(n: int) -> np.ndarray:
    """Periodic."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """(frames, bins) of complete frames."""
    if size % hop:
        raise ValueError("the hop must divide the frame")
    n = 1 + (len(x) - size) // hop if len(x) >= size else 0
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n] if n else np.empty((0, size))
    return np.fft.rfft(frames * hann(size), axis=1)


def istft(frames: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Overlap-add with the window over the sum of its shifted squares."""
    w = hann(size)
    total = sum(np.roll(w * w, k * hop) for k in range(size // hop))
    out = np.zeros(hop * (len(frames) - 1) + size if len(frames) else 0)
    for k, f in enumerate(np.fft.irfft(frames, size, axis=1)):
        out[k * hop:k * hop + size] += f * w / total
    return out


def welch(x: np.ndarray, rate: float, size: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Power density averaged over half-overlapping Hann frames, each without its mean."""
    size = min(size, len(x))
    w, hop = hann(size), size - size // 2
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    p = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * w, axis=1)) ** 2 / (rate * (w * w).sum())
    p[:, 1:p.shape[1] - (size % 2 == 0)] *= 2
    return np.fft.rfftfreq(size, 1 / rate), p.mean(0)


# The fourfold interpolator of the loudness standard, in order of its impulse response.
TRUE_PEAK_TAPS = (
    0.001708984375, -0.0291748046875, -0.0189208984375, -0.00830078125, 0.010986328125, 0.029296875, 0.0330810546875, 0.0148925781250,
    -0.0196533203125, -0.0517578125, -0.0582275390625, -0.0266113281250, 0.0332031250, 0.0891113281250, 0.1015625, 0.0476074218750,
    -0.0594482421875, -0.1665039062500, -0.2003173828125, -0.1022949218750, 0.1373291015625, 0.4650878906250, 0.7797851562500, 0.9721679687500,
    0.9721679687500, 0.7797851562500, 0.4650878906250, 0.1373291015625, -0.1022949218750, -0.2003173828125, -0.1665039062500, -0.0594482421875,
    0.0476074218750, 0.1015625, 0.0891113281250, 0.0332031250, -0.0266113281250, -0.0582275390625, -0.0517578125, -0.0196533203125,
    0.0148925781250, 0.0330810546875, 0.029296875, 0.010986328125, -0.00830078125, -0.0189208984375, -0.0291748046875, 0.001708984375,
)


def true_peak_phases() -> np.ndarray:
    """four phases of twelve taps; ``phases[p][k]`` meets the sample ``k`` back."""
    return np.array(TRUE_PEAK_TAPS).reshape(12, 4).T
