"""Numeric kernels in numpy, for what has no relational form. Each takes and returns plain arrays."""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np


def window(kind: str, n: int) -> np.ndarray:
    made = {"hann": np.hanning, "hanning": np.hanning, "hamming": np.hamming, "blackman": np.blackman}
    if kind not in made:
        raise ValueError(f"unknown window {kind!r}; one of {sorted(made)}")
    return made[kind](n)


def stft_power(x: np.ndarray, sample_rate: float, n_fft: int, hop: int, length: int | None = None, kind: str = "hanning") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, frame centres in seconds, power[frame, bin]): scaled by the window's sum, one-sided without doubling, no padding, incomplete tail dropped."""
    x = np.asarray(x, np.float64)
    if x.ndim != 1:
        raise ValueError(f"expected one channel, got shape {x.shape}")
    length = length or n_fft
    w = window(kind, length)
    freqs = np.fft.rfftfreq(n_fft, 1.0 / sample_rate)
    if len(x) < length:
        return freqs, np.zeros(0), np.zeros((0, len(freqs)))
    frames = np.lib.stride_tricks.sliding_window_view(x, length)[::hop]
    z = np.fft.rfft(frames * w, n_fft, axis=1) / w.sum()
    times = (np.arange(len(frames)) * hop + length / 2) / sample_rate
    return freqs, times, z.real**2 + z.imag**2


def butter_sos(order: int, cut: float | tuple[float, float]) -> np.ndarray:
    """Digital Butterworth sections by the bilinear transform; cut in units of the Nyquist rate, a pair for a band pass."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if isinstance(cut, tuple):
        lo, hi = (4 * np.tan(np.pi * c / 2) for c in cut)
        bw, w0 = hi - lo, math.sqrt(hi * lo)
        half = poles * bw / 2
        root = np.sqrt(half**2 - w0**2 + 0j)
        p, z, k = np.r_[half + root, half - root], np.zeros(order, complex), bw**order
    else:
        w0 = 4 * np.tan(np.pi * cut / 2)
        p, z, k = poles * w0, np.zeros(0, complex), w0**order
    return _sections(*_bilinear(z, p, k))


def butter_bands(order: int, cuts: np.ndarray) -> np.ndarray:
    """Sections of many band passes, cuts[k] a pair: those of ``butter_sos``, side by side along the third axis."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))[:, None]
    lo, hi = 4 * np.tan(np.pi * np.asarray(cuts, float).T / 2)
    bw, w0 = hi - lo, np.sqrt(hi * lo)
    half = poles * bw / 2
    root = np.sqrt(half**2 - w0**2 + 0j)
    p = np.concatenate([half + root, half - root])
    # Not np.prod: its last digits depend on how many cascades there are.
    gain, p = np.real((4.0 * bw) ** order / reduce(np.multiply, 4 - p)), (4 + p) / (4 - p)
    plain = (np.count_nonzero(p.imag > 1e-12, axis=0) == order) & (np.count_nonzero(p.imag < -1e-12, axis=0) == order)
    # Of a conjugate pair the upper pole; sections in order of their poles, each with a zero at either end of the circle.
    p = np.where(p.imag > 0, p, np.inf)
    p = np.take_along_axis(p, np.lexsort((np.abs(p.imag), p.real), axis=0)[:order], axis=0)
    sos = np.zeros((order, 6, len(gain)))
    sos[:, 0], sos[:, 2], sos[:, 3], sos[:, 4], sos[:, 5] = 1.0, -1.0, 1.0, -2 * p.real, np.abs(p) ** 2
    sos[0, :3] *= gain
    for k in np.flatnonzero(~plain):  # real poles among them
        sos[:, :, k] = butter_sos(order, (float(cuts[k][0]), float(cuts[k][1])))
    return sos


def _bilinear(z: np.ndarray, p: np.ndarray, k: float) -> tuple[np.ndarray, np.ndarray, float]:
    k = k * np.real(np.prod(4 - z) / np.prod(4 - p))
    zd = np.r_[(4 + z) / (4 - z), -np.ones(len(p) - len(z))]
    return zd, (4 + p) / (4 - p), float(k)


def _sections(z: np.ndarray, p: np.ndarray, k: float) -> np.ndarray:
    """Second-order sections: conjugate poles together, zeros from either end of the circle."""
    p = p[np.lexsort((np.abs(p.imag), p.real))]
    upper = [v for v in p if v.imag > 1e-12]
    real = [v.real for v in p if abs(v.imag) <= 1e-12]
    dens = [(1.0, -2 * v.real, abs(v) ** 2) for v in upper]
    for a in range(0, len(real) - 1, 2):
        dens.append((1.0, -(real[a] + real[a + 1]), real[a] * real[a + 1]))
    if len(real) % 2:
        dens.append((1.0, -real[-1], 0.0))
    zs = sorted(z.real)
    out = []
    for d in dens:
        if d[2] == 0.0 and len(zs) % 2:
            num = (1.0, -zs.pop(0), 0.0)
        elif len(zs) >= 2:
            a, b = zs.pop(0), zs.pop(-1)
            num = (1.0, -(a + b), a * b)
        elif zs:
            num = (1.0, -zs.pop(0), 0.0)
        else:
            num = (1.0, 0.0, 0.0)
        out.append([*num, *d])
    sos = np.array(out)
    sos[0, :3] *= k
    return sos


def sos_filter(sos: np.ndarray, x: np.ndarray, zi: np.ndarray | None = None) -> np.ndarray:
    """One pass of the cascade. The recursion runs over blocks by its impulse response (a block at a time, whole-array work inside)."""
    return sos_run(sos, x, np.zeros((len(sos), 2)) if zi is None else zi)[0]


def sos_run(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass from the sections' ``state`` (rows of two numbers), and the state that it ends in."""
    y, end = np.asarray(x, np.float64), np.array(state, np.float64)
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        y, end[s] = _biquad(y, b0, b1, b2, a1, a2, end[s])
    return y, end


def sos_step(sos: np.ndarray, n: int) -> np.ndarray:
    """The matrix that takes the cascade's state over n samples of silence."""
    size = 2 * len(sos)
    one = np.stack([sos_run(sos, np.zeros(1), unit.reshape(-1, 2))[1].ravel() for unit in np.eye(size)], axis=1)
    return np.linalg.matrix_power(one, n)


def padding(sos: np.ndarray) -> int:
    """Samples of odd extension at either end of a zero-phase pass."""
    return 3 * (2 * len(sos) + 1 - int(min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum())))


@lru_cache(maxsize=32)
def _block_response(b0: float, b1: float, b2: float, a1: float, a2: float, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over a block from rest: the matrix from inputs to outputs; and the responses to either state."""

    def free(v: float, p1: float, p2: float) -> np.ndarray:
        out = [v]
        for _ in range(block - 1):
            v = p1
            p1, p2 = p2 - a1 * v, -a2 * v
            out.append(v)
        return np.array(out)

    h, r1 = free(b0, b1 - a1 * b0, b2 - a2 * b0), free(1.0, -a1, -a2)
    toeplitz = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.r_[h[::-1], np.zeros(block - 1)], block)[::-1])
    return toeplitz, r1, np.r_[0.0, r1[:-1]]  # the second state is the first one a sample later


def _biquad(x: np.ndarray, b0: float, b1: float, b2: float, a1: float, a2: float, state: np.ndarray, block: int = 256) -> tuple[np.ndarray, tuple[float, float]]:
    n = len(x)
    s1, s2 = float(state[0]), float(state[1])
    # State-space over a block: outputs are a Toeplitz product of inputs plus the response to the state.
    b0, b1, b2, a1, a2 = map(float, (b0, b1, b2, a1, a2))
    toeplitz, r1, r2 = _block_response(b0, b1, b2, a1, a2, block)
    y = np.empty(n)
    for at in range(0, n, block):
        u = x[at : at + block]
        m = len(u)
        v = toeplitz[:m, :m] @ u + s1 * r1[:m] + s2 * r2[:m]
        y[at : at + m] = v
        u1, v1 = float(u[-1]), float(v[-1])
        s1 = b1 * u1 - a1 * v1 + b2 * float(u[-2]) - a2 * float(v[-2]) if m >= 2 else b1 * u1 - a1 * v1 + s2
        s2 = b2 * u1 - a2 * v1
    return y, (s1, s2)


def steady(sos: np.ndarray) -> np.ndarray:
    """Section states for a constant input of 1; cascades side by side stand along a third axis."""
    zi, scale = np.zeros((len(sos), 2, *sos.shape[2:])), 1.0
    for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        zi[s] = scale * np.array([gain - b0, b2 - a2 * gain])
        scale *= gain
    return zi


def zero_phase(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward pass with odd extension, so that the filter shifts nothing."""
    ext, pad = _extended(sos, x)
    zi = steady(sos)
    y = sos_filter(sos, ext, zi * ext[0])
    y = sos_filter(sos, y[::-1], zi * y[-1])[::-1]
    return y[pad : len(y) - pad] if pad > 0 else y


def _extended(sos: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, int]:
    """x with its odd extension, and how long that is at either end."""
    x = np.asarray(x, np.float64)
    pad = min(padding(sos), len(x) - 1)
    return (np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x), pad


def zero_phase_each(sos: np.ndarray, waves: list[np.ndarray]) -> list[np.ndarray]:
    """``zero_phase`` of many short recordings, each by its own cascade sos[:, :, k]. All run side by side, sample by sample: a filter used once isn't worth a block response."""
    ext, pads = zip(*(_extended(sos[:, :, k], x) for k, x in enumerate(waves)), strict=True)
    zi, n = steady(sos), max(map(len, ext))
    for _ in range(2):  # forward, then backward over what came out; beyond its end a recording repeats, which changes nothing before
        y = _cascades(sos, np.array([np.resize(e, n) for e in ext]).T, zi * np.array([e[0] for e in ext]))
        ext = [y[: len(e), k][::-1] for k, e in enumerate(ext)]
    return [e[p : len(e) - p] for e, p in zip(ext, pads, strict=True)]


def _cascades(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """One pass of cascades side by side: sos[section, :, k] over x[:, k] from state[section, :, k]. A section works one sample behind the section before it, so that a step takes all of them at once."""
    (n, m), k = x.shape, len(sos)
    b0, b1, b2, _, a1, a2 = (np.ascontiguousarray(sos[:, i]) for i in range(6))
    s1, s2 = (np.ascontiguousarray(state[:, i]) for i in range(2))
    x, out = np.concatenate([x, np.zeros((k - 1, m))]), np.empty((n + k - 1, m))
    u, y, w = np.zeros((k, m)), np.zeros((k, m)), np.empty((k, m))
    for t in range(n + k - 1):
        if t < k:  # later sections have not begun
            c = slice(0, t + 1)
            b0_, b1_, b2_, a1_, a2_, s1_, s2_, u_, y_, w_ = (v[c] for v in (b0, b1, b2, a1, a2, s1, s2, u, y, w))
        u_[1:] = y_[: len(u_) - 1]
        u_[0] = x[t]
        np.multiply(b0_, u_, out=y_)
        y_ += s1_
        np.multiply(b1_, u_, out=s1_)
        s1_ -= np.multiply(a1_, y_, out=w_)
        s1_ += s2_
        np.multiply(b2_, u_, out=s2_)
        s2_ -= np.multiply(a2_, y_, out=w_)
        out[t] = y[-1]
    return out[k - 1 :]


def bandpass(x: np.ndarray, sample_rate: float, low: float, high: float, order: int = 4) -> np.ndarray:
    return zero_phase(butter_sos(order, _band(sample_rate, low, high)), x)


def _band(sample_rate: float, low: float, high: float) -> tuple[float, float]:
    """A band in units of the Nyquist rate."""
    nyq = sample_rate / 2
    lo, hi = max(low / nyq, 1e-6), min(high / nyq, 1 - 1e-6)
    if lo >= hi:
        raise ValueError(f"invalid band [{low}, {high}] at {sample_rate} Hz")
    return lo, hi


def _around(f: float, sample_rate: float, factor: float, least: float) -> tuple[float, float]:
    bw = max(factor * f, least)
    return max(f - bw, 1.0), min(f + bw, sample_rate / 2 - 1.0)


def band_rms(x: np.ndarray, sample_rate: float, f: float, factor: float = 0.1, least: float = 4.0) -> float:
    """RMS around f, over f plus and minus max(factor * f, least)."""
    y = bandpass(x, sample_rate, *_around(f, sample_rate, factor, least))
    return float(np.sqrt(np.mean(y * y)))


#: Samples up to which recordings are filtered side by side; longer ones go by blocks, one at a time.
SHORT = 4096


def band_rms_each(waves: list[np.ndarray], sample_rates: list[float], fs: list[float], factor: float = 0.1, least: float = 4.0) -> list[float]:
    """``band_rms`` of many recordings, each around its own frequency. How one is filtered follows from its length alone, not from what stands beside it."""
    out = [band_rms(x, r, f, factor, least) if len(x) > SHORT else 0.0 for x, r, f in zip(waves, sample_rates, fs, strict=True)]
    short = [k for k, x in enumerate(waves) if len(x) <= SHORT]
    if short:
        sos = butter_bands(4, np.array([_band(sample_rates[k], *_around(fs[k], sample_rates[k], factor, least)) for k in short]))
        for k, y in zip(short, zero_phase_each(sos, [waves[k] for k in short]), strict=True):
            y = np.ascontiguousarray(y)
            out[k] = float(np.sqrt(np.mean(y * y)))
    return out


def cheby1_sos(order: int, ripple_db: float, cut: float) -> np.ndarray:
    eps = math.sqrt(10 ** (0.1 * ripple_db) - 1)
    mu = math.asinh(1 / eps) / order
    theta = np.pi * (2 * np.arange(1, order + 1) - 1) / (2 * order)
    p = -np.sinh(mu) * np.sin(theta) + 1j * np.cosh(mu) * np.cos(theta)
    k = np.real(np.prod(-p)) / (math.sqrt(1 + eps**2) if order % 2 == 0 else 1.0)
    w0 = 4 * np.tan(np.pi * cut / 2)
    return _sections(*_bilinear(np.zeros(0, complex), p * w0, k * w0**order))


def decimate(x: np.ndarray, factor: int) -> np.ndarray:
    """Zero-phase Chebyshev low pass (order 8, 0.05 dB) at 0.8 of the new Nyquist rate, then every factor-th sample."""
    return np.asarray(x, np.float64) if factor == 1 else zero_phase(cheby1_sos(8, 0.05, 0.8 / factor), x)[::factor]


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Polyphase FIR resampling by the reduced ratio, Kaiser window (5.0), length ceil(n * up / down). Type kept; equal rates give the input."""
    x = np.asarray(x)
    if x.ndim != 1:
        raise ValueError(f"expected one channel, got shape {x.shape}")
    if source <= 0 or target <= 0:
        raise ValueError(f"sample rates must be positive: {source}, {target}")
    if source == target:
        return x
    up, down, _, _ = ratio(source, target)
    return resample_part(x, 0, source, target, 0, -(-len(x) * up // down)).astype(x.dtype if x.dtype.kind == "f" else np.float64)


def ratio(source: int, target: int) -> tuple[int, int, int, int]:
    """Up and down factors, half the filter's length, and how many samples a result takes in."""
    g = math.gcd(source, target)
    up, down = target // g, source // g
    half = 10 * max(up, down)
    return up, down, half, -(-(2 * half + 1) // up)


def resample_part(x: np.ndarray, start: int, source: int, target: int, a: int, b: int) -> np.ndarray:
    """Results a to b (exclusive) of a recording of which x is the part from ``start`` on; beyond x is silence."""
    up, down, half, taps = ratio(source, target)
    top = max(up, down)
    t = np.arange(-half, half + 1)
    h = np.sinc(t / top) / top * np.kaiser(2 * half + 1, 5.0)
    h *= up / h.sum()
    x, out, step, k = np.asarray(x, np.float64), np.empty(b - a), 1 << 14, np.arange(taps)
    for at in range(a, b, step):
        pos = np.arange(at, min(at + step, b)) * down + half
        first, phase = pos // up, pos % up
        idx = phase[:, None] + k[None, :] * up
        coef = np.where(idx < len(h), h[np.minimum(idx, len(h) - 1)], 0.0)
        src = first[:, None] - k[None, :] - start
        out[at - a : at - a + len(pos)] = (coef * np.where((src >= 0) & (src < len(x)), x[np.clip(src, 0, max(len(x) - 1, 0))] if len(x) else 0.0, 0.0)).sum(axis=1)
    return out


def demon_power_db(x: np.ndarray, sample_rate: int, band: tuple[float, float], lowpass: float, factor: int, n_fft: int, hop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Envelope spectrum: band pass, square, low pass, decimate, remove the mean, STFT, dB relative to the peak."""
    nyq = sample_rate / 2
    y = zero_phase(butter_sos(4, (band[0] / nyq, band[1] / nyq)), x) ** 2
    y = decimate(zero_phase(butter_sos(4, lowpass / nyq), y), factor)
    f, t, p = stft_power(y - y.mean(), sample_rate / factor, n_fft, hop)
    ref = max(float(p.max(initial=0.0)), float(np.finfo(np.float32).tiny))
    return f, t, 10 * np.log10(p / ref + 1e-6)


def find_peaks(x: np.ndarray, height: float, distance: float) -> np.ndarray:
    """Indices of local maxima >= height (a plateau at its middle, ends never), thinned: the tallest stays, others nearer than ceil(distance) go; of equal heights the later one is kept first."""
    x = np.asarray(x, np.float64)
    if len(x) < 3:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    v = x[change]
    stop = np.r_[change[1:], len(x)] - 1
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    at = (change[top] + stop[top]) // 2
    at = at[x[at] >= height]
    return at[thin(at, x[at], math.ceil(distance))]


def thin(at: np.ndarray, height: np.ndarray, gap: int) -> np.ndarray:
    """Which of the peaks at sorted places stay: the tallest first (of equal ones the later), unless one that stays is nearer than ``gap``."""
    keep = np.ones(len(at), bool)
    for i in np.argsort(height, kind="stable")[::-1]:
        if keep[i]:
            a, b = np.searchsorted(at, [at[i] - gap + 1, at[i] + gap])
            keep[a:b] = False
            keep[i] = True
    return np.flatnonzero(keep)


def track(time: np.ndarray, freq: np.ndarray, snr: np.ndarray, drift_bins: int, gap_bins: int, least_bins: float) -> list[tuple[int, int, int, int, int, float, int]]:
    """Greedy persistence tracking over peaks.

    Peaks are visited by (time, frequency). A run follows, bin by bin, the nearest unused peak
    within the drift of its current frequency (a tie goes to the lower one) as long as the gap
    allows; its peaks stay used whether or not the run lasts. Returns per run of at least
    ``least_bins``: centre (weighted by positive SNR, rounded half to even), lowest and highest
    bin, first and last time, largest SNR, number of peaks.
    """
    order = np.lexsort((freq, time))
    time, freq, snr = time[order], freq[order], snr[order]
    times, first = np.unique(time, return_index=True)
    last = np.r_[first[1:], len(time)]
    row_of = {int(t): k for k, t in enumerate(times)}
    used = np.zeros(len(time), bool)
    out = []
    for s in range(len(time)):
        if used[s]:
            continue
        used[s] = True
        run, f, t_last = [s], int(freq[s]), int(time[s])
        t = t_last + 1
        while t - t_last <= gap_bins:
            k = row_of.get(t)
            if k is not None:
                a, b = first[k], last[k]
                lo = a + np.searchsorted(freq[a:b], f - drift_bins)
                hi = a + np.searchsorted(freq[a:b], f + drift_bins, "right")
                free = [i for i in range(lo, hi) if not used[i]]
                if free:
                    best = min(free, key=lambda i: (abs(int(freq[i]) - f), freq[i]))  # noqa: B023
                    used[best] = True
                    run.append(best)
                    f, t_last = int(freq[best]), t
            t += 1
        if t_last - int(time[s]) >= least_bins:
            fs, w = freq[run].astype(float), np.maximum(snr[run], 0.0)
            centre = (fs * w).sum() / w.sum() if w.sum() > 0 else fs.mean()
            out.append((int(np.rint(centre)), int(fs.min()), int(fs.max()), int(time[s]), t_last, float(snr[run].max()), len(run)))
    return out


def thin_within(at: np.ndarray, height: np.ndarray, gap: int, first: float, last: float) -> tuple[np.ndarray, np.ndarray]:
    """``thin`` of part of a series, of which all peaks at ``first`` to ``last`` are given: which stay, and of which that can't be told without the peaks beyond."""
    keep, unknown = np.zeros(len(at), bool), np.zeros(len(at), bool)
    low, high = np.searchsorted(at, at - gap + 1), np.searchsorted(at, at + gap)
    for i in np.argsort(height, kind="stable")[::-1]:  # whatever is taller is settled before
        if keep[low[i] : high[i]].any():
            continue
        unknown[i] = unknown[low[i] : high[i]].any() or at[i] - gap + 1 < first or at[i] + gap - 1 > last
        keep[i] = not unknown[i]
    return keep, unknown


#: Of a part of a run: place among the runs before and after the chunk (-1: begun, ended inside), number of peaks, first and last time, lowest and highest bin, largest SNR, sums of bin times weight, weight and bin, last bin.
PART = (("i", int), ("o", int), ("n", int), ("a", int), ("b", int), ("lo", int), ("hi", int), ("top", float), ("fw", float), ("w", float), ("fs", float), ("f", int))


def sweep(time: np.ndarray, freq: np.ndarray, snr: np.ndarray, state: list[tuple[int, int]], drift_bins: int, gap_bins: int, end: int) -> tuple[list[tuple], bool]:
    """``track`` as a sweep in time over one chunk of a series (times before ``end``).

    Runs extend in the order of their first peaks whether each is followed to its end before the
    next begins, as there, or all of them step by step, so a chunk needs no more of what is before it than the
    runs still open, in order: ``state``, their last bin and time. Returns a PART of each run of
    the chunk, and whether two runs of ``state`` wanted one peak, so that their order matters.
    """
    order = np.lexsort((freq, time))
    t_, f_, v_ = time[order].tolist(), freq[order].tolist(), snr[order].tolist()
    taken = [-2] * len(t_)  # place of the run that has the peak; -1 for one begun here
    run = lambda i, f, t: [i, -1, 0, 0, t, 1 << 30, -(1 << 30), -np.inf, 0.0, 0.0, 0.0, f]
    runs = [run(i, f, t) for i, (f, t) in enumerate(state)]
    done, contended = [], False

    def add(r: list, k: int) -> None:
        w = max(v_[k], 0.0)
        if not r[2]:
            r[3] = t_[k]
        r[2] += 1
        r[4], r[5], r[6], r[7] = t_[k], min(r[5], f_[k]), max(r[6], f_[k]), max(r[7], v_[k])
        r[8], r[9], r[10], r[11] = r[8] + f_[k] * w, r[9] + w, r[10] + f_[k], f_[k]
        taken[k] = r[0]

    a = 0
    while a < len(t_):
        b = a
        while b < len(t_) and t_[b] == t_[a]:
            b += 1
        alive = []
        for r in runs:
            if t_[a] - r[4] > gap_bins:
                done.append(r)
                continue
            alive.append(r)
            best = wish = None
            for k in range(a, b):
                d = abs(f_[k] - r[11])
                if d <= drift_bins:
                    if wish is None or d < abs(f_[wish] - r[11]):
                        wish = k
                    if taken[k] == -2 and (best is None or d < abs(f_[best] - r[11])):
                        best = k
            if r[0] >= 0 and wish is not None and taken[wish] >= 0:
                contended = True
            if best is not None:
                add(r, best)
        for k in range(a, b):
            if taken[k] == -2:
                alive.append(run(-1, 0, 0))
                add(alive[-1], k)
        runs, a = alive, b
    out = 0
    for r in runs:
        if end - r[4] <= gap_bins:
            r[1], out = out, out + 1
    return [tuple(r) for r in done + runs], contended


def joined(a: tuple, b: tuple) -> tuple:
    """PART of a run from those of two chunks that follow each other."""
    if not b[2]:
        return (a[0], b[1], *a[2:])
    if not a[2]:
        return (a[0], *b[1:])
    return (a[0], b[1], a[2] + b[2], a[3], b[4], min(a[5], b[5]), max(a[6], b[6]), max(a[7], b[7]), a[8] + b[8], a[9] + b[9], a[10] + b[10], b[11])


def line_of(p: tuple) -> tuple[int, int, int, int, int, float, int]:
    """The row of ``track`` of a whole run."""
    centre = p[8] / p[9] if p[9] > 0 else p[10] / p[2]
    return (int(np.rint(centre)), p[5], p[6], p[3], p[4], p[7], p[2])


def label_4(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """4-connected components of a boolean image: labels from 1 in order of their first cell, and how many."""
    n = mask.size
    root = np.arange(n).reshape(mask.shape)
    a = np.r_[root[:, :-1][mask[:, :-1] & mask[:, 1:]], root[:-1][mask[:-1] & mask[1:]]]
    b = np.r_[root[:, 1:][mask[:, :-1] & mask[:, 1:]], root[1:][mask[:-1] & mask[1:]]]
    r = np.arange(n)
    while len(a):
        low = np.minimum(r[a], r[b])
        new = r.copy()
        np.minimum.at(new, r[a], low)
        np.minimum.at(new, r[b], low)
        new = new[new[new]]
        if (new == r).all():
            break
        r = new
    out = np.zeros(n, np.int64)
    on = np.flatnonzero(mask.ravel())
    roots, inv = np.unique(r[on], return_inverse=True)
    out[on] = inv + 1
    return out.reshape(mask.shape), len(roots)


def assign(cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minimum-cost one-to-one assignment of a rectangular matrix by shortest augmenting paths; rows ascending."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return np.zeros(0, int), np.zeros(0, int)
    turned = cost.shape[0] > cost.shape[1]
    c = cost.T if turned else cost
    n, m = c.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, seen, back = np.full(m + 1, np.inf), np.zeros(m + 1, bool), np.zeros(m + 1, int)
        while owner[j]:
            seen[j] = True
            r = owner[j]
            slack = c[r - 1] - u[r] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better], back[1:][better] = slack[better], j
            free = np.where(seen, np.inf, least)
            free[0] = np.inf
            k = int(free.argmin())
            d = free[k]
            u[owner[seen]] += d
            v[seen] -= d
            least[~seen] -= d
            j = k
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    cols = np.flatnonzero(owner[1:])
    rows = owner[1:][cols] - 1
    a, b = (cols, rows) if turned else (rows, cols)
    o = np.argsort(a)
    return a[o], b[o]
