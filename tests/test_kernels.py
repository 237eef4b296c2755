"""Numeric kernels against analytic signals and brute force."""

import itertools

import numpy as np
import pytest

from tonalis.functions import kernels as K


def test_stft_finds_a_tone_and_scales_by_the_window():
    sr = 8000
    t = np.arange(sr) / sr
    f, times, p = K.stft_power(np.sin(2 * np.pi * 500 * t), sr, 1024, 256)
    assert abs(f[p.mean(axis=0).argmax()] - 500) <= sr / 1024
    assert times[0] == pytest.approx(512 / sr) and len(times) == (sr - 1024) // 256 + 1
    assert p.max() == pytest.approx(0.25, rel=0.05)


def test_stft_of_a_short_recording_is_empty():
    assert K.stft_power(np.zeros(10), 100, 64, 16)[2].shape == (0, 33)


@pytest.mark.parametrize("kind", ["hann", "hamming", "blackman"])
def test_windows_are_symmetric(kind):
    w = K.window(kind, 33)
    assert np.allclose(w, w[::-1]) and w[16] == pytest.approx(1.0)
    with pytest.raises(ValueError):
        K.window("none", 4)


def _gain(sos, w):
    z = np.exp(1j * np.pi * w)
    h = 1.0
    for b0, b1, b2, _, a1, a2 in sos:
        h = h * (b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2)
    return np.abs(h)


def test_butterworth_has_its_corners_at_half_power():
    low = K.butter_sos(4, 0.3)
    assert _gain(low, 1e-9) == pytest.approx(1) and _gain(low, 0.3) == pytest.approx(2**-0.5, rel=1e-6)
    band = K.butter_sos(4, (0.2, 0.4))
    assert _gain(band, 0.2) == pytest.approx(2**-0.5, rel=1e-6) and _gain(band, 0.4) == pytest.approx(2**-0.5, rel=1e-6)
    assert _gain(band, 0.02) < 1e-3 and _gain(band, 0.9) < 1e-3
    cheb = K.cheby1_sos(8, 0.05, 0.08)
    assert _gain(cheb, 1e-9) == pytest.approx(10 ** (-0.05 / 20), rel=1e-6) and _gain(cheb, 0.2) < 1e-4


def test_block_filter_equals_the_recursion():
    rng = np.random.default_rng(0)
    x, sos = rng.standard_normal(1000), K.butter_sos(4, (0.1, 0.3))
    y = x.copy()
    for b0, b1, b2, _, a1, a2 in sos:
        s1 = s2 = 0.0
        out = np.empty_like(y)
        for i, u in enumerate(y):
            v = b0 * u + s1
            s1, s2 = b1 * u - a1 * v + s2, b2 * u - a2 * v
            out[i] = v
        y = out
    assert np.allclose(K.sos_filter(sos, x), y, atol=1e-10)


def test_zero_phase_shifts_nothing():
    t = np.arange(4000) / 1000
    x = np.sin(2 * np.pi * 10 * t)
    y = K.zero_phase(K.butter_sos(4, 0.2), x)
    assert np.abs(x - y)[200:-200].max() < 1e-3


def test_resample_keeps_the_tone_and_checks_its_input():
    t = np.arange(52734) / 52734
    y = K.resample(np.sin(2 * np.pi * 50 * t).astype(np.float32), 52734, 32000)
    assert len(y) == 32000 and y.dtype == np.float32
    assert np.fft.rfft(y).__abs__().argmax() == 50
    x = np.ones(5)
    assert K.resample(x, 7, 7) is x
    for bad in ((np.ones((2, 2)), 1, 2), (x, 0, 2), (x, 2, -1)):
        with pytest.raises(ValueError):
            K.resample(*bad)


def test_demon_finds_the_modulation():
    sr, rng = 32000, np.random.default_rng(1)
    t = np.arange(8 * sr) / sr
    x = (1 + 0.5 * np.sin(2 * np.pi * 12 * t)) * np.sin(2 * np.pi * 2000 * t) + 0.01 * rng.standard_normal(len(t))
    f, _, db = K.demon_power_db(x, sr, (500, 5000), 150, 100, 1024, 256)
    m = db.mean(axis=0)
    m[f < 3] = -200
    assert abs(f[m.argmax()] - 12) < 1 and db.max() == pytest.approx(0, abs=1e-3)


def _brute_peaks(x, height, distance):
    out, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j < len(x) - 1 and x[j + 1] == x[i]:
                j += 1
            if j < len(x) - 1 and x[j + 1] < x[i] and x[i] >= height:
                out.append((i + j) // 2)
            i = j
        i += 1
    keep = set(out)
    for p in sorted(out, key=lambda k: (x[k], k), reverse=True):
        if p in keep:
            keep -= {q for q in out if q != p and abs(q - p) < distance}
    return sorted(keep)


def test_peaks_against_brute_force():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 50, 200):
        for _ in range(20):
            x = rng.integers(0, 6, n).astype(float)
            assert K.find_peaks(x, 2, 4).tolist() == _brute_peaks(x, 2, 4)


def test_assignment_is_optimal():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (2, 4), (4, 2), (4, 4), (5, 3)):
        c = rng.random((n, m))
        a, b = K.assign(c)
        k = min(n, m)
        best = min(sum(c[r, q] for r, q in zip(rows, cols, strict=True)) for rows in itertools.permutations(range(n), k) for cols in itertools.combinations(range(m), k))
        assert c[a, b].sum() == pytest.approx(best) and len(a) == k == len(set(b))
    assert len(K.assign(np.zeros((0, 3)))[0]) == 0


def test_labels_have_no_diagonals():
    lab, n = K.label_4(np.array([[1, 0, 1], [1, 0, 0], [0, 1, 1]], bool))
    assert n == 3 and lab[0, 0] == lab[1, 0] != lab[2, 1] == lab[2, 2]


def test_track_follows_drift_bridges_gaps_and_uses_peaks_once():
    t = np.array([0, 1, 2, 5, 6, 0, 20])
    f = np.array([10, 11, 12, 12, 13, 40, 40])
    v = np.array([9.0, 9, 10, 11, 9, 20, 20])
    got = K.track(t, f, v, 2, 3, 4)
    assert got == [(12, 10, 13, 0, 6, 11.0, 5)]
    assert K.track(t, f, v, 2, 2, 4) == []


def test_track_prefers_the_nearest_then_the_lower():
    got = K.track(np.array([0, 1, 1]), np.array([10, 9, 11]), np.array([9.0, 9, 9]), 2, 2, 1)
    assert got[0][1:3] == (9, 10)


def test_a_filters_response_is_made_once():
    """A recording costs its samples, not the response of the filter anew in each section and pass; results are those of the plain recursion."""
    rng = np.random.default_rng(8)
    sos = K.butter_sos(4, (0.1, 0.3))
    K._block_response.cache_clear()
    for n in (1, 2, 255, 256, 257, 700):
        x, state = rng.normal(2, 1, n), rng.normal(0, 1, (len(sos), 2))
        y, end = K.sos_run(sos, x, state)
        want, z = x.copy(), state.copy()
        for s, (b0, b1, b2, _, a1, a2) in enumerate(sos):
            for t in range(n):
                u = want[t]
                want[t] = b0 * u + z[s, 0]
                z[s] = b1 * u - a1 * want[t] + z[s, 1], b2 * u - a2 * want[t]
        assert np.allclose(y, want, rtol=0, atol=1e-12) and np.allclose(end, z, rtol=0, atol=1e-12)
        K.zero_phase(sos, x)
    assert K._block_response.cache_info().misses == len(sos)


def test_short_recordings_are_filtered_side_by_side(monkeypatch):
    """No block response is made for a filter that is used once; a result doesn't depend on what stands beside it."""
    rng = np.random.default_rng(4)
    waves = [rng.uniform(0, 10, n) for n in (600, 1, 2, 30, 599, 700, 600)] + [np.zeros(500), np.r_[rng.normal(size=3), np.zeros(400)]]
    rates, fs = [1000] * 8 + [900], [10.0, 20.0, 33.0, 445.0, 110.0, 490.0, 2.0, 60.0, 250.0]
    K._block_response.cache_clear()
    got = K.band_rms_each(waves, rates, fs)
    assert K._block_response.cache_info().misses == 0
    assert np.allclose(got, [K.band_rms(*x) for x in zip(waves, rates, fs, strict=True)], rtol=1e-9, atol=0) and got[7] == 0
    assert got == [K.band_rms_each([x], [r], [f])[0] for x, r, f in zip(waves, rates, fs, strict=True)]
    monkeypatch.setattr(K, "SHORT", 600)
    assert K.band_rms_each(waves, rates, fs)[5] == K.band_rms(waves[5], 1000, 490.0)
    cuts = np.array([(0.02, 0.03), (1e-6, 1 - 1e-6), (0.3, 0.9), (0.4, 0.41)])
    assert np.allclose(K.butter_bands(4, cuts), np.stack([K.butter_sos(4, tuple(c)) for c in cuts], axis=2), rtol=1e-12, atol=1e-14)
