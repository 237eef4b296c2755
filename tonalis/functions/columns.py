"""Scalar functions of the engine as Column expressions: all stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int

#: SNR buckets of the evaluation, as (label, lower edge, upper edge); fixed values.
SNR_BUCKETS = (("<0", None, 0.0), ("0-5", 0.0, 5.0), ("5-8", 5.0, 8.0), ("8-12", 8.0, 12.0), ("12-20", 12.0, 20.0), (">=20", 20.0, None))
MERGED_BUCKETS = (("<5", None, 5.0), ("5-8", 5.0, 8.0), ("8-12", 8.0, 12.0), (">=12", 12.0, None))
MANIFEST_BUCKETS = (("<5", None, 5.0), ("5-10", 5.0, 10.0), ("10-15", 10.0, 15.0), ("15-20", 15.0, 20.0), (">20", 20.0, None))


def col(x: Num) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def hann(i: Column, n: int) -> Column:
    """Symmetric Hann window of n points at index i."""
    return F.lit(1.0) if n == 1 else 0.5 - 0.5 * F.cos(F.lit(2.0) * F.pi() * i / F.lit(float(n - 1)))


def hamming(i: Column, n: int) -> Column:
    return F.lit(1.0) if n == 1 else 0.54 - 0.46 * F.cos(F.lit(2.0) * F.pi() * i / F.lit(float(n - 1)))


def blackman(i: Column, n: int) -> Column:
    if n == 1:
        return F.lit(1.0)
    x = F.lit(2.0) * F.pi() * i / F.lit(float(n - 1))
    return 0.42 - 0.5 * F.cos(x) + 0.08 * F.cos(2.0 * x)


WINDOWS = {"hann": hann, "hanning": hann, "hamming": hamming, "blackman": blackman}


def window_value(kind: str, i: Column, n: int) -> Column:
    if kind not in WINDOWS:
        raise ValueError(f"unknown window {kind!r}; one of {sorted(WINDOWS)}")
    return WINDOWS[kind](i, n)


def power_db(p: Column, epsilon: float = 1e-10) -> Column:
    return 10.0 * F.log10(p + F.lit(epsilon))


def peak_relative_db(p: Column, peak: Column) -> Column:
    """Relative to the recording's peak, whose floor is the smallest normal 32-bit float."""
    return 10.0 * F.log10(p / F.greatest(peak, F.lit(1.1754943508222875e-38)) + F.lit(1e-6))


def temporal_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; 0 where either is empty or they don't meet."""
    both = F.least(a1, b1) - F.greatest(a0, b0)
    union = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when((both <= 0) | (union <= 0), 0.0).otherwise(both / union)


def frequency_proximity(fa: Column, fb: Column, resolution: Num) -> Column:
    """1 within two bins, 0.5 within four, else 0."""
    d = F.abs(fa - fb)
    return F.when(d <= 2.0 * col(resolution), 1.0).when(d <= 4.0 * col(resolution), 0.5).otherwise(0.0)


def line_iou(fa: Column, a0: Column, a1: Column, fb: Column, b0: Column, b1: Column, resolution: Num) -> Column:
    return frequency_proximity(fa, fb, resolution) * temporal_overlap(a0, a1, b0, b1)


def bucket(x: Column, buckets: Sequence[tuple[str, float | None, float | None]] = SNR_BUCKETS) -> Column:
    """Label of the half-open bucket; NaN and infinity go to the last, null stays null."""
    steps = reduce(lambda c, b: c.when(x < F.lit(b[2]), b[0]), buckets[1:-1], F.when(x < F.lit(buckets[0][2]), buckets[0][0]))
    return F.when(x.isNotNull(), steps.otherwise(buckets[-1][0]))


def clipped(p: Column, floor: float = 1e-12) -> Column:
    return F.greatest(F.lit(floor), F.least(F.lit(1.0 - floor), p))


def binary_entropy(p: Column) -> Column:
    """In nats, with p kept off 0 and 1."""
    c = clipped(p.cast("double"))
    return -(c * F.ln(c) + (1.0 - c) * F.ln(1.0 - c))


def reflected(i: Column, n: int) -> Column:
    """Place in 0..n-1 of the i-th cell beyond the start of an axis that is reflected at its ends."""
    if n == 1:
        return i * 0
    k = F.pmod(i, F.lit(2 * n - 2))
    return F.when(k < n, k).otherwise(F.lit(2 * n - 2) - k)


def hop_seconds(times: Column, sample_rate: int, hop: int) -> Column:
    """Hop of a gram from its time axis (array of seconds), or from the configuration where the axis has fewer than two entries."""
    return F.when(F.size(times) >= 2, F.get(times, F.lit(1)) - F.get(times, F.lit(0))).otherwise(F.lit(hop / sample_rate))


def thorpe_db_per_km(f_hz: Column) -> Column:
    """Thorpe's volume absorption of sound in sea water (1967)."""
    f2 = F.pow(f_hz / 1000.0, F.lit(2.0))
    return 3.3e-3 + 0.11 * f2 / (1.0 + f2) + 44.0 * f2 / (4100.0 + f2) + 3.0e-4 * f2


def slant_ranges(horizontal: Column, source: Column, receiver: Column, water: Column) -> tuple[Column, Column, Column]:
    """Lengths of the direct, surface and bottom paths (images of the source)."""
    leg = lambda v: F.sqrt(horizontal * horizontal + v * v)
    return leg(source - receiver), leg(source + receiver), leg(2.0 * water - source - receiver)


def three_path_response(f_hz: Column, horizontal: Column, source: Column, receiver: Column, water: Column, loss_db: Column, speed: Num = 1500.0) -> tuple[Column, Column]:
    """Real and imaginary part of direct path, inverted surface bounce and lossy bottom bounce."""
    alpha = thorpe_db_per_km(f_hz)
    gains = (F.lit(1.0), F.lit(-1.0), F.pow(F.lit(10.0), -loss_db / 20.0))
    re = im = F.lit(0.0)
    for r, gain in zip(slant_ranges(horizontal, source, receiver, water), gains, strict=True):
        a = gain / r * F.pow(F.lit(10.0), -alpha * r / 20000.0)
        phase = 2.0 * F.pi() * f_hz * r / col(speed)
        re, im = re + a * F.cos(phase), im - a * F.sin(phase)
    return re, im


def taper_gate(i: Column, start: Num, end: Num, fade: Num) -> Column:
    """Gate over sample indices: 0 outside [start, end), cosine edges of ``fade`` samples; where they overlap the fade-out holds."""
    s, e, f = (x if isinstance(x, Column) else F.lit(int(x)) for x in (start, end, fade))
    f = F.greatest(F.lit(1), f)
    edge = lambda d: 0.5 * (1.0 - F.cos(F.pi() * d / f))
    return F.when((i < s) | (i >= e), 0.0).when(i >= e - f, edge(e - i)).when(i < s + f, edge(i - s)).otherwise(1.0)


def tonal_amplitude(local_rms: Column, snr_db: Column) -> Column:
    return local_rms * F.pow(F.lit(10.0), snr_db / 20.0) * F.sqrt(F.lit(2.0))


def harmonic_snr(snr_db: Column, h: Column, decay: Column) -> Column:
    return snr_db + 20.0 * h * F.log10(decay)


def patches_per_hour(stride: int, hop: int, sample_rate: int) -> float:
    return 3600.0 / (stride * hop / sample_rate)


def merge_tolerance(drift_bins: int, bin_hz: float, n_bins: int) -> float:
    """Default tolerance of the line merge; 0 on a gram of fewer than two bins."""
    return 2.0 * drift_bins * bin_hz if n_bins >= 2 else 0.0


def compound_key(class_label: Column, ident: Column) -> Column:
    return F.concat_ws("/", class_label, ident)


def split_key(key: Column) -> tuple[Column, Column]:
    """(class, identifier): the identifier keeps further slashes. Fails on a key without a slash."""
    parts = F.split(key, "/", 2)
    ok = F.instr(key, "/") > 0
    bad = F.raise_error(F.concat(F.lit("not a <class>/<id> key: "), key))
    return F.when(ok, parts[0]).otherwise(bad), F.when(ok, F.get(parts, F.lit(1))).otherwise(bad)


def nearest_bin(f_hz: Column, first_hz: Num, step_hz: Num, n_bins: int) -> Column:
    """Index of the nearest bin of a uniform grid; a tie goes to the lower bin, ends are clamped."""
    raw = F.ceil((f_hz - col(first_hz)) / col(step_hz) - 0.5)
    return F.least(F.greatest(raw, F.lit(0)), F.lit(n_bins - 1)).cast("int")


def name_timestamp(stem: Column) -> Column:
    """Start time (UTC) in a name with yymmdd and hhmmss; null without one. Years below 70 are 20yy."""
    d, t = F.regexp_extract(stem, r"(\d{6})[_-](\d{6})", 1), F.regexp_extract(stem, r"(\d{6})[_-](\d{6})", 2)
    century = F.when(F.substring(d, 1, 2).cast("int") < 70, "20").otherwise("19")
    return F.when(d != "", F.try_to_timestamp(F.concat(century, d, t), F.lit("yyyyMMddHHmmss")))


def add_seconds(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.round(seconds * 1_000_000).cast("long"))


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b) - F.unix_micros(a)) / 1e6


def threshold_name(bin_threshold: Num, class_threshold: Num) -> Column:
    """b<bin>_c<class> with the shortest form of each number."""
    short = lambda x: F.regexp_replace(F.format_string("%.6f", col(x)), r"\.?0+$", "")
    return F.concat(F.lit("b"), short(bin_threshold), F.lit("_c"), short(class_threshold))


def focal_loss(logit: Column, label: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    """Sigmoid focal loss of one score (metric only)."""
    p = 1.0 / (1.0 + F.exp(-logit))
    pt = F.when(label == 1, p).otherwise(1.0 - p)
    w = F.when(label == 1, F.lit(alpha)).otherwise(1.0 - alpha)
    return -w * F.pow(1.0 - pt, F.lit(gamma)) * F.ln(clipped(pt))


def bce(p: Column, label: Column) -> Column:
    c = clipped(p)
    return -(label * F.ln(c) + (1.0 - label) * F.ln(1.0 - c))


def dice_loss(p: Column, label: Column, smooth: float = 1.0) -> Column:
    """Aggregate: 1 - soft Dice."""
    return 1.0 - (2.0 * F.sum(p * label) + smooth) / (F.sum(p) + F.sum(label) + smooth)
