"""Waveforms to grams: framing, spectra, envelopes.

A recording is a row with its samples, or a long table of samples. Spectra of whole recordings
are numeric kernels over Arrow batches (one recording at a time, no shuffle); framing, frame
times and the frame-by-pulse envelope are native.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalis.functions import columns as C
from tonalis.functions import kernels as K
from tonalis.operators import normalize as N


@dataclass(frozen=True)
class LofarConfig:
    sample_rate: int = 32000
    n_fft: int = 16384
    hop: int = 4096
    window_length: int = 16384
    window: str = "hanning"
    freq_min_hz: float = 1.0
    freq_max_hz: float = 1000.0
    epsilon: float = 1e-10
    train: int = 33
    central: int = 5
    gap: int = 1

    def __post_init__(self) -> None:
        if min(self.sample_rate, self.n_fft, self.hop, self.window_length) < 1 or self.window_length > self.n_fft:
            raise ValueError(f"rates and lengths must be positive, the window no longer than the transform: {self}")
        if not 0 <= self.freq_min_hz < self.freq_max_hz:
            raise ValueError(f"invalid band {self.freq_min_hz}..{self.freq_max_hz}")

    def band(self) -> tuple[int, int]:
        """First and last bin with freq_min <= f <= freq_max."""
        f = np.fft.rfftfreq(self.n_fft, 1.0 / self.sample_rate)
        inside = np.flatnonzero((f >= self.freq_min_hz) & (f <= self.freq_max_hz))
        if not len(inside):
            raise ValueError("no bin lies in the band")
        return int(inside[0]), int(inside[-1])

    @property
    def bin_hz(self) -> float:
        return self.sample_rate / self.n_fft

    @property
    def hop_s(self) -> float:
        return self.hop / self.sample_rate


@dataclass(frozen=True)
class DemonConfig:
    sample_rate: int = 32000
    band_low_hz: float = 500.0
    band_high_hz: float = 5000.0
    lowpass_hz: float = 150.0
    decimation: int = 100
    n_fft: int = 1024
    hop: int = 256


def frame_starts(n: Column, length: int, hop: int) -> Column:
    """Start samples of the complete frames; empty if the recording is shorter than one."""
    return F.when(n < length, F.expr("cast(array() as array<bigint>)")).otherwise(F.sequence(F.lit(0).cast("long"), n.cast("long") - length, F.lit(hop).cast("long")))


def frame_times(recordings: DataFrame, ident: str, n_samples: str, length: int, hop: int, sample_rate: int) -> DataFrame:
    """(ident, time_bin, time_s): centres of the frames."""
    return recordings.select(ident, F.posexplode(frame_starts(F.col(n_samples), length, hop)).alias("time_bin", "_s")).select(ident, "time_bin", ((F.col("_s") + length / 2) / float(sample_rate)).alias("time_s"))


def frames(samples: DataFrame, ident: str, index: str, value: str, length: int, hop: int) -> DataFrame:
    """Long samples to (ident, time_bin, pos, value) of overlapping frames: each sample goes to the frames that hold it."""
    last = F.floor(F.col(index) / hop)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(index) - length + 1) / hop))
    out = samples.select(ident, index, value, F.explode(F.when(first <= last, F.sequence(first, last))).alias("time_bin"))
    n = samples.groupBy(ident).agg((F.max(index) + 1).alias("_n"))
    whole = F.floor((F.col("_n") - length) / hop)
    return out.join(n, ident).filter(F.col("time_bin") <= whole).select(ident, "time_bin", (F.col(index) - F.col("time_bin") * hop).cast("int").alias("pos"), value)


#: Bins whose sums one row of ``dft_power`` holds while samples are added up.
STRIP = 32


def dft_power(framed: DataFrame, ident: str, value: str, n_fft: int, length: int, window: str = "hanning", bins: tuple[int, int] | None = None) -> DataFrame:
    """(ident, time_bin, freq_bin, power) of framed samples by sums of cosines and sines: the native form of the transform, for short windows.

    A frame's bins are summed side by side, ``STRIP`` at a time: samples aren't multiplied by the number of bins, nor is the table of sums."""
    lo, hi = bins or (0, n_fft // 2)
    w = K.window(window, length).sum()
    x = F.col(value) * C.window_value(window, F.col("pos"), length) / F.lit(float(w))
    width = min(STRIP, hi - lo + 1)
    by = framed.withColumn("_x", x).withColumn("_b", F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(width))) if width < hi - lo + 1 else F.lit(lo))
    angle = lambda k: F.lit(2.0) * F.pi() * F.pmod((F.col("_b") + k) * F.col("pos"), F.lit(n_fft)) / F.lit(float(n_fft))
    s = by.groupBy(ident, "time_bin", "_b").agg(*[F.sum(F.col("_x") * f(angle(k))).alias(f"_{c}{k}") for k in range(width) for c, f in (("re", F.cos), ("im", F.sin))])
    power = F.array(*[F.col(f"_re{k}") * F.col(f"_re{k}") + F.col(f"_im{k}") * F.col(f"_im{k}") for k in range(width)])
    out = s.select(ident, "time_bin", "_b", F.posexplode(power).alias("_k", "power")).withColumn("freq_bin", F.col("_b") + F.col("_k"))
    return out.filter(F.col("freq_bin") <= hi).select(ident, "time_bin", "freq_bin", "power")


def _per_recording(recordings: DataFrame, ident: str, rate: str, samples: str, one) -> DataFrame:  # noqa: ANN001
    kind = dict(recordings.dtypes)[ident]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                if not b.column(2)[k].is_valid:
                    continue
                x = b.column(2)[k].values.to_numpy(zero_copy_only=False)
                t, p = one(x, b.column(1)[k].as_py())
                step = max(1, (4 << 20) // (8 * max(1, p.shape[1] if p.ndim == 2 else 1)))
                for a in range(0, len(t), step):
                    part = p[a : a + step]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1]), pa.int32()), pa.array(part.ravel()))
                    yield pa.record_batch([pa.array([b.column(0)[k].as_py()] * len(part), b.column(0).type), pa.array(np.arange(a, a + len(part)), pa.int32()), pa.array(t[a : a + step]), lists], names=[ident, "time_bin", "time_s", "power_db"])

    return recordings.select(ident, rate, samples).mapInArrow(run, f"{ident} {kind}, time_bin int, time_s double, power_db array<double>")


def lofar(recordings: DataFrame, config: LofarConfig = LofarConfig(), ident: str = "recording_id", rate: str = "sample_rate_hz", samples: str = "samples", normalise: bool = True) -> DataFrame:
    """Frame table (ident, time_bin, time_s, power_db, normalized_power_db) in the band. Another sample rate is resampled first; a null waveform gives no frames."""
    lo, hi = config.band()

    def one(x: np.ndarray, sr: int) -> tuple[np.ndarray, np.ndarray]:
        x = K.resample(x.astype(np.float64), int(sr), config.sample_rate)
        _, t, p = K.stft_power(x, config.sample_rate, config.n_fft, config.hop, config.window_length, config.window)
        return t, 10 * np.log10(p[:, lo : hi + 1] + config.epsilon)

    out = _per_recording(recordings, ident, rate, samples, one)
    return out.withColumn("normalized_power_db", N.split_window(F.col("power_db"), config.train, config.central, config.gap)) if normalise else out


def demon(recordings: DataFrame, config: DemonConfig = DemonConfig(), ident: str = "recording_id", rate: str = "sample_rate_hz", samples: str = "samples") -> DataFrame:
    """Frame table (ident, time_bin, time_s, power_db): modulation spectrum relative to the recording's peak."""

    def one(x: np.ndarray, sr: int) -> tuple[np.ndarray, np.ndarray]:
        x = K.resample(x.astype(np.float64), int(sr), config.sample_rate)
        _, t, p = K.demon_power_db(x, config.sample_rate, (config.band_low_hz, config.band_high_hz), config.lowpass_hz, config.decimation, config.n_fft, config.hop)
        return t, p

    return _per_recording(recordings, ident, rate, samples, one)


def mono(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean over channels of long samples."""
    return samples.groupBy(*keys).agg(F.avg(value).alias(value))


def active_envelope(times: DataFrame, pulses: DataFrame, key: str, gamma: str, time: str = "time_s", onset: str = "onset_s", ratio: float = 1e-3, width: float = 8.0) -> DataFrame:
    """Per frame the largest exp(-gamma * age) over pulses younger than ln(1/ratio) / max(gamma, 0.001), else 0.

    Pulses spread over buckets of ``width`` seconds that their life covers; frames meet them by
    (key, bucket). Frames are mostly exploded from few rows, which Spark's estimate of their size doesn't see:
    they are never broadcast.
    """
    times = times.hint("merge")
    life = -np.log(max(ratio, 1e-12)) / F.greatest(F.col(gamma), F.lit(1e-3))
    p = pulses.withColumn("_life", life).withColumn("_b", F.explode(F.sequence(F.floor(F.col(onset) / width), F.floor((F.col(onset) + F.col("_life")) / width)))).hint("merge")
    t = times.withColumn("_b", F.floor(F.col(time) / width))
    age = F.col(time) - F.col(onset)
    hit = t.join(p, [key, "_b"]).filter((age >= 0) & (age < F.col("_life"))).groupBy(key, time).agg(F.max(F.exp(-F.col(gamma) * age)).alias("envelope"))
    return times.join(hit, [key, time], "left").withColumn("envelope", F.coalesce("envelope", F.lit(0.0)))


def frame_truth(envelope: DataFrame, harmonics: DataFrame, source: str, sample_rate: int, n_fft: int, hop: int) -> DataFrame:
    """One row per (source, harmonic): frequency and SNR curves and mask cells over the active frames, in time order.

    envelope: source, time_bin, time_s, envelope; harmonics: source, h, f0_hz, drift, onset_s,
    amplitude, local_rms. Harmonics from the Nyquist rate up are left out; inactive sources give
    a row with empty curves.
    """
    own = harmonics.filter((F.col("h") + 1) * F.col("f0_hz") < sample_rate / 2)
    e = own.join(envelope.filter("envelope > 0").hint("merge"), source, "left")
    sample = _truth_sample(F.col("time_bin"), F.col("time_s"), F.col("envelope"), sample_rate, n_fft)
    e = e.withColumn("_s", F.when(F.col("time_bin").isNotNull(), sample))
    g = e.groupBy(source, "h", "f0_hz", "drift", "onset_s").agg(F.array_sort(F.collect_list("_s")).alias("_a"))
    return g.select(*_truth_line(source, sample_rate, hop))


def source_truth(sources: DataFrame, source: str, n_samples: str, sample_rate: int, n_fft: int, hop: int, ratio: float = 1e-3) -> DataFrame:
    """``active_envelope`` and ``frame_truth`` of sources that are rows with their pulses, on the row: nothing is shuffled. A line's curves are no longer than its recording.

    sources: source, samples of its recording, f0_hz, n_harmonics, harmonic_decay, decay_per_s, drift,
    onset_s, amplitude, local_rms, onsets array<double>; other columns pass through, after the line's.
    """
    used = {source, n_samples, "f0_hz", "n_harmonics", "harmonic_decay", "decay_per_s", "drift", "onset_s", "amplitude", "local_rms", "onsets"}
    gamma = F.col("decay_per_s")
    life = -np.log(max(ratio, 1e-12)) / F.greatest(gamma, F.lit(1e-3))
    frame = F.transform(frame_starts(F.col(n_samples), n_fft, hop), lambda s, i: F.struct(i.alias("time_bin"), ((s + n_fft / 2) / float(sample_rate)).alias("time_s")))
    # An envelope falls from pulse to pulse, so the youngest pulse is the largest.
    aged = F.transform(frame, lambda x: F.struct(x["time_bin"].alias("time_bin"), x["time_s"].alias("time_s"), (x["time_s"] - F.array_max(F.filter("onsets", lambda o: o <= x["time_s"]))).alias("age")))
    own = sources.withColumn("_f", F.filter(aged, lambda x: (x["age"] < life) & (F.exp(-gamma * x["age"]) > 0)))
    own = own.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("n_harmonics") - 1))).filter((F.col("h") + 1) * F.col("f0_hz") < sample_rate / 2)
    own = own.withColumn("amplitude", F.col("amplitude") * F.pow("harmonic_decay", F.col("h")))
    own = own.withColumn("_a", F.transform("_f", lambda x: _truth_sample(x["time_bin"], x["time_s"], F.exp(-gamma * x["age"]), sample_rate, n_fft)))
    return own.select(*_truth_line(source, sample_rate, hop), *[c for c in sources.columns if c not in used])


def _truth_sample(time_bin: Column, time_s: Column, envelope: Column, sample_rate: int, n_fft: int) -> Column:
    """A harmonic (columns h, f0_hz, drift, onset_s, amplitude, local_rms) in one frame."""
    f = (F.col("h") + 1) * (F.col("f0_hz") + F.col("drift") * (time_s - F.col("onset_s")))
    inside = F.least(F.greatest(f, F.lit(1e-3)), F.lit(sample_rate / 2 - 1.0))
    bin_ = F.least(F.greatest(F.rint(inside / (sample_rate / n_fft)), F.lit(0.0)), F.lit(float(n_fft // 2 - 1))).cast("int")
    snr = 20.0 * F.log10(F.greatest(F.col("amplitude") * envelope / F.sqrt(F.lit(2.0)), F.lit(1e-12)) / F.col("local_rms"))
    return F.struct(time_bin.alias("time_bin"), time_s.alias("time_s"), f.alias("f"), snr.alias("snr"), bin_.alias("bin"))


def _truth_line(source: str, sample_rate: int, hop: int) -> list[Column]:
    """The columns of a line, of its samples ``_a`` in time order."""
    none = F.size("_a") == 0
    start = F.when(none, F.col("onset_s")).otherwise(F.get("_a", F.lit(0))["time_s"])
    end = F.when(none, F.col("onset_s")).otherwise(F.get("_a", F.size("_a") - 1)["time_s"] + hop / sample_rate)
    return [
        F.concat_ws("_h", F.col(source).cast("string"), F.col("h").cast("string")).alias("line_id"), F.col(source), F.col("h").alias("harmonic_id"), F.col("f0_hz"),
        F.transform("_a", lambda x: x["f"]).alias("freq_curve_hz"), F.transform("_a", lambda x: x["snr"]).alias("snr_curve_db"),
        F.transform("_a", lambda x: F.struct(x["time_bin"].alias("frame"), x["bin"].alias("bin"))).alias("mask_bin_indices"),
        start.alias("t_start_s"), end.alias("t_end_s"), (end - start).alias("persistence_s"), F.col("drift").alias("drift_rate_hz_per_s"),
    ]


def exact_quantile(df: DataFrame, keys: list[str], value: str, q: float, cells: int = 4096) -> DataFrame:
    """keys, quantile: exactly, with linear interpolation, of groups of any size, without gathering one.

    Equal values become one row with a count. The range of a group is divided into ``cells``; their counts tell which
    one or two hold the order statistics, and only values of those are ranked. Nulls and NaN are left out.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    own = v.groupBy(*keys, "_v").agg(F.count("*").alias("_m"))
    ends = own.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.sum("_m").alias("_n"))
    same = lambda right: [F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]  # noqa: E731, ARG005
    share = F.when(F.col("_z") > F.col("_a"), (F.col("_v") - F.col("_a")) / (F.col("_z") - F.col("_a"))).otherwise(0.0)
    placed = own.alias("o").join(ends.alias("r"), same(ends)).select("o.*", "_a", "_z", "_n").withColumn("_c", F.least(F.floor(share * cells), F.lit(cells - 1)))
    count = placed.groupBy(*keys, "_c").agg(F.sum("_m").alias("_s"), F.first("_n").alias("_n"))
    count = count.withColumn("_b", F.sum("_s").over(Window.partitionBy(*keys).orderBy("_c")) - F.col("_s"))  # ``cells`` rows a group
    at = (F.col("_n") - 1) * F.lit(float(q))
    holds = lambda k, lo, hi: (k >= lo) & (k < hi)
    wanted = count.filter(holds(F.floor(at), F.col("_b"), F.col("_b") + F.col("_s")) | holds(F.ceil(at), F.col("_b"), F.col("_b") + F.col("_s"))).select(*keys, F.col("_c").alias("_cell"), "_b")
    inside = placed.alias("o").join(wanted.alias("r"), [*same(wanted), F.col("_c") == F.col("_cell")]).select("o.*", "_b")
    upto = F.sum("_m").over(Window.partitionBy(*keys, "_c").orderBy("_v"))
    ranked = inside.withColumn("_hi", F.col("_b") + upto).withColumn("_lo", F.col("_hi") - F.col("_m"))
    pick = lambda k: F.max(F.when(holds(k, F.col("_lo"), F.col("_hi")), F.col("_v")))
    part = at - F.floor(at)
    got = ranked.groupBy(*keys).agg(pick(F.floor(at)).alias("_low"), pick(F.ceil(at)).alias("_high"), F.first(part).alias("_part"))
    return got.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile"))


def display_ceiling(cell: DataFrame, keys: list[str], value: str, span_db: float = 40.0) -> DataFrame:
    """99th percentile and floor of the display range per gram."""
    return exact_quantile(cell, keys, value, 0.99).select(*keys, F.col("quantile").alias("vmax"), (F.col("quantile") - span_db).alias("vmin"))
