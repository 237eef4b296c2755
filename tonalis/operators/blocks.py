"""Recordings of any length: blocks of samples as rows, dealt over tasks.

A recording is many rows (ident, sample_rate_hz, n, block, start, samples): blocks that follow one
another, ``n`` samples in all. Block k begins at k times the block's length; the last one
takes the rest, so that it is never shorter than the others (but for a recording that is). Each operator gives blocks or
frames again, equal to what the kernel gives for the whole recording:

* **Framing and resampling** need some samples beyond a block: blocks around send them (a halo), one
  shuffle.
* **Recursive filters** carry a state through the whole recording, in which they are linear. Every
  block but the last is filtered from rest; a scan over the blocks' end states, a few numbers each, gives
  the state that each really begins in; then each is filtered from that. A zero-phase pass
  is two of those, the second from the end, with the odd extension in the first and last block.

Nothing but states and sums goes through one task per recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.functions import kernels as K
from tonalis.operators import normalize as N
from tonalis.operators.batches import cut, grouped
from tonalis.operators.grams import DemonConfig, LofarConfig

#: Samples of a block.
BLOCK = 1 << 16
COLUMNS = ("sample_rate_hz", "n", "block", "start", "samples")
SCHEMA = "sample_rate_hz int, n long, block int, start long, samples array<double>"


def n_blocks(n: int, size: int) -> int:
    return max(1, n // size)


def bounds(k: int, n: int, size: int) -> tuple[int, int]:
    """First sample of block k, and where it ends."""
    return k * size, n if k == n_blocks(n, size) - 1 else (k + 1) * size


def from_samples(samples: DataFrame, ident: str, index: str, value: str, sample_rate: int, size: int = BLOCK) -> DataFrame:
    """Blocks of a long table of samples (index from 0, without gaps). Null values are silence."""
    n = samples.groupBy(ident).agg(F.count("*").alias("n"))
    own = samples.select(ident, F.col(index).cast("long").alias("_i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_x")).join(n, ident)
    block = F.least(F.floor(F.col("_i") / size), F.greatest(F.floor(F.col("n") / size), F.lit(1)) - 1).cast("int")
    got = own.groupBy(ident, "n", block.alias("block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias("samples"))
    return got.select(ident, F.lit(sample_rate).cast("int").alias("sample_rate_hz"), "n", "block", (F.col("block").cast("long") * size).alias("start"), "samples")


def from_arrays(recordings: DataFrame, ident: str = "recording_id", rate: str = "sample_rate_hz", samples: str = "samples", size: int = BLOCK) -> DataFrame:
    """Blocks of recordings that are one array each. A null or empty waveform gives none."""
    own = recordings.filter(F.size(samples) > 0).select(ident, F.col(rate).cast("int").alias("sample_rate_hz"), F.col(samples).cast("array<double>").alias("_x"), F.size(samples).cast("long").alias("n"))
    last = F.greatest(F.floor(F.col("n") / size), F.lit(1)).cast("int") - 1
    each = own.withColumn("_last", last).withColumn("block", F.explode(F.sequence(F.lit(0), "_last")))
    start = F.col("block").cast("long") * size
    part = F.slice("_x", (start + 1).cast("int"), F.when(F.col("block") == F.col("_last"), F.col("n") - start).otherwise(F.lit(size)).cast("int"))
    return each.select(ident, "sample_rate_hz", "n", "block", start.alias("start"), part.alias("samples"))


def _flat(c: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values of a column of arrays and where each begins (and the end)."""
    c = c.combine_chunks()
    at = c.offsets.to_numpy()
    return c.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def _arrays(rows: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0)))


def _around(blocks: DataFrame, ident: str, to: Callable[[int, int, int], range], need: Callable[[int, int, int], tuple[int, int]]) -> DataFrame:
    """Every block's samples by the blocks that need them: ``to`` gives those (of start, end, n, rate), ``need`` the range of samples of one."""
    kind = dict(blocks.dtypes)[ident]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rate, n, start = (b.column(i).to_pylist() for i in (1, 2, 4))
            x, at = _flat(pa.chunked_array([b.column(5)]))
            rows, out = [], []
            for i in range(b.num_rows):
                a, z = start[i], start[i] + int(at[i + 1] - at[i])
                for k in to(a, z, n[i], rate[i]):
                    lo, hi = need(k, n[i], rate[i])
                    lo, hi = max(lo, a), min(hi, z)
                    if lo < hi:
                        rows.append((i, k, lo))
                        out.append(x[at[i] + lo - a : at[i] + hi - a])
            i, k, lo = (list(v) for v in zip(*rows, strict=True)) if rows else ([], [], [])
            own = b.select([0, 1, 2]).take(pa.array(i, pa.int64()))
            yield pa.record_batch([own.column(0), own.column(1), own.column(2), pa.array(k, pa.int32()), pa.array(lo, pa.int64()), _arrays(out)], names=[ident, *COLUMNS])

    return blocks.select(ident, *COLUMNS).mapInArrow(run, f"{ident} {kind}, {SCHEMA}")


def _each(t: pa.Table, starts: np.ndarray) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """Of the groups of a table: place of the first row, rate, n, block, first sample, samples (pieces in order are joined)."""
    x, at = _flat(t["samples"])
    rate, n, block, start = (t[c].to_pylist() for c in COLUMNS[:-1])
    for a, b in pairwise(starts.tolist()):
        yield a, rate[a], n[a], block[a], start[a], x[at[a] : at[b]]


def resampled(blocks: DataFrame, target: int, ident: str = "recording_id", size: int = BLOCK) -> DataFrame:
    """Blocks at another rate, equal to ``kernels.resample`` of the whole."""
    kind = dict(blocks.dtypes)[ident]
    total = lambda n, rate: -(-n * K.ratio(rate, target)[0] // K.ratio(rate, target)[1])

    def need(k: int, n: int, rate: int) -> tuple[int, int]:
        up, down, half, taps = K.ratio(rate, target)
        a, b = bounds(k, total(n, rate), size)
        return (a * down + half) // up - taps + 1, ((b - 1) * down + half) // up + 1

    def to(a: int, z: int, n: int, rate: int) -> range:
        up, down, half, taps = K.ratio(rate, target)
        last = n_blocks(total(n, rate), size) - 1
        first = ((a * up - half) // down - 1) // size
        return range(min(max(first, 0), last), min(max(((z + taps) * up - half) // down + 1, 0) // size, last) + 1)

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        rows, out = [], []
        for i, rate, n, k, start, x in _each(t, starts):
            a, b = bounds(k, total(n, rate), size)
            rows.append((i, total(n, rate), k, a))
            out.append(x if rate == target else K.resample_part(x, start, rate, target, a, b))
        i, n, k, a = zip(*rows, strict=True)
        return pa.table([t[ident].take(pa.array(i)), pa.array([target] * len(i), pa.int32()), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(a, pa.int64()), _arrays(out)], names=[ident, *COLUMNS])

    # At its own rate a block needs itself alone.
    same = lambda k, n, rate: bounds(k, n, size) if rate == target else need(k, n, rate)
    where = lambda a, z, n, rate: range(min(a // size, n_blocks(n, size) - 1), min((z - 1) // size, n_blocks(n, size) - 1) + 1) if rate == target else to(a, z, n, rate)
    return grouped(_around(blocks, ident, where, same), [ident, "block"], ["start"], run, f"{ident} {kind}, {SCHEMA}")


def power_frames(blocks: DataFrame, n_fft: int, hop: int, length: int | None = None, window: str = "hanning", ident: str = "recording_id", bins: tuple[int, int] | None = None, size: int = BLOCK, factor: int = 1) -> DataFrame:
    """(ident, time_bin, time_s, power): the frames that begin in a block, with the samples beyond it that they need; equal to ``kernels.stft_power`` of the whole.

    With a column ``mean`` that is taken from the samples first. ``factor`` divides the rate, of samples that were decimated.
    """
    kind, length = dict(blocks.dtypes)[ident], length or n_fft
    lo, hi = bins or (0, n_fft // 2)
    need = lambda k, n, rate: (bounds(k, n, size)[0], bounds(k, n, size)[1] + length - 1)
    to = lambda a, z, n, rate: range(min(max(0, (a - length + 1) // size), n_blocks(n, size) - 1), min((z - 1) // size, n_blocks(n, size) - 1) + 1)
    w = K.window(window, length)

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        means = t["mean"].to_pylist() if "mean" in t.column_names else None
        who, number, time, power = [], [], [], []
        for i, rate, n, k, start, x in _each(t, starts):
            a, b = bounds(k, n, size)
            first = -(-a // hop) * hop
            stop = min(b, n - length + 1)
            if first >= stop:
                continue
            frames = np.lib.stride_tricks.sliding_window_view(x[first - start :] - (means[i] if means else 0.0), length)[: stop - first : hop]
            z = np.fft.rfft(frames * w, n_fft, axis=1)[:, lo : hi + 1] / w.sum()
            own = first // hop + np.arange(len(frames))
            who += [i] * len(frames)
            number.append(own)
            time.append((own * hop + length / 2) / (rate / factor))
            power.append(z.real**2 + z.imag**2)
        join = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
        flat = np.concatenate(power).ravel() if power else np.zeros(0)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(who) + 1) * (hi - lo + 1), pa.int32()), pa.array(flat))
        return pa.table([t[ident].take(pa.array(who, pa.int64())), pa.array(join(number, int), pa.int32()), pa.array(join(time, float)), lists], names=[ident, "time_bin", "time_s", "power"])

    dealt = _around(blocks, ident, to, need)
    if "mean" in blocks.columns:
        dealt = dealt.join(blocks.select(ident, "mean").distinct(), ident)  # one row a recording
    return grouped(dealt, [ident, "block"], ["start"], run, f"{ident} {kind}, time_bin int, time_s double, power array<double>")


def lofar_blocks(blocks: DataFrame, config: LofarConfig = LofarConfig(), ident: str = "recording_id", normalise: bool = True, size: int = BLOCK) -> DataFrame:
    """``grams.lofar`` of recordings in blocks, with the same frames."""
    frames = power_frames(resampled(blocks, config.sample_rate, ident, size), config.n_fft, config.hop, config.window_length, config.window, ident, config.band(), size)
    out = frames.select(ident, "time_bin", "time_s", F.transform("power", lambda p: F.lit(10.0) * F.log10(p + F.lit(config.epsilon))).alias("power_db"))
    return out.withColumn("normalized_power_db", N.split_window(F.col("power_db"), config.train, config.central, config.gap)) if normalise else out


def _pass(blocks: DataFrame, sos: np.ndarray, ident: str, size: int, back: bool) -> DataFrame:
    """One pass over the whole recording, forward (adds the odd extension to the first and last block) or back (takes it off again)."""
    kind, steps, pad_most, zi = dict(blocks.dtypes)[ident], K.sos_step(sos, size), K.padding(sos), K.steady(sos)
    width = 2 * len(sos)

    def extended(x: np.ndarray, k: int, n: int) -> np.ndarray:
        """What the pass runs over in this block, in its direction."""
        if back:
            return x[::-1]
        pad = min(pad_most, n - 1)
        if pad > 0 and k == 0:
            x = np.r_[2 * x[0] - x[pad:0:-1], x]
        if pad > 0 and k == n_blocks(n, size) - 1:
            x = np.r_[x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
        return x

    begins = lambda k, n: k == (n_blocks(n, size) - 1 if back else 0)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            rows = []
            for i, _, n, k, _, x in _each(t, np.arange(t.num_rows + 1)):
                x = extended(x, k, n)
                rows.append((i, k, n, K.sos_run(sos, x, zi * x[0] if begins(k, n) else np.zeros((len(sos), 2)))[1].ravel().tolist()))
            i, k, n, s = (list(v) for v in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.record_batch([b.column(0).take(pa.array(i, pa.int64())), pa.array(k, pa.int32()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.float64()))], names=[ident, "block", "n", "end"])

    def scan(t: pa.Table, starts: np.ndarray) -> pa.Table:
        """From the end states of blocks filtered from rest, in order, to the states that the blocks after them begin in."""
        ends, block = np.array(t["end"].to_pylist()).reshape(-1, width), t["block"].to_numpy()
        out = np.zeros_like(ends)
        for a, b in pairwise(starts.tolist()):
            order = range(b - 1, a - 1, -1) if back else range(a, b)
            now = None
            for i in order:
                out[i] = now = ends[i] if now is None else ends[i] + steps @ now
        return pa.table([t[ident], pa.array(block + (-1 if back else 1), pa.int32()), pa.array(out.tolist(), pa.list_(pa.float64()))], names=[ident, "block", "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = pa.Table.from_batches([b])
            out, states = [], b.column(6).to_pylist()
            for i, _, n, k, _, x in _each(t, np.arange(t.num_rows + 1)):
                x = extended(x, k, n)
                y = K.sos_run(sos, x, zi * x[0] if begins(k, n) else np.array(states[i]).reshape(-1, 2))[0]
                if back:
                    pad = min(pad_most, n - 1)
                    y = y[::-1]
                    y = y[pad if k == 0 else 0 : len(y) - (pad if k == n_blocks(n, size) - 1 else 0)]
                out.append(y)
            yield pa.record_batch([*(b.column(i) for i in range(5)), _arrays(out)], names=[ident, *COLUMNS])

    own = blocks.select(ident, *COLUMNS)
    # Nothing begins in the state that a pass ends in, so its last block, the only one of a short recording, isn't run from rest.
    last = F.lit(0) if back else F.greatest(F.floor(F.col("n") / size), F.lit(1)) - 1
    ends = own.filter(F.col("block") != last).mapInArrow(rest, f"{ident} {kind}, block int, n long, end array<double>")  # a few numbers a block
    states = grouped(ends, [ident], ["block"], scan, f"{ident} {kind}, block int, state array<double>")
    told = own.join(states, [ident, "block"], "left").select(ident, *COLUMNS, "state")
    return cut(told.mapInArrow(run, f"{ident} {kind}, {SCHEMA}"))


def zero_phase(blocks: DataFrame, sos: np.ndarray, ident: str = "recording_id", size: int = BLOCK) -> DataFrame:
    """Forward and backward pass, equal to ``kernels.zero_phase`` of the whole. Blocks must be longer than the extension (``kernels.padding``)."""
    if size <= K.padding(sos):
        raise ValueError(f"blocks of {size} samples are too short for an extension of {K.padding(sos)}")
    return _pass(_pass(blocks, sos, ident, size, False), sos, ident, size, True)


def demon_blocks(blocks: DataFrame, config: DemonConfig = DemonConfig(), ident: str = "recording_id", size: int = BLOCK) -> DataFrame:
    """``grams.demon`` of recordings in blocks, with the same frames: band pass, square, low pass, decimation, mean and peak of the whole recording."""
    nyq, kind = config.sample_rate / 2, dict(blocks.dtypes)[ident]
    square = lambda d: d.withColumn("samples", F.transform("samples", lambda v: v * v))
    at_rate = cut(resampled(blocks, config.sample_rate, ident, size))
    y = square(zero_phase(at_rate, K.butter_sos(4, (config.band_low_hz / nyq, config.band_high_hz / nyq)), ident, size))
    y = zero_phase(y, K.butter_sos(4, config.lowpass_hz / nyq), ident, size)
    f = config.decimation
    if f > 1:
        y = zero_phase(y, K.cheby1_sos(8, 0.05, 0.8 / f), ident, size)
    left = F.filter("samples", lambda _, i: F.pmod(F.col("start") + i, F.lit(f)) == 0)
    kept = y.withColumn("samples", left).withColumn("start", F.ceil(F.col("start") / f)).withColumn("n", F.ceil(F.col("n") / f))
    # Fewer samples a block now: they are dealt anew, as the blocks of framing are of one length.
    where = lambda a, z, n, rate: range(min(a // size, n_blocks(n, size) - 1), min((z - 1) // size, n_blocks(n, size) - 1) + 1)

    def whole(t: pa.Table, starts: np.ndarray) -> pa.Table:
        rows = [(i, rate, n, k, start, x) for i, rate, n, k, start, x in _each(t, starts)]
        i, rate, n, k, start, x = zip(*rows, strict=True)
        return pa.table([t[ident].take(pa.array(i)), pa.array(rate, pa.int32()), pa.array(n, pa.int64()), pa.array(k, pa.int32()), pa.array(start, pa.int64()), _arrays(list(x))], names=[ident, *COLUMNS])

    low = cut(grouped(_around(kept, ident, where, lambda k, n, rate: bounds(k, n, size)), [ident, "block"], ["start"], whole, f"{ident} {kind}, {SCHEMA}"))
    mean = low.groupBy(ident).agg((F.sum(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v)) / F.sum(F.size("samples"))).alias("mean"))
    frames = cut(power_frames(low.join(mean, ident), config.n_fft, config.hop, ident=ident, size=size, factor=f))
    peak = frames.groupBy(ident).agg(F.greatest(F.max(F.array_max("power")), F.lit(float(np.finfo(np.float32).tiny))).alias("_top"))
    db = F.transform("power", lambda p: F.lit(10.0) * F.log10(p / F.col("_top") + F.lit(1e-6)))
    return frames.join(peak, ident).select(ident, "time_bin", "time_s", db.alias("power_db"))
