"""Background normalisation and peaks of time-frequency grams.

A gram is a frame table: one row per (recording, time bin) with an array over frequency. What
concerns one frame (split window, two-pass window, band filter) is an array expression on its
row: no shuffle, any number of frames. What looks across time (2-D peaks) windows over frames;
frames are dealt in chunks with a halo, so that a recording of any length spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096


def _check(train: int, central: int, gap: int) -> None:
    if min(train, central) < 1 or gap < 0 or train % 2 == 0 or central % 2 == 0:
        raise ValueError(f"windows must be odd and positive, the gap not negative: train {train}, central {central}, gap {gap}")
    if train <= central + 2 * gap:
        raise ValueError(f"the training window {train} must exceed the guard {central + 2 * gap}")


def band_slice(power: Column, first: int, last: int) -> Column:
    """Bins first..last (both inside), to be taken before normalising: edges are replicated from inside the band."""
    return F.slice(power, first + 1, last - first + 1)


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once per row. Without it the optimizer would copy x into every step of an array function that f makes."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _padded(x: Column, half: int) -> Column:
    return F.concat(F.array_repeat(F.element_at(x, 1), half), x, F.array_repeat(F.element_at(x, -1), half))


def _ring(pad: Column, i: Column, train: int, guard: int) -> Column:
    """Sum over the training window without the guard, around index i of the array that was padded by train // 2."""
    half, g = train // 2, guard // 2
    add = lambda a, v: a + v
    left = F.aggregate(F.slice(pad, i + 1, half - g), F.lit(0.0), add)
    right = F.aggregate(F.slice(pad, i + 1 + half + g + 1, half - g), F.lit(0.0), add)
    return left + right


def split_window(power: Column, train: int = 33, central: int = 5, gap: int = 1) -> Column:
    """power - mean of the ring around each bin, edges replicated."""
    _check(train, central, gap)
    guard = central + 2 * gap
    mean = lambda pad, i: _ring(pad, i, train, guard) / F.lit(float(train - guard))
    return let(_padded(power, train // 2), lambda pad: F.transform(power, lambda v, i: v - mean(pad, i)))


def tpsw(df: DataFrame, power: str, out: str, train: int = 33, central: int = 5, gap: int = 1, threshold_db: float = 6.0, least: int = 16) -> DataFrame:
    """Two-pass split window: cells that stand out in the first pass are left out of the second's mean.

    Where fewer than ``least`` cells of the ring are left, the first pass's background holds.
    Counts are whole numbers. Adds the array column ``out``; frames with a null or empty array
    give the same.
    """
    _check(train, central, gap)
    guard, half = central + 2 * gap, train // 2

    def second(x: Column, first: Column) -> Column:
        keep = F.transform(first, lambda r: F.when(r > F.lit(threshold_db), F.lit(0.0)).otherwise(F.lit(1.0)))
        return let(keep, lambda k: let(_padded(k, half), lambda kp: let(_padded(F.zip_with(x, k, lambda a, b: a * b), half), lambda sp: F.transform(x, lambda v, i: cell(v, i, first, kp, sp)))))

    def cell(v: Column, i: Column, first: Column, kp: Column, sp: Column) -> Column:
        background = let(F.round(_ring(kp, i, train, guard)), lambda n: F.when(n >= F.lit(float(least)), _ring(sp, i, train, guard) / n))
        return let(background, lambda b: F.when(b.isNotNull(), v - b).otherwise(F.get(first, i)))

    both = let(F.col(power), lambda x: let(split_window(x, train, central, gap), lambda first: second(x, first)))
    return df.withColumn(out, both)


def cells(frames: DataFrame, keys: list[str], power: str, value: str = "value") -> DataFrame:
    """One row per (keys, freq_bin)."""
    return frames.select(*keys, F.posexplode(power).alias("freq_bin", value))


def _chunked(frames: DataFrame, time: str, halo: int, chunk: int) -> DataFrame:
    """Each frame in its chunk, and in the neighbour's too within ``halo`` of the border."""
    own = F.floor(F.col(time) / F.lit(chunk)).cast("long")
    before = F.when(F.col(time) % chunk < halo, own - 1)
    after = F.when(F.col(time) % chunk >= chunk - halo, own + 1)
    return frames.withColumn("_chunk", F.explode(F.array_compact(F.array(own, before, after)))).withColumn("_own", F.col("_chunk") == own)


def peaks_2d(frames: DataFrame, recording: str, time: str, power: str, threshold: float = 8.0, neighbourhood: tuple[int, int] = (3, 5), chunk: int = CHUNK) -> DataFrame:
    """Cells (recording, time, freq_bin, value) that are the maximum of their (frequency, time) neighbourhood and >= threshold; a plateau is all peaks.

    The maximum is taken over frequency inside each frame, then over neighbouring frames. Time
    bins of a recording are whole numbers that count frames without gaps.
    """
    df, dt = (n // 2 for n in neighbourhood)
    if min(neighbourhood) < 1 or not all(n % 2 for n in neighbourhood):
        raise ValueError(f"the neighbourhood must be odd and positive: {neighbourhood}")
    across = F.transform(power, lambda _, i: F.array_max(F.slice(F.col(power), F.greatest(i - df, F.lit(0)) + 1, F.least(i, F.lit(df)) + df + 1)))
    df_ = _chunked(frames.select(recording, time, power).withColumn("_m", across), time, max(dt, 1), chunk)
    w = Window.partitionBy(recording, "_chunk").orderBy(time)
    near = [F.lag("_m", k).over(w) for k in range(1, dt + 1)] + [F.lead("_m", k).over(w) for k in range(1, dt + 1)]
    df_ = df_.withColumns({f"_n{k}": c for k, c in enumerate(near)}).filter("_own")

    def top(v: Column, i: Column) -> Column:
        rest = [F.coalesce(F.get(f"_n{k}", i), v) for k in range(len(near))]
        return (v >= F.lit(threshold)) & (v >= F.greatest(F.get("_m", i), v, *rest))

    hits = F.filter(F.transform(power, lambda v, i: F.struct(i.alias("freq_bin"), v.alias("value"), top(v, i).alias("ok"))), lambda s: s["ok"])
    return df_.select(recording, time, F.explode(hits).alias("_s")).select(recording, time, "_s.freq_bin", "_s.value")


def peak_candidates(frames: DataFrame, recording: str, time: str, power: str, threshold: float = 8.0, chunk: int = CHUNK) -> DataFrame:
    """Local maxima (recording, freq_bin, time, value) along time per frequency bin, before distance suppression: a plateau counts once, at its middle (the left one of two); ends of the series never.

    Each frame is held against the one before and after as arrays, in chunks with a halo; only
    cells at or above the threshold that no neighbour exceeds leave the frames, so that plateaus
    are joined over few rows. Time bins of a recording count frames without gaps.
    """
    d = _chunked(frames.select(recording, time, power), time, 1, chunk)
    w = Window.partitionBy(recording, "_chunk").orderBy(time)
    d = d.withColumns({"_p": F.lag(power).over(w), "_q": F.lead(power).over(w)}).filter("_own and _p is not null and _q is not null")
    cell = F.transform(power, lambda v, i: F.struct(i.alias("freq_bin"), v.alias("value"), F.get("_p", i).alias("p"), F.get("_q", i).alias("q")))
    high = F.filter(cell, lambda c: (c["value"] >= F.lit(threshold)) & (c["value"] >= c["p"]) & (c["value"] >= c["q"]))
    flat = d.select(recording, time, F.explode(high).alias("_c")).select(recording, time, "_c.*")
    own = Window.partitionBy(recording, "freq_bin").orderBy(time)
    goes_on = (F.lag(time).over(own) == F.col(time) - 1) & (F.col("p") == F.col("value"))
    runs = flat.withColumn("_run", F.sum(F.when(goes_on, 0).otherwise(1)).over(own)).groupBy(recording, "freq_bin", "_run").agg(F.min(time).alias("_a"), F.max(time).alias("_b"), F.first("value").alias("value"), F.min_by("p", time).alias("_l"), F.max_by("q", time).alias("_r"))
    return runs.filter("_l < value and _r < value").select(recording, "freq_bin", F.floor((F.col("_a") + F.col("_b")) / 2).cast("long").alias(time), "value")
