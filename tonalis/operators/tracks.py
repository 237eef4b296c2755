"""From peaks to lines: thinning, persistence tracking, cluster merge, anchor dedupe, and the whole detection.

Thinning, tracking and merging follow an order and are kernels, called on many groups at a time.
A recording of any length without a pause spreads over tasks: its peaks are cut into chunks of
time bins. Thinning gives a chunk the peaks around it, more of them where that doesn't settle
it. Tracking gives a chunk the runs that the chunk before leaves open, and repeats chunks until what each got
is what the one before gave. Merging, of far fewer rows, is cut at pauses.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalis.functions import columns as C
from tonalis.functions import kernels as K
from tonalis.operators import normalize as N
from tonalis.operators.batches import cut, grouped

#: Time bins of a chunk of peaks.
CHUNK = 8192

TRACK = "freq_bin_center int, freq_bin_min int, freq_bin_max int, t_start_bin int, t_end_bin int, peak_snr_db double, n_peaks int"
LINE = "correlation_id string, array_id string, beam_id string, timestamp timestamp, frequency_hz double, bandwidth_hz double, snr_db double, persistence_s double, detection_method string, confidence double"


@dataclass(frozen=True)
class PersistenceConfig:
    min_persistence_s: float = 3.0
    max_drift_bins: int = 2
    max_gap_bins: int = 4

    def __post_init__(self) -> None:
        if self.min_persistence_s < 0 or self.max_drift_bins < 0 or self.max_gap_bins < 1:
            raise ValueError(f"persistence and drift can't be negative, the gap must be at least 1: {self}")


@dataclass(frozen=True)
class DetectionConfig:
    train: int = 33
    central: int = 5
    gap: int = 1
    mask_db: float = 6.0
    least: int = 16
    snr_db: float = 8.0
    separation: float = 4
    neighbourhood: tuple[int, int] = (3, 5)
    method: str = "per_bin"
    persistence: PersistenceConfig = PersistenceConfig()
    merge: bool = True
    tolerance_hz: float | None = None

    def __post_init__(self) -> None:
        if self.method not in ("per_bin", "two_d"):
            raise ValueError(f"unknown peak method {self.method!r}; one of per_bin, two_d")


def _stretches(df: DataFrame, keys: list[str], starts: Column, order: list[str]) -> DataFrame:
    """Adds ``_stretch``: how many rows up to this one, in order, start a stretch of the keys."""
    return df.withColumn("_stretch", F.sum(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(*order)))


def peaks_per_bin(frames: DataFrame, recording: str, time: str, power: str, threshold: float = 8.0, separation: float = 4, chunk: int = CHUNK) -> DataFrame:
    """Peaks (recording, freq_bin, time, value) along time per frequency bin, thinned so that none is nearer than ``separation`` to a taller one.

    Candidates are found natively. A chunk of a bin's candidates gets those around it as well, as far as
    ``halo`` bins; where that doesn't settle which stay, it is thinned again with twice as many.
    """
    keys, gap = [recording, "freq_bin"], -int(-separation // 1)
    found = N.peak_candidates(frames, recording, time, power, threshold)
    if gap < 2:
        return found.select(*keys, time, "value")
    kinds, names = dict(found.dtypes), [*keys, time, "value"]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", _chunk long, _open boolean"
    found, out, halo, open_ = cut(found.select(*names)), None, 4 * gap, None
    while True:
        dealt = _with_halo(found, time, chunk, halo)
        if open_ is not None:
            dealt = dealt.join(open_, [*keys, "_chunk"], "left_semi")

        def run(t: pa.Table, starts: np.ndarray, halo: int = halo) -> pa.Table:
            at, height, own = (t[c].to_numpy() for c in (time, "value", "_chunk"))
            stay, unclear = np.zeros(len(at), bool), np.zeros(len(at), bool)
            for a, b in pairwise(starts.tolist()):
                low = own[a] * chunk
                keep, unknown = K.thin_within(at[a:b], height[a:b], gap, low - halo, low + chunk + halo - 1)
                mine = (at[a:b] >= low) & (at[a:b] < low + chunk)
                if (unknown & mine).any():
                    unclear[a + np.flatnonzero(mine)[0]] = True  # one row says so for the chunk
                else:
                    stay[a:b] = keep & mine
            t = t.append_column("_open", pa.array(unclear))
            return t.filter(pa.array(stay | unclear)).select([*names, "_chunk", "_open"])

        got = cut(grouped(dealt, [*keys, "_chunk"], [time], run, schema))
        done = got.filter("not _open").select(names)
        out = done if out is None else out.unionByName(done)
        open_ = got.filter("_open").select(*keys, "_chunk")
        if open_.isEmpty():
            return out
        halo *= 2


def _with_halo(df: DataFrame, time: str, chunk: int, halo: int) -> DataFrame:
    """Rows by the chunks (``_chunk``) that they lie in or no further than ``halo`` from."""
    cell = lambda c: F.floor(c / F.lit(chunk)).cast("long")
    return df.withColumn("_chunk", F.explode(F.sequence(cell(F.col(time) - halo), cell(F.col(time) + halo))))


_PARTS = "array<struct<" + ",".join(f"{n}:{'bigint' if k is int else 'double'}" for n, k in K.PART) + ">>"
_STATE = "array<struct<f:bigint,t:bigint>>"
_PART_TYPE = pa.list_(pa.struct([(n, pa.int64() if k is int else pa.float64()) for n, k in K.PART]))
_STATE_TYPE = pa.list_(pa.struct([("f", pa.int64()), ("t", pa.int64())]))


def persistent_lines(peaks: DataFrame, recording: str, time: str, freq: str, value: str, hop_s: float, config: PersistenceConfig = PersistenceConfig(), chunk: int = CHUNK) -> DataFrame:
    """Tracks per recording, from sparse peak rows.

    Peaks are dealt by (recording, chunk of time bins) and swept with no open runs before. Then the chunks'
    open runs are put together per recording, in order; a chunk that was swept with others than
    the one before leaves is swept again, and so on until they agree, mostly after one repeat.
    Only runs that cross a border, and those long enough, leave their chunk. A peak without time or
    frequency says nothing, one without a value weighs nothing; a null recording is one like any other.
    """
    kind, least, gap = dict(peaks.dtypes)[recording], config.min_persistence_s / hop_s, config.max_gap_bins
    rows = peaks.select(recording, F.col(time).cast("long").alias("t"), F.col(freq).cast("long").alias("f"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v")).dropna(subset=["t", "f"]).withColumn("_chunk", F.floor(F.col("t") / chunk).cast("long"))
    rows = cut(rows)

    def sweep(t: pa.Table, starts: np.ndarray) -> pa.Table:
        at, f, v, own = (t[c].to_numpy() for c in ("t", "f", "v", "_chunk"))
        states = t["_state"].take(pa.array(starts[:-1])).to_pylist()
        parts, fought = [], []
        for (a, b), state in zip(pairwise(starts.tolist()), states, strict=True):
            got, contended = K.sweep(at[a:b], f[a:b], v[a:b], [(s["f"], s["t"]) for s in state], config.max_drift_bins, gap, (int(own[a]) + 1) * chunk)
            parts.append([dict(zip(PART_NAMES, p, strict=True)) for p in got if p[0] >= 0 or p[1] >= 0 or p[4] - p[3] >= least])
            fought.append(contended)
        first = t.take(pa.array(starts[:-1]))
        return pa.table([first[recording], first["_chunk"], pa.array(states, _STATE_TYPE), pa.array(fought, pa.bool_()), pa.array(parts, _PART_TYPE)], names=[recording, "_chunk", "_state", "_fought", "_parts"])

    def scan(t: pa.Table, starts: np.ndarray) -> pa.Table:
        place, own, state, fought, parts = (t[c].to_pylist() for c in (recording, "_chunk", "_state", "_fought", "_parts"))
        again, lines = [], []
        for a, b in pairwise(starts.tolist()):
            some, ended = _along(own[a:b], state[a:b], fought[a:b], parts[a:b], chunk, gap)
            again += [(place[a], c, [{"f": f, "t": u} for f, u in s]) for c, s in some]
            if not some:
                lines += [(place[a], *K.line_of(p)) for p in ended if p[4] - p[3] >= least]
        head = pa.array([x[0] for x in again] + [x[0] for x in lines], t.schema.field(recording).type)
        pad = lambda kind, n: pa.nulls(n, kind)
        cols = list(zip(*(x[1:] for x in lines), strict=True)) or [()] * 7
        kinds = [pa.int32()] * 5 + [pa.float64(), pa.int32()]
        left = [pa.concat_arrays([pa.array([x[k] for x in again], kind), pad(kind, len(lines))]) for k, kind in ((1, pa.int64()), (2, _STATE_TYPE))]
        right = [pa.concat_arrays([pad(k, len(again)), pa.array(c, k)]) for c, k in zip(cols, kinds, strict=True)]
        return pa.table([head, *left, *right], names=[recording, "_chunk", "_state", *(c.split()[0] for c in TRACK.split(", "))])

    none = F.lit(None).cast(_STATE)
    swept = f"{recording} {kind}, _chunk long, _state {_STATE}, _fought boolean, _parts {_PARTS}"
    known = cut(grouped(rows.withColumn("_state", F.coalesce(none, F.array().cast(_STATE))), [recording, "_chunk"], ["t", "f"], sweep, swept))
    while True:
        got = cut(grouped(known, [recording], ["_chunk"], scan, f"{recording} {kind}, _chunk long, _state {_STATE}, {TRACK}"))
        again = got.filter("_chunk is not null").select(recording, "_chunk", "_state")
        if again.isEmpty():
            return got.select(recording, *(c.split()[0] for c in TRACK.split(", ")))
        same = rows[recording].eqNullSafe(again[recording]) & (rows["_chunk"] == again["_chunk"])
        new = grouped(rows.join(again, same).select(rows[recording], rows["t"], rows["f"], rows["v"], rows["_chunk"], again["_state"]), [recording, "_chunk"], ["t", "f"], sweep, swept)
        same = known[recording].eqNullSafe(again[recording]) & (known["_chunk"] == again["_chunk"])
        known = cut(known.join(again, same, "left_anti").unionByName(new))


PART_NAMES = [n for n, _ in K.PART]


def _along(own: list[int], states: list[list], fought: list[bool], parts: list[list], chunk: int, gap: int) -> tuple[list[tuple[int, list]], list[tuple]]:
    """The chunks of one recording in order: those to be swept again, with the open runs that the one before leaves (as far as is known), and the runs put together."""
    again, ended, open_ = [], [], []  # open_: PARTs in order
    for c, state, f, raw in zip(own, states, fought, parts, strict=True):
        alive = [p for p in open_ if c * chunk - p[4] <= gap]
        ended += [p for p in open_ if c * chunk - p[4] > gap]
        want, had = [(p[11], p[4]) for p in alive], [(s["f"], s["t"]) for s in state]
        if want != had and (f or sorted(want) != sorted(had)):
            again.append((c, want))
        at = {s: k for k, s in enumerate(had)}
        here = [tuple(p[n] for n in PART_NAMES) for p in raw]
        of = {p[0]: p for p in here if p[0] >= 0}
        open_ = []
        for p in alive:  # in the order that is right, whatever order they were swept in
            mine = of.get(at.get((p[11], p[4]), -1))
            if mine is not None:
                (open_ if mine[1] >= 0 else ended).append(K.joined(p, mine))
        if again and again[-1][0] == c:  # a guess, from what this chunk left when it was swept
            open_ = [p for p in sorted(here, key=lambda p: p[1]) if p[1] >= 0]
            continue
        open_ += sorted((p for p in here if p[0] < 0 and p[1] >= 0), key=lambda p: p[1])
        ended += [p for p in here if p[0] < 0 and p[1] < 0]
    return again, ended + open_


def to_lines(tracks: DataFrame, array_id: Column, beam_id: Column, start: Column, first_hz: float, bin_hz: float, hop_s: float, first_s: float = 0.0, method: str = "classical") -> DataFrame:
    """Line rows from tracks by the gram's uniform axes; the identifier is a hash of the natural key, so that reruns agree."""
    f = lambda c: F.lit(first_hz) + F.col(c) * F.lit(bin_hz)
    return tracks.select(
        F.md5(F.concat_ws("/", array_id, beam_id, "t_start_bin", "t_end_bin", "freq_bin_min", "freq_bin_center", "freq_bin_max")).alias("correlation_id"),
        array_id.cast("string").alias("array_id"), beam_id.cast("string").alias("beam_id"),
        C.add_seconds(start, F.lit(first_s) + F.col("t_start_bin") * F.lit(hop_s)).alias("timestamp"),
        f("freq_bin_center").alias("frequency_hz"), (f("freq_bin_max") - f("freq_bin_min")).alias("bandwidth_hz"),
        F.col("peak_snr_db").alias("snr_db"), ((F.col("t_end_bin") - F.col("t_start_bin")) * F.lit(hop_s)).alias("persistence_s"),
        F.lit(method).alias("detection_method"), F.lit(None).cast("double").alias("confidence"),
    )


def merge_rows(rows: list[dict], tolerance: float) -> list[dict]:
    """Ordered cluster merge of lines (dicts with start and persistence in seconds), repeated until no pass shortens the list."""
    if len(rows) < 2:
        return rows
    while True:
        out: list[dict] = []
        for r in sorted(rows, key=lambda x: (x["start"], x["frequency_hz"], x["correlation_id"])):
            if out and _touch(out[-1], r, tolerance):
                out[-1] = _joined(out[-1], r)
            else:
                out.append(r)
        if len(out) == len(rows):
            return out
        rows = out


def merged_rows(rows: list[dict], tolerance: float) -> list[dict]:
    """``merge_rows`` of lines in order, with starts in whole microseconds (``timestamp``) and identifiers of what was merged."""
    zero, out = rows[0]["timestamp"], []
    for r in merge_rows([{**r, "start": (r["timestamp"] - zero) / 1e6} for r in rows], tolerance):
        if "ids" in r:
            r["correlation_id"] = hashlib.md5("+".join(r["ids"]).encode()).hexdigest()
        r["timestamp"] = zero + round(r["start"] * 1e6)
        out.append(r)
    return out


def _touch(a: dict, b: dict, tolerance: float) -> bool:
    apart = a["start"] + a["persistence_s"] < b["start"] or b["start"] + b["persistence_s"] < a["start"]
    return not apart and abs(a["frequency_hz"] - b["frequency_hz"]) <= tolerance


def _joined(a: dict, b: dict) -> dict:
    top = b if b["snr_db"] > a["snr_db"] else a
    start = min(a["start"], b["start"])
    end = max(x["start"] + x["persistence_s"] for x in (a, b))
    half = lambda x: (x["bandwidth_hz"] if x["bandwidth_hz"] == x["bandwidth_hz"] and x["bandwidth_hz"] else 0.0) / 2  # noqa: E731  null and NaN count as 0
    wide = max(x["frequency_hz"] + half(x) for x in (a, b)) - min(x["frequency_hz"] - half(x) for x in (a, b))
    return {**top, "start": start, "persistence_s": end - start, "bandwidth_hz": wide, "confidence": None, "ids": sorted(a.get("ids", [a["correlation_id"]]) + b.get("ids", [b["correlation_id"]]))}


def merge_nearby(lines: DataFrame, tolerance: float, keys: tuple[str, ...] = ("array_id", "beam_id")) -> DataFrame:
    """Cluster merge of line rows per (array, beam); a merged row has an identifier derived from its parts and a null confidence.

    Lines of one start and frequency are taken in order of identifier. A group is a stretch of
    lines that meet in time: what starts after all before it has ended merges with none of them.
    """
    if tolerance < 0:
        raise ValueError(f"the tolerance can't be negative: {tolerance}")
    columns = [c.split()[0] for c in LINE.split(", ")]

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        rows = t.to_pylist()
        got = [r for a, b in pairwise(starts.tolist()) for r in merged_rows(rows[a:b], tolerance)]
        return pa.table({c: pa.array([r[c] for r in got], t.schema.field(c).type) for c in columns})

    # Times cross to the kernel as whole microseconds.
    own = lines.select(*columns).withColumn("timestamp", F.unix_micros("timestamp")).withColumn("_end", F.col("timestamp") + F.round(F.col("persistence_s") * 1e6).cast("long"))
    order = ["timestamp", "frequency_hz", "correlation_id"]
    ended = F.max("_end").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    # A microsecond of slack, as the kernel compares seconds.
    dealt = _stretches(own, list(keys), ended.isNull() | (F.col("timestamp") > ended + 1), order)
    return grouped(dealt.drop("_end"), [*keys, "_stretch"], order, run, LINE.replace("timestamp timestamp", "timestamp long")).withColumn("timestamp", F.timestamp_micros("timestamp"))


def in_band(lines: DataFrame, low_hz: float, high_hz: float, freq: str = "frequency_hz") -> DataFrame:
    """Lines whose frequency (a number, or an array of which the mean counts) lies in the band, ends included; those without one are left out."""
    array = dict(lines.dtypes)[freq].startswith("array")
    mean = F.try_divide(F.aggregate(freq, F.lit(0.0), lambda a, x: a + x), F.size(freq)) if array else F.col(freq)
    return lines.filter((mean >= low_hz) & (mean <= high_hz))


def anchor_dedupe(preds: DataFrame, keys: list[str], tolerance: float = 5.0, freq: str = "freq_hz", start: str = "t_start", end: str = "t_end", conf: str = "confidence") -> DataFrame:
    """Predictions grouped along frequency by distance to the group's first: mean frequency, hull in time, largest confidence. One pass in order of frequency over each group of ``keys``, many to a call; a prediction without frequency is left out."""
    kinds = dict(preds.dtypes)
    names = [freq, start, end, conf]
    own = preds.select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).dropna(subset=[freq])

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        f = t[freq].to_pylist()
        first = []
        for a, b in pairwise(starts.tolist()):
            head = None
            for i in range(a, b):
                if head is None or abs(f[i] - head) > tolerance:
                    first.append(i)
                    head = f[i]
        at = np.array(first, int)
        if not len(at):
            return pa.table({c: t[c].slice(0, 0) for c in [*keys, *names]} | {"n": pa.array([], pa.int32())})
        n = np.diff(np.r_[at, t.num_rows])
        one = lambda c, empty: t[c].fill_null(empty).to_numpy()
        hull = (np.add.reduceat(one(freq, 0.0), at) / n, np.minimum.reduceat(one(start, np.inf), at), np.maximum.reduceat(one(end, -np.inf), at), np.maximum.reduceat(one(conf, -np.inf), at))
        return pa.table({**{k: t[k].take(pa.array(at)) for k in keys}, **{c: pa.array(v, mask=~np.isfinite(v)) for c, v in zip(names, hull, strict=True)}, "n": pa.array(n, pa.int32())})

    return grouped(own, keys, names, run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} double" for c in names), "n int"]))


def detect(frames: DataFrame, recording: str, time: str, power: str, first_hz: float, bin_hz: float, hop_s: float, config: DetectionConfig = DetectionConfig(), start: Column | None = None, first_s: float = 0.0, publish: Callable[[DataFrame], object] | None = None) -> DataFrame:
    """Frames to merged line rows: background, peaks, tracks, projection, merge. ``publish`` gets the result too (``Topics.publish`` of a topic, say)."""
    normal = N.tpsw(frames, power, "_snr", config.train, config.central, config.gap, config.mask_db, config.least)
    if config.method == "two_d":
        peaks = N.peaks_2d(normal, recording, time, "_snr", config.snr_db, config.neighbourhood)
    else:
        peaks = peaks_per_bin(normal, recording, time, "_snr", config.snr_db, config.separation)
    tracks = persistent_lines(peaks, recording, time, "freq_bin", "value", hop_s, config.persistence)
    lines = to_lines(tracks, F.col(recording).cast("string"), F.lit("0"), start if start is not None else F.timestamp_micros(F.lit(0).cast("long")), first_hz, bin_hz, hop_s, first_s)
    if config.merge:
        lines = merge_nearby(lines, C.merge_tolerance(config.persistence.max_drift_bins, bin_hz, 2) if config.tolerance_hz is None else config.tolerance_hz)
    if publish is not None:
        publish(lines)
    return lines


def false_alarm_grid(normal: DataFrame, recording: str, time: str, power: str, hop_s: float, snrs: list[float], persistences: list[float], first_hz: float, bin_hz: float, config: DetectionConfig = DetectionConfig()) -> DataFrame:
    """Lines per hour for each (snr, persistence), in one pass over the frames.

    Peaks are found once at the least SNR: thinning goes by height, so those that reach a larger
    one are its peaks. They are tracked for every SNR that they reach, at the least persistence, which only filters
    tracks, and merged per cell of the grid.
    """
    spark, gap = normal.sparkSession, config.persistence
    hours = normal.agg((F.count("*") * F.lit(hop_s) / 3600.0).alias("hours"))
    peaks = peaks_per_bin(normal, recording, time, power, min(snrs), config.separation)
    each = peaks.withColumn("_snr", F.explode(F.filter(F.array(*[F.lit(float(x)) for x in snrs]), lambda x: x <= F.col("value"))))
    each = each.withColumn("_key", F.concat_ws("|", F.col("_snr").cast("string"), F.col(recording).cast("string")))
    every = persistent_lines(each, "_key", time, "freq_bin", "value", hop_s, PersistenceConfig(min(persistences), gap.max_drift_bins, gap.max_gap_bins))
    lasts = F.filter(F.array(*[F.lit(float(x)) for x in persistences]), lambda x: F.col("t_end_bin") - F.col("t_start_bin") >= x / hop_s)
    grid = every.withColumn("_p", F.explode(lasts))
    lines = to_lines(grid, F.concat_ws("|", F.col("_p").cast("string"), "_key"), F.lit("0"), F.timestamp_micros(F.lit(0).cast("long")), first_hz, bin_hz, hop_s)
    if config.merge:
        lines = merge_nearby(lines, C.merge_tolerance(gap.max_drift_bins, bin_hz, 2) if config.tolerance_hz is None else config.tolerance_hz)
    cell = F.split("array_id", r"\|", 3)
    n = lines.groupBy(cell[0].cast("double").alias("persistence_s"), cell[1].cast("double").alias("snr_db")).agg(F.count("*").alias("n_lines"))
    cells = spark.createDataFrame([(float(s), float(p)) for s in snrs for p in persistences], "snr_db double, persistence_s double")
    # n has a row a cell at most.
    return cells.join(F.broadcast(n), ["snr_db", "persistence_s"], "left").crossJoin(F.broadcast(hours)).select("snr_db", "persistence_s", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), (F.coalesce("n_lines", F.lit(0)) / F.col("hours")).alias("per_hour"))
