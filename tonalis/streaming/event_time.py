"""Live tracking, merging and peaks in event time: rows equal the batch's, however late within the bound, out of order or stalled the input comes.

Rows wait in list state. A stretch of them (what can have to do with each other) is closed when
the watermark has passed all that it could still meet, never by the clock of the machine: an
event-time timer at the end of each stretch says when. A source that stalls only delays rows.
State is as large as the open stretches. What comes later than ``late`` behind the newest row
of the stream is left out, as by any watermark. The last stretch of a stream waits for a row that moves the watermark
past its end.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tonalis.functions import kernels as K
from tonalis.operators.tracks import LINE, TRACK, PersistenceConfig, merged_rows

Rows = list[tuple]
#: Event time of bin 0, in milliseconds: a stream's watermark begins at 0, and what isn't after it is late.
ORIGIN = 10**12
#: List and timer state need this state store; a fixed name.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Stretches(StatefulProcessor):
    """Holds rows (at, end, ...: milliseconds of event time from and until which a row can meet others) and gives whole closed stretches to ``emit``."""

    def __init__(self, schema: str, emit: Callable[[tuple, list[Rows]], pd.DataFrame | None]) -> None:
        self._schema, self._emit = schema, emit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._rows = handle.getListState("rows", self._schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = [c.split()[0] for c in self._schema.split(", ")]
        new = [tuple(None if v is None or v != v else v.item() if isinstance(v, np.generic) else v for v in r) for b in rows for r in b[names].itertuples(index=False, name=None)]
        if new:
            self._rows.appendList(new)
            # A stretch that is longer than these rows has the timer of a later one, too.
            for _, end in _stretches(sorted(new, key=lambda r: r[0])):
                self._handle.registerTimer(end + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        held = sorted(self._rows.get(), key=lambda r: r[0]) if self._rows.exists() else []
        closed = [rows for rows, end in _stretches(held) if end < upto]  # the first ones: ends rise
        n = sum(map(len, closed))
        if n:
            if n < len(held):
                self._rows.put([tuple(r) for r in held[n:]])
            else:
                self._rows.clear()
            out = self._emit(key, closed)
            if out is not None and len(out):
                yield out

    def close(self) -> None:
        pass


def _stretches(rows: Rows) -> list[tuple[Rows, int]]:
    """Sorted rows cut where one begins after all before it have ended, and those ends."""
    out: list[tuple[Rows, int]] = []
    for r in rows:
        if out and r[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r[1]))
            out[-1][0].append(r)
        else:
            out.append(([r], r[1]))
    return out


def _held(stream: DataFrame, keys: list[str], at: Column, late: str, schema: str, emit: Callable, result: str) -> DataFrame:
    spark: SparkSession = stream.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    marked = stream.withColumn("ts_", F.timestamp_millis(at)).withWatermark("ts_", late)
    names = [c.split()[0] for c in schema.split(", ")]
    return marked.select(*keys, "ts_", *names).groupBy(*keys).transformWithStateInPandas(Stretches(schema, emit), outputStructType=result, outputMode="Append", timeMode="EventTime")


def event_tracks(peaks: DataFrame, key: str, time: str, freq: str, value: str, hop_s: float, config: PersistenceConfig = PersistenceConfig(), late: str = "10 seconds") -> DataFrame:
    """``tracks.persistent_lines`` of a stream of peaks, in append mode. The event time of a peak is its bin times ``hop_s``; peaks without key, time or frequency say nothing."""
    kind, least = dict(peaks.dtypes)[key], config.min_persistence_s / hop_s

    def emit(k: tuple, closed: list[Rows]) -> pd.DataFrame | None:
        t, f, v = (np.array([r[c] for rows in closed for r in rows]) for c in (2, 3, 4))
        got = K.track(t, f, v, config.max_drift_bins, config.max_gap_bins, least)
        if not got:
            return None
        out = pd.DataFrame(got, columns=[c.split()[0] for c in TRACK.split(", ")])
        out.insert(0, key, k[0])
        return out

    ms = lambda bins: (F.col(time).cast("double") + bins) * F.lit(hop_s * 1000.0) + ORIGIN
    own = peaks.dropna(subset=[key, time, freq]).withColumns({"at_ms": F.floor(ms(0)), "end_ms": F.ceil(ms(config.max_gap_bins))})
    own = own.select(key, "at_ms", "end_ms", F.col(time).cast("long").alias("t"), F.col(freq).cast("long").alias("f"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    return _held(own, [key], F.col("at_ms"), late, "at_ms long, end_ms long, t long, f long, v double", emit, f"{key} {kind}, {TRACK}")


def event_merge(lines: DataFrame, tolerance: float, keys: tuple[str, ...] = ("array_id", "beam_id"), late: str = "10 minutes") -> DataFrame:
    """``tracks.merge_nearby`` of a stream of lines, in append mode. The event time of a line is its start; lines without one, or without keys, are left out."""
    columns = [c.split()[0] for c in LINE.split(", ")]
    schema = LINE.replace("timestamp timestamp", "timestamp long")

    def emit(k: tuple, closed: list[Rows]) -> pd.DataFrame:
        held = [sorted((dict(zip(columns, tuple(r)[2:], strict=True)) for r in rows), key=lambda r: (r["timestamp"], r["frequency_hz"], r["correlation_id"])) for rows in closed]
        got = pd.DataFrame([[r[c] for c in columns] for rows in held for r in merged_rows(rows, tolerance)], columns=columns)
        return got.astype({"bandwidth_hz": float, "confidence": float})

    own = lines.select(*columns).dropna(subset=["timestamp", *keys]).withColumn("timestamp", F.unix_micros("timestamp"))
    end = F.col("timestamp") + F.round(F.col("persistence_s") * 1e6).cast("long") + 1
    own = own.withColumns({"at_ms": F.floor(F.col("timestamp") / 1000), "end_ms": F.ceil(end / 1000)})
    out = _held_lines(own, list(keys), late, schema, emit)
    return out.withColumn("timestamp", F.timestamp_micros("timestamp"))


def _held_lines(own: DataFrame, keys: list[str], late: str, schema: str, emit: Callable) -> DataFrame:
    # Keys are copied, as the rows in state have them too.
    named = [f"k{i}_" for i in range(len(keys))]
    return _held(own.withColumns({n: F.col(k) for n, k in zip(named, keys, strict=True)}), named, F.col("at_ms"), late, f"at_ms long, end_ms long, {schema}", emit, schema)


class Frames(StatefulProcessor):
    """Holds frames until the watermark has passed them, and then those that peaks to come could still touch."""

    def __init__(self, threshold: float, separation: float, key: str, time: str) -> None:
        self._threshold, self._gap, self._names = threshold, math.ceil(separation), [key, "freq_bin", time, "value"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._frames = handle.getListState("frames", "at long, t long, x array<double>")
        self._done = handle.getValueState("done", "t array<long>, seen long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [(int(a), int(t), [float(v) for v in x]) for b in rows for a, t, x in zip(b["at_ms"], b["t"], b["x"], strict=True)]
        if new:
            self._frames.appendList(new)
            self._handle.registerTimer(max(r[0] for r in new) + 1)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(r) for r in self._frames.get()), key=lambda r: r[1]) if self._frames.exists() else []
        now = [r for r in held if r[0] < upto]
        if not now:
            return
        width = max(len(r[2]) for r in now)
        t, x = np.array([r[1] for r in now]), np.array([r[2] for r in now if len(r[2]) == width])
        told = self._done.get() if self._done.exists() else None
        done = list(told[0]) if told else [int(t[0]) - 1] * width
        out, first = [], []
        for f in range(width):
            peaks, done[f], open_from = closed_peaks(t, x[:, f], self._threshold, self._gap, done[f])
            out += [(key[0], f, *p) for p in peaks]
            first.append(open_from)
        keep = min(first) - 1
        self._frames.put([r for r in held if r[1] >= keep or r[0] >= upto])
        self._done.update((done, int(t[-1])))
        if out:
            yield pd.DataFrame(out, columns=self._names)

    def close(self) -> None:
        pass


def closed_peaks(t: np.ndarray, x: np.ndarray, threshold: float, gap: int, done: int) -> tuple[list[tuple[int, float]], int, int]:
    """Of one bin's frames so far, in order: the thinned peaks behind ``done`` that nothing to come can change, the last time that is settled, and the first time that must be kept for what isn't."""
    change = np.flatnonzero(x[1:] != x[:-1])
    begun = int(change[-1]) + 1 if len(change) else 0
    # The last plateau may yet be a peak if it is high enough and was risen to; else the next frame is the first that may.
    rising = x[-1] >= threshold and (begun == 0 or x[begun] > x[begun - 1])
    trailing = int(t[begun]) if rising else int(t[-1]) + 1
    at = K.find_peaks(x, threshold, 1)
    at = at[t[at] > done]
    out, open_from = [], trailing
    for stretch in np.split(at, np.flatnonzero(np.diff(t[at]) >= gap) + 1) if len(at) else ():
        if t[stretch[-1]] <= trailing - gap:
            out += [(int(t[i]), float(x[i])) for i in stretch[K.thin(t[stretch], x[stretch], gap)]]
            done = int(t[stretch[-1]])
        else:
            open_from = min(open_from, int(t[change[np.searchsorted(change, stretch[0]) - 1] + 1]))  # where its plateau begins
            break
    return out, done, open_from


def event_peaks(frames: DataFrame, key: str, time: str, power: str, hop_s: float, threshold: float = 8.0, separation: float = 4, late: str = "10 seconds") -> DataFrame:
    """``tracks.peaks_per_bin`` of a stream of frames (key, freq_bin, time, value), in append mode. The event time of a frame is its bin times ``hop_s``; frames count time without gaps."""
    spark, kind = frames.sparkSession, dict(frames.dtypes)[key]
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    at = F.floor(F.col(time).cast("double") * F.lit(hop_s * 1000.0)) + ORIGIN
    own = frames.dropna(subset=[key, time, power]).select(key, at.alias("at_ms"), F.col(time).cast("long").alias("t"), F.col(power).alias("x")).withColumn("ts_", F.timestamp_millis("at_ms")).withWatermark("ts_", late)
    return own.groupBy(key).transformWithStateInPandas(Frames(threshold, separation, key, time), outputStructType=f"{key} {kind}, freq_bin int, {time} long, value double", outputMode="Append", timeMode="EventTime")
