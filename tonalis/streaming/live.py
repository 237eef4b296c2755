"""Live forms: topics with isolated handlers, frame-local normalisation, peaks, persistence tracking and merging with state, windowed counts."""

from __future__ import annotations

import hashlib
import json
import logging
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tonalis.functions import kernels as K
from tonalis.operators.tracks import LINE, TRACK, PersistenceConfig, merge_rows

#: Topics; fixed values.
TOPICS = ("gram.generated", "line.detected", "contact.initiated", "contact.updated")


class Topics:
    """Handlers by topic, called in order; one that fails is logged and does not stop the others. As a sink, each batch's rows of a topic go to its handlers as a DataFrame."""

    def __init__(self) -> None:
        self._handlers: dict[str, list[Callable]] = {}

    def subscribe(self, topic: str, handler: Callable) -> None:
        self._handlers.setdefault(topic, []).append(handler)

    def publish(self, topic: str, message: object) -> int:
        """Returns how many handlers succeeded."""
        ok = 0
        for h in list(self._handlers.get(topic, ())):
            try:
                h(message)
                ok += 1
            except Exception:
                logging.getLogger(__name__).exception("a handler of %s failed", topic)
        return ok

    def reset(self) -> None:
        self._handlers.clear()

    def sink(self, stream: DataFrame, topic: str, checkpoint: str | None = None):  # noqa: ANN201
        w = stream.writeStream.foreachBatch(lambda df, _: self.publish(topic, df))
        return w.option("checkpointLocation", checkpoint) if checkpoint else w


_DEFAULT = Topics()


def default_topics() -> Topics:
    return _DEFAULT


def live_tracks(peaks: DataFrame, key: str, time: str, freq: str, value: str, hop_s: float, config: PersistenceConfig = PersistenceConfig()) -> DataFrame:
    """Tracks of a stream of peaks per key, in append mode.

    Peaks wait in state until every run that they could belong to is closed: once no peak has
    come for more than the gap, all before it is tracked as in a batch, so the rows equal the
    batch's. State is as large as the peaks since the last such pause; the key must see its
    peaks in time order of bins across batches.
    """
    kind = dict(peaks.dtypes)[key]
    state_type = "t array<bigint>, f array<bigint>, v array<double>"
    least = config.min_persistence_s / hop_s

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, f, v = (list(x) for x in (state.get if state.exists else ([], [], [])))
        for b in batches:
            t += b[time].astype(int).tolist()
            f += b[freq].astype(int).tolist()
            v += b[value].astype(float).tolist()
        rows = []
        seen = sorted(set(t))
        ends = [a for a, b in zip(seen, seen[1:], strict=False) if b - a > config.max_gap_bins]
        over = state.hasTimedOut
        upto = seen[-1] if over and seen else (ends[-1] if ends else None)
        if upto is not None:
            s = pd.DataFrame({"t": t, "f": f, "v": v})
            old, rest = s[s["t"] <= upto], s[s["t"] > upto]
            rows = K.track(old["t"].to_numpy(), old["f"].to_numpy(), old["v"].to_numpy(), config.max_drift_bins, config.max_gap_bins, least)
            t, f, v = (rest[c].tolist() for c in "tfv")
        if t:
            state.update((t, f, v))
            state.setTimeoutDuration(60_000)
        elif state.exists:
            state.remove()
        if rows:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in TRACK.split(", ")])
            out.insert(0, key, k[0])
            yield out

    return peaks.select(key, time, freq, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {TRACK}", state_type, "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_peaks(frames: DataFrame, key: str, time: str, power: str, threshold: float = 8.0, separation: float = 4) -> DataFrame:
    """Thinned peaks per frequency bin of a stream of frames per key (key, freq_bin, time, value), in append mode; the rows equal the batch's.

    Frames wait in state until the stretches of candidates that they hold are closed: nothing to
    come can be nearer than the separation to them. The key must see its frames in time order
    across batches, without gaps. What is open when frames stop coming follows after a minute.
    """
    kind, gap = dict(frames.dtypes)[key], math.ceil(separation)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"t": [], "x": [], "done": []}
        rows = sorted([(t, x) for t, x in zip(held["t"], held["x"], strict=True)] + [(int(t), [float(v) for v in x]) for b in batches for t, x in zip(b[time], b[power], strict=True)])
        if not rows:
            return
        t, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
        done = np.array(held["done"] or [-1] * x.shape[1])
        out, need = [], []
        for f in range(x.shape[1]):
            column = x[:, f]
            change = np.flatnonzero(column[1:] != column[:-1])
            # The last plateau may yet be a peak if it is high enough and was risen to; else the next frame is the first that may.
            begun = int(change[-1]) + 1 if len(change) else 0
            rising = column[-1] >= threshold and (begun == 0 or column[begun] > column[begun - 1])
            trailing = int(t[begun]) if rising else int(t[-1]) + 1
            at = K.find_peaks(column, threshold, 1)
            at = at[t[at] > done[f]]
            open_from = trailing
            for stretch in np.split(at, np.flatnonzero(np.diff(at) >= gap) + 1) if len(at) else ():
                if state.hasTimedOut or t[stretch[-1]] <= trailing - gap:
                    kept = stretch[K.thin(stretch, column[stretch], gap)]
                    out += [(k[0], f, int(t[i]), float(column[i])) for i in kept]
                    done[f] = int(t[stretch[-1]])
                else:
                    rise = change[np.searchsorted(change, stretch[0]) - 1] + 1  # where its plateau begins
                    open_from = min(open_from, int(t[rise]))
            need.append(open_from - 1)
        if state.hasTimedOut:
            state.remove()
        else:
            keep = t >= min(need)
            state.update((json.dumps({"t": t[keep].tolist(), "x": x[keep].tolist(), "done": done.tolist()}),))
            state.setTimeoutDuration(60_000)
        if out:
            yield pd.DataFrame(out, columns=[key, "freq_bin", time, "value"])

    return frames.select(key, time, power).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, freq_bin int, {time} long, value double", "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def live_merge(lines: DataFrame, tolerance: float, keys: tuple[str, ...] = ("array_id", "beam_id")) -> DataFrame:
    """Merged line rows of a stream of lines per beam, in append mode; the rows equal the batch's.

    Lines wait in state until one comes that starts after all of them have ended: what is before
    it is merged. The beam must see its lines in order of start across batches.
    """
    columns = [c.split()[0] for c in LINE.split(", ")]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = json.loads(state.get[0]) if state.exists else []
        for b in batches:
            for r in b.to_dict("records"):
                confidence, wide = r["confidence"], r["bandwidth_hz"]
                rows.append({**r, "timestamp": int(r["timestamp"]), "confidence": None if confidence is None or confidence != confidence else confidence, "bandwidth_hz": None if wide is None or wide != wide else wide})
        rows.sort(key=lambda r: (r["timestamp"], r["frequency_hz"], r["correlation_id"]))
        cut, end = 0, None
        for i, r in enumerate(rows):
            if end is not None and r["timestamp"] > end + 1:
                cut = i
            last = r["timestamp"] + round(r["persistence_s"] * 1e6)
            end = last if end is None else max(end, last)
        cut = len(rows) if state.hasTimedOut else cut
        old, rows = rows[:cut], rows[cut:]
        if rows:
            state.update((json.dumps(rows),))
            state.setTimeoutDuration(60_000)
        elif state.exists:
            state.remove()
        if old:
            zero = old[0]["timestamp"]
            got = merge_rows([{**r, "start": (r["timestamp"] - zero) / 1e6} for r in old], tolerance)
            for r in got:
                if "ids" in r:
                    r["correlation_id"] = hashlib.md5("+".join(r["ids"]).encode()).hexdigest()
                r["timestamp"] = zero + round(r["start"] * 1e6)
            yield pd.DataFrame([{c: r[c] for c in columns} for r in got]).astype({"bandwidth_hz": float, "confidence": float})

    own = lines.select(*columns).withColumn("timestamp", F.unix_micros("timestamp")).groupBy(*keys)
    out = own.applyInPandasWithState(step, LINE.replace("timestamp timestamp", "timestamp long"), "held string", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.withColumn("timestamp", F.timestamp_micros("timestamp"))


def windowed_counts(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; rows later than ``late`` are dropped once their window is out. (New: the batch engine has no windows of this kind.)"""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    d = events.withWatermark(ts, late) if events.isStreaming else events
    g = d.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), *keys, "n", "total")
