"""Live operators in event time: late, out-of-order and stalled input gives the batch's rows."""

import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonalis.operators import tracks as T
from tonalis.streaming import event_time as V

RUN = itertools.count()


def streamed(spark, tmp_path, batches, schema, make, stall=0.0):
    """Rows that ``make`` gives of batches that come one after the other, each when the one before is done."""
    name, src = f"event_{next(RUN)}", tmp_path / f"in{next(RUN)}"
    src.mkdir()
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(src))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"ck{name}")).trigger(processingTime="0 seconds").start()
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).repartition(1).write.parquet(str(src / f"{k:03d}"))
            q.processAllAvailable()
            time.sleep(stall)
        q.processAllAvailable()
        assert q.exception() is None
    finally:
        q.stop()
    return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]


def shuffled(rows, n, reach, seed=0):
    """Rows in batches of n, each moved by up to ``reach`` places."""
    order = np.argsort(np.arange(len(rows)) + np.random.default_rng(seed).uniform(0, reach, len(rows)), kind="stable")
    rows = [rows[i] for i in order]
    return [rows[i : i + n] for i in range(0, len(rows), n)]


PEAKS = "k long, t int, f int, v double"
CFG = T.PersistenceConfig(2.0, 2, 4)


def peaks(n=400):
    rng = np.random.default_rng(1)
    own = {(k, int(t), int(f)) for k in (1, 2) for t, f in zip(rng.integers(0, 300, n), rng.integers(0, 12, n), strict=True) if (t // 20) % 3}
    return sorted(((k, t, f, float(v)) for (k, t, f), v in zip(own, rng.random(len(own)), strict=True)), key=lambda r: r[1])


LAST = [(9, 5000, 1, 1.0)]  # moves the watermark past all the rest


@pytest.mark.parametrize("reach", [0, 60])
def test_tracks_of_late_and_mixed_peaks(spark, tmp_path, reach):
    rows = peaks()
    want = [tuple(r) for r in T.persistent_lines(spark.createDataFrame(rows, PEAKS), "k", "t", "f", "v", 1.0, CFG).collect()]
    got = streamed(spark, tmp_path, [*shuffled(rows, 150, reach), LAST], PEAKS, lambda s: V.event_tracks(s, "k", "t", "f", "v", 1.0, CFG, "120 seconds"))
    assert sorted(got) == sorted(want) and len(want) > 20


def test_a_stalled_source_closes_nothing(spark, tmp_path):
    """One run in two parts with a pause of the machine between: one row, not two."""
    rows = [(1, t, 5, 1.0) for t in range(30)]
    got = streamed(spark, tmp_path, [rows[:15], rows[15:], LAST], PEAKS, lambda s: V.event_tracks(s, "k", "t", "f", "v", 1.0, CFG, "1 second"), stall=1.0)
    assert got == [(1, 5, 5, 5, 0, 29, 1.0, 30)]


def test_what_is_too_late_is_left_out(spark, tmp_path):
    rows = [(1, t, 5, 1.0) for t in range(10)]
    late = [(1, 12, 5, 1.0), (1, 100, 7, 1.0)]
    got = streamed(spark, tmp_path, [rows, [(2, 200, 1, 1.0)], [(2, 201, 1, 1.0)], late, LAST], PEAKS, lambda s: V.event_tracks(s, "k", "t", "f", "v", 1.0, CFG, "10 seconds"))
    assert got == [(1, 5, 5, 5, 0, 9, 1.0, 10)]


def test_the_last_stretch_waits(spark, tmp_path):
    rows = [(1, t, 5, 1.0) for t in range(10)]
    assert streamed(spark, tmp_path, [rows, [(2, 11, 1, 1.0)]], PEAKS, lambda s: V.event_tracks(s, "k", "t", "f", "v", 1.0, CFG, "10 seconds")) == []


@pytest.mark.parametrize("reach", [0, 12])
def test_merging_of_late_and_mixed_lines(spark, tmp_path, reach):
    rng = np.random.default_rng(2)
    zero = 1_700_000_000_000_000

    def line(i, start, long, freq):
        return (f"id{i:03d}", "a", str(i % 2), zero + int(start * 1e6), float(freq), [None, 2.0][i % 2], float(rng.random()), float(long), "classical", None)

    rows = sorted((line(i, rng.uniform(0, 300), rng.uniform(1, 5), rng.integers(40, 50)) for i in range(120)), key=lambda r: r[3])
    schema = T.LINE.replace("timestamp timestamp", "timestamp long")
    as_lines = lambda d: d.withColumn("timestamp", F.timestamp_micros("timestamp"))
    want = [tuple(r) for r in T.merge_nearby(as_lines(spark.createDataFrame(rows, schema)), 2.0).collect()]
    last = [("last", "z", "z", zero + 10**10, 1.0, 1.0, 1.0, 1.0, "classical", None)]
    got = streamed(spark, tmp_path, [*shuffled(rows, 60, reach), last], schema, lambda s: V.event_merge(as_lines(s), 2.0, late="200 seconds"))
    rounded = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
    assert rounded(got) == rounded(want) and len(want) < 120


@pytest.mark.parametrize("reach", [0, 8])
def test_peaks_of_late_and_mixed_frames(spark, tmp_path, reach):
    rng = np.random.default_rng(3)
    x = np.r_[rng.integers(0, 14, (90, 3)), np.zeros((40, 3))].astype(float)
    x[20:25, 1] = 12
    rows = [(1, t, [float(v) for v in r]) for t, r in enumerate(x)]
    schema = "rec long, t int, power array<double>"
    want = [tuple(r) for r in T.peaks_per_bin(spark.createDataFrame(rows, schema), "rec", "t", "power", 8.0, 4).select("rec", "freq_bin", "t", "value").collect()]
    last = [(2, 5000, [0.0, 0.0, 0.0])]
    got = streamed(spark, tmp_path, [*shuffled(rows, 65, reach), last], schema, lambda s: V.event_peaks(s, "rec", "t", "power", 1.0, 8.0, 4, "20 seconds"))
    assert sorted(got) == sorted(want) and len(want) > 20
