"""Recordings in blocks against the kernels of whole recordings."""

import io
import struct
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tonalis.functions import kernels as K
from tonalis.operators import blocks as B
from tonalis.operators import grams as G
from tonalis.operators.batches import grouped
from tonalis.plans import gram_queries as Q
from tonalis.plans import inputs as X
from tonalis.sources import audio, readers

SIZES = [700, 1000, 3001]


def recordings(rates=(1000, 800), lengths=(1, 50, 699, 700, 1400, 4003)):
    rng = np.random.default_rng(3)
    return [(f"{rate}/{n}", rate, (rng.normal(0, 1, n) + np.sin(np.arange(n) / 3) + 2).tolist()) for rate in rates for n in lengths]


@pytest.fixture(scope="module")
def waves(spark):
    return spark.createDataFrame([*recordings(), ("none", 1000, None), ("empty", 1000, [])], "recording_id string, sample_rate_hz int, samples array<double>").repartition(4).cache()


def frames_of(df, *columns):
    return {(r.recording_id, r.time_bin): (r.time_s, *(np.array(r[c]) for c in columns)) for r in df.collect()}


def whole(blocks):
    out = {}
    for r in blocks.collect():
        out.setdefault(r.recording_id, []).append((r.start, r.n, r.samples))
    for parts in out.values():
        parts.sort()
        assert [s for s, *_ in parts] == np.cumsum([0, *(len(x) for *_, x in parts[:-1])]).tolist() and sum(len(x) for *_, x in parts) == parts[0][1]
    return {k: np.concatenate([x for *_, x in v]) for k, v in out.items()}


def test_blocks_of_arrays_and_of_long_samples(spark, waves):
    long = spark.createDataFrame([(k, i, x) for k, _, v in recordings((1000,)) for i, x in enumerate(v)], "recording_id string, i long, x double").repartition(3)
    a = {(r.recording_id, r.block): (r.n, r.start, r.samples) for r in B.from_samples(long, "recording_id", "i", "x", 1000, 700).collect()}
    b = {(r.recording_id, r.block): (r.n, r.start, r.samples) for r in B.from_arrays(waves.filter("sample_rate_hz = 1000"), size=700).collect()}
    assert a == b and len(a) > 8 and all(len(x) < 1400 for *_, x in a.values())


@pytest.mark.parametrize("target", [1000, 333])
def test_resampling_in_blocks(waves, target):
    got = whole(B.resampled(B.from_arrays(waves, size=700), target, size=700))
    for k, rate, x in recordings():
        assert np.allclose(got[k], K.resample(np.array(x), rate, target), rtol=0, atol=1e-12), k
    assert set(got) == {k for k, *_ in recordings()}


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("sos", [K.butter_sos(4, (0.1, 0.3)), K.butter_sos(4, 0.05), K.cheby1_sos(8, 0.05, 0.16)], ids=["band", "low", "cheby"])
def test_filters_in_blocks(waves, size, sos):
    got = whole(B.zero_phase(B.from_arrays(waves, size=size), sos, size=size))
    for k, _, x in recordings():
        want = K.zero_phase(sos, np.array(x))
        assert np.allclose(got[k], want, rtol=0, atol=1e-9), (k, np.abs(got[k] - want).max())


def test_the_last_block_of_a_pass_is_not_run_from_rest(waves, monkeypatch):
    """Each block goes through the filter once a pass, and those that others follow once more."""
    sent = []
    real = B.grouped
    monkeypatch.setattr(B, "grouped", lambda rows, *a: sent.append(rows.count()) or real(rows, *a))
    blocks = B.from_arrays(waves, size=700)
    B.zero_phase(blocks, K.butter_sos(4, 0.05), size=700)
    assert sent == [blocks.filter("n >= 1400").groupBy("recording_id").count().selectExpr("sum(count - 1)").first()[0]] * 2


def test_filters_need_blocks_longer_than_the_extension(waves):
    with pytest.raises(ValueError, match="too short"):
        B.zero_phase(B.from_arrays(waves, size=20), K.butter_sos(4, (0.1, 0.3)), size=20)


@pytest.mark.parametrize("size", [97, 1000])
def test_lofar_in_blocks(waves, size):
    """Frames longer than a block, overlapping, and of recordings at two rates."""
    cfg = G.LofarConfig(1000, 256, 64, 200, freq_min_hz=50.0, freq_max_hz=400.0, train=9, central=1, gap=1)
    got = frames_of(B.lofar_blocks(B.from_arrays(waves, size=size), cfg, size=size), "power_db", "normalized_power_db")
    want = frames_of(G.lofar(waves, cfg), "power_db", "normalized_power_db")
    assert set(got) == set(want) and len(want) > 50
    assert all(np.allclose(x, y, rtol=0, atol=1e-9) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_demon_in_blocks(waves):
    cfg = G.DemonConfig(1000, 100.0, 400.0, 50.0, 5, 64, 16)
    long = waves.filter("size(samples) > 400")
    got = frames_of(B.demon_blocks(B.from_arrays(long, size=700), cfg, size=700), "power_db")
    want = frames_of(G.demon(long, cfg), "power_db")
    assert set(got) == set(want) and len(want) > 20
    assert all(np.allclose(x, y, rtol=0, atol=1e-6) for k in want for x, y in zip(got[k], want[k], strict=True))


def test_no_recordings(waves):
    none = B.from_arrays(waves.filter("false"), size=700)
    assert B.lofar_blocks(none, G.LofarConfig(1000, 256, 64, 200, freq_max_hz=400.0), size=700).count() == 0
    assert B.demon_blocks(none, G.DemonConfig(1000, 100.0, 400.0, 50.0, 5, 64, 16), size=700).count() == 0


def test_queries_in_blocks_equal_whole_recordings(spark):
    """c2_demon_blocks over the whole table against the kernel of each recording."""
    d = "/root/testdata/sf0.001"
    rows = {}
    for r in X.waveform(spark, d).collect():
        rows.setdefault(r.rec, {})[r.i] = r.x
    got = {}
    for r in Q.c2_demon_blocks(spark, d).collect():
        got[r.rec, r.time_bin] = (r.time_s, r.power_db)
    n = 0
    for rec, x in rows.items():
        _, t, p = K.demon_power_db(np.array([x[i] for i in range(len(x))]), 1000, (100.0, 400.0), 50.0, 5, 32, 8)
        for k in range(len(t)):
            assert got[rec, k][0] == pytest.approx(t[k]) and np.allclose(got[rec, k][1], p[k], rtol=0, atol=1e-6)
            n += 1
    assert n == len(got) > 100


def riff(tag, bits, channels, rate, data, extensible=False, cut=0, junk=b""):
    form = struct.pack("<HHIIHH", 0xFFFE if extensible else tag, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    if extensible:
        form += struct.pack("<HHIH", 22, bits, 0, tag) + b"\0" * 14
    body = b"WAVE" + (b"LIST" + struct.pack("<I", len(junk)) + junk + b"\0" * (len(junk) % 2) if junk else b"") + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data) + cut) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav_files_by_ranges(spark, tmp_path):
    """Every width, float files, extensible headers, chunks before the samples, broken-off and unreadable files."""
    rng = np.random.default_rng(4)
    x = rng.uniform(-0.9, 0.9, (5000, 2)).astype(np.float32)
    p24 = (x * (1 << 23)).astype("<i4")
    files = {
        "a8.wav": riff(1, 8, 2, 8000, ((x * 128) + 128).astype(np.uint8).tobytes()), "b16.wav": riff(1, 16, 2, 8000, (x * 32768).astype("<i2").tobytes(), junk=b"odd"),
        "c24.wav": riff(1, 24, 2, 8000, p24.view(np.uint8).reshape(-1, 4)[:, :3].tobytes(), extensible=True), "d32.WAV": riff(1, 32, 2, 8000, (x.astype(float) * 2**31).astype("<i4").tobytes()),
        "e-float.wav": riff(3, 32, 2, 8000, x.astype("<f4").tobytes()), "f-double.wav": riff(3, 64, 2, 8000, x.astype("<f8").tobytes(), extensible=True), "g-cut.wav": riff(1, 16, 2, 8000, (x * 32768).astype("<i2").tobytes(), cut=4000),
    }
    bad = {"x.wav": b"RIFF", "y.wav": b"R", "z.flac": b"fLaC\0", "law.wav": riff(7, 8, 1, 8000, b"abc"), "none.wav": riff(1, 16, 1, 8000, b"")}
    flac = b"fLaC\0\0\0\x22" + bytes(10) + ((44100 << 44) | (1 << 41) | (15 << 36) | 441000).to_bytes(8, "big") + bytes(16)
    for name, raw in {**files, **bad, "s.flac": flac}.items():
        (tmp_path / name).write_bytes(raw)
    listed = readers.audio_files(spark, str(tmp_path))
    blocks = audio.wav_blocks(listed, size=700)
    got = {}
    for r in blocks.collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.start, r.samples))
    assert set(got) == set(files) and all(len(v) == 5000 // 700 for v in got.values())
    for name, parts in got.items():
        y = np.concatenate([v for _, v in sorted(parts)])
        assert len(y) == 5000 and np.abs(y - x.mean(axis=1)).max() < (0.01 if name[0] == "a" else 1e-4)
    heads = {r.path.rsplit("/", 1)[1]: (r.sample_rate_hz, r.duration_s, r.n_channels) for r in readers.probe(listed).collect()}
    assert all(heads[k] == (8000, 0.625, 2) for k in files) and heads["s.flac"] == (44100, 10.0, 2)
    assert all(heads[k] == (None, None, None) for k in ("x.wav", "y.wav", "z.flac", "law.wav")) and heads["none.wav"] == (8000, 0.0, 1)
    whole = {r.path.rsplit("/", 1)[1]: r.samples for r in readers.decode(listed).collect()}
    assert {k for k, v in whole.items() if v} == set(files) and np.allclose(whole["e-float.wav"], x.mean(axis=1), atol=1e-6)
    assert readers.probe(spark.createDataFrame([("nofs://x/y.wav",), ("/not/there.wav",)], "path string")).filter("sample_rate_hz is null").count() == 2
    cfg = G.LofarConfig(8000, 512, 128, 512, freq_max_hz=4000.0)
    framed = B.lofar_blocks(audio.wav_blocks(listed.filter("path like '%b16.wav'"), "recording_id", 700), cfg, size=700)
    one = G.lofar(readers.decode(listed.filter("path like '%b16.wav'")).withColumnRenamed("path", "recording_id"), cfg)
    a, b = (np.array([r.power_db for r in d.orderBy("time_bin").collect()]) for d in (framed, one))
    assert a.shape == b.shape and np.allclose(a, b, atol=1e-3)


def test_a_long_file_is_not_read_whole(tmp_path):
    """A sparse file of 3 GB: the header and the last samples only."""
    n = 3 * 2**29 - 100
    path = tmp_path / "long.wav"
    with path.open("wb") as f:
        head = riff(1, 16, 1, 48000, b"")
        f.write(head[:-4] + struct.pack("<I", 2 * n))
        f.seek(44 + 2 * (n - 3))
        f.write(struct.pack("<3h", 1 << 14, 1 << 13, 1 << 12))
    with audio.opened(str(path)) as f:
        at = audio.layout(f)
        assert at.n == n and audio.samples(f.read_at(6, at.offset + 2 * (n - 3)), at).tolist() == [0.5, 0.25, 0.125]


def test_wave_module_agrees():
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(22050)
        w.writeframes(np.arange(-500, 500, dtype="<i2").tobytes())
    at = audio.layout(audio.pa.BufferReader(raw.getvalue()))
    assert (at.rate, at.channels, at.n) == (22050, 1, 1000)
    assert np.allclose(audio.samples(raw.getvalue()[at.offset :], at) * 32768, np.arange(-500, 500))


def test_kernels_get_a_few_mb_at_a_time(spark):
    """Groups of long arrays: what a task holds doesn't grow with its partition, but for a group that is larger, which comes whole."""

    def size(t, starts):
        return pa.table([t["k"].slice(0, 1), pa.array([t.nbytes]), pa.array([len(starts) - 1])], names=["k", "bytes", "groups"])

    rows = spark.range(5000).select(F.when(F.col("id") < 2500, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id", F.array_repeat(F.lit(1.0), 1000).alias("samples")).coalesce(1)
    got = grouped(rows, ["k"], ["id"], size, "k long, bytes long, groups long").collect()
    assert sum(r.groups for r in got) == 2501
    assert max(r.bytes for r in got if r.k != -1) < 16 << 20 and sum(r.bytes for r in got) > 39_000_000 and sum(r.k == -1 for r in got) == 1
