"""Operators on small rows: edge cases, orders, errors; round trips."""

import math
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonalis.functions import columns as C
from tonalis.functions import kernels as Kn
from tonalis.operators import calibrate as A
from tonalis.operators import evaluate as E
from tonalis.operators import grams as G
from tonalis.operators import normalize as N
from tonalis.operators import splits as S
from tonalis.operators import synth as Y
from tonalis.operators import tracks as T
from tonalis.sources import readers as R
from tonalis.sources import sinks as K
from tonalis.streaming import live as L


def _frames(spark, x):
    return spark.createDataFrame([(0, t, [float(v) for v in row]) for t, row in enumerate(x)], "rec int, t int, power array<double>")


def _ring(x, i, half=16, g=3):
    idx = [np.clip(i + o, 0, len(x) - 1) for o in range(-half, half + 1) if abs(o) > g]
    return x[idx]


def test_split_window_and_two_pass_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3, 40)) * 3
    x[1, 20] = 40
    df = N.tpsw(_frames(spark, x).withColumn("one", N.split_window(F.col("power"))), "power", "two")
    for r in df.collect():
        row = x[r["t"]]
        one = np.array([row[i] - _ring(row, i).mean() for i in range(40)])
        assert np.allclose(r["one"], one)
        keep = one <= 6
        for i in range(40):
            ok = _ring(keep.astype(float), i).astype(bool)
            want = row[i] - _ring(row, i)[ok].mean() if ok.sum() >= 16 else one[i]
            assert r["two"][i] == pytest.approx(want)


def test_normalisation_rejects_bad_windows():
    with pytest.raises(ValueError):
        N.split_window(F.lit(0), 7, 5, 1)
    with pytest.raises(ValueError):
        N.split_window(F.lit(0), 8, 5, 1)


def test_peaks_2d_against_brute_force_across_chunks(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (23, 9)).astype(float)
    got = {(r["t"], r["freq_bin"]) for r in N.peaks_2d(_frames(spark, x), "rec", "t", "power", 8.0, chunk=5).collect()}
    want = {(t, f) for t in range(23) for f in range(9) if x[t, f] >= 8 and x[t, f] == x[max(0, t - 2) : t + 3, max(0, f - 1) : f + 2].max()}
    assert got == want


def _line(i, f, start, persist, snr, bw):
    return (f"l{i}", "a", "b", pd.Timestamp(start, unit="s").to_pydatetime(), f, bw, snr, persist, "classical", 0.5)


def test_merge_pair_chain_and_apart(spark):
    rows = [_line(0, 48.0, 0, 3.0, 10.0, 2.0), _line(1, 50.0, 2, 3.0, 15.0, 2.0), _line(2, 90.0, 20, 3.0, 9.0, None), _line(3, 48.5, 50, 3.0, 9.0, 1.0)]
    got = T.merge_nearby(spark.createDataFrame(rows, T.LINE), 2.0).orderBy("timestamp", "frequency_hz").collect()
    assert [(r["frequency_hz"], r["persistence_s"], r["snr_db"], r["bandwidth_hz"]) for r in got[:1]] == [(50.0, 5.0, 15.0, 4.0)]
    assert len(got) == 3 and got[0]["confidence"] is None
    chain = [_line(0, 48.0, 0, 3.0, 10.0, 0.0), _line(1, 50.0, 1, 3.0, 11.0, 0.0), _line(2, 52.0, 2, 3.0, 12.0, 0.0)]
    assert T.merge_nearby(spark.createDataFrame(chain, T.LINE), 2.0).count() == 1
    with pytest.raises(ValueError):
        T.merge_nearby(spark.createDataFrame(chain, T.LINE), -1.0)


def test_peaks_per_bin_against_brute_force_across_chunks(spark):
    from tonalis.functions import kernels as B

    rng = np.random.default_rng(20)
    x = rng.integers(0, 14, (400, 5)).astype(float)
    x[50:56, 1] = 13
    x[0, 2] = x[399, 2] = 50
    for gap in (1, 4, 6.5):
        got = {(r["t"], r["freq_bin"], r["value"]) for r in T.peaks_per_bin(_frames(spark, x), "rec", "t", "power", 8.0, gap).collect()}
        assert got == {(int(t), f, x[t, f]) for f in range(5) for t in B.find_peaks(x[:, f], 8.0, gap)}
    assert {tuple(r) for r in N.peak_candidates(_frames(spark, x), "rec", "t", "power", 8.0, chunk=7).collect()} == {tuple(r) for r in N.peak_candidates(_frames(spark, x), "rec", "t", "power", 8.0).collect()}


def test_tracks_and_merging_by_stretches_equal_the_whole(spark):
    from tonalis.functions import kernels as B

    rng = np.random.default_rng(21)
    rows = sorted({(int(k), int(t), int(f)) for k, t, f in zip(rng.integers(0, 3, 900), rng.integers(0, 500, 900), rng.integers(0, 25, 900), strict=True)})
    rows = [(*r, float(v)) for r, v in zip(rows, rng.random(len(rows)) * 9, strict=True)]
    cfg = T.PersistenceConfig(2.0, 2, 3)
    tracks = T.persistent_lines(spark.createDataFrame(rows, "k int, t int, f int, v double").repartition(3), "k", "t", "f", "v", 1.0, cfg)
    want = [(k, *r) for k in range(3) for r in B.track(*(np.array([r[c] for r in rows if r[0] == k]) for c in (1, 2, 3)), 2, 3, 2.0)]
    assert sorted(tuple(r) for r in tracks.collect()) == sorted(want) and len(want) > 50
    lines = T.to_lines(tracks, F.col("k").cast("string"), F.lit("0"), F.timestamp_micros(F.lit(0).cast("long")), 0.0, 1.0, 0.1)
    got = sorted((r["array_id"], r["correlation_id"], round(r["persistence_s"], 6)) for r in T.merge_nearby(lines, 3.0).collect())
    whole = []
    for k in "012":
        own = [{**r.asDict(), "start": r["timestamp"].timestamp()} for r in lines.filter(F.col("array_id") == k).collect()]
        for r in T.merge_rows(own, 3.0):
            name = __import__("hashlib").md5("+".join(r["ids"]).encode()).hexdigest() if "ids" in r else r["correlation_id"]
            whole.append((k, name, round(r["persistence_s"], 6)))
    assert got == sorted(whole) and len(whole) < lines.count()


@pytest.mark.parametrize("kind", ["steady", "crossing", "noise", "sparse"])
@pytest.mark.parametrize("chunk", [5, 40])
def test_tracks_of_a_recording_without_pause_spread_over_chunks(spark, kind, chunk):
    """Peaks in every frame: chunks that agree at once, runs that want one peak at borders, and runs over all chunks."""
    rng = np.random.default_rng(8)
    n = 300
    rows = {
        "steady": {(t, f): 5.0 + f for t in range(n) for f in (3, 20, 50)},
        "crossing": {(t, f): 1.0 + t % 7 for t in range(n) for f in (20 + int(15 * np.sin(t / 9)), 20 - int(15 * np.sin(t / 9)), 18 + t % 5)},
        "noise": {(int(t), int(f)): float(v) for t, f, v in zip(rng.integers(0, n, 1500), rng.integers(0, 30, 1500), rng.normal(2, 3, 1500), strict=True)},
        "sparse": {(t, int(rng.integers(0, 9))): 1.0 for t in range(-60, n, 3)},
    }[kind]
    peaks = spark.createDataFrame([(r, t, f, v) for (t, f), v in rows.items() for r in ("a", None)], "rec string, t int, f int, v double").repartition(3)
    got = T.persistent_lines(peaks, "rec", "t", "f", "v", 1.0, T.PersistenceConfig(4.0, 2, 3), chunk=chunk)
    t, f, v = (np.array(x) for x in zip(*((t, f, v) for (t, f), v in rows.items()), strict=True))
    want = T.K.track(t, f, v, 2, 3, 4.0)
    rounded = lambda x: (*x[:5], round(x[5], 9), x[6])
    for rec in ("a", None):
        assert sorted(rounded(tuple(r)[1:]) for r in got.filter(F.col("rec").eqNullSafe(rec)).collect()) == sorted(map(rounded, want))
    assert want and T.persistent_lines(peaks.limit(0), "rec", "t", "f", "v", 1.0).count() == 0


@pytest.mark.parametrize("chunk", [6, 50])
def test_thinning_of_a_series_without_pause_spreads_over_chunks(spark, chunk):
    """Heights that fall by and by, so that what stays depends on peaks far away, and random ones."""
    rng = np.random.default_rng(9)
    n = 400
    x = np.zeros((n, 4))
    x[1::2, 0] = 300 - np.arange(1, n, 2) * 0.5  # one chain over the whole series
    x[1::2, 1] = 100 + np.arange(1, n, 2) * 0.5
    x[1::2, 2] = rng.random(n // 2) * 50 + 9
    x[1::2, 3] = 9 + rng.integers(0, 2, n // 2)  # ties
    for gap in (3, 7.5):
        got = {(r["t"], r["freq_bin"], r["value"]) for r in T.peaks_per_bin(_frames(spark, x), "rec", "t", "power", 8.0, gap, chunk=chunk).collect()}
        assert got == {(int(t), f, x[t, f]) for f in range(4) for t in T.K.find_peaks(x[:, f], 8.0, gap)}


def test_detection_publishes_its_lines(spark):
    topics, seen = L.Topics(), []
    topics.subscribe("line.detected", lambda df: seen.append(df.count()))
    x = np.zeros((60, 64))
    x[10:50, 30] = 30.0
    got = T.detect(_frames(spark, x), "rec", "t", "power", 0.0, 1.0, 1.0, T.DetectionConfig(method="two_d"), publish=lambda df: topics.publish("line.detected", df))
    assert seen == [got.count()] == [1]


def test_anchor_dedupe_compares_with_the_head(spark):
    p = spark.createDataFrame([(0, 10.0, 0.0, 1.0, 0.5), (0, 14.0, 2.0, 3.0, 0.9), (0, 18.0, 0.0, 1.0, 0.1)], "k int, freq_hz double, t_start double, t_end double, confidence double")
    got = T.anchor_dedupe(p, ["k"], 5.0).orderBy("freq_hz").collect()
    assert [(r["freq_hz"], r["t_end"], r["confidence"], r["n"]) for r in got] == [(12.0, 3.0, 0.9, 2), (18.0, 1.0, 0.1, 1)]


def _signal(kind, sr=2000, n_s=6, seed=3):
    rng = np.random.default_rng(seed)
    t = np.arange(sr * n_s) / sr
    tone = {"steady": np.sin(2 * np.pi * 200 * t), "drift": np.sin(2 * np.pi * (195 * t + t * t)), "burst": np.where((t > 2) & (t < 2.5), np.sin(2 * np.pi * 200 * t), 0)}[kind]
    return (0.1 * tone + 0.02 * rng.standard_normal(len(t))).astype(np.float32)


@pytest.mark.parametrize(("kind", "found"), [("steady", True), ("drift", True), ("burst", False)])
def test_detection_end_to_end(spark, kind, found):
    rec = spark.createDataFrame([("r", 2000, _signal(kind).tolist())], "recording_id string, sample_rate_hz int, samples array<float>")
    cfg = G.LofarConfig(2000, 512, 128, 512, freq_min_hz=1.0, freq_max_hz=900.0)
    lo, _ = cfg.band()
    frames = G.lofar(rec, cfg)
    lines = T.detect(frames, "recording_id", "time_bin", "power_db", lo * cfg.bin_hz, cfg.bin_hz, cfg.hop_s, T.DetectionConfig(snr_db=14.0, persistence=T.PersistenceConfig(3.0, 2, 10), merge=False)).collect()
    hit = [r for r in lines if abs(r["frequency_hz"] - 200) < 12 and r["persistence_s"] >= 3 and r["snr_db"] >= 8]
    assert bool(hit) == found


def test_lofar_resamples_and_survives_null(spark):
    rec = spark.createDataFrame([("a", 4000, _signal("steady", 4000).tolist()), ("b", 4000, None)], "recording_id string, sample_rate_hz int, samples array<float>")
    cfg = G.LofarConfig(2000, 512, 128, 512, freq_min_hz=1.0, freq_max_hz=900.0)
    got = G.lofar(rec, cfg).toPandas()
    assert set(got["recording_id"]) == {"a"}
    assert abs(np.mean(got["power_db"].to_list(), axis=0).argmax() * cfg.bin_hz + cfg.band()[0] * cfg.bin_hz - 200) < 5


def test_iou_functions(spark):
    r = spark.range(1).select(C.temporal_overlap(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(3.0)).alias("a"), C.temporal_overlap(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(2.0)).alias("b"), *[C.frequency_proximity(F.lit(0.0), F.lit(float(x)), 1.0).alias(f"p{x}") for x in (2, 4, 5)]).first()
    assert r["a"] == pytest.approx(1 / 3) and r["b"] == 0 and (r["p2"], r["p4"], r["p5"]) == (1, 0.5, 0)


def test_matching_leaves_false_sides(spark):
    s = "k int, id long, freq_hz double, t_start double, t_end double, peak_snr_db double"
    p = spark.createDataFrame([(0, 1, 10.0, 0.0, 2.0, 0.0), (0, 2, 10.0, 1.0, 3.0, 0.0), (1, 3, 10.0, 0.0, 1.0, 0.0)], s)
    t = spark.createDataFrame([(0, 7, 10.0, 0.0, 2.0, 9.0), (0, 8, 10.0, 1.0, 3.0, 3.0), (2, 9, 10.0, 0.0, 1.0, 30.0)], s)
    m = {(r["k"], r["pred_id"], r["truth_id"]) for r in E.match_lines(p, t, "k", 1.0).collect()}
    assert m == {(0, 1, 7), (0, 2, 8), (1, 3, None), (2, None, 9)}
    b = E.recall_by_bucket(E.match_lines(p, t, "k", 1.0), t, "k").orderBy("ord").collect()
    assert len(b) == 6 and b[0]["recall"] is None and b[3]["recall"] == 1.0 and b[5]["recall"] == 0.0
    assert b[0]["all_fp"] == 1 and b[0]["gate_recall"] == 0.5 and not b[0]["passes"]


def test_reliability_edges_and_empty_bins(spark):
    rows = [(0.3, 1), (0.6, 0), (0.7, 1), (1.0, 1), (1.5, 0)]
    b = A.reliability_bins(spark.createDataFrame(rows, "confidence double, label int")).orderBy("bin").collect()
    assert [r["n"] for r in b] == [0, 0, 1, 0, 0, 1, 1, 0, 0, 1] and b[0]["mean_score"] is None
    ece = [(0.05, int(i == 0)) for i in range(10)] + [(0.95, int(i != 0)) for i in range(10)]
    got = A.reliability_summary(A.reliability_bins(spark.createDataFrame(ece, "confidence double, label int"))).first()
    assert got["ece"] == pytest.approx(0.05)


def test_conformal_quantile_interpolates_and_clips(spark):
    rng = np.random.default_rng(4)
    s = [(float(x), 1) for x in rng.random(37)] + [(float(x), 0) for x in rng.random(3)]
    f = {r["alpha"]: r for r in A.conformal_fit(spark.createDataFrame(s, "confidence double, label int")).collect()}
    pos = np.array([1 - x for x, y in s if y])
    for a in (0.05, 0.1, 0.2):
        assert f[a]["q_positive"] == pytest.approx(np.quantile(pos, min(math.ceil(38 * (1 - a)) / 37, 1)))
    assert f[0.05]["q_negative"] == pytest.approx(max(x for x, y in s if not y))
    one = spark.createDataFrame([(0.5, 1)], "confidence double, label int")
    with pytest.raises(Exception, match="both classes"):
        A.require_fit(A.conformal_fit(one)).collect()


def test_coverage_over_trials(spark):
    rng, got = np.random.default_rng(5), []
    for _ in range(3):
        y = rng.random(800) < 0.7
        c = np.where(y, rng.beta(8, 2, 800), rng.beta(2, 8, 800))
        df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(c, y, strict=True))], "id int, confidence double, label int")
        fit = A.conformal_fit(df.filter("id < 400"), (0.1,))
        got.append(A.empirical_coverage(A.prediction_sets(df.filter("id >= 400"), fit), fit).first()["coverage"])
    assert abs(np.mean(got) - 0.9) < 0.03


def test_patch_confidence_method_is_checked(spark):
    with pytest.raises(ValueError):
        A.patch_confidence(spark.range(1), "median")


def test_scalars_and_keys(spark):
    r = spark.range(1).select(C.nearest_bin(F.lit(4.25), 3.0, 2.5, 10).alias("tie"), C.nearest_bin(F.lit(-9.0), 3.0, 2.5, 10).alias("low"), C.nearest_bin(F.lit(99.0), 3.0, 2.5, 10).alias("high"), C.bucket(F.lit(float("nan"))).alias("nan"), C.bucket(F.lit(8.0)).alias("edge"), *[c.alias(f"k{i}") for i, c in enumerate(C.split_key(F.lit("Cargo/7/x")))], C.name_timestamp(F.lit("s_690101_000001.wav")).alias("ts")).first()
    assert (r["tie"], r["low"], r["high"], r["nan"], r["edge"], r["k0"], r["k1"]) == (0, 0, 9, ">=20", "8-12", "Cargo", "7/x") and r["ts"].year == 2069
    with pytest.raises(Exception, match="not a"):
        spark.range(1).select(C.split_key(F.lit("bare"))[0]).collect()


def test_splits_keep_floors_and_are_stable(spark):
    u = spark.range(90).withColumn("c", (F.col("id") % 2).cast("string"))
    got = S.split(u, "id", (0.7, 0.15, 0.15), 1, "c").groupBy("c", "partition").count().collect()
    n = {(r["c"], r["partition"]): r["count"] for r in got}
    assert n["0", "train"] == int(45 * 0.7) and n["0", "val"] == int(45 * 0.15) and sum(n.values()) == 90
    with pytest.raises(ValueError):
        S.check_ratios(0.5, 0.5, 0.5)
    one = spark.createDataFrame([(1, 1), (2, 1)], "id int, label int")
    with pytest.raises(Exception, match="both classes"):
        S.balanced_weights(one).collect()


def test_weighted_draws_follow_the_weights(spark):
    df = spark.createDataFrame([(i, 3.0 if i < 10 else 1.0) for i in range(20)], "id long, w double")
    got = S.draw_with_replacement(df, "w", "id", 4000, 2)
    assert got.count() == 4000
    assert abs(got.filter("id < 10").count() / 4000 - 0.75) < 0.04


def test_draws_of_uneven_weights_meet_few_rows(spark):
    df = spark.createDataFrame([(i, 1e6 if i == 7 else 1.0 if i % 2 else 0.0) for i in range(3000)], "id long, w double")
    got = S.draw_with_replacement(df, "w", "id", 2000, 3).groupBy("id").count().collect()
    n = {r["id"]: r["count"] for r in got}
    assert sum(n.values()) == 2000 and n[7] > 1980 and all(i % 2 for i in n)


def test_species_draws(spark):
    clips = spark.createDataFrame([(f"a{i}", "a") for i in range(100)] + [(f"b{i}", "b") for i in range(4)], "clip_id string, species string")
    got = S.species_draws(clips, 3000, seed=4).toPandas()
    assert len(got) == 3000 and abs((got["species"] == "a").mean() - 10 / 12) < 0.03
    assert got[got["species"] == "b"]["clip_id"].value_counts().between(80, 170).all()
    assert (got["clip_id"].str[0] == got["species"]).all()


def test_ranks_by_bucket_are_ranks(spark):
    u = spark.range(500).withColumn("c", F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 2).cast("string")))
    for by in (None, "c"):
        got = S._ranked(u, "id", 3, by).withColumn("d", S.draw(3, "id")).toPandas()
        for _, g in got.groupby(got["c"].fillna("?") if by else [0] * 500):
            assert sorted(g["_r"]) == list(range(1, len(g) + 1)) and (g["_n"] == len(g)).all()
            assert g.sort_values("_r")["d"].is_monotonic_increasing


def test_wav_tree_round_trip(spark, tmp_path):
    for p in ("Cargo/v1/a.wav", "Cargo/v2/b.WAV", "Tug/c.wav"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(K.wav_bytes(0.1 * np.sin(np.arange(8000 * 4) / 10), 8000))
    (tmp_path / "Tug" / "bad.wav").write_bytes(b"nothing")
    (tmp_path / "Tug" / "short.wav").write_bytes(K.wav_bytes(np.zeros(10), 8000))
    files = R.audio_files(spark, str(tmp_path))
    assert R.listing(files).select("path").toPandas()["path"].is_monotonic_increasing
    rows = {r["recording_id"]: r for r in R.class_tree(R.probe(files), str(tmp_path)).collect()}
    assert set(rows) == {"a", "b", "c"} and rows["a"]["vessel_id"] == "v1" and rows["c"]["vessel_id"] == "c" and rows["a"]["duration_s"] == 4.0
    x = R.decode(files.filter("path like '%a.wav'"), 4000).first()
    assert x["sample_rate_hz"] == 4000 and len(x["samples"]) == 16000


def test_annotations_skip_bad_rows(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("2018-01-01T00:00:00Z,2018-01-01 00:00:05,10,20,whale,good\nbad,2018-01-01 00:00:05,1,2,x,y\n2018-01-01 00:00:00,2018\n")
    got = R.annotations(spark, str(p)).collect()
    assert len(got) == 1 and got[0]["species"] == "whale" and got[0]["low_hz"] == 10.0


def test_truth_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"clip_id":"c","lines":[{"line_id":"l","freq_curve_hz":[1.0,2.0],"snr_curve_db":[3.0,4.0],"mask_bin_indices":[{"frame":0,"bin":1},{"frame":1,"bin":2}]}]}')
    s = R.truth_samples(R.truth_manifests(spark, str(tmp_path / "m.json"))).orderBy("frame").collect()
    assert [(r["frame"], r["bin"], r["freq_hz"], r["snr_db"]) for r in s] == [(0, 1, 1.0, 3.0), (1, 2, 2.0, 4.0)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    h = K.manifest(df, str(tmp_path / "out"), ["id", "v"]).first()
    assert len(h["manifest_sha256"]) == 64 and h["n_files"] == 2
    assert spark.read.json(str(tmp_path / "out.sha256")).first()["manifest_sha256"] == h["manifest_sha256"]
    assert K.digest_of_rows(df.orderBy(F.desc("id")).repartition(3), ["id", "v"]).first()["manifest_sha256"] == h["manifest_sha256"] != K.digest_of_rows(df.limit(1), ["id", "v"]).first()["manifest_sha256"]
    assert K.digest_of_rows(df.limit(0), ["id", "v"]).first()["n_files"] == 0
    both = K.metrics_csv(spark.createDataFrame([(1, 0.5)], "epoch int, loss double"), spark.createDataFrame([(2, 0.1)], "epoch int, recall double"), str(tmp_path / "csv"))
    assert both.columns == ["epoch", "loss", "recall"]


def test_generator_is_seeded_and_marks_negatives(spark):
    amb = (np.random.default_rng(6).standard_normal(20000) * 0.01).tolist()
    plan = spark.createDataFrame([(f"c{i}", i, 2000, amb) for i in range(12)], "clip_id string, seed long, sample_rate_hz int, ambient array<float>")
    a, b = (Y.generate(plan, geometry=Y.GeometryPriors()).orderBy("clip_id").toPandas() for _ in range(2))
    assert a["sources"].equals(b["sources"]) and (a["negative"] == (a["n_sources"] == 0)).all() and a["n_sources"].max() > 0
    quiet = a[a["negative"]]
    assert all(np.allclose(x, np.float32(amb)) for x in quiet["samples"])


def _clips(spark, n=8):
    rng = np.random.default_rng(30)
    amb = (rng.standard_normal(16000) * 0.01).tolist()
    birds = [{"species": "a", "low_hz": 200.0, "high_hz": 400.0, "samples": (rng.standard_normal(500) * 0.1).tolist()}, {"species": "b", "low_hz": 200.0, "high_hz": 400.0, "samples": [0.0] * 20_000}, {"species": "c", "low_hz": 200.0, "high_hz": 400.0, "samples": [0.0] * 100}]
    rows = [(f"c{i}", i, 2000, amb, birds if i else None) for i in range(n)] + [("none", 99, 2000, None, None)]
    return spark.createDataFrame(rows, "clip_id string, seed long, sample_rate_hz int, ambient array<float>, confuser_clips array<struct<species:string,low_hz:double,high_hz:double,samples:array<float>>>")


def test_generator_lays_confusers_and_writes_truth(spark):
    import json

    plan = _clips(spark)
    priors = Y.TonalPriors(n_sources={1: 0.5, 0: 0.5}, f0_primary_hz=(50.0, 400.0), f0_secondary_hz=(400.0, 800.0), snr_mean_db=20.0)
    made = Y.generate(plan, priors, Y.GeometryPriors(), Y.ConfuserPriors((1, 3))).cache()
    got = {r["clip_id"]: r for r in made.collect()}
    assert set(got) == {f"c{i}" for i in range(8)} and got["c0"]["generator_version"] == "1+tonals+channel+confusers"
    laid = [c for r in got.values() for c in json.loads(r["confusers"])]
    assert laid and {c["species"] for c in laid} == {"a"} and json.loads(got["c0"]["confusers"]) == []  # too long and silent ones are skipped
    lines = Y.truth_lines(made, 256, 128, 2000).cache()
    want = {f"{r['clip_id']}_s{k}_h{h}" for r in got.values() for k, s in enumerate(json.loads(r["sources"])) for h in range(s["n_harmonics"]) if (h + 1) * s["f0_hz"] < 1000}
    rows = lines.collect()
    assert {r["line_id"] for r in rows} == want and all(r["geometry"]["speed"] == 1500.0 for r in rows)
    assert all(len(r["freq_curve_hz"]) == len(r["snr_curve_db"]) == len(r["mask_bin_indices"]) for r in rows) and any(r["freq_curve_hz"] for r in rows)
    docs = {r["clip_id"]: json.loads(r["manifest"]) for r in Y.truth_manifest(made, lines).collect()}
    assert all(docs[k]["negative_label"] == r["negative"] and len(docs[k]["lines"]) == sum(x["clip_id"] == k for x in rows) for k, r in got.items())
    assert sum(len(d["confuser_labels"]) for d in docs.values()) == len(laid)


def test_truth_manifests_are_read_back(spark, tmp_path):
    made = Y.generate(_clips(spark, 4), Y.TonalPriors(n_sources={1: 1.0}, f0_primary_hz=(50.0, 400.0), f0_secondary_hz=(400.0, 800.0)))
    lines = Y.truth_lines(made, 256, 128, 2000)
    for r in Y.truth_manifest(made, lines).collect():
        (tmp_path / f"{r['clip_id']}.json").write_text(r["manifest"])
    back = R.truth_manifests(spark, str(tmp_path)).select("clip_id", "line_id", "f0_hz", F.size("mask_bin_indices").alias("n"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in lines.select("clip_id", "line_id", "f0_hz", F.size("mask_bin_indices").alias("n")).collect()}


def test_explicit_injection_reaches_its_snr(spark):
    plan = _clips(spark, 2)
    tonals = spark.createDataFrame([("c1", 200.0, 20.0, 0.0, 8.0, 1, 0.5)], "clip_id string, f_hz double, snr_db double, t_start_s double, t_end_s double, harmonics int, decay double")
    got = {r["clip_id"]: r for r in Y.inject_ambient(plan, explicit=tonals).collect()}
    amb = np.array(plan.first()["ambient"])
    assert got["c0"]["n_sources"] == 0 and np.allclose(got["c0"]["samples"], amb) and set(got) == {"c0", "c1"}
    from tonalis.functions import kernels as B

    added = np.array(got["c1"]["samples"]) - amb
    assert 20 * np.log10(np.sqrt(np.mean(added[2000:14000] ** 2)) / B.band_rms(amb, 2000, 200.0)) == pytest.approx(20.0, abs=0.1)
    for bad in ({}, {"priors": Y.TonalPriors(), "explicit": tonals}):
        with pytest.raises(ValueError, match="either"):
            Y.inject_ambient(plan, **bad)


def test_augmented_rows_by_seed(spark):
    p = np.arange(36.0).reshape(6, 6)
    df = spark.createDataFrame([(k, "keep", p.tolist(), p.tolist()) for k in range(6)], "seed long, other string, patch array<array<double>>, target array<array<double>>")
    a, b = (Y.augmented(df, noise=0.0).orderBy("seed").collect() for _ in range(2))
    assert a == b and all(r["patch"] == r["target"] and r["other"] == "keep" for r in a) and len({str(r["patch"]) for r in a}) > 2


def test_patch_labels_of_all_kinds(spark):
    truth = spark.createDataFrame([(1, "l", 3, 2, 5.0, 1.0), (1, "l", 9, 2, 5.0, 1.0), (1, "m", 19, 11, 5.0, 1.0)], "clip int, line_id string, frame int, bin int, freq_hz double, snr_db double")
    grid = E.patch_grid(spark.createDataFrame([(1, 12, 20)], "clip int, nf int, nt int"), "clip", "nf", "nt", 8, 4)
    cells = {tuple(r)[1:] for r in E.patch_mask(truth, grid, "clip", 8, 4).collect()}
    want = {(f, t, b - f, x - t) for f in (0, 4) for t in (0, 4, 8, 12) for x, b in ((3, 2), (9, 2), (19, 11)) if f <= b < f + 8 and t <= x < t + 8}
    assert cells == want
    heat = {(r["f_start"], r["t_start"]): r["heat"] for r in E.patch_heatmap(truth, grid, "clip", 8, 4).collect()}
    assert heat == {(f, t): [int(any((f, t, h, w) in want for w in range(8))) for h in range(8)] for f in (0, 4) for t in (0, 4, 8, 12)}


def test_stitching_moments_and_reflection(spark):
    p = spark.createDataFrame([(0, 0, 0, 0, 0, 0.2), (0, 0, 0, 0, 1, 0.4), (0, 0, 1, 0, 0, 0.8)], "k int, f0 int, t0 int, h int, w int, p double")
    got = {(r["freq_bin"], r["time_bin"]): (r["mean"], r["variance"], r["n"]) for r in E.stitch(p, "k", "f0", "t0", "h", "w", "p", 1, 2, "moments").collect()}
    assert got[0, 0] == (0.2, 0.0, 1) and got[0, 1] == pytest.approx((0.6, 0.04, 2))
    x = np.arange(12.0).reshape(3, 4)
    cells = spark.createDataFrame([(7, i, j, float(x[i, j])) for i in range(3) for j in range(4)], "k int, f int, t int, v double")
    pad = E.reflect_pad(cells, ["k"], "f", "t", 3, 4, 8).collect()
    want = np.pad(x, ((0, 5), (0, 4)), mode="reflect")
    assert {(r["f"], r["t"]): r["v"] for r in pad} == {(i, j): want[i, j] for i in range(8) for j in range(8)}


def test_components_by_mean_row(spark):
    m = spark.createDataFrame([(0, 0, 0, 0.9), (0, 1, 0, 0.9), (0, 1, 1, 0.6), (0, 3, 3, 0.9)], "k int, h int, w int, p double")
    got = E.component_lines(m, "k", "h", "w", "p", centre="mean").orderBy("row").collect()
    assert [(round(r["row"], 6), r["col_min"], r["col_max"], r["n_cells"]) for r in got] == [(0.666667, 0, 1, 3), (3.0, 3, 3, 1)]
    with pytest.raises(ValueError):
        E.component_lines(m, "k", "h", "w", "p", centre="mode")


@pytest.mark.parametrize("tile", [1, 3, 8, 256])
@pytest.mark.parametrize("centre", ["median", "mean"])
def test_components_of_whole_grams_by_tiles(spark, tile, centre):
    """Random masks, a snake through all tiles, and a null patch, against the labels of the whole."""
    from tonalis.functions import kernels as B

    rng = np.random.default_rng(31)
    snake = np.zeros((20, 30))
    snake[::2] = 0.9
    snake[1::4, -1] = snake[3::4, 0] = 0.8
    images = {"a": rng.random((23, 31)), "s": snake, None: np.pad(rng.random((5, 5)), ((10, 0), (12, 0)))}
    rows = [(k, h, w, float(x[h, w])) for k, x in images.items() for h in range(x.shape[0]) for w in range(x.shape[1])]
    got = E.component_lines(spark.createDataFrame(rows + [("a", None, 3, 0.9)], "k string, h int, w int, p double").repartition(4), "k", "h", "w", "p", 0.5, 2, centre, tile)
    want = []
    for k, x in images.items():
        lab, n = B.label_4(x > 0.5)
        for c in range(1, n + 1):
            h, w = np.nonzero(lab == c)
            if len(h) >= 2:
                want.append((str(k), int(np.median(h)) if centre == "median" else round(float(h.mean()), 9), int(w.min()), int(w.max()), round(float(x[h, w].mean()), 9), len(h)))
    rounded = [(str(r["k"]), r["row"] if centre == "median" else round(r["row"], 9), r["col_min"], r["col_max"], round(r["confidence"], 9), r["n_cells"]) for r in got.collect()]
    assert sorted(rounded) == sorted(want) and sum(w[0] == "s" for w in want) == 1


def test_matching_of_a_crowded_patch(spark):
    """20,000 lines of one patch: few meet, and the total is that of the whole assignment where that can be solved."""
    from tonalis.functions import kernels as B

    rng = np.random.default_rng(32)
    line = lambda n, f, t: [(1, i, float(rng.uniform(0, f)), *sorted(rng.uniform(0, t, 2).tolist())) for i in range(n)]
    schema = "k int, id long, freq_hz double, t_start double, t_end double"
    for n, f, t in ((60, 40.0, 50.0), (60, 200.0, 5000.0), (10_000, 1e5, 3000.0)):
        p, q = line(n, f, t), line(n, f, t)
        got = E.match_lines(spark.createDataFrame(p, schema), spark.createDataFrame(q, schema), "k", 1.0, 0.0)
        both = [(r["pred_id"], r["truth_id"], r["iou"]) for r in got.collect() if r["iou"] is not None]
        assert got.filter("pred_id is null").count() == got.filter("truth_id is null").count() == n - len(both)
        if n < 100:
            a, b = (np.array([r[2:] for r in x]) for x in (p, q))
            d = np.abs(a[:, None, 0] - b[None, :, 0])
            near = np.where(d <= 2, 1.0, np.where(d <= 4, 0.5, 0.0))
            both_t = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 1], b[None, :, 1])
            iou = near * np.maximum(both_t, 0) / (np.maximum(a[:, None, 2], b[None, :, 2]) - np.minimum(a[:, None, 1], b[None, :, 1]))
            assert sum(x for *_, x in both) == pytest.approx(iou[B.assign(1 - iou)].sum())
        assert len(both) == len({x for x, *_ in both}) == len({x for _, x, _ in both}) > 10


def test_band_of_lines_and_hop(spark):
    d = spark.createDataFrame([("a", [10.0, 20.0]), ("b", [90.0]), ("c", []), ("d", None)], "k string, f array<double>")
    assert [r["k"] for r in T.in_band(d, 15.0, 50.0, "f").collect()] == ["a"]
    assert [r["k"] for r in T.in_band(spark.createDataFrame([("x", 15.0), ("y", 51.0)], "k string, frequency_hz double"), 15.0, 50.0).collect()] == ["x"]
    r = spark.range(1).select(C.hop_seconds(F.array(F.lit(1.0), F.lit(1.25)), 100, 50).alias("a"), C.hop_seconds(F.array(F.lit(1.0)), 100, 50).alias("b")).first()
    assert (r["a"], r["b"]) == (0.25, 0.5)


def test_parameters_from_text():
    c = R.parameters("sample_rate: 8000\nfreq_max_hz: 900.0\n", G.LofarConfig)
    assert (c.sample_rate, c.freq_max_hz, c.n_fft) == (8000, 900.0, 16384)
    d = R.parameters('{"method": "two_d", "neighbourhood": [3, 7], "persistence": {"max_gap_bins": 9}}', T.DetectionConfig)
    assert d.neighbourhood == (3, 7) and d.persistence.max_gap_bins == 9 and d.snr_db == 8.0
    with pytest.raises(ValueError, match="no typo"):
        R.parameters("typo: 1", G.LofarConfig)


def test_gram_cache_makes_what_is_missing(spark, tmp_path):
    made = []

    def make(df):
        made.append(sorted(r["recording_id"] for r in df.collect()))
        return df.select("recording_id", F.lit(0).alias("time_bin"), F.array(F.lit(1.0)).alias("power_db"))

    at = str(tmp_path / "grams")
    rec = lambda *k: spark.createDataFrame([(x,) for x in k], "recording_id string")
    assert R.cached_grams(spark, rec("a", "b"), at, make).count() == 2
    assert R.cached_grams(spark, rec("b", "c"), at, make).count() == 2
    assert R.cached_grams(spark, rec("a"), at, make).count() == 1
    assert made == [["a", "b"], ["c"]]


def test_gram_cache_is_addressed_by_content(spark, tmp_path):
    """Changed parameters and changed files make grams anew; unchanged ones don't, and what was made before is still there."""
    made = []

    def make(df):
        rows = df.collect()
        made.append(sorted(r["recording_id"] for r in rows))
        return df.select("recording_id", F.col("size").alias("time_bin"), F.array(F.lit(1.0)).alias("power_db"))

    at = str(tmp_path / "grams")
    rec = lambda *k: spark.createDataFrame(list(k), "recording_id string, size int")
    get = lambda r, p: sorted(tuple(x) for x in R.cached_grams(spark, r, at, make, parameters=p, source=["size"]).select("recording_id", "time_bin").collect())
    one, two = G.LofarConfig(hop=64), G.LofarConfig(hop=32)
    assert get(rec(("a", 1), ("b", 1)), one) == [("a", 1), ("b", 1)] == get(rec(("a", 1), ("b", 1)), one)
    assert get(rec(("a", 1), ("b", 1)), two) == [("a", 1), ("b", 1)]
    assert get(rec(("a", 2), ("b", 1)), one) == [("a", 2), ("b", 1)]
    assert get(rec(("a", 1)), one) == [("a", 1)]
    assert made == [["a", "b"], ["a", "b"], ["a"]]


@pytest.mark.parametrize("q", [0.0, 0.37, 0.99, 1.0])
def test_quantiles_by_cells_are_exact(spark, q):
    rng = np.random.default_rng(33)
    groups = {"normal": rng.normal(0, 1, 2000), "ties": rng.integers(0, 3, 500).astype(float), "one": np.array([4.0]), "skewed": np.r_[rng.random(900), 1e12], None: np.arange(7.0)}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("one", None), ("one", float("nan")), ("nulls", None)]
    got = {r["k"]: r["quantile"] for r in G.exact_quantile(spark.createDataFrame(rows, "k string, v double").repartition(4), ["k"], "v", q, 64).collect()}
    assert set(got) == set(groups) and all(got[k] == pytest.approx(np.quantile(x, q), rel=1e-12) for k, x in groups.items())


def test_skeletons_and_their_loss(spark):
    rng = np.random.default_rng(34)

    def near(x, f):
        return np.stack([f(x[max(i - 1, 0) : i + 2], axis=0) for i in range(len(x))])

    def skeleton(x, n):
        left = lambda y: np.maximum(y - near(near(y, np.min), np.max), 0)
        s = left(x)
        for _ in range(n):
            x = near(x, np.min)
            s = s + np.maximum(left(x) - s * left(x), 0)
        return s

    masks = {k: (rng.random((9, 5)), (rng.random((9, 5)) > 0.5).astype(float)) for k in range(3)}
    cells = spark.createDataFrame([(k, h, w, float(p[h, w]), float(t[h, w])) for k, (p, t) in masks.items() for h in range(9) for w in range(5)], "k int, h int, w int, p double, t double").repartition(3)
    for n in (0, 4):
        for r in E.centreline_dice(cells, ["k"], "h", "w", "p", "t", n).collect():
            p, t = masks[r["k"]]
            a, b = skeleton(p, n), skeleton(t, n)
            x, y = (a * t).sum() / (a.sum() + 1), (b * p).sum() / (b.sum() + 1)
            assert (r["precision"], r["sensitivity"], r["loss"]) == pytest.approx((x, y, 1 - 2 * x * y / (x + y + 1e-6)))


def test_digest_of_files_in_order(spark):
    import hashlib

    rows = [("a", x) for x in ("x", "y", "x", None)] + [(None, "z")]
    got = {r["k"]: (r["manifest_sha256"], r["n_files"]) for r in K.hash_files(spark.createDataFrame(rows, "k string, t string").repartition(3), ["k"], "t").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got == {"a": (sha("".join(sorted([sha("x"), sha("x"), sha("y")]))), 4), None: (sha(sha("z")), 1)}


def test_confuser_library_siblings_and_windows(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"species_counts":{"a":1},"clips":[{"clip_id":"x","species":"a","path":"/p/x.wav","sample_rate_hz":2000,"duration_s":5.0,"low_hz":1.0,"high_hz":2.0}]}')
    assert [tuple(r)[:3] for r in R.confuser_library(spark, str(tmp_path / "m.json")).collect()] == [("x", "a", "/p/x.wav")]
    f = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    got = R.siblings(f("/d/a.wav", "/d/b.wav"), f("/d/a.truth.json", "/d/c.truth.json")).collect()
    assert [(r["path"], r["sibling"]) for r in got] == [("/d/a.wav", "/d/a.truth.json")]
    s = spark.createDataFrame([([1.0, 2.0, 3.0],)], "x array<float>")
    assert s.select(R.read_window(F.col("x"), F.lit(1), 4).alias("w")).first()["w"] == [2.0, 3.0, 0.0, 0.0]
    keys, files = spark.createDataFrame([("k",)], "compound_key string"), spark.createDataFrame([("k", "/f")], "compound_key string, path string")
    assert R.resolve(keys, files).first()["path"] == "/f"
    with pytest.raises(Exception, match="no file"):
        R.resolve(keys, files.filter("false")).collect()
    cells = R.sweep_cells(f("/s/unet_seed7_ratio0.25", "/s/other")).collect()
    assert [(r["seed"], r["ratio"]) for r in cells] == [(7, 0.25)]
    (tmp_path / "run.json").write_text('{"seed":"3","augmentation":{"ratio":"0.5"}}')
    r = R.run_metadata(spark, str(tmp_path / "run.json"), ["seed", "ratio"]).first()
    assert (r["seed"], r["ratio"]) == ("3", "0.5")


def test_priors_and_channel():
    with pytest.raises(ValueError):
        Y.TonalPriors(n_sources={0: 0.5, 1: 0.4})
    rng = np.random.default_rng(7)
    for _ in range(300):
        g = Y.sample_geometry(rng, Y.GeometryPriors())
        assert g["source_m"] <= g["water_m"] and g["receiver_m"] <= g["water_m"]
    assert Y.sample_tonal(rng, Y.TonalPriors(min_separation_hz=2000.0), 30.0, (500.0,)) is None
    g = {"range_m": 200.0, "source_m": 5.0, "receiver_m": 50.0, "water_m": 5000.0, "speed": 1500.0, "loss_db": 6.0}
    x = rng.standard_normal(4096)
    assert Y.apply_channel(x, 8000, g).shape == x.shape


def test_augmentation_moves_patch_and_target_alike():
    rng = np.random.default_rng(8)
    p = np.zeros((8, 8))
    p[4, 2] = 1
    for _ in range(20):
        a, b = Y.augment(rng, p, p, noise=0.0)
        assert np.array_equal(a, b) and a.shape == p.shape


def test_topics_isolate_handlers():
    t, got = L.Topics(), []
    t.subscribe("line.detected", lambda m: 1 / 0)
    t.subscribe("line.detected", got.append)
    assert t.publish("line.detected", 5) == 1 and got == [5]
    t.reset()
    assert t.publish("line.detected", 5) == 0


def test_live_tracks_equal_batch(spark, tmp_path):
    rows = [(1, t, 10 + t // 4, 9.0) for t in range(12)] + [(1, 40, 99, 9.0)] + [(2, t, 5, 9.0) for t in (0, 1, 2, 30)]
    df = spark.createDataFrame(rows, "k long, t int, f int, v double").repartition(1)
    cfg = T.PersistenceConfig(2.0, 2, 4)
    want = {tuple(r) for r in T.persistent_lines(df, "k", "t", "f", "v", 1.0, cfg).collect()}
    df.write.parquet(str(tmp_path / "in"))
    stream = L.live_tracks(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "t", "f", "v", 1.0, cfg)
    q = stream.writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(20)
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from live").collect()} == want


def _streamed(spark, df, order, parts, tmp_path, make, name):
    """What ``make`` gives of the rows of df that come in ``parts`` batches in this order, and a last row far off that closes all before it."""
    rows = df.orderBy(*order).collect()
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], df.schema).repartition(1).write.parquet(str(tmp_path / "in" / f"{k:02d}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    until = time.monotonic() + 60
    while sum(p["numInputRows"] for p in q.recentProgress) < len(rows) and time.monotonic() < until:
        time.sleep(0.2)
    q.stop()
    return [tuple(r) for r in spark.sql(f"select * from {name}").collect()]


def test_live_peaks_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(40)
    x = np.r_[rng.integers(0, 12, (60, 4)), np.zeros((10, 4))].astype(float)
    x[20:25, 1] = 11
    df = _frames(spark, x)
    want = {(r["rec"], r["freq_bin"], r["t"], r["value"]) for r in T.peaks_per_bin(df, "rec", "t", "power", 8.0, 4).collect()}
    got = _streamed(spark, df, ["t"], 6, tmp_path, lambda s: L.live_peaks(s, "rec", "t", "power", 8.0, 4), "live_p")
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_live_merge_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(41)
    rows = [_line(i, float(rng.integers(40, 60)), int(rng.integers(0, 100)), float(rng.integers(1, 4)), float(rng.random()), [None, 2.0][i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, T.LINE)
    want = {tuple(r) for r in T.merge_nearby(df, 2.0).collect()}
    last = spark.createDataFrame([_line(999, 50.0, 10_000, 1.0, 1.0, 1.0)], T.LINE)
    got = _streamed(spark, df.unionByName(last), ["timestamp"], 5, tmp_path, lambda s: L.live_merge(s, 2.0), "live_m")
    assert set(got) == want and len(want) < 60


def test_live_normalisation_equals_batch(spark, tmp_path):
    df = _frames(spark, np.random.default_rng(42).standard_normal((12, 40)) * 5)
    norm = lambda d: N.tpsw(d.withColumn("one", N.split_window(F.col("power"))), "power", "two").select("t", "one", "two")
    assert sorted(map(str, _streamed(spark, df, ["t"], 3, tmp_path, norm, "live_n"))) == sorted(str(tuple(r)) for r in norm(df).collect())


def test_command_line(spark, tmp_path):
    from tonalis.__main__ import main

    for p in ("Cargo/v1/a.wav", "Tug/c.wav"):
        f = tmp_path / "audio" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(K.wav_bytes(_signal("steady"), 2000))
    (tmp_path / "gram.yaml").write_text("{sample_rate: 2000, n_fft: 512, hop: 128, window_length: 512, freq_min_hz: 1.0, freq_max_hz: 900.0}".replace("{", '{"').replace(": ", '": ').replace(", ", ', "'))
    main(["index", str(tmp_path / "audio"), str(tmp_path / "index")], spark)
    assert spark.read.parquet(str(tmp_path / "index")).count() == 2
    main(["detect", str(tmp_path / "audio"), str(tmp_path / "lines"), "--gram", str(tmp_path / "gram.yaml")], spark)
    got = spark.read.parquet(str(tmp_path / "lines")).collect()
    assert {r["array_id"].rsplit("/", 1)[-1] for r in got if abs(r["frequency_hz"] - 200) < 12} == {"a.wav", "c.wav"}
    main(["recordings", str(tmp_path / "index"), "--class-label", "Tug"], spark)
    main(["query", "f1_windows", "/root/testdata/sf0.001", str(tmp_path / "q")], spark)
    assert spark.read.parquet(str(tmp_path / "q")).count() == 25


def test_whole_tables_of_grids_and_times(spark):
    from tonalis.plans import inputs as X
    from tonalis.plans import queries

    d = "/root/testdata/sf0.001"
    got = {}
    for r in queries.QUERIES["w7_patch_grid"](spark, d).collect():
        got.setdefault(r["o_orderkey"], []).append((r["f_start"], r["t_start"]))
    for r in X.read(spark, d, "orders").collect():
        nt = r["o_custkey"] % 40 + 4
        times = sorted({*range(0, nt - 7, 5), nt - 8}) if nt >= 8 else []
        assert sorted(got.get(r["o_orderkey"], [])) == [(f, t) for f in (0, 5, 10, 12) for t in times]
    times = {r["event_id"]: r["s"] for r in queries.QUERIES["p10_relative_time"](spark, d).collect()}
    events = X.read(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()
    assert times == {r["event_id"]: int((r["us"] - X.EPOCH * 1_000_000) / 1_000_000) for r in events}


def test_totals_of_patches_with_many_lines(spark, tmp_path):
    from itertools import permutations

    from tonalis.plans import inputs as X
    from tonalis.plans import queries

    rng = np.random.default_rng(5)
    rows = [(k, u, ("click", "view")[k % 2], pd.Timestamp(X.EPOCH + int(rng.integers(0, 20_000)), unit="s").to_pydatetime(), float(rng.integers(0, 70))) for k, u in enumerate([1] * 12 + [2] * 4 + [3])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz, value double").write.parquet(str(tmp_path / "events.parquet"))
    pairs = {(r["pred_id"], r["truth_id"]): r["iou"] for r in E.line_iou_pairs(X.spans(spark, str(tmp_path), "click"), X.spans(spark, str(tmp_path), "view"), "patch", 15.0).collect()}
    want = {}
    for u in (1, 2):
        a, b = ([r[0] for r in rows if r[1] == u and r[2] == k] for k in ("click", "view"))
        want[u * 100] = max(sum(pairs.get(x, 0.0) for x in zip(a, o, strict=True)) for o in permutations(b))
    got = {r["patch"]: r["total"] for r in queries.QUERIES["j4_match_totals"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(want, abs=1e-5)


def test_masks_of_every_member(spark):
    from tonalis.plans import inputs as X
    from tonalis.plans import queries

    d = "/root/testdata/sf0.001"
    cells, gram = {}, {}
    for r in X.masks(spark, d).collect():
        cells.setdefault((r["patch_id"], r["member"]), {})[r["h"], r["w"]] = r["p"]
        f, t = r["patch_id"] % 5 * 2 + r["h"], r["patch_id"] % 7 * 2 + r["w"]
        if f < 11 and t < 14:
            k = (r["patch_id"] % 50, r["member"], f, t)
            gram[k] = max(gram.get(k, 0), round(r["p"], 8))
    want = []
    for key, m in cells.items():
        left = {c for c, p in m.items() if p > 0.5}
        while left:
            part, todo = [], [left.pop()]
            while todo:
                h, w = todo.pop()
                part.append((h, w))
                near = left & {(h + 1, w), (h - 1, w), (h, w + 1), (h, w - 1)}
                left -= near
                todo += near
            if len(part) > 1:
                want.append((*key, int(np.median([h for h, _ in part])), min(w for _, w in part), max(w for _, w in part), len(part)))
    got = [(r["patch_id"], r["member"], r["row"], r["col_min"], r["col_max"], r["n_cells"]) for r in queries.QUERIES["a25_components"](spark, d).collect()]
    assert sorted(got) == sorted(want) and {r[1] for r in got} == {0, 1, 2, 3}
    assert {(r["rec"], r["member"], r["freq_bin"], r["time_bin"]): r["p"] for r in queries.QUERIES["a27_stitch"](spark, d).collect()} == pytest.approx(gram)


def test_frames_of_an_envelope_are_never_broadcast(spark):
    """Frames are exploded from few rows and look small to the optimizer."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(719)))
    own = spark.range(20).repartition(2).select("id").distinct().select("id", hours.alias("time_bin")).withColumn("time_s", F.col("time_bin") + 0.5)
    pulses = spark.createDataFrame([(i, i + 0.25, 0.5) for i in range(20)], "id long, onset_s double, gamma double")
    envelope = G.active_envelope(own.select("id", "time_s"), pulses, "id", "gamma")
    harmonics = pulses.select("id", F.lit(0).alias("h"), F.lit(10.0).alias("f0_hz"), F.lit(0.0).alias("drift"), "onset_s", F.lit(1.0).alias("amplitude"), F.lit(0.1).alias("local_rms"))
    truth = G.frame_truth(envelope.withColumn("time_bin", F.floor("time_s").cast("int")), harmonics, "id", 800, 512, 800)
    clips = spark.createDataFrame([("a", [0.0] * 4000, '[{"f0_hz": 50, "n_harmonics": 1, "harmonic_decay": 0.5, "decay_per_s": 1, "persistence_s": 2, "drift": 0, "snr_db": 6, "onset_s": 0.5, "amplitude": 1, "local_rms": 0.1, "onsets": [0.5]}]', None)], "clip_id string, samples array<float>, sources string, geometry string")
    for df, n in ((envelope, 20 * 720), (truth, 20), (Y.truth_lines(clips, 64, 16, 1000).select("line_id"), 1)):
        assert len(df.collect()) == n
        joins = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # What is broadcast may be rows of sources, never frames.
        assert not [line for line in joins.splitlines() if "BroadcastHashJoin" in line and "time_s" in line], joins
    assert truth.agg(F.sum(F.size("mask_bin_indices"))).first()[0] == envelope.filter("envelope > 0").count() > 200


@pytest.mark.parametrize(("n_fft", "bins"), [(32, None), (128, None), (128, (3, 50))])
def test_a_frame_is_one_row_while_its_bins_are_summed(spark, n_fft, bins):
    """Against the transform; bins are columns of the sums, strips of them keys where they are many."""
    rng = np.random.default_rng(5)
    x = {r: rng.normal(0, 1, n) for r, n in ((0, 300), (1, 129), (2, 20))}
    long = spark.createDataFrame([(r, i, float(v)) for r, y in x.items() for i, v in enumerate(y)], "rec int, i long, x double").repartition(3)
    df = G.dft_power(G.frames(long, "rec", "i", "x", n_fft, 16), "rec", "x", n_fft, n_fft, bins=bins)
    got = {(r.rec, r.time_bin, r.freq_bin): r.power for r in df.collect()}
    lo, hi = bins or (0, n_fft // 2)
    want = {(r, t, f): p[t, f] for r, y in x.items() for p in [_stft(y, n_fft)] for t in range(len(p)) for f in range(lo, hi + 1)}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items())
    keys = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "HashAggregate(keys" in line]
    assert keys and not [line for line in keys if "freq_bin" in line]


def _stft(x, n):
    return Kn.stft_power(x, 1000, n, 16)[2]


def test_truth_lines_are_made_on_the_row(spark):
    """Against frames and pulses as rows; frames meet pulses without a shuffle."""
    made = Y.generate(_clips(spark), Y.TonalPriors(n_sources={0: 0.2, 3: 0.8}, f0_primary_hz=(50.0, 400.0), f0_secondary_hz=(400.0, 1200.0), persistence_s=(0.1, 1.0), cluster_period_s=(0.1, 1.0), decay_per_s=(1.0, 60.0)), Y.GeometryPriors()).cache()
    lines = Y.truth_lines(made, 256, 128, 2000)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    src = made.select("clip_id", F.size("samples").alias("n"), F.posexplode(F.from_json("sources", Y.SOURCE)).alias("k", "s")).select("n", F.concat_ws("_s", "clip_id", F.col("k").cast("string")).alias("id"), "s.*")
    times = G.frame_times(src, "id", "n", 256, 128, 2000)
    envelope = G.active_envelope(times.select("id", "time_s"), src.select("id", F.explode("onsets").alias("onset_s"), F.col("decay_per_s").alias("gamma")), "id", "gamma").join(times, ["id", "time_s"])
    each = src.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("n_harmonics") - 1))).withColumn("amplitude", F.col("amplitude") * F.pow("harmonic_decay", F.col("h")))
    want = G.frame_truth(envelope, each, "id", 2000, 256, 128)
    own = [c for c in want.columns if c != "id"]
    rows = sorted(map(tuple, want.select(own).collect()))
    assert sorted(map(tuple, lines.select(own).collect())) == rows and len({len(r[3]) for r in rows}) > 3


def test_a_gate_costs_its_edges(monkeypatch):
    """Cosines are taken at the edges only; values are those of the formula."""
    seen, cos = [], np.cos
    monkeypatch.setattr(Y.np, "cos", lambda v: seen.append(np.size(v)) or cos(v))
    Y.gate(100_000, 10, 90_000, 50)
    assert sum(seen) <= 2 * 51
    for n, a, b, fade in ((300, 20, 250, 40), (300, 20, 60, 40), (300, 20, 90, 40), (300, 20, 400, 500), (5, 0, 5, 0), (5, 4, 5, 1), (5, 3, 3, 2)):
        i, fade, stop = np.arange(n), max(1, fade), min(b, n)
        up, down = (0.5 * (1 - cos(np.pi * np.clip(x / fade, 0, 1))) for x in (i - a, stop - i))
        assert np.array_equal(Y.gate(n, a, b, fade), np.where((i < a) | (i >= stop), 0.0, np.where(i >= stop - fade, down, up)))


def test_a_clips_channel_is_made_once(monkeypatch):
    """Its response over the whole spectrum serves all sources of the clip."""
    import pyarrow as pa

    class Plan:  # hands out what would run in the tasks
        select = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run  # noqa: E731, N815

    seen, plain = [], Y.response
    monkeypatch.setattr(Y, "response", lambda f, g: seen.append(len(f)) or plain(f, g))
    x = np.random.default_rng(2).uniform(0, 10, (20, 600)).tolist()
    rows = pa.record_batch([pa.array([f"c{i}" for i in range(20)]), pa.array(range(20), pa.int64()), pa.array([1000] * 20, pa.int32()), pa.array(x, pa.list_(pa.float32()))], names=["clip_id", "seed", "sample_rate_hz", "ambient"])
    run = Y.generate(Plan(), Y.TonalPriors(n_sources={3: 1.0}, f0_primary_hz=(10.0, 200.0), f0_secondary_hz=(200.0, 450.0)), Y.GeometryPriors())
    whole = pa.Table.from_batches(run(iter([rows])))
    assert sum(whole["n_sources"].to_pylist()) == 60 and seen.count(301) == 20
    # A clip is the same whatever it is made beside.
    assert pa.Table.from_batches(b for i in range(20) for b in run(iter([rows.slice(i, 1)]))).equals(whole.combine_chunks())
