"""Clips as files, data sets of vessels and of patches."""

import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonalis.operators import datasets as DS
from tonalis.operators import synth as Y
from tonalis.sources import clips as W
from tonalis.sources import readers as R
from tonalis.sources import sinks as K

ROWS = [("a/b c+1.5", b"one", "{}", '{"k": 1}'), ("z", b"two", "{}", "{}"), ("z", b"three", "{}", "{}")]
KIND = "clip_id string, wav binary, truth string, audit string, path string"


def made(spark, rows, parts=1):
    return spark.createDataFrame([(*r, "x") for r in rows], KIND).coalesce(parts)


def files(spark, path):
    found = W.read_clips(spark, str(path)).collect()
    return sorted((r.clip_id, open(r.wav.removeprefix("file:"), "rb").read(), json.load(open(r.audit.removeprefix("file:")))) for r in found)


@pytest.mark.parametrize("parts", [1, 3])
def test_clips_of_any_name_and_repeated_ones_are_kept(spark, tmp_path, parts):
    W.write_clips(made(spark, ROWS).repartition(parts), str(tmp_path / "d"))
    assert files(spark, tmp_path / "d") == sorted((c, w, json.loads(a)) for c, w, _, a in ROWS)


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    W.write_clips(made(spark, ROWS[:1]), str(tmp_path / "d"))
    for bad in ((None, b"x", "{}", "{}"), ("", b"x", "{}", "{}"), ("k", None, "{}", "{}"), ("k", b"x", None, "{}"), ("k", b"x", "{}", ""), ("n" * 300, b"x", "{}", "{}")):
        with pytest.raises(Exception):
            W.write_clips(made(spark, [*ROWS, bad], 4), str(tmp_path / "d"))
        with pytest.raises(Exception):
            W.write_clips(made(spark, [bad]), str(tmp_path / "d"), "overwrite")
    assert len(list((tmp_path / "d").iterdir())) == 1 and len(files(spark, tmp_path / "d")) == 1
    with pytest.raises(Exception, match="audit"):
        made(spark, ROWS).drop("audit").write.format("clips").mode("append").save(str(tmp_path / "d"))


def test_appended_and_overwritten_jobs(spark, tmp_path):
    for mode, n in (("append", 3), ("append", 6), ("overwrite", 3)):
        W.write_clips(made(spark, ROWS), str(tmp_path / "d"), mode)
        assert len(files(spark, tmp_path / "d")) == n
    W.write_clips(made(spark, []), str(tmp_path / "e"))
    assert not list((tmp_path / "e").rglob("*.wav"))


def test_attempts_that_lost_are_removed(tmp_path):
    w = W.ClipWriter(str(tmp_path), False)
    for n in ("part-won", "part-lost"):
        (tmp_path / f"_staging-{w.job}" / n).mkdir(parents=True)
    w.commit([W.Staged("part-won", 0), None])
    assert [p.name for p in tmp_path.rglob("*")] == [f"job-{w.job}", "part-won"]


def test_numbers_in_order_of_key(spark):
    keys = [f"k{i * 7919 % 1000:04d}" for i in range(1000)]
    got = DS.numbered(spark.createDataFrame([(k,) for k in keys], "k string").repartition(7), "k").collect()
    assert [r.number for r in sorted(got)] == list(range(1000))
    assert DS.numbered(spark.createDataFrame([], "k string"), "k").count() == 0


PRIORS = Y.TonalPriors(f0_primary_hz=(10.0, 200.0), f0_secondary_hz=(200.0, 450.0), persistence_s=(0.1, 1.0), cluster_period_s=(0.1, 1.0))


@pytest.fixture(scope="module")
def ambients(spark):
    rng = np.random.default_rng(1)
    rows = [(f"Cargo/v{i}", f"/f/v{i}.wav", 1000, rng.normal(0, 0.1, n).tolist()) for i, n in enumerate((2000, 3000, 400, 2500))]
    return spark.createDataFrame([*rows, ("Tug/none", "/f/n.wav", 1000, None)], "compound_key string, path string, sample_rate_hz int, samples array<double>")


def test_vessel_set(spark, tmp_path, ambients):
    vessels = ambients.select("compound_key", F.when(F.col("samples").isNotNull(), F.size("samples") / 1000.0).alias("duration_s"), F.lit("x").alias("seed_note"))
    doc = DS.build_vessel_set(vessels, ambients, str(tmp_path / "s"), 3, PRIORS, 64, 16, 1000, seed=5, clip_s=1.5, shortest_s=1.0, commit="abc").collect()
    assert [(r.n_vessels, r.n_skipped, r.n_clips) for r in doc] == [(5, 2, 9)] and json.loads(doc[0].parameters)["priors"]["tries"] == 33

    # Each clip is what the generator makes of the ambient's beginning with the seed of vessel and clip.
    index = {r.clip_id: r for r in spark.read.json(str(tmp_path / "s/index")).collect()}
    own = {r.compound_key: r.samples for r in ambients.collect()}
    want = [(f"tier2_Cargo_v{v}_c{k:02d}", 5 + 1000 * v + k, own[f"Cargo/v{v}"][:1500]) for v in (0, 1, 3) for k in range(3)]
    plain = Y.generate(spark.createDataFrame([(c, s, 1000, x) for c, s, x in want], "clip_id string, seed long, sample_rate_hz int, ambient array<float>"), PRIORS)
    plain = {r.clip_id: r for r in plain.collect()}
    assert index.keys() == plain.keys() and all(index[c].seed == r.seed and index[c].n_sources == r.n_sources for c, r in plain.items())
    assert doc[0].n_negative == sum(r.negative for r in plain.values())

    stored = {r.clip_id: r for r in W.read_clips(spark, str(tmp_path / "s/clips")).collect()}
    assert stored.keys() == plain.keys()
    for c, r in plain.items():
        with wave.open(io.BytesIO(open(stored[c].wav.removeprefix("file:"), "rb").read())) as w:
            got = np.frombuffer(w.readframes(w.getnframes()), "<i2")
        assert np.array_equal(got, np.clip(np.rint(np.array(r.samples, np.float64) * 32767), -32768, 32767))
        audit = json.load(open(stored[c].audit.removeprefix("file:")))
        assert audit["parameter_snapshot"]["seed"] == r.seed and audit["code_commit_hash"] == "abc" and audit["dataset_manifest_hash"] is None
        assert audit["source_recording_path"] == f"/f/{c.split('_')[2]}.wav" and json.loads(audit["parameter_snapshot"]["configuration"])["seed"] == 5
    lines = R.truth_manifests(spark, str(tmp_path / "s/clips/*/*/*.truth_manifest.json")).groupBy("clip_id").count().collect()
    assert {r.clip_id: r["count"] for r in lines} == {c: r.n_lines for c, r in index.items() if r.n_lines}
    assert R.probe(R.audio_files(spark, str(tmp_path / "s/clips"))).filter("duration_s = 1.5").count() == 9


def test_vessel_set_refuses_what_it_cannot_make(spark, tmp_path, ambients):
    plan = DS.vessel_clips(spark.createDataFrame([("Cargo/v0", 0, 40.0), ("Cargo/gone", 1, 40.0)], "compound_key string, number int, duration_s double"), 1)
    with pytest.raises(Exception, match="no ambient for Cargo/gone"):
        DS.inject_vessels(plan, ambients, PRIORS).collect()
    with pytest.raises(ValueError, match="no vessels"):
        DS.build_vessel_set(ambients.limit(0).select("compound_key", F.lit(1.0).alias("duration_s")), ambients, str(tmp_path / "s"), 1, PRIORS, 64, 16, 1000)
    with pytest.raises(ValueError, match="seeds"):
        DS.vessel_clips(plan, 1001)


@pytest.mark.parametrize("target", ["mask", "heatmap"])
def test_patches_against_slices(spark, target):
    rng = np.random.default_rng(2)
    grams = {"a": rng.normal(0, 1, (21, 30)), "b": rng.normal(0, 1, (8, 8)), "small": rng.normal(0, 1, (7, 30))}  # frequency by time
    cells = [("a", t, b) for b, t in zip(*np.nonzero(grams["a"] > 2.2), strict=True)] + [("a", 0, 0), ("a", 0, 0), ("b", 3, 99)]
    frames = spark.createDataFrame([(c, t, g[:, t].tolist(), "x") for c, g in grams.items() for t in range(g.shape[1]) if (c, t) != ("a", 11)], "clip string, time_bin int, power array<double>, label string").repartition(3)
    truth = spark.createDataFrame([(c, int(t), int(b), None) for c, t, b in cells], "clip string, frame int, bin int, patch double")
    got = {(r.clip, r.f_start, r.t_start): r for r in DS.patch_table(frames, truth, "clip", 8, 5, target).collect()}
    want = {("a", f, t) for f in (0, 5, 10, 13) for t in (0, 5, 10, 15, 20, 22)} | {("b", 0, 0)}
    assert got.keys() == want
    for (c, f, t), r in got.items():
        part = grams[c][f : f + 8, t : t + 8].copy()
        mask = np.zeros((8, 8))
        for cc, tt, b in cells:
            if cc == c and f <= b < f + 8 and t <= tt < t + 8:
                mask[b - f, tt - t] = 1
        seen = np.array(r.patch, float)
        if c == "a" and t <= 11 < t + 8:
            assert np.isnan(seen[:, 11 - t]).all()
            seen[:, 11 - t] = part[:, 11 - t]
        assert np.array_equal(seen, part) and r.label == int(mask.any())
        assert np.array_equal(np.array(r.target), mask if target == "mask" else mask.max(axis=1))


def test_patch_transform_and_empty(spark):
    frames = spark.createDataFrame([("a", t, [float(t)] * 8) for t in range(8)], "clip string, time_bin int, power array<double>")
    truth = spark.createDataFrame([("a", 1, 2)], "clip string, frame int, bin int")
    turned = DS.patch_table(frames, truth, "clip", 8, 4, "mask", lambda df: Y.augmented(df.withColumn("seed", F.lit(3)), flip=1.0, shift=0, noise=0.0)).collect()
    assert len(turned) == 1 and turned[0].patch[0] == [float(t) for t in range(7, -1, -1)] and turned[0].target[2] == [0, 0, 0, 0, 0, 0, 1, 0]
    assert DS.patch_table(frames.limit(0), truth, "clip", 8, 4).count() == 0
    assert [r.label for r in DS.patch_table(frames, truth.limit(0), "clip", 8, 4).collect()] == [0]
    with pytest.raises(ValueError, match="heatmap"):
        DS.patch_table(frames, truth, "clip", 8, 4, "other")


def test_wav_lines_and_metrics_are_read_back(spark, tmp_path):
    clips = spark.createDataFrame([("a", [0.5, -0.5, 2.0], 8), ("b", None, 8)], "clip_id string, samples array<float>, sample_rate_hz int")
    got = {r.clip_id: r.wav for r in K.as_wav(clips).collect()}
    with wave.open(io.BytesIO(got["a"])) as w:
        assert w.getframerate() == 8 and np.frombuffer(w.readframes(3), "<i2").tolist() == [16384, -16384, 32767] and got["b"] is None
    K.lines_jsonl(clips.select("clip_id"), str(tmp_path / "l"))
    assert {r.clip_id for r in spark.read.json(str(tmp_path / "l")).collect()} == {"a", "b"}
    old, new = clips.select("clip_id", F.lit(1).alias("x")), clips.select("clip_id", F.lit(2).alias("y"))
    K.metrics_csv(old, new, str(tmp_path / "m"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "m"))
    assert back.columns == ["clip_id", "x", "y"] and {tuple(r) for r in back.collect()} == {("a", "1", None), ("b", "1", None), ("a", None, "2"), ("b", None, "2")}


def test_a_vessel_set_makes_each_ambient_once(spark, monkeypatch):
    """Plan and clips read what was made once."""
    from tonalis.plans import synth_queries as Q

    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    plain = Q._ambient
    monkeypatch.setattr(Q, "_ambient", lambda spark, d: plain(spark, d).mapInArrow(counted, plain(spark, d).schema))
    got = Q.c12_vessel_set(spark, "/root/testdata/sf0.001").collect()
    vessels = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_suppkey").distinct().count()
    assert n.value == vessels and len(got) == 2 * vessels
