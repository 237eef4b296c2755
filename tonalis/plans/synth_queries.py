"""Queries that make signals, and those on patches and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.operators import datasets as DS
from tonalis.operators import evaluate as E
from tonalis.operators import synth as Y
from tonalis.operators.batches import cut
from tonalis.plans import inputs as X
from tonalis.sources import sinks as K

Q, SQL = {}, {}


def _ambient(spark: SparkSession, d: str) -> DataFrame:
    """Supplier waveforms as ambients of 1 kHz."""
    x = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("float"))
    return X.waveform(spark, d).groupBy("rec").agg(x.alias("ambient")).select(F.concat(F.lit("c"), F.col("rec").cast("string")).alias("clip_id"), F.col("rec").alias("seed"), F.lit(1000).alias("sample_rate_hz"), "ambient")


def c10_generate_clips(spark: SparkSession, d: str) -> DataFrame:
    out = Y.generate(_ambient(spark, d), Y.TonalPriors(f0_primary_hz=(10.0, 200.0), f0_secondary_hz=(200.0, 450.0), persistence_s=(0.1, 1.0), cluster_period_s=(0.1, 1.0)), Y.GeometryPriors())
    return out.select("clip_id", "n_sources", "negative", F.size("samples").alias("n"), "sources", "geometry")


Q["c10_generate_clips"] = c10_generate_clips


def c11_inject_ambient(spark: SparkSession, d: str) -> DataFrame:
    """Without propagation: sources straight into the ambient."""
    return Y.generate(_ambient(spark, d), Y.TonalPriors(f0_primary_hz=(10.0, 200.0), f0_secondary_hz=(200.0, 450.0), persistence_s=(0.1, 1.0), cluster_period_s=(0.1, 1.0))).select("clip_id", "n_sources", "negative", F.size("samples").alias("n"))


Q["c11_inject_ambient"] = c11_inject_ambient


def c12_vessel_set(spark: SparkSession, d: str) -> DataFrame:
    """Two clips of each supplier's waveform with sources laid in, and their truth lines; waveforms below half a second are skipped."""
    own = _ambient(spark, d).select(F.concat(F.lit("s/"), "clip_id").alias("compound_key"), F.concat(F.lit("/f/"), "clip_id").alias("path"), "sample_rate_hz", F.col("ambient").alias("samples"), F.col("seed").alias("number"))
    own = cut(own)  # read by plan and clips
    vessels = own.select("compound_key", "number", (F.size("samples") / F.col("sample_rate_hz")).alias("duration_s"))
    clips = DS.inject_vessels(DS.vessel_clips(vessels, 2, 9, shortest_s=0.5), own, VESSEL_PRIORS)
    clips = cut(clips)  # read by lines and index
    return DS.clip_index(clips, Y.truth_lines(clips, 64, 16, 1000))


VESSEL_PRIORS = Y.TonalPriors(f0_primary_hz=(10.0, 200.0), f0_secondary_hz=(200.0, 450.0), persistence_s=(0.1, 1.0), cluster_period_s=(0.1, 1.0))
Q["c12_vessel_set"] = c12_vessel_set


def _patch_rows(spark: SparkSession, d: str, target: str) -> DataFrame:
    """Patches of the whole gram; its cells of 12 and more are the truth."""
    g = X.gram(spark, d)
    truth = g.select("rec", F.col("t").alias("frame"), F.posexplode("power").alias("bin", "x")).filter("x >= 12")
    return DS.patch_table(g.select("rec", F.col("t").alias("time_bin"), "power"), truth, "rec", 16, 10, target)


def c13_patch_table(spark: SparkSession, d: str) -> DataFrame:
    """Patches with masks as targets, a row a cell's row: sums that tell where values and truth stand."""
    rows = _patch_rows(spark, d, "mask").select("rec", "f_start", "t_start", "label", F.posexplode(F.arrays_zip("patch", "target")).alias("h", "z"))
    weighed = lambda c: F.aggregate(F.transform(F.col(c), lambda v, w: v * (w + 1)), F.lit(0.0), lambda a, v: a + v)
    return rows.select("rec", "f_start", "t_start", "label", "h", F.round(weighed("z.patch"), 4).alias("cells"), weighed("z.target").cast("long").alias("truth"))


Q["c13_patch_table"] = c13_patch_table
_GRID = """n AS (SELECT rec, max(t) + 1 AS nt FROM cell GROUP BY rec), ts AS (SELECT rec, CAST(k AS INTEGER) AS t_start FROM n, range(0, 100000, 10) r(k) WHERE k <= nt - 16 UNION SELECT rec, CAST(nt - 16 AS INTEGER) FROM n WHERE nt >= 16),
fs AS (SELECT CAST(a AS INTEGER) AS f_start FROM (VALUES (0), (10), (20), (30), (40), (48)) x(a))"""
SQL["c13_patch_table"] = f"""WITH {X.GRAM}, {_GRID},
q AS (SELECT ts.rec, f_start, t_start, CAST(f - f_start AS INTEGER) AS h, sum(x * (t - t_start + 1)) AS cells, sum(CASE WHEN x >= 12 THEN t - t_start + 1 ELSE 0 END) AS truth
 FROM ts, fs, cell c WHERE c.rec = ts.rec AND t >= t_start AND t < t_start + 16 AND f >= f_start AND f < f_start + 16 GROUP BY ALL)
SELECT rec, f_start, t_start, CAST(CASE WHEN sum(truth) OVER (PARTITION BY rec, f_start, t_start) > 0 THEN 1 ELSE 0 END AS INTEGER) AS label, h, round(cells, 4) AS cells, CAST(truth AS BIGINT) AS truth FROM q"""


def c13_patch_heatmaps(spark: SparkSession, d: str) -> DataFrame:
    """The same patches with heatmaps as targets."""
    return _patch_rows(spark, d, "heatmap").select("rec", "f_start", "t_start", "label", F.posexplode("target").alias("h", "heat"))


Q["c13_patch_heatmaps"] = c13_patch_heatmaps
SQL["c13_patch_heatmaps"] = f"""WITH {X.GRAM}, {_GRID},
q AS (SELECT ts.rec, f_start, t_start, CAST(f - f_start AS INTEGER) AS h, CASE WHEN max(x) >= 12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS heat
 FROM ts, fs, cell c WHERE c.rec = ts.rec AND t >= t_start AND t < t_start + 16 AND f >= f_start AND f < f_start + 16 GROUP BY ALL)
SELECT rec, f_start, t_start, CAST(max(heat) OVER (PARTITION BY rec, f_start, t_start) AS INTEGER) AS label, h, heat FROM q"""


def f22_patch_labels(spark: SparkSession, d: str) -> DataFrame:
    grid = E.patch_grid(X.month_clips(spark, d), "user_id", "nf", "nt", 16, 10)
    return E.patch_labels(E.truth_in_patches(X.month_truth(spark, d), grid, "user_id", 16, 10, 2.0), grid, "user_id")


Q["f22_patch_labels"] = f22_patch_labels
SQL["f22_patch_labels"] = f"""WITH {X.MONTH_TRUTH}, {X.MONTH_STARTS}, g AS (SELECT user_id, f_start, t_start FROM (SELECT DISTINCT user_id FROM events), ms)
SELECT g.user_id, f_start, t_start, CAST(max(CASE WHEN mt.user_id IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS label FROM g LEFT JOIN mt ON mt.user_id = g.user_id AND bin >= f_start AND bin < f_start + 16 AND frame >= t_start AND frame < t_start + 16 GROUP BY ALL"""


def f22_heatmaps(spark: SparkSession, d: str) -> DataFrame:
    grid = E.patch_grid(X.month_clips(spark, d), "user_id", "nf", "nt", 16, 10)
    heat = E.patch_heatmap(X.month_truth(spark, d), grid, "user_id", 16, 10)
    return heat.select("user_id", "f_start", "t_start", F.posexplode("heat").alias("h", "heat"))


Q["f22_heatmaps"] = f22_heatmaps
SQL["f22_heatmaps"] = f"""WITH {X.MONTH_TRUTH}, {X.MONTH_STARTS}, g AS (SELECT user_id, f_start, t_start, CAST(h AS INTEGER) AS h FROM (SELECT DISTINCT user_id FROM events), ms, range(0, 16) r(h))
SELECT g.user_id, f_start, t_start, h, CAST(max(CASE WHEN mt.user_id IS NULL THEN 0 ELSE 1 END) AS INTEGER) AS heat FROM g LEFT JOIN mt ON mt.user_id = g.user_id AND bin = f_start + h AND frame >= t_start AND frame < t_start + 16 GROUP BY ALL"""


def f22_masks(spark: SparkSession, d: str) -> DataFrame:
    grid = E.patch_grid(X.month_clips(spark, d), "user_id", "nf", "nt", 16, 10)
    return E.patch_mask(X.month_truth(spark, d), grid, "user_id", 16, 10)


Q["f22_masks"] = f22_masks
SQL["f22_masks"] = f"WITH {X.MONTH_TRUTH}, {X.MONTH_STARTS} SELECT DISTINCT user_id, f_start, t_start, CAST(bin - f_start AS INTEGER) AS h, CAST(frame - t_start AS INTEGER) AS w FROM mt JOIN ms ON bin >= f_start AND bin < f_start + 16 AND frame >= t_start AND frame < t_start + 16"


def k11_far_table(spark: SparkSession, d: str) -> DataFrame:
    g = X.read(spark, d, "events").groupBy(F.col("event_type").alias("persistence_s"), F.floor(F.col("value") / 100).cast("long").alias("snr_db")).agg(F.count("*").alias("per_hour"))
    return K.far_table(g).na.fill(0)


Q["k11_far_table"] = k11_far_table
_KINDS = ("click", "view", "purchase", "signup", "error")
SQL["k11_far_table"] = f"SELECT CAST(floor(value / 100) AS BIGINT) AS snr_db, {', '.join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in _KINDS)} FROM events GROUP BY 1"
