"""Queries over scores, masks and matched lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.functions import columns as C
from tonalis.operators import calibrate as K
from tonalis.operators import evaluate as E
from tonalis.plans import fold_sql as S
from tonalis.plans import inputs as X

Q, SQL = {}, {}
#: Bin edges as doubles, in SQL.
_BIN = "CASE WHEN confidence < 0 OR confidence > 1 THEN NULL " + " ".join(f"WHEN confidence < CAST({k + 1} AS DOUBLE) * 0.1::DOUBLE THEN {k}" for k in range(9)) + " ELSE 9 END"


def _bucket(x: str, buckets=C.SNR_BUCKETS) -> str:  # noqa: ANN001
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} < {b[2]} THEN '{b[0]}'" for b in buckets[:-1]) + f" ELSE '{buckets[-1][0]}' END"


def _r(c: str, n: int = 8):  # noqa: ANN202
    return (F.round(c, n) + 0.0).alias(c)


def a2_reliability_bins(spark: SparkSession, d: str) -> DataFrame:
    b = K.reliability_bins(X.scores(spark, d))
    return b.select("bin", "n", _r("mean_score"), _r("positive_rate"), _r("share"))


_A2 = f"""WITH {X.SCORES}, g AS (SELECT {_BIN} AS bin, count(*) AS n, avg(confidence) AS p, avg(label) AS y FROM s GROUP BY 1),
b AS (SELECT CAST(k AS INTEGER) AS bin, coalesce(n, 0) AS n, p, y, coalesce(n, 0) / (SELECT count(*) FROM s) AS share FROM range(0, 10) r(k) LEFT JOIN g ON g.bin = k)"""
Q["a2_reliability_bins"] = a2_reliability_bins
SQL["a2_reliability_bins"] = _A2 + " SELECT bin, n, round(p, 8) AS mean_score, round(y, 8) AS positive_rate, round(share, 8) AS share FROM b"


def a2_ece(spark: SparkSession, d: str) -> DataFrame:
    return K.reliability_summary(K.reliability_bins(X.scores(spark, d))).select(_r("ece"), _r("overconfidence"), "n_used")


Q["a2_ece"] = a2_ece
SQL["a2_ece"] = _A2 + " SELECT round(sum(share * abs(p - y)), 8) AS ece, round(count(*) FILTER (p > y) / count(*) FILTER (n > 0), 8) AS overconfidence, count(*) FILTER (n > 0) AS n_used FROM b"


def a3_ece_by_bucket(spark: SparkSession, d: str) -> DataFrame:
    return K.ece_by_bucket(X.scores(spark, d)).select("bucket", "n", _r("ece"), "stable")


_A3 = "g AS (SELECT {b} AS bucket, {bin} AS bin, count(*) AS n, avg(confidence) AS p, avg(label) AS y FROM s GROUP BY ALL) SELECT bucket, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(p - y)) / sum(n), 8) AS ece, sum(n) >= 10 AS stable FROM g GROUP BY bucket"
Q["a3_ece_by_bucket"] = a3_ece_by_bucket
SQL["a3_ece_by_bucket"] = f"WITH {X.SCORES}, " + _A3.format(b=_bucket("peak_snr_db"), bin=_BIN)


def a3_ece_merged(spark: SparkSession, d: str) -> DataFrame:
    return K.ece_by_bucket(X.scores(spark, d), buckets=C.MERGED_BUCKETS).select("bucket", "n", _r("ece"), "stable")


Q["a3_ece_merged"] = a3_ece_merged
SQL["a3_ece_merged"] = f"WITH {X.SCORES}, " + _A3.format(b=_bucket("peak_snr_db", C.MERGED_BUCKETS), bin=_BIN)

_FIT = f"""{X.SCORES}, a(alpha) AS (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)),
c AS (SELECT label = 1 AS pos, CASE WHEN label = 1 THEN 1.0::DOUBLE - confidence ELSE confidence END AS v, row_number() OVER (PARTITION BY label = 1 ORDER BY CASE WHEN label = 1 THEN 1.0::DOUBLE - confidence ELSE confidence END) - 1 AS r FROM s WHERE doc_id % 2 = 0),
n AS (SELECT pos, count(*) AS n FROM c GROUP BY pos),
w AS (SELECT pos, alpha, n, least(ceil((n + 1) * (1.0::DOUBLE - alpha)) / n, 1.0::DOUBLE) * (n - 1) AS pos_at FROM n, a),
q AS (SELECT w.pos, alpha, n, lo.v + (pos_at - floor(pos_at)) * (hi.v - lo.v) AS q FROM w JOIN c lo ON lo.pos = w.pos AND lo.r = floor(pos_at) JOIN c hi ON hi.pos = w.pos AND hi.r = least(floor(pos_at) + 1, n - 1)),
f AS (SELECT alpha, max(q) FILTER (pos) AS q_positive, max(q) FILTER (NOT pos) AS q_negative, max(n) FILTER (pos) AS n_cal_positive, max(n) FILTER (NOT pos) AS n_cal_negative FROM q GROUP BY alpha)"""
_SETS = """x AS (SELECT s.*, alpha, 1.0::DOUBLE - confidence <= q_positive AS in_positive, confidence <= q_negative AS in_negative, n_cal_positive, n_cal_negative FROM s, f WHERE doc_id % 2 = 1),
y AS (SELECT *, CAST(in_positive AS INTEGER) + CAST(in_negative AS INTEGER) AS set_size, CASE WHEN in_positive AND in_negative THEN 'uncertain' WHEN in_positive THEN 'detected' WHEN in_negative THEN 'not_detected' ELSE 'empty' END AS verdict FROM x)"""


def _fit(spark: SparkSession, d: str) -> DataFrame:
    return K.conformal_fit(X.scores(spark, d).filter("doc_id % 2 = 0"))


def _sets(spark: SparkSession, d: str) -> DataFrame:
    return K.prediction_sets(X.scores(spark, d).filter("doc_id % 2 = 1"), _fit(spark, d))


def a5_conformal_fit(spark: SparkSession, d: str) -> DataFrame:
    return K.require_fit(_fit(spark, d)).select("alpha", _r("q_positive"), _r("q_negative"), "n_cal_positive", "n_cal_negative")


Q["a5_conformal_fit"] = a5_conformal_fit
SQL["a5_conformal_fit"] = f"WITH {_FIT} SELECT alpha, round(q_positive, 8) AS q_positive, round(q_negative, 8) AS q_negative, n_cal_positive, n_cal_negative FROM f"


#: The same after a round trip through JSON.
SQL["k13_conformal_json"] = SQL["a5_conformal_fit"]


def f20_prediction_sets(spark: SparkSession, d: str) -> DataFrame:
    return _sets(spark, d).select("doc_id", "alpha", "in_positive", "in_negative", "set_size", "verdict")


Q["f20_prediction_sets"] = f20_prediction_sets
SQL["f20_prediction_sets"] = f"WITH {_FIT}, {_SETS} SELECT doc_id, alpha, in_positive, in_negative, set_size, verdict FROM y"


def a6_coverage(spark: SparkSession, d: str) -> DataFrame:
    c = K.empirical_coverage(_sets(spark, d), _fit(spark, d))
    return c.select("alpha", "n", *[_r(k) for k in ("coverage", "coverage_positive", "coverage_negative", "mean_set_size", "singleton", "uncertain", "empty", "bound_positive", "bound_negative")])


Q["a6_coverage"] = a6_coverage
SQL["a6_coverage"] = f"""WITH {_FIT}, {_SETS}, z AS (SELECT *, CAST(CASE WHEN label = 1 THEN in_positive ELSE in_negative END AS INTEGER) AS ok FROM y)
SELECT alpha, count(*) AS n, round(avg(ok), 8) AS coverage, round(avg(ok) FILTER (label = 1), 8) AS coverage_positive, round(avg(ok) FILTER (label = 0), 8) AS coverage_negative, round(avg(set_size), 8) AS mean_set_size,
round(avg(CAST(set_size = 1 AS INTEGER)), 8) AS singleton, round(avg(CAST(set_size = 2 AS INTEGER)), 8) AS uncertain, round(avg(CAST(set_size = 0 AS INTEGER)), 8) AS empty,
round(any_value(1 / sqrt(n_cal_positive)), 8) AS bound_positive, round(any_value(1 / sqrt(n_cal_negative)), 8) AS bound_negative FROM z GROUP BY alpha"""


def a13_far_projection(spark: SparkSession, d: str) -> DataFrame:
    out = K.far_projection(_sets(spark, d), C.patches_per_hour(128, 4096, 32000))
    return out.select("alpha", "n_negative", _r("p_false"), _r("per_beam_hour", 6), _r("per_hour", 4))


Q["a13_far_projection"] = a13_far_projection
SQL["a13_far_projection"] = f"""WITH {_FIT}, {_SETS}, p AS (SELECT alpha, count(*) FILTER (label = 0) AS n_negative, count(*) FILTER (label = 0 AND verdict = 'detected') / count(*) FILTER (label = 0) AS p FROM y GROUP BY alpha)
SELECT alpha, n_negative, round(p, 8) AS p_false, round(p * (3600.0::DOUBLE / 16.384::DOUBLE), 6) AS per_beam_hour, round(p * (3600.0::DOUBLE / 16.384::DOUBLE) * 180, 4) AS per_hour FROM p"""


def a14_set_size_by_snr(spark: SparkSession, d: str) -> DataFrame:
    return K.set_size_by_bucket(_sets(spark, d)).select("bucket", "n", _r("singleton"), _r("uncertain"), _r("empty"))


Q["a14_set_size_by_snr"] = a14_set_size_by_snr
SQL["a14_set_size_by_snr"] = f"WITH {_FIT}, {_SETS} SELECT {_bucket('peak_snr_db')} AS bucket, count(*) AS n, round(avg(CAST(set_size = 1 AS INTEGER)), 8) AS singleton, round(avg(CAST(set_size = 2 AS INTEGER)), 8) AS uncertain, round(avg(CAST(set_size = 0 AS INTEGER)), 8) AS empty FROM y WHERE alpha = 0.1::DOUBLE GROUP BY 1"


def a15_pixel_statistics(spark: SparkSession, d: str) -> DataFrame:
    return K.pixel_statistics(X.masks(spark, d)).select("patch_id", "h", "w", "n_members", *[_r(k) for k in ("mean_p", "entropy", "mutual_information", "variance")])


_H = lambda p: f"-({p} * ln({p}) + (1 - {p}) * ln(1 - {p}))"
Q["a15_pixel_statistics"] = a15_pixel_statistics
SQL["a15_pixel_statistics"] = f"""WITH {X.MASKS}, g AS (SELECT patch_id, h, w, avg(p) AS a, avg({_H("p")}) AS e, var_pop(p) AS v, count(*) AS n FROM m GROUP BY ALL)
SELECT patch_id, h, w, n AS n_members, round(a, 8) AS mean_p, round({_H("a")}, 8) AS entropy, round(greatest(0, {_H("a")} - e), 8) AS mutual_information, round(v, 8) AS variance FROM g"""


def a19_max_disagreement(spark: SparkSession, d: str) -> DataFrame:
    return K.max_disagreement(K.pixel_statistics(X.masks(spark, d))).select("patch_id", _r("max_disagreement"))


Q["a19_max_disagreement"] = a19_max_disagreement
SQL["a19_max_disagreement"] = f"WITH {X.MASKS}, g AS (SELECT patch_id, h, w, var_pop(p) AS v FROM m GROUP BY ALL) SELECT patch_id, round(max(v), 8) AS max_disagreement FROM g GROUP BY 1"


def a20_patch_confidence(spark: SparkSession, d: str) -> DataFrame:
    m = X.masks(spark, d)
    parts = [K.patch_confidence(m, k).select("patch_id", F.lit(k).alias("method"), _r("confidence")) for k in ("max_mean", "mean_max", "peak_freq_band")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


Q["a20_patch_confidence"] = a20_patch_confidence
SQL["a20_patch_confidence"] = f"""WITH {X.MASKS}, g AS (SELECT patch_id, h, w, avg(p) AS a FROM m GROUP BY ALL), b AS (SELECT patch_id, w, max(a) AS a FROM g GROUP BY ALL), k AS (SELECT patch_id, member, max(p) AS a FROM m GROUP BY ALL)
SELECT patch_id, 'max_mean' AS method, round(max(a), 8) AS confidence FROM g GROUP BY 1 UNION ALL SELECT patch_id, 'mean_max', round(avg(a), 8) FROM k GROUP BY 1 UNION ALL SELECT patch_id, 'peak_freq_band', round(avg(a), 8) FROM b GROUP BY 1"""


def a21_diversity(spark: SparkSession, d: str) -> DataFrame:
    return K.ensemble_diversity(X.masks(spark, d)).select(*[_r(k) for k in ("mean_cosine", "median_cosine", "min_cosine", "max_cosine")], "homogeneous", "n_pairs")


Q["a21_diversity"] = a21_diversity
SQL["a21_diversity"] = f"""WITH {X.MASKS}, c AS (SELECT sum(x.p * y.p) / (sqrt(sum(x.p * x.p)) * sqrt(sum(y.p * y.p))) AS c FROM m x JOIN m y ON x.patch_id = y.patch_id AND x.h = y.h AND x.w = y.w AND x.member < y.member GROUP BY x.member, y.member)
SELECT round(avg(c), 8) AS mean_cosine, round(quantile_cont(c, 0.5), 8) AS median_cosine, round(min(c), 8) AS min_cosine, round(max(c), 8) AS max_cosine, avg(c) > 0.95 AS homogeneous, count(*) AS n_pairs FROM c"""


def a25_components(spark: SparkSession, d: str) -> DataFrame:
    m = X.masks(spark, d).withColumn("_k", F.col("patch_id") * 4 + F.col("member"))
    return E.component_lines(m, "_k", "h", "w", "p", 0.5, 2).select(F.shiftright("_k", 2).alias("patch_id"), F.pmod("_k", F.lit(4)).cast("int").alias("member"), "row", "col_min", "col_max", _r("confidence"), "n_cells")


Q["a25_components"] = a25_components
SQL["a25_components"] = f"""WITH RECURSIVE {X.MASKS}, c AS MATERIALIZED (SELECT patch_id, member, h, w, p, h * 4 + w AS id FROM m WHERE p > 0.5),
r AS (SELECT patch_id, member, id, id AS root FROM c UNION SELECT c.patch_id, c.member, c.id, r.root FROM r JOIN c o ON o.patch_id = r.patch_id AND o.member = r.member AND o.id = r.id JOIN c ON c.patch_id = o.patch_id AND c.member = o.member AND abs(c.h - o.h) + abs(c.w - o.w) = 1),
k AS (SELECT patch_id, member, id, min(root) AS root FROM r GROUP BY ALL)
SELECT patch_id, member, CAST(floor(quantile_cont(h, 0.5)) AS INTEGER) AS row, min(w) AS col_min, max(w) AS col_max, round(avg(p), 8) AS confidence, CAST(count(*) AS INTEGER) AS n_cells FROM k JOIN c USING (patch_id, member, id) GROUP BY patch_id, member, root HAVING count(*) >= 2"""


def a25_mean_rows(spark: SparkSession, d: str) -> DataFrame:
    """Components with their mean row instead of the median."""
    m = X.masks(spark, d).withColumn("_k", F.col("patch_id") * 4 + F.col("member"))
    return E.component_lines(m, "_k", "h", "w", "p", 0.6, 1, "mean").select(F.shiftright("_k", 2).alias("patch_id"), F.pmod("_k", F.lit(4)).cast("int").alias("member"), _r("row"), "col_min", "col_max", _r("confidence"), "n_cells")


Q["a25_mean_rows"] = a25_mean_rows
SQL["a25_mean_rows"] = SQL["a25_components"].replace("p > 0.5", "p > 0.6").replace("CAST(floor(quantile_cont(h, 0.5)) AS INTEGER) AS row", "round(avg(h), 8) AS row").replace("count(*) >= 2", "count(*) >= 1")


def a26_heatmap_lines(spark: SparkSession, d: str) -> DataFrame:
    h = X.read(spark, d, "embeddings").select(F.col("vec_id").alias("patch"), (1.0 / (1.0 + F.exp(-8.0 * F.col("embedding")[0].cast("double")))).alias("cls"), F.transform("embedding", lambda v: 1.0 / (1.0 + F.exp(-8.0 * v.cast("double")))).alias("heat"))
    return E.heatmap_lines(h, "patch", "cls", "heat", 3.0, 2.0, 0.0, 32.0, 0.5, 0.7).select("patch", "freq_hz", "t_start", "t_end", _r("confidence"))


Q["a26_heatmap_lines"] = a26_heatmap_lines
SQL["a26_heatmap_lines"] = """WITH c AS (SELECT vec_id AS patch, i, 1.0::DOUBLE / (1.0::DOUBLE + exp(-8.0::DOUBLE * CAST(embedding[i] AS DOUBLE))) AS p, 1.0::DOUBLE / (1.0::DOUBLE + exp(-8.0::DOUBLE * CAST(embedding[1] AS DOUBLE))) AS k FROM embeddings, range(1, 65) r(i))
SELECT patch, 3.0::DOUBLE + (i - 1) * 2.0::DOUBLE AS freq_hz, 0.0::DOUBLE AS t_start, 32.0::DOUBLE AS t_end, round(p, 8) AS confidence FROM c WHERE k >= 0.5 AND p > 0.7"""


def a27_stitch(spark: SparkSession, d: str) -> DataFrame:
    m = X.masks(spark, d).select((F.col("patch_id") % 50 * 4 + F.col("member")).alias("_k"), ((F.col("patch_id") % 5) * 2).cast("int").alias("f0"), ((F.col("patch_id") % 7) * 2).cast("int").alias("t0"), "h", "w", "p")
    return E.stitch(m, "_k", "f0", "t0", "h", "w", "p", 11, 14).select(F.shiftright("_k", 2).alias("rec"), F.pmod("_k", F.lit(4)).cast("int").alias("member"), "freq_bin", "time_bin", _r("p"))


Q["a27_stitch"] = a27_stitch
SQL["a27_stitch"] = f"WITH {X.MASKS} SELECT patch_id % 50 AS rec, member, CAST(patch_id % 5 * 2 + h AS INTEGER) AS freq_bin, CAST(patch_id % 7 * 2 + w AS INTEGER) AS time_bin, round(max(p), 8) AS p FROM m WHERE patch_id % 5 * 2 + h < 11 AND patch_id % 7 * 2 + w < 14 GROUP BY ALL"


def a27_moments(spark: SparkSession, d: str) -> DataFrame:
    """Mean and variance over the patches that cover a cell."""
    m = X.masks(spark, d).select((F.col("patch_id") % 50 * 4 + F.col("member")).alias("_k"), ((F.col("patch_id") % 5) * 2).cast("int").alias("f0"), ((F.col("patch_id") % 7) * 2).cast("int").alias("t0"), "h", "w", "p")
    return E.stitch(m, "_k", "f0", "t0", "h", "w", "p", 11, 14, "moments").select(F.shiftright("_k", 2).alias("rec"), F.pmod("_k", F.lit(4)).cast("int").alias("member"), "freq_bin", "time_bin", _r("mean"), _r("variance"), "n")


Q["a27_moments"] = a27_moments
SQL["a27_moments"] = SQL["a27_stitch"].replace("round(max(p), 8) AS p", "round(avg(p), 8) AS mean, round(var_pop(p), 8) AS variance, count(*) AS n")

_IOU = """CASE WHEN abs(p.freq_hz - t.freq_hz) <= 2 * 15.0 THEN 1.0::DOUBLE WHEN abs(p.freq_hz - t.freq_hz) <= 4 * 15.0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END * greatest(0.0::DOUBLE, (least(p.t_end, t.t_end) - greatest(p.t_start, t.t_start)) / (greatest(p.t_end, t.t_end) - least(p.t_start, t.t_start)))"""
_LINES = f"{X.sql_spans('p', 'click')}, {X.sql_spans('t', 'view')}"


def j3_line_iou(spark: SparkSession, d: str) -> DataFrame:
    return E.line_iou_pairs(X.spans(spark, d, "click"), X.spans(spark, d, "view"), "patch", 15.0).select("patch", "pred_id", "truth_id", _r("iou"))


Q["j3_line_iou"] = j3_line_iou
SQL["j3_line_iou"] = f"WITH {_LINES}, i AS (SELECT p.patch, p.id AS pred_id, t.id AS truth_id, {_IOU} AS iou FROM p JOIN t USING (patch)) SELECT patch, pred_id, truth_id, round(iou, 8) AS iou FROM i WHERE iou > 0"


def _matches(spark: SparkSession, d: str) -> DataFrame:
    return E.match_lines(X.spans(spark, d, "click"), X.spans(spark, d, "view"), "patch", 15.0)


def j4_match_lines(spark: SparkSession, d: str) -> DataFrame:
    """Pairs, and lines without one: -1 stands for the missing side."""
    return _matches(spark, d).select("patch", F.coalesce("pred_id", F.lit(-1)).alias("pred_id"), F.coalesce("truth_id", F.lit(-1)).alias("truth_id"), F.coalesce(F.round("iou", 8), F.lit(-1.0)).alias("iou"))


_MATCH = f"""{_LINES}, i AS MATERIALIZED (SELECT * FROM (SELECT p.patch, p.id AS pred_id, t.id AS truth_id, {_IOU} AS iou FROM p JOIN t USING (patch)) WHERE iou > 0), {S.matched('best', 'i')},
good AS MATERIALIZED (SELECT * FROM best WHERE iou >= 0.1),
m AS MATERIALIZED (SELECT * FROM good UNION ALL SELECT patch, id, NULL, NULL FROM p ANTI JOIN good ON good.patch = p.patch AND good.pred_id = p.id UNION ALL SELECT patch, NULL, id, NULL FROM t ANTI JOIN good ON good.patch = t.patch AND good.truth_id = t.id)"""
Q["j4_match_lines"] = j4_match_lines
SQL["j4_match_lines"] = f"WITH RECURSIVE {_MATCH} SELECT patch, coalesce(pred_id, -1) AS pred_id, coalesce(truth_id, -1) AS truth_id, coalesce(round(iou, 8), -1.0::DOUBLE) AS iou FROM m"


def j4_match_totals(spark: SparkSession, d: str) -> DataFrame:
    """The best total of IoU of every patch with lines on both sides, without a threshold."""
    p, t = X.spans(spark, d, "click"), X.spans(spark, d, "view")
    both = p.select("patch").intersect(t.select("patch"))
    m = E.match_lines(p.join(both, "patch", "left_semi"), t.join(both, "patch", "left_semi"), "patch", 15.0, 0.0)
    return m.groupBy("patch").agg(F.round(F.coalesce(F.sum("iou"), F.lit(0.0)), 6).alias("total"))


Q["j4_match_totals"] = j4_match_totals
SQL["j4_match_totals"] = f"WITH RECURSIVE {_MATCH}, z AS (SELECT patch, sum(iou) AS iou FROM best GROUP BY patch) SELECT patch, round(coalesce(iou, 0.0::DOUBLE), 6) AS total FROM (SELECT patch FROM p INTERSECT SELECT patch FROM t) LEFT JOIN z USING (patch)"


def a1_recall_by_snr(spark: SparkSession, d: str) -> DataFrame:
    return E.recall_by_bucket(_matches(spark, d), X.spans(spark, d, "view"), "patch").select("ord", "bucket", "tp", "fn", _r("recall"), "all_tp", "all_fn", _r("gate_recall"), "passes")


_A1 = f"""WITH RECURSIVE {_MATCH}, x AS (SELECT t.*, good.pred_id IS NOT NULL AS hit FROM t LEFT JOIN good ON good.patch = t.patch AND good.truth_id = t.id), g AS (SELECT {_bucket("peak_snr_db")} AS bucket, count(*) FILTER (hit) AS tp, count(*) FILTER (NOT hit) AS fn FROM x GROUP BY 1),
o(ord, bucket) AS (VALUES {", ".join(f"({k}, '{b[0]}')" for k, b in enumerate(C.SNR_BUCKETS))}), tot AS (SELECT count(*) FILTER (hit) AS a, count(*) FILTER (NOT hit) AS b, count(*) FILTER (hit AND peak_snr_db >= 8) / count(*) FILTER (peak_snr_db >= 8) AS g, (SELECT count(*) FROM m WHERE truth_id IS NULL) AS fp FROM x)
SELECT ord, bucket, coalesce(tp, 0) AS tp, coalesce(fn, 0) AS fn, round(tp / (tp + fn), 8) AS recall, a AS all_tp, b AS all_fn, round(g, 8) AS gate_recall, g >= 0.8 AS passes"""
Q["a1_recall_by_snr"] = a1_recall_by_snr
SQL["a1_recall_by_snr"] = _A1 + " FROM o LEFT JOIN g USING (bucket), tot"


def a1_evaluate_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same with false positives, precision, recall and F1 of all."""
    return E.recall_by_bucket(_matches(spark, d), X.spans(spark, d, "view"), "patch").select("ord", "bucket", "tp", "fn", _r("recall"), "all_tp", "all_fn", _r("gate_recall"), "passes", "all_fp", _r("precision_all"), _r("recall_all"), _r("f1_all"))


Q["a1_evaluate_matches"] = a1_evaluate_matches
SQL["a1_evaluate_matches"] = _A1 + ", fp AS all_fp, round(a / (a + fp), 8) AS precision_all, round(a / (a + b), 8) AS recall_all, round(2 * a / (2 * a + fp + b), 8) AS f1_all FROM o LEFT JOIN g USING (bucket), tot"


def a10_seed_aggregate(spark: SparkSession, d: str) -> DataFrame:
    runs = X.read(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("metric"))
    return E.seed_aggregate(runs, ["event_type"], "seed", "metric").select("event_type", _r("mean", 6), _r("std", 6), "n")


_A10 = "r AS (SELECT event_type, user_id % 5 AS seed, avg(value) AS v FROM events GROUP BY ALL), g AS (SELECT event_type, avg(v) AS mean, coalesce(stddev_samp(v), 0.0::DOUBLE) AS std, count(*) AS n FROM r GROUP BY 1)"
Q["a10_seed_aggregate"] = a10_seed_aggregate
SQL["a10_seed_aggregate"] = f"WITH {_A10} SELECT event_type, round(mean, 6) AS mean, round(std, 6) AS std, n FROM g"


def a10_seed_values(spark: SparkSession, d: str) -> DataFrame:
    """The seeds' own values, as the aggregate keeps them."""
    runs = X.read(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("metric"))
    return E.seed_aggregate(runs, ["event_type"], "seed", "metric").select("event_type", F.posexplode("per_seed").alias("place", "s")).select("event_type", "place", "s.seed", F.round("s.metric", 6).alias("metric"))


Q["a10_seed_values"] = a10_seed_values
SQL["a10_seed_values"] = "SELECT event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY seed) - 1 AS INTEGER) AS place, seed, round(metric, 6) AS metric FROM (SELECT event_type, user_id % 5 AS seed, avg(value) AS metric FROM events GROUP BY ALL)"


def a11_winner(spark: SparkSession, d: str) -> DataFrame:
    runs = X.read(spark, d, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("metric"))
    return E.winner(E.seed_aggregate(runs, ["event_type"], "seed", "metric"), ["event_type"]).select("event_type", _r("mean", 6), _r("std", 6), "n_rivals")


Q["a11_winner"] = a11_winner
SQL["a11_winner"] = f"WITH {_A10}, b AS (SELECT * FROM g ORDER BY mean DESC LIMIT 1) SELECT b.event_type, round(b.mean, 6) AS mean, round(b.std, 6) AS std, count(*) FILTER (g.event_type <> b.event_type AND g.mean + g.std >= b.mean - b.std) AS n_rivals FROM b, g GROUP BY ALL"


def j5_truth_in_patches(spark: SparkSession, d: str) -> DataFrame:
    grid = E.patch_grid(X.month_clips(spark, d), "user_id", "nf", "nt", 16, 10)
    return E.truth_in_patches(X.month_truth(spark, d), grid, "user_id", 16, 10, 2.0).select("user_id", "f_start", "t_start", "line_id", _r("freq_hz", 6), "t_start_s", "t_end_s", _r("peak_snr_db"), "n")


Q["j5_truth_in_patches"] = j5_truth_in_patches
SQL["j5_truth_in_patches"] = f"""WITH {X.MONTH_TRUTH}, {X.MONTH_STARTS}
SELECT user_id, f_start, t_start, line_id, round(avg(f), 6) AS freq_hz, min(frame) * 2.0::DOUBLE AS t_start_s, (max(frame) + 1) * 2.0::DOUBLE AS t_end_s, round(max(snr), 8) AS peak_snr_db, count(*) AS n FROM mt JOIN ms ON bin >= f_start AND bin < f_start + 16 AND frame >= t_start AND frame < t_start + 16 GROUP BY ALL"""


def l1_score_losses(spark: SparkSession, d: str) -> DataFrame:
    s = X.scores(spark, d).withColumn("y", F.col("label").cast("double"))
    logit = F.ln(C.clipped(F.col("confidence")) / (1.0 - C.clipped(F.col("confidence"))))
    return s.agg(F.round(F.avg(C.bce(F.col("confidence"), F.col("y"))), 6).alias("bce"), F.round(F.avg(C.focal_loss(logit, F.col("label"))), 6).alias("focal"), F.round(C.dice_loss(F.col("confidence"), F.col("y")), 6).alias("dice"))


Q["l1_score_losses"] = l1_score_losses
SQL["l1_score_losses"] = f"""WITH {X.SCORES}, c AS (SELECT label AS y, confidence AS r, greatest(1e-12::DOUBLE, least(1 - 1e-12::DOUBLE, confidence)) AS p FROM s)
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS bce, round(avg(-CASE WHEN y = 1 THEN 0.25 * pow(1 - p, 2) * ln(p) ELSE 0.75 * pow(p, 2) * ln(1 - p) END), 6) AS focal, round(1 - (2 * sum(r * y) + 1) / (sum(r) + sum(y) + 1), 6) AS dice FROM c"""


def m1_centreline_dice(spark: SparkSession, d: str) -> DataFrame:
    """Every mask against where it is above 0.6, thinned three times."""
    m = X.masks(spark, d).withColumn("target", (F.col("p") > 0.6).cast("double"))
    out = E.centreline_dice(m, ["patch_id", "member"], "h", "w", "p", "target", 3)
    return out.select("patch_id", "member", *[_r(c) for c in ("precision", "sensitivity", "loss")])


def _skeleton_sql(source: str, v: str, n_iter: int) -> str:
    """CTEs that end in <v>s (patch_id, member, h, w, s): the soft skeleton of column ``v`` of ``source``."""
    win = "PARTITION BY patch_id, member, w ORDER BY h ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING"
    cell = "patch_id, member, h, w"
    parts = [f"{v}x0 AS (SELECT {cell}, {v} AS x FROM {source})"]
    for k in range(n_iter + 1):
        if k:
            parts.append(f"{v}x{k} AS MATERIALIZED (SELECT {cell}, min(x) OVER ({win}) AS x FROM {v}x{k - 1})")
        parts.append(f"{v}e{k} AS (SELECT {cell}, x, min(x) OVER ({win}) AS e FROM {v}x{k})")
        parts.append(f"{v}d{k} AS MATERIALIZED (SELECT {cell}, greatest(x - max(e) OVER ({win}), 0) AS d FROM {v}e{k})")
        parts.append(f"{v}s{k} AS MATERIALIZED (SELECT {cell}, d AS s FROM {v}d0)" if not k else f"{v}s{k} AS MATERIALIZED (SELECT {cell}, s + greatest(d - s * d, 0) AS s FROM {v}s{k - 1} JOIN {v}d{k} USING ({cell}))")
    return ", ".join([*parts, f"{v}s AS (SELECT * FROM {v}s{n_iter})"])


Q["m1_centreline_dice"] = m1_centreline_dice
SQL["m1_centreline_dice"] = f"""WITH {X.MASKS}, src AS MATERIALIZED (SELECT *, CASE WHEN p > 0.6 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM m), {_skeleton_sql("src", "p", 3)}, {_skeleton_sql("src", "t", 3)},
z AS (SELECT patch_id, member, sum(ps.s * t) / (sum(ps.s) + 1) AS a, sum(ts.s * p) / (sum(ts.s) + 1) AS b FROM src JOIN ps USING (patch_id, member, h, w) JOIN ts USING (patch_id, member, h, w) GROUP BY patch_id, member)
SELECT patch_id, member, round(a, 8) + 0.0::DOUBLE AS precision, round(b, 8) + 0.0::DOUBLE AS sensitivity, round(1 - 2 * a * b / (a + b + 1e-6::DOUBLE), 8) + 0.0::DOUBLE AS loss FROM z"""
