"""Queries over tables: interval joins, splits, weights, parsing, hashes, scalar functions, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.functions import columns as C
from tonalis.operators import datasets as DS
from tonalis.operators import intervals as I
from tonalis.operators import splits as S
from tonalis.plans import inputs as X
from tonalis.sources import readers as R
from tonalis.sources import sinks as K
from tonalis.streaming import live as L

Q, SQL = {}, {}


def _r(c: str, n: int = 8):  # noqa: ANN202
    return (F.round(c, n) + 0.0).alias(c)


def j1_containment(spark: SparkSession, d: str) -> DataFrame:
    p = X.read(spark, d, "events").select("event_id", F.unix_timestamp("ts").cast("double").alias("a")).withColumn("b", F.col("a") + 300.0)
    f = X.read(spark, d, "customer").select("c_custkey", (X.EPOCH + F.col("c_custkey") * 1740.0).alias("s")).withColumn("e", F.col("s") + 3000.0)
    return I.containment(p, f, "a", "b", "s", "e", "c_custkey", 3600.0).select("event_id", "c_custkey")


Q["j1_containment"] = j1_containment
SQL["j1_containment"] = f"""WITH p AS (SELECT event_id, floor(epoch(ts)) AS a, floor(epoch(ts)) + 300 AS b FROM events), f AS (SELECT c_custkey, {X.EPOCH} + c_custkey * 1740.0::DOUBLE AS s FROM customer)
SELECT event_id, min(c_custkey) AS c_custkey FROM p LEFT JOIN f ON s <= a AND b < s + 3000 GROUP BY event_id"""


def j2_overlap_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = X.read(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_timestamp("ts").cast("double").alias("a"), F.col("value").alias("f")).withColumn("b", F.col("a") + 7200.0)
    return I.overlap_pairs(e, "event_id", ["user_id"], "a", "b", "f", 20.0, 7200.0)


Q["j2_overlap_pairs"] = j2_overlap_pairs
SQL["j2_overlap_pairs"] = """WITH e AS (SELECT event_id, user_id, floor(epoch(ts)) AS a, floor(epoch(ts)) + 7200 AS b, value AS f FROM events)
SELECT x.user_id, x.event_id AS a, y.event_id AS b FROM e x JOIN e y ON x.user_id = y.user_id AND x.event_id < y.event_id AND abs(x.f - y.f) <= 20 AND x.a <= y.b AND y.a <= x.b"""


def j6_nearest_bin(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "part").select("p_partkey", C.nearest_bin(F.col("p_retailprice").cast("double") / 4.0, 3.0, 2.5, 256).alias("bin"))


Q["j6_nearest_bin"] = j6_nearest_bin
SQL["j6_nearest_bin"] = "SELECT p_partkey, CAST(least(greatest(ceil((CAST(p_retailprice AS DOUBLE) / 4 - 3.0::DOUBLE) / 2.5::DOUBLE - 0.5::DOUBLE), 0), 255) AS INTEGER) AS bin FROM part"


def j10_config_grid(spark: SparkSession, d: str) -> DataFrame:
    e = X.read(spark, d, "events").select("user_id", "value")
    grid = spark.createDataFrame([(float(a), float(b)) for a in (50, 100, 200) for b in (1, 2)], "low double, factor double")
    return e.crossJoin(F.broadcast(grid)).filter(F.col("value") >= F.col("low") * F.col("factor")).groupBy("low", "factor").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


Q["j10_config_grid"] = j10_config_grid
SQL["j10_config_grid"] = "SELECT low::DOUBLE AS low, factor::DOUBLE AS factor, count(*) AS n, count(DISTINCT user_id) AS users FROM events, (VALUES (50), (100), (200)) a(low), (VALUES (1), (2)) b(factor) WHERE value >= low * factor GROUP BY ALL"


def t3_sample_per_class(spark: SparkSession, d: str) -> DataFrame:
    return S.sample_per(X.read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 10, 7)


Q["t3_sample_per_class"] = t3_sample_per_class
SQL["t3_sample_per_class"] = "SELECT c_custkey, c_mktsegment FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('7/' || c_custkey), c_custkey) <= 10"


def _split_sql(part: str) -> str:
    return f"""WITH r AS (SELECT c_custkey, c_mktsegment, count(*) OVER ({part}) AS n, row_number() OVER ({part} ORDER BY md5('7/' || c_custkey), c_custkey) AS k FROM customer)
SELECT c_mktsegment || '/' || c_custkey AS compound_key, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS partition FROM r"""


def t4_split_stratified(spark: SparkSession, d: str) -> DataFrame:
    return S.split(X.read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", seed=7, by="c_mktsegment").select(C.compound_key(F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("compound_key"), "partition")


def t4_split_flat(spark: SparkSession, d: str) -> DataFrame:
    return S.split(X.read(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", seed=7).select(C.compound_key(F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("compound_key"), "partition")


Q["t4_split_stratified"], Q["t4_split_flat"] = t4_split_stratified, t4_split_flat
SQL["t4_split_stratified"], SQL["t4_split_flat"] = _split_sql("PARTITION BY c_mktsegment"), _split_sql("PARTITION BY 0")


def t5_holdout(spark: SparkSession, d: str) -> DataFrame:
    return S.holdout(X.read(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 0.2, 3)


Q["t5_holdout"] = t5_holdout
SQL["t5_holdout"] = "SELECT s_suppkey, CASE WHEN row_number() OVER (ORDER BY md5('3/' || s_suppkey), s_suppkey) <= greatest(1, floor(count(*) OVER () * 0.2::DOUBLE)) THEN 'val' ELSE 'train' END AS partition FROM supplier"


def t6_balanced_weights(spark: SparkSession, d: str) -> DataFrame:
    return S.balanced_weights(X.scores(spark, d).select("doc_id", "label")).select("doc_id", "label", _r("weight", 10))


Q["t6_balanced_weights"] = t6_balanced_weights
SQL["t6_balanced_weights"] = f"WITH {X.SCORES} SELECT doc_id, label, round(1.0::DOUBLE / count(*) OVER (PARTITION BY label), 10) AS weight FROM s"


def t7_domain_weights(spark: SparkSession, d: str) -> DataFrame:
    return S.domain_weights(X.scores(spark, d).select("doc_id", "label", "lang"), {"en": 0.75, "de": 0.25}, "lang").select("doc_id", "label", "lang", _r("weight", 10))


Q["t7_domain_weights"] = t7_domain_weights
SQL["t7_domain_weights"] = f"WITH {X.SCORES} SELECT doc_id, label, lang, round(CASE lang WHEN 'en' THEN 0.75::DOUBLE WHEN 'de' THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END * 0.5 / count(*) OVER (PARTITION BY lang, label), 10) AS weight FROM s"


def t6_weighted_draws(spark: SparkSession, d: str) -> DataFrame:
    w = S.balanced_weights(X.scores(spark, d).select("doc_id", "label"))
    return S.draw_with_replacement(w, "weight", "doc_id", 500, 5).join(w.select("doc_id", "label"), "doc_id")


Q["t6_weighted_draws"] = t6_weighted_draws
SQL["t6_weighted_draws"] = f"""WITH {X.SCORES}, k AS MATERIALIZED (SELECT doc_id, label, 1.0::DOUBLE / count(*) OVER (PARTITION BY label) AS weight, substr(md5(CAST(doc_id AS VARCHAR)), 1, 3) AS st FROM s),
z AS MATERIALIZED (SELECT st, sum(weight) AS sw FROM k GROUP BY st), zf AS (SELECT *, coalesce(sum(sw) OVER (ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS f FROM z),
c AS (SELECT *, sum(weight) OVER (PARTITION BY st ORDER BY doc_id) AS hi FROM k), d AS (SELECT k AS draw, {X.sql_hashed("5/", "k")} * (SELECT sum(sw) FROM z) AS u FROM range(0, 500) r(k))
SELECT draw, doc_id, label FROM d JOIN zf ON u >= f AND u < f + sw JOIN c ON c.st = zf.st AND u - f >= hi - weight AND u - f < hi"""


def t8_species_weights(spark: SparkSession, d: str) -> DataFrame:
    return S.species_weights(X.read(spark, d, "events"), "event_type").select("event_type", "n", _r("weight", 10))


Q["t8_species_weights"] = t8_species_weights
SQL["t8_species_weights"] = "WITH n AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1) SELECT event_type, n, round(sqrt(n) / sum(sqrt(n)) OVER (), 10) AS weight FROM n"


def t9_clip_plan(spark: SparkSession, d: str) -> DataFrame:
    return S.assign_with_replacement(X.read(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 12, 100)


Q["t9_clip_plan"] = t9_clip_plan
SQL["t9_clip_plan"] = "SELECT s_suppkey, CAST(floor(CAST(('0x' || substr(md5('100/' || s_suppkey), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE * 12) AS INTEGER) AS choice, 100 + row_number() OVER (ORDER BY s_suppkey) AS clip_seed FROM supplier"


def c12_vessel_clips(spark: SparkSession, d: str) -> DataFrame:
    """Plan of vessels by clips with their seeds; short ones are skipped with a reason."""
    v = X.read(spark, d, "customer").select(F.col("c_custkey").alias("vessel"), (F.abs(F.col("c_acctbal").cast("double")) / 100.0).alias("duration_s"))
    return DS.vessel_clips(v, 3, 9, "vessel").select("vessel", "clip", "seed", "skipped")


Q["c12_vessel_clips"] = c12_vessel_clips
SQL["c12_vessel_clips"] = "SELECT c_custkey AS vessel, CAST(k AS INTEGER) AS clip, 9 + 1000 * c_custkey + k AS seed, abs(CAST(c_acctbal AS DOUBLE)) / 100 < 35 AS skipped FROM customer, range(0, 3) r(k)"


def s5_parse_names(spark: SparkSession, d: str) -> DataFrame:
    """File names made of part rows: number, class word, vessel word; every third doesn't fit."""
    p = X.read(spark, d, "part")
    path = F.concat(F.lit("/data/"), F.when(F.col("p_partkey") % 3 == 0, F.lit("x")).otherwise(F.lit("")), F.col("p_partkey").cast("string"), F.lit("_"), F.regexp_replace("p_brand", "[^A-Za-z]", ""), F.lit("-"), F.regexp_replace("p_type", "[^A-Za-z0-9]", ""), F.lit(".WAV"))
    files = p.select(path.alias("path"), F.lit(32000).alias("sample_rate_hz"), (F.col("p_size") / 2.0).alias("duration_s"), F.lit(1).alias("n_channels"))
    return R.named_files(files).select("recording_id", "vessel_id", "class_label", "duration_s", "path", "notes")


Q["s5_parse_names"] = s5_parse_names
SQL["s5_parse_names"] = """WITH f AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END || p_partkey || '_' || regexp_replace(p_brand, '[^A-Za-z]', '', 'g') || '-' || regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g') AS stem, p_size / 2.0::DOUBLE AS duration_s FROM part)
SELECT stem AS recording_id, nullif(regexp_extract(stem, '^(\\d+)[_-]+([A-Za-z]+)[_-]+([A-Za-z0-9]+)', 3), '') AS vessel_id, nullif(regexp_extract(stem, '^(\\d+)[_-]+([A-Za-z]+)[_-]+([A-Za-z0-9]+)', 2), '') AS class_label, duration_s, '/data/' || stem || '.WAV' AS path,
CASE WHEN NOT regexp_matches(stem, '^(\\d+)[_-]+([A-Za-z]+)[_-]+([A-Za-z0-9]+)') THEN 'name not recognised' END AS notes FROM f WHERE duration_s >= 3"""


def s1_class_tree(spark: SparkSession, d: str) -> DataFrame:
    """Paths of both layouts made of customers: even nations nested, odd ones flat."""
    c = X.read(spark, d, "customer")
    nest = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("v"), (F.col("c_custkey") % 7).cast("string"), F.lit("/"))).otherwise(F.lit(""))
    path = F.concat(F.lit("file:/root/audio/"), F.concat(F.lit("c"), F.col("c_nationkey").cast("string")), F.lit("/"), nest, F.col("c_custkey").cast("string"), F.lit(".wav"))
    files = c.select(path.alias("path"), F.lit(32000).alias("sample_rate_hz"), (F.abs(F.col("c_acctbal").cast("double")) / 1000.0).alias("duration_s"), F.lit(1).alias("n_channels"))
    return R.class_tree(files, "/root/audio").select("recording_id", "vessel_id", "class_label", "path")


Q["s1_class_tree"] = s1_class_tree
SQL["s1_class_tree"] = """SELECT CAST(c_custkey AS VARCHAR) AS recording_id, CASE WHEN c_nationkey % 2 = 0 THEN 'v' || (c_custkey % 7) ELSE CAST(c_custkey AS VARCHAR) END AS vessel_id, 'c' || c_nationkey AS class_label,
'file:/root/audio/c' || c_nationkey || '/' || CASE WHEN c_nationkey % 2 = 0 THEN 'v' || (c_custkey % 7) || '/' ELSE '' END || c_custkey || '.wav' AS path FROM customer WHERE abs(CAST(c_acctbal AS DOUBLE)) / 1000 >= 3"""


def s10_name_times(spark: SparkSession, d: str) -> DataFrame:
    f = X.read(spark, d, "events").select(F.concat(F.lit("/a/site_"), F.date_format("ts", "yyMMdd_HHmmss"), F.lit(".wav")).alias("path"), (F.col("value") * 2.0).alias("duration_s"), "event_id")
    spans = R.file_spans(f.select(F.concat_ws("#", "path", F.col("event_id").cast("string")).alias("path"), "duration_s"))
    return spans.select("path", F.unix_seconds("start_ts").alias("start_s"), F.unix_micros("end_ts").alias("end_us"))


Q["s10_name_times"] = s10_name_times
SQL["s10_name_times"] = "SELECT '/a/site_' || strftime(ts, '%y%m%d_%H%M%S') || '.wav#' || event_id AS path, CAST(floor(epoch(ts)) AS BIGINT) AS start_s, CAST(floor(epoch(ts)) * 1000000 + round(value * 2.0::DOUBLE * 1000000) AS BIGINT) AS end_us FROM events"


def s16_manifest_keys(spark: SparkSession, d: str) -> DataFrame:
    return R.partition_keys(t4_split_stratified(spark, d), "val")


Q["s16_manifest_keys"] = s16_manifest_keys
SQL["s16_manifest_keys"] = f"WITH z AS ({_split_sql('PARTITION BY c_mktsegment')}) SELECT compound_key, split_part(compound_key, '/', 1) AS class_label, split_part(compound_key, '/', 2) AS vessel_id FROM z WHERE partition = 'val'"


def j7_key_join(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a partition resolved to files, all of them there."""
    keys = s16_manifest_keys(spark, d).select("compound_key")
    files = X.read(spark, d, "customer").select(C.compound_key(F.col("c_mktsegment"), F.col("c_custkey").cast("string")).alias("compound_key"), F.concat(F.lit("/f/"), "c_name").alias("path"))
    return R.resolve(R.require_subset(keys, files), files).select("compound_key", "path")


Q["j7_key_join"] = j7_key_join
SQL["j7_key_join"] = f"WITH z AS ({_split_sql('PARTITION BY c_mktsegment')}) SELECT compound_key, '/f/' || c_name AS path FROM z JOIN customer ON c_mktsegment || '/' || c_custkey = compound_key WHERE partition = 'val'"


def k4_manifest_hash(spark: SparkSession, d: str) -> DataFrame:
    return K.hash_files(X.read(spark, d, "documents").select("source", "text"), ["source"], "text")


Q["k4_manifest_hash"] = k4_manifest_hash
SQL["k4_manifest_hash"] = "SELECT source, sha256(string_agg(h, '' ORDER BY h)) AS manifest_sha256, count(*) AS n_files FROM (SELECT source, sha256(text) AS h FROM documents) GROUP BY source"


def k3_correlation_ids(spark: SparkSession, d: str) -> DataFrame:
    return K.provenance(X.read(spark, d, "supplier"), ["s_suppkey"], {"n_fft": 16384}).select("s_suppkey", "correlation_id", "parameter_snapshot")


Q["k3_correlation_ids"] = k3_correlation_ids
SQL["k3_correlation_ids"] = """SELECT s_suppkey, md5('{"n_fft": 16384}/' || s_suppkey) AS correlation_id, '{"n_fft": 16384}' AS parameter_snapshot FROM supplier"""


def k8_metrics_union(spark: SparkSession, d: str) -> DataFrame:
    r = X.read(spark, d, "nation")
    old = r.select(F.col("n_nationkey").alias("epoch"), F.lit(0.5).alias("loss"))
    return K.metrics_union(old, r.select((F.col("n_nationkey") + 25).alias("epoch"), F.lit(0.25).alias("recall")))


Q["k8_metrics_union"] = k8_metrics_union
SQL["k8_metrics_union"] = "SELECT n_nationkey AS epoch, 0.5::DOUBLE AS loss, NULL::DOUBLE AS recall FROM nation UNION ALL SELECT n_nationkey + 25, NULL, 0.25::DOUBLE FROM nation"


def k12_missing(spark: SparkSession, d: str) -> DataFrame:
    return K.missing(X.read(spark, d, "customer").select("c_custkey"), X.read(spark, d, "events").select(F.col("user_id").alias("c_custkey")), "c_custkey")


Q["k12_missing"] = k12_missing
SQL["k12_missing"] = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)"


def k13_conformal_json(spark: SparkSession, d: str) -> DataFrame:
    from tonalis.operators import calibrate as A

    fit = A.conformal_fit(X.scores(spark, d).filter("doc_id % 2 = 0"))
    return K.conformal_from_json(K.conformal_json(fit)).select("alpha", _r("q_positive"), _r("q_negative"), "n_cal_positive", "n_cal_negative")


Q["k13_conformal_json"] = k13_conformal_json


def a22_manifest_counters(spark: SparkSession, d: str) -> DataFrame:
    s = X.scores(spark, d)
    return s.groupBy(C.bucket(F.col("peak_snr_db"), C.MANIFEST_BUCKETS).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == 0).alias("negatives"))


Q["a22_manifest_counters"] = a22_manifest_counters
SQL["a22_manifest_counters"] = f"WITH {X.SCORES} SELECT CASE WHEN peak_snr_db < 5 THEN '<5' WHEN peak_snr_db < 10 THEN '5-10' WHEN peak_snr_db < 15 THEN '10-15' WHEN peak_snr_db < 20 THEN '15-20' ELSE '>20' END AS bucket, count(*) AS n, count(*) FILTER (label = 0) AS negatives FROM s GROUP BY 1"


def a24_distinct_by_class(spark: SparkSession, d: str) -> DataFrame:
    c = X.read(spark, d, "customer").join(F.broadcast(X.read(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy(F.coalesce("n_name", F.lit("Unknown")).alias("class_label")).agg(F.countDistinct("c_mktsegment").alias("n_vessels"), F.count("*").alias("n"))


Q["a24_distinct_by_class"] = a24_distinct_by_class
SQL["a24_distinct_by_class"] = "SELECT n_name AS class_label, count(DISTINCT c_mktsegment) AS n_vessels, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"


def p7_skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    e = X.read(spark, d, "events")
    reason = R.skip_reason(F.col("value"), 100.0, F.col("event_type"), ["click", "view", "purchase"], (F.col("user_id") % 3).cast("string"), ["0", "1"])
    return e.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


Q["p7_skip_reasons"] = p7_skip_reasons
SQL["p7_skip_reasons"] = "SELECT CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'quality' WHEN user_id % 3 NOT IN (0, 1) THEN 'species' WHEN value > 100 THEN 'too_long' ELSE 'kept' END AS reason, count(*) AS n FROM events GROUP BY 1"


def p10_relative_time(spark: SparkSession, d: str) -> DataFrame:
    return X.read(spark, d, "events").select("event_id", C.seconds_between(F.timestamp_seconds(F.lit(X.EPOCH)), F.col("ts").cast("timestamp")).cast("long").alias("s"))


Q["p10_relative_time"] = p10_relative_time
SQL["p10_relative_time"] = f"SELECT event_id, CAST(trunc(epoch(ts) - {X.EPOCH}) AS BIGINT) AS s FROM events"


def p8_lines_in_band(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as frequency curves; those whose mean lies in the band."""
    from tonalis.operators import tracks as T

    v = X.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 100.0).alias("curve"))
    return T.in_band(v, -1.0, 1.0, "curve").select("vec_id")


Q["p8_lines_in_band"] = p8_lines_in_band
SQL["p8_lines_in_band"] = "SELECT vec_id FROM (SELECT vec_id, avg(CAST(embedding[i] AS DOUBLE) * 100.0::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY vec_id) WHERE m BETWEEN -1 AND 1"


def s12_windows(spark: SparkSession, d: str) -> DataFrame:
    """Eight samples from a place of each vector on, zeros beyond its end."""
    v = X.read(spark, d, "embeddings").select("vec_id", R.read_window(F.col("embedding"), F.pmod("vec_id", F.lit(70)).cast("int"), 8).alias("w"))
    return v.select("vec_id", F.posexplode("w").alias("i", "x")).select("vec_id", "i", F.round(F.col("x").cast("double"), 7).alias("x"))


Q["s12_windows"] = s12_windows
SQL["s12_windows"] = "SELECT vec_id, CAST(k AS INTEGER) AS i, round(coalesce(CAST(embedding[vec_id % 70 + k + 1] AS DOUBLE), 0.0::DOUBLE), 7) AS x FROM embeddings, range(0, 8) r(k)"


def f23_rates(spark: SparkSession, d: str) -> DataFrame:
    """Patches per hour and merge tolerances over the sizes of parts; hop of an axis or of the configuration."""
    p = X.read(spark, d, "part")
    axis = F.when(F.col("p_size") % 2 == 0, F.array(F.lit(0.5), F.lit(0.5) + F.col("p_size") / 8.0)).otherwise(F.array(F.lit(0.5)))
    return p.select("p_partkey", F.lit(C.patches_per_hour(128, 4096, 32000)).alias("per_hour"), F.lit(C.merge_tolerance(2, 1.5, 10)).alias("tolerance"), F.lit(C.merge_tolerance(2, 1.5, 1)).alias("single"), C.hop_seconds(axis, 1000, 250).alias("hop_s"))


Q["f23_rates"] = f23_rates
SQL["f23_rates"] = "SELECT p_partkey, 3600.0::DOUBLE / (128 * 4096 / 32000.0::DOUBLE) AS per_hour, 6.0::DOUBLE AS tolerance, 0.0::DOUBLE AS single, CASE WHEN p_size % 2 = 0 THEN p_size / 8.0::DOUBLE ELSE 0.25::DOUBLE END AS hop_s FROM part"


def f1_windows(spark: SparkSession, d: str) -> DataFrame:
    i = X.read(spark, d, "nation").select(F.col("n_nationkey").alias("i"))
    return i.select("i", *[(F.round(C.window_value(k, F.col("i"), 25), 9) + 0.0).alias(k) for k in ("hann", "hamming", "blackman")])


Q["f1_windows"] = f1_windows
SQL["f1_windows"] = """SELECT i, round(0.5 - 0.5 * cos(2 * pi() * i / 24), 9) + 0.0::DOUBLE AS hann, round(0.54::DOUBLE - 0.46::DOUBLE * cos(2 * pi() * i / 24), 9) + 0.0::DOUBLE AS hamming, round(0.42::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * i / 24) + 0.08::DOUBLE * cos(4 * pi() * i / 24), 9) + 0.0::DOUBLE AS blackman FROM (SELECT n_nationkey AS i FROM nation)"""


def f6_scalars(spark: SparkSession, d: str) -> DataFrame:
    p = X.read(spark, d, "part").withColumn("x", F.col("p_retailprice").cast("double"))
    prob = F.col("x") / 3000.0
    return p.select(
        "p_partkey", F.round(C.binary_entropy(prob), 8).alias("entropy"), C.bucket(F.col("x") / 60.0 - 15.0).alias("bucket"),
        F.round(C.thorpe_db_per_km(F.col("x") * 10.0), 8).alias("thorpe"), F.round(C.tonal_amplitude(F.lit(0.01), F.col("x") / 100.0), 8).alias("amplitude"),
        F.round(C.harmonic_snr(F.col("x") / 100.0, F.lit(2.0), F.lit(0.5)), 8).alias("harmonic"), F.round(C.power_db(F.col("x") / 1e6), 8).alias("db"),
        F.round(C.taper_gate(F.col("p_size"), 5, 40, 8), 8).alias("gate"), C.threshold_name(F.lit(0.001), F.lit(0.5)).alias("name"),
    )


Q["f6_scalars"] = f6_scalars
SQL["f6_scalars"] = """WITH p AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS x, p_size AS i, CAST(p_retailprice AS DOUBLE) / 3000 AS q, pow(CAST(p_retailprice AS DOUBLE) / 100, 2) AS f2 FROM part)
SELECT p_partkey, round(-(q * ln(q) + (1 - q) * ln(1 - q)), 8) AS entropy, CASE WHEN x / 60 - 15 < 0 THEN '<0' WHEN x / 60 - 15 < 5 THEN '0-5' WHEN x / 60 - 15 < 8 THEN '5-8' WHEN x / 60 - 15 < 12 THEN '8-12' WHEN x / 60 - 15 < 20 THEN '12-20' ELSE '>=20' END AS bucket,
round(3.3e-3::DOUBLE + 0.11::DOUBLE * f2 / (1 + f2) + 44 * f2 / (4100 + f2) + 3e-4::DOUBLE * f2, 8) AS thorpe, round(0.01::DOUBLE * pow(10.0::DOUBLE, x / 100 / 20) * sqrt(2.0::DOUBLE), 8) AS amplitude,
round(x / 100 + 40 * log10(0.5::DOUBLE), 8) AS harmonic, round(10 * log10(x / 1e6::DOUBLE + 1e-10::DOUBLE), 8) AS db,
round(CASE WHEN i < 5 OR i >= 40 THEN 0.0::DOUBLE WHEN i >= 32 THEN 0.5::DOUBLE * (1 - cos(pi() * (40 - i) / 8)) WHEN i < 13 THEN 0.5::DOUBLE * (1 - cos(pi() * (i - 5) / 8)) ELSE 1.0::DOUBLE END, 8) AS gate, 'b0.001_c0.5' AS name FROM p"""


def f9_three_paths(spark: SparkSession, d: str) -> DataFrame:
    p = X.read(spark, d, "part").withColumn("f", F.col("p_retailprice").cast("double"))
    re, im = C.three_path_response(F.col("f"), F.lit(200.0), F.lit(5.0), F.lit(50.0), F.lit(5000.0), F.lit(6.0))
    a, b, c = C.slant_ranges(F.lit(200.0), F.lit(5.0), F.lit(50.0), F.lit(5000.0))
    return p.select("p_partkey", F.round(re, 9).alias("re"), F.round(im, 9).alias("im"), F.round(a, 6).alias("direct"), F.round(b, 6).alias("surface"), F.round(c, 6).alias("bottom"))


Q["f9_three_paths"] = f9_three_paths
SQL["f9_three_paths"] = """WITH r(r, g) AS (VALUES (sqrt(200.0::DOUBLE * 200 + 45.0::DOUBLE * 45), 1.0::DOUBLE), (sqrt(200.0::DOUBLE * 200 + 55.0::DOUBLE * 55), -1.0::DOUBLE), (sqrt(200.0::DOUBLE * 200 + 9945.0::DOUBLE * 9945), pow(10.0::DOUBLE, -0.3::DOUBLE))),
p AS (SELECT p_partkey, CAST(p_retailprice AS DOUBLE) AS f, pow(CAST(p_retailprice AS DOUBLE) / 1000, 2) AS f2 FROM part), a AS (SELECT p_partkey, f, 3.3e-3::DOUBLE + 0.11::DOUBLE * f2 / (1 + f2) + 44 * f2 / (4100 + f2) + 3e-4::DOUBLE * f2 AS al FROM p)
SELECT p_partkey, round(sum(g / r * pow(10.0::DOUBLE, -al * r / 20000) * cos(2 * pi() * f * r / 1500)), 9) AS re, round(-sum(g / r * pow(10.0::DOUBLE, -al * r / 20000) * sin(2 * pi() * f * r / 1500)), 9) AS im,
round(sqrt(200.0::DOUBLE * 200 + 45.0::DOUBLE * 45), 6) AS direct, round(sqrt(200.0::DOUBLE * 200 + 55.0::DOUBLE * 55), 6) AS surface, round(sqrt(200.0::DOUBLE * 200 + 9945.0::DOUBLE * 9945), 6) AS bottom FROM a, r GROUP BY p_partkey"""


def u1_set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Two domains in one, marked; keys in one but not the other; keys in both."""
    o, c = X.read(spark, d, "orders").select(F.col("o_custkey").alias("k")), X.read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    parts = (o.unionByName(c).distinct(), "union"), (c.join(o, "k", "left_anti"), "except"), (c.intersect(o), "intersect")
    out = [x.agg(F.count("*").alias("n")).select(F.lit(n).alias("op"), "n") for x, n in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


Q["u1_set_operations"] = u1_set_operations
SQL["u1_set_operations"] = "SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)"


def st_windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    w = L.windowed_counts(X.read(spark, d, "events"), "ts", ["event_type"], "value", "6 hours")
    return w.select(F.unix_timestamp("window_start").alias("window_s"), "event_type", "n", _r("total", 4))


Q["st_windowed_counts"] = st_windowed_counts
SQL["st_windowed_counts"] = "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS window_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def api_recordings(spark: SparkSession, d: str) -> DataFrame:
    t = X.read(spark, d, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("recording_id"), F.lit("tree").alias("dataset"), F.col("c_mktsegment").alias("class_label"))
    return R.recordings(t, "tree", "BUILDING", 50)


Q["api_recordings"] = api_recordings
SQL["api_recordings"] = "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS recording_id, 'tree' AS dataset, c_mktsegment AS class_label FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY 1 LIMIT 50"
