"""Calibration of scores: reliability bins, conformal sets, ensemble statistics. Native aggregates throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalis.functions import columns as C


def _edges(n_bins: int) -> list[float]:
    """Edges as numpy.linspace(0, 1, n + 1) has them: i * (1 / n), the last exactly 1."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_of(score: Column, n_bins: int = 10) -> Column:
    """Index of the reliability bin, [lo, hi) but the last closed; null outside [0, 1]. Compared with the edges themselves, not by multiplication."""
    e = _edges(n_bins)
    out = F.when((score < e[0]) | (score > e[-1]) | F.isnan(score), F.lit(None))
    for k in range(n_bins - 1):
        out = out.when(score < F.lit(e[k + 1]), k)
    return out.otherwise(n_bins - 1).cast("int")


def bins_table(spark: SparkSession, n_bins: int) -> DataFrame:
    e = _edges(n_bins)
    return spark.createDataFrame([(k, e[k], e[k + 1]) for k in range(n_bins)], "bin int, lo double, hi double")


def reliability_bins(scores: DataFrame, score: str = "confidence", label: str = "label", n_bins: int = 10) -> DataFrame:
    """All bins (empty ones with nulls): bin, lo, hi, n, mean_score, positive_rate, share (of all rows, also those in no bin)."""
    got = scores.groupBy(bin_of(F.col(score), n_bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_rate"))
    total = scores.agg(F.count("*").alias("_n"))
    out = bins_table(scores.sparkSession, n_bins).join(got, "bin", "left").crossJoin(F.broadcast(total))  # one row
    return out.select("bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "positive_rate", F.try_divide(F.coalesce("n", F.lit(0)), F.col("_n")).alias("share"))


def reliability_summary(bins: DataFrame) -> DataFrame:
    """From ``reliability_bins``: ece, overconfidence (share of bins in use whose score exceeds the rate), n_used."""
    gap = F.abs(F.col("mean_score") - F.col("positive_rate"))
    return bins.agg(
        F.coalesce(F.sum(F.col("share") * gap), F.lit(0.0)).alias("ece"),
        F.try_divide(F.count_if(F.col("mean_score") > F.col("positive_rate")), F.count_if(F.col("n") > 0)).alias("overconfidence"),
        F.count_if(F.col("n") > 0).alias("n_used"),
    )


def ece_by_bucket(scores: DataFrame, score: str = "confidence", label: str = "label", snr: str = "peak_snr_db", buckets: Sequence = C.SNR_BUCKETS, n_bins: int = 10, least: int = 10) -> DataFrame:
    """Per SNR bucket with rows: n, ece, stable (n >= least). Rows without SNR (null or NaN) are left out."""
    b = C.bucket(F.col(snr), buckets)
    per = scores.filter(F.col(snr).isNotNull() & ~F.isnan(snr)).groupBy(b.alias("bucket"), bin_of(F.col(score), n_bins).alias("_bin")).agg(F.count("*").alias("_n"), F.avg(score).alias("_p"), F.avg(F.col(label).cast("double")).alias("_y"))
    gap = F.when(F.col("_bin").isNotNull(), F.col("_n") * F.abs(F.col("_p") - F.col("_y"))).otherwise(0.0)
    return per.groupBy("bucket").agg(F.sum("_n").alias("n"), (F.sum(gap) / F.sum("_n")).alias("ece"), (F.sum("_n") >= least).alias("stable"))


def quantile_level(n: Column, alpha: Column) -> Column:
    return F.least(F.ceil((n + 1) * (F.lit(1.0) - alpha)) / n, F.lit(1.0))


def conformal_fit(scores: DataFrame, alphas: Sequence[float] = (0.05, 0.10, 0.20), score: str = "confidence", label: str = "label") -> DataFrame:
    """alpha, q_positive, q_negative, n_cal_positive, n_cal_negative.

    Nonconformity is 1 - score for positives and score for negatives; the corrected quantile
    interpolates between the two order statistics around level * (n - 1), found by rank: no
    scores are gathered. Ranks come from counts of 4,096 cells a class, and only the scores of one
    cell are sorted together. A class without rows gives nulls (``require_fit`` raises).
    """
    spark = scores.sparkSession
    grid = spark.createDataFrame([(float(a),) for a in sorted(set(alphas))], "alpha double")
    s = scores.select((F.col(label) == 1).alias("pos"), F.when(F.col(label) == 1, 1.0 - F.col(score)).otherwise(F.col(score)).alias("s"))
    # Ranks by counting: distinct scores are aggregated first, so that ties cost one row.
    cell = F.when(F.isnan("s") | (F.col("s") > 1), 4096).otherwise(F.floor(F.greatest(F.col("s"), F.lit(0.0)) * 4096)).cast("int")
    distinct = s.groupBy("pos", "s").agg(F.count("*").alias("m")).withColumn("cell", cell)
    counts = distinct.groupBy("pos", "cell").agg(F.sum("m").alias("c"))
    counts = counts.withColumn("before", F.sum("c").over(Window.partitionBy("pos").orderBy("cell")) - F.col("c")).drop("c")  # at most 4,097 cells a class
    w = Window.partitionBy("pos", "cell").orderBy("s")
    ranked = distinct.join(counts, ["pos", "cell"]).withColumn("hi", F.col("before") + F.sum("m").over(w)).withColumn("lo", F.col("hi") - F.col("m"))
    n = s.groupBy("pos").agg(F.count("*").alias("n"))
    want = n.crossJoin(F.broadcast(grid))  # two rows by the grid
    at = quantile_level(F.col("n").cast("double"), F.col("alpha")) * (F.col("n") - 1)
    want = want.withColumn("at", at).withColumn("k", F.floor("at")).withColumn("k2", F.least(F.col("k") + 1, F.col("n") - 1))
    hit = ranked.join(F.broadcast(want), "pos").filter("(k >= lo and k < hi) or (k2 >= lo and k2 < hi)")
    low, high = F.max(F.when(F.expr("k >= lo and k < hi"), F.col("s"))), F.max(F.when(F.expr("k2 >= lo and k2 < hi"), F.col("s")))
    q = hit.groupBy("pos", "alpha", "n").agg((low + (F.first("at") - F.first("k")) * (high - low)).alias("q"))
    return q.groupBy("alpha").agg(*[F.max(F.when(F.col("pos") == p, F.col(c))).alias(a) for p, c, a in ((True, "q", "q_positive"), (False, "q", "q_negative"), (True, "n", "n_cal_positive"), (False, "n", "n_cal_negative"))])


def require_fit(fit: DataFrame) -> DataFrame:
    """Fails where a class had no rows."""
    bad = F.raise_error(F.lit("calibration needs rows of both classes"))
    return fit.withColumn("q_positive", F.coalesce("q_positive", bad)).withColumn("q_negative", F.coalesce("q_negative", bad))


def prediction_sets(scores: DataFrame, fit: DataFrame, score: str = "confidence") -> DataFrame:
    """scores by alpha: in_positive, in_negative, set_size, verdict. ``fit`` has one row per alpha and is broadcast."""
    p, n = 1.0 - F.col(score) <= F.col("q_positive"), F.col(score) <= F.col("q_negative")
    out = scores.crossJoin(F.broadcast(fit.select("alpha", "q_positive", "q_negative"))).withColumn("in_positive", p).withColumn("in_negative", n)
    verdict = F.when(F.expr("in_positive and in_negative"), "uncertain").when(F.col("in_positive"), "detected").when(F.col("in_negative"), "not_detected").otherwise("empty")
    return out.withColumn("set_size", F.col("in_positive").cast("int") + F.col("in_negative").cast("int")).withColumn("verdict", verdict)


def empirical_coverage(sets: DataFrame, fit: DataFrame, label: str = "label") -> DataFrame:
    """Per alpha: n, coverage overall and by class, mean set size, fractions of singletons, uncertain and empty sets, 1/sqrt(n_cal) heuristics."""
    covered = F.when(F.col(label) == 1, F.col("in_positive")).otherwise(F.col("in_negative")).cast("double")
    per = sets.groupBy("alpha").agg(
        F.count("*").alias("n"), F.avg(covered).alias("coverage"),
        F.avg(F.when(F.col(label) == 1, covered)).alias("coverage_positive"), F.avg(F.when(F.col(label) == 0, covered)).alias("coverage_negative"),
        F.avg("set_size").alias("mean_set_size"),
        *[F.avg((F.col("set_size") == k).cast("double")).alias(a) for k, a in ((1, "singleton"), (2, "uncertain"), (0, "empty"))],
    )
    bounds = fit.select("alpha", (1.0 / F.sqrt("n_cal_positive")).alias("bound_positive"), (1.0 / F.sqrt("n_cal_negative")).alias("bound_negative"))
    return per.join(F.broadcast(bounds), "alpha")


def far_projection(sets: DataFrame, per_hour: float, n_beams: int = 180, label: str = "label") -> DataFrame:
    """Per alpha: share of negatives called detected, false alarms per beam-hour and per hour over all beams."""
    neg = F.col(label) == 0
    p = F.try_divide(F.count_if(neg & (F.col("verdict") == "detected")), F.count_if(neg)).cast("double")
    return sets.groupBy("alpha").agg(F.count_if(neg).alias("n_negative"), p.alias("p_false")).withColumn("per_beam_hour", F.col("p_false") * per_hour).withColumn("per_hour", F.col("p_false") * per_hour * n_beams)


def set_size_by_bucket(sets: DataFrame, snr: str = "peak_snr_db", alpha: float = 0.10, buckets: Sequence = C.SNR_BUCKETS) -> DataFrame:
    """Composition of sets per SNR bucket at one alpha; buckets without rows are left out."""
    own = sets.filter((F.col("alpha") == alpha) & F.col(snr).isNotNull())
    return own.groupBy(C.bucket(F.col(snr), buckets).alias("bucket")).agg(F.count("*").alias("n"), *[F.avg((F.col("set_size") == k).cast("double")).alias(a) for k, a in ((1, "singleton"), (2, "uncertain"), (0, "empty"))])


def pixel_statistics(masks: DataFrame, p: str = "p") -> DataFrame:
    """masks: patch_id, member, h, w, p. Per pixel: mean, entropy of the mean, mutual information, variance over members, n_members."""
    mean = F.avg(F.col(p).cast("double"))
    out = masks.groupBy("patch_id", "h", "w").agg(mean.alias("mean_p"), F.avg(C.binary_entropy(F.col(p))).alias("_inner"), F.var_pop(F.col(p).cast("double")).alias("variance"), F.count("*").alias("n_members"))
    out = out.withColumn("entropy", C.binary_entropy(F.col("mean_p"))).withColumn("mutual_information", F.greatest(F.lit(0.0), F.col("entropy") - F.col("_inner")))
    return out.drop("_inner")


def max_disagreement(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("patch_id").agg(F.max("variance").alias("max_disagreement"))


def patch_confidence(masks: DataFrame, method: str = "max_mean", p: str = "p") -> DataFrame:
    """patch_id, confidence. max_mean: largest pixel of the member mean; mean_max: mean of the members' largest pixels; peak_freq_band: largest over frequency (h) of the member mean, averaged over time (w)."""
    v = F.col(p).cast("double")
    if method == "max_mean":
        return masks.groupBy("patch_id", "h", "w").agg(F.avg(v).alias("m")).groupBy("patch_id").agg(F.max("m").alias("confidence"))
    if method == "mean_max":
        return masks.groupBy("patch_id", "member").agg(F.max(v).alias("m")).groupBy("patch_id").agg(F.avg("m").alias("confidence"))
    if method == "peak_freq_band":
        return masks.groupBy("patch_id", "h", "w").agg(F.avg(v).alias("m")).groupBy("patch_id", "w").agg(F.max("m").alias("m")).groupBy("patch_id").agg(F.avg("m").alias("confidence"))
    raise ValueError(f"unknown method {method!r}; one of max_mean, mean_max, peak_freq_band")


def ensemble_diversity(masks: DataFrame, p: str = "p", homogeneous: float = 0.95) -> DataFrame:
    """Cosine similarity of each pair of members over all pixels: the mean, median, min, max, and whether the mean exceeds ``homogeneous``.

    Each pixel's member values are one row (members are few), so that all pair products come
    from one aggregation; a zero norm counts as 1.
    """
    pixel = masks.groupBy("patch_id", "h", "w").agg(F.map_from_entries(F.collect_list(F.struct("member", F.col(p).cast("double")))).alias("v"))  # as many as members
    pairs = pixel.select(F.explode("v").alias("a", "x"), "v").select("a", "x", F.explode("v").alias("b", "y")).filter("a < b")
    sums = pairs.groupBy("a", "b").agg(F.sum(F.expr("x * y")).alias("xy"), F.sum(F.expr("x * x")).alias("xx"), F.sum(F.expr("y * y")).alias("yy"))
    norm = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.sqrt(c))
    cos = sums.select((F.col("xy") / (norm("xx") * norm("yy"))).alias("c"))
    return cos.agg(F.avg("c").alias("mean_cosine"), F.percentile("c", 0.5).alias("median_cosine"), F.min("c").alias("min_cosine"), F.max("c").alias("max_cosine"), (F.avg("c") > homogeneous).alias("homogeneous"), F.count("*").alias("n_pairs"))
