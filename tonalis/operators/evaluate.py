"""Scoring of predicted lines against truth, patch windows, mask components."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.functions import columns as C
from tonalis.functions import kernels as K
from tonalis.operators.batches import cut, grouped
from tonalis.operators.components import component_lines as component_lines
from tonalis.operators.normalize import let



def line_iou_pairs(preds: DataFrame, truths: DataFrame, key: str, resolution: float, width: float = 600.0) -> DataFrame:
    """All (prediction, truth) pairs of a patch that overlap at all, with their IoU. Both have <key>, id, freq_hz, t_start, t_end.

    Lines further apart than four times the resolution have none, nor have those that don't meet
    in time, so they meet by (patch, frequency bucket, time bucket of ``width``): a prediction in its own frequency bucket, a
    truth in its own and those beside it, both in all time buckets that they touch; the pair counts in the bucket where the later one begins.
    """
    cell, time = (lambda c: F.floor(F.col(c) / F.lit(4.0 * resolution))), (lambda c: F.floor(F.col(c) / F.lit(width)))
    spread = F.explode(F.sequence(time("t_start"), F.greatest(time("t_start"), time("t_end"))))
    p = preds.dropna(subset=["freq_hz", "t_start", "t_end"]).withColumn("_f", cell("freq_hz")).withColumn("_t", spread).alias("p")
    t = truths.dropna(subset=["freq_hz", "t_start", "t_end"]).withColumn("_f", F.explode(F.sequence(cell("freq_hz") - 1, cell("freq_hz") + 1))).withColumn("_t", spread).alias("t")
    c = F.col
    iou = C.line_iou(c("p.freq_hz"), c("p.t_start"), c("p.t_end"), c("t.freq_hz"), c("t.t_start"), c("t.t_end"), resolution)
    meet = (c(f"p.{key}") == c(f"t.{key}")) & (c("p._f") == c("t._f")) & (c("p._t") == c("t._t")) & (c("p._t") == F.floor(F.greatest("p.t_start", "t.t_start") / F.lit(width)))
    return p.join(t, meet).select(c(f"p.{key}").alias(key), c("p.id").alias("pred_id"), c("t.id").alias("truth_id"), iou.alias("iou")).filter("iou > 0")


def match_lines(preds: DataFrame, truths: DataFrame, key: str, resolution: float, threshold: float = 0.1) -> DataFrame:
    """Optimal one-to-one matching per patch: rows (key, pred_id, truth_id, iou); an unmatched prediction or truth has null on the other side.

    The assignment minimises the sum of 1 - IoU; pairs under ``threshold`` are undone afterwards.
    Pairs without overlap add nothing to the optimum, so only overlapping pairs are made. A patch
    falls into parts that share no pair; a part of one pair needs no solver, and the others
    are solved each for itself. Pairs are made once.
    """
    kind = dict(preds.dtypes)[key]

    def solve(t: pa.Table, starts: np.ndarray) -> pa.Table:
        pred, truth, iou = (t[c].to_numpy() for c in ("pred_id", "truth_id", "iou"))
        rows = [a + np.array(x, int) for a, b in pairwise(starts.tolist()) for x in (_matched(pred[a:b], truth[a:b], iou[a:b]),)]
        return t.take(pa.array(np.concatenate(rows) if rows else np.zeros(0, int)))

    pairs = line_iou_pairs(preds, truths, key, resolution).withColumns({c: F.col(c).cast("long") for c in ("pred_id", "truth_id")})
    solved = grouped(pairs, [key], ["pred_id", "truth_id"], solve, f"{key} {kind}, pred_id long, truth_id long, iou double")
    good = cut(solved.filter((F.col("iou") >= threshold) & (F.col("iou") > 0)))
    none = lambda t, a: F.lit(None).cast(t).alias(a)
    loose_p = preds.select(key, F.col("id").alias("pred_id")).join(good.select(key, "pred_id"), [key, "pred_id"], "left_anti").select(key, "pred_id", none("long", "truth_id"), none("double", "iou"))
    loose_t = truths.select(key, F.col("id").alias("truth_id")).join(good.select(key, "truth_id"), [key, "truth_id"], "left_anti").select(key, none("long", "pred_id"), "truth_id", none("double", "iou"))
    return good.unionByName(loose_p).unionByName(loose_t)


def _matched(pred: np.ndarray, truth: np.ndarray, iou: np.ndarray) -> list[int]:
    """Places of the pairs of an optimal matching of one patch, part by part of the graph of pairs."""
    p, i = np.unique(pred, return_inverse=True)
    j = np.unique(truth, return_inverse=True)[1] + len(p)
    root = np.arange(j.max() + 1)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    order = np.argsort(root[i], kind="stable")
    out = []
    for at in np.split(order, np.flatnonzero(np.diff(root[i][order])) + 1):
        if len(at) == 1:
            out.append(int(at[0]))
            continue
        (a, x), (b, y) = (np.unique(v[at], return_inverse=True) for v in (i, j))
        cost, place = np.ones((len(a), len(b))), np.full((len(a), len(b)), -1)
        cost[x, y], place[x, y] = 1 - iou[at], at
        out += [int(k) for k in place[K.assign(cost)] if k >= 0]
    return sorted(out)


def bucket_table(spark: SparkSession, buckets: Sequence = C.SNR_BUCKETS) -> DataFrame:
    return spark.createDataFrame([(k, b[0], b[1]) for k, b in enumerate(buckets)], "ord int, bucket string, lo double")


def recall_by_bucket(matches: DataFrame, truths: DataFrame, key: str, snr: str = "peak_snr_db", gate_db: float = 8.0, gate: float = 0.80) -> DataFrame:
    """Every SNR bucket: tp, fn, recall; and on each row the overall tp, fp, fn, precision, recall, f1, the recall from ``gate_db`` up and whether it passes. Undefined ratios are null."""
    t = truths.select(key, F.col("id").alias("truth_id"), F.col(snr).alias("_snr")).join(matches.filter("truth_id is not null").select(key, "truth_id", F.col("pred_id").isNotNull().alias("hit")), [key, "truth_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    per = t.groupBy(C.bucket(F.col("_snr")).alias("bucket")).agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fn"))
    every = bucket_table(truths.sparkSession).join(F.broadcast(per), "bucket", "left").select("ord", "bucket", F.coalesce("tp", F.lit(0)).alias("tp"), F.coalesce("fn", F.lit(0)).alias("fn"))
    strong = F.col("_snr") >= gate_db
    tot = t.agg(F.count_if("hit").alias("all_tp"), F.count_if(~F.col("hit")).alias("all_fn"), F.try_divide(F.count_if(strong & F.col("hit")), F.count_if(strong)).cast("double").alias("gate_recall"))
    fp = matches.agg(F.count_if(F.expr("pred_id is not null and truth_id is null")).alias("all_fp"))
    tot = tot.crossJoin(F.broadcast(fp))
    ratio = lambda a, b: F.try_divide(a, b).cast("double")
    out = every.crossJoin(F.broadcast(tot)).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    out = out.withColumn("precision_all", ratio(F.col("all_tp"), F.col("all_tp") + F.col("all_fp"))).withColumn("recall_all", ratio(F.col("all_tp"), F.col("all_tp") + F.col("all_fn")))
    return out.withColumn("f1_all", ratio(2 * F.col("all_tp"), 2 * F.col("all_tp") + F.col("all_fp") + F.col("all_fn"))).withColumn("passes", F.coalesce(F.col("gate_recall") >= gate, F.lit(False)))


def patch_starts(n: Column, patch: int, stride: int) -> Column:
    """Starts 0, stride, ... that fit, and one flush with the end if some is left over; empty if nothing fits."""
    tail = n - F.lit(patch)
    return F.when(tail < 0, F.expr("cast(array() as array<int>)")).otherwise(F.array_union(F.sequence(F.lit(0), tail.cast("int"), F.lit(stride)), F.array(tail.cast("int"))))


def patch_grid(clips: DataFrame, ident: str, n_freq: str, n_time: str, patch: int, stride: int) -> DataFrame:
    """(ident, f_start, t_start) of every window of the two-dimensional grid."""
    return clips.select(ident, F.explode(patch_starts(F.col(n_freq), patch, stride)).alias("f_start"), n_time).select(ident, "f_start", F.explode(patch_starts(F.col(n_time), patch, stride)).alias("t_start"))


def patch_starts_in(clips: DataFrame, ident: str, n_time: str, patch: int, stride: int) -> DataFrame:
    """(ident, t_start): the grid's starts in time alone."""
    return clips.select(ident, F.explode(patch_starts(F.col(n_time), patch, stride)).alias("t_start"))


def _in_patches(truth: DataFrame, grid: DataFrame, clip: str, patch: int, stride: int) -> DataFrame:
    """Truth samples (clip, frame, bin, ...) by the patches that hold them. A sample lies in few patches; they meet on (clip, stride cell), not by a range condition."""
    reach = -(-patch // stride)
    cell = lambda c: F.floor(F.col(c) / F.lit(stride)).cast("int")
    spread = lambda c: F.explode(F.sequence(cell(c) - reach, cell(c)))
    s = truth.withColumn("_fc", spread("bin")).withColumn("_tc", spread("frame"))
    g = grid.withColumn("_fc", cell("f_start")).withColumn("_tc", cell("t_start"))
    return s.join(g, [clip, "_fc", "_tc"]).filter((F.col("bin") >= F.col("f_start")) & (F.col("bin") < F.col("f_start") + patch) & (F.col("frame") >= F.col("t_start")) & (F.col("frame") < F.col("t_start") + patch))


def truth_in_patches(truth: DataFrame, grid: DataFrame, clip: str, patch: int, stride: int, hop_s: float) -> DataFrame:
    """Truth samples (clip, line_id, frame, bin, freq_hz, snr_db) cut by patches: one row per (clip, f_start, t_start, line_id) with mean frequency, first and last time, peak SNR and number of samples."""
    hit = _in_patches(truth, grid, clip, patch, stride)
    return hit.groupBy(clip, "f_start", "t_start", "line_id").agg(F.avg("freq_hz").alias("freq_hz"), (F.min("frame") * hop_s).alias("t_start_s"), ((F.max("frame") + 1) * hop_s).alias("t_end_s"), F.max("snr_db").alias("peak_snr_db"), F.count("*").alias("n"))


def patch_mask(truth: DataFrame, grid: DataFrame, clip: str, patch: int, stride: int) -> DataFrame:
    """Cells (clip, f_start, t_start, h, w) of each patch that hold truth: the mask label, sparse."""
    hit = _in_patches(truth, grid, clip, patch, stride)
    return hit.select(clip, "f_start", "t_start", (F.col("bin") - F.col("f_start")).alias("h"), (F.col("frame") - F.col("t_start")).alias("w")).distinct()


def patch_heatmap(truth: DataFrame, grid: DataFrame, clip: str, patch: int, stride: int) -> DataFrame:
    """Every patch of the grid with ``heat`` array<int>: over its frequency bins, 1 where there is truth at any time."""
    rows = patch_mask(truth, grid, clip, patch, stride).groupBy(clip, "f_start", "t_start").agg(F.collect_set("h").alias("_h"))
    heat = F.transform(F.sequence(F.lit(0), F.lit(patch - 1)), lambda h: F.coalesce(F.array_contains("_h", h), F.lit(False)).cast("int"))
    return grid.join(rows, [clip, "f_start", "t_start"], "left").select(*grid.columns, heat.alias("heat"))


def patch_labels(in_patches: DataFrame, grid: DataFrame, clip: str) -> DataFrame:
    """label 1 for patches with any truth."""
    some = in_patches.select(clip, "f_start", "t_start").distinct().withColumn("label", F.lit(1))
    return grid.join(some, [clip, "f_start", "t_start"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def heatmap_lines(heat: DataFrame, key: str, class_prob: str, bins: str, first_hz: float, bin_hz: float, t0: float, t1: float, class_threshold: float = 0.5, bin_threshold: float = 0.5) -> DataFrame:
    """A line over the whole patch for each bin above ``bin_threshold`` of patches whose class probability reaches the gate."""
    return heat.filter(F.col(class_prob) >= class_threshold).select(key, F.posexplode(bins).alias("bin", "confidence")).filter(F.col("confidence") > bin_threshold).select(key, (F.lit(first_hz) + F.col("bin") * bin_hz).alias("freq_hz"), F.lit(t0).alias("t_start"), F.lit(t1).alias("t_end"), "confidence")


def _three(x: Column, pick) -> Column:  # noqa: ANN001
    """Least or largest of each element and its neighbours; beyond the ends is nothing."""
    return F.transform(x, lambda v, i: pick(v, F.coalesce(F.get(x, i - 1), v), F.coalesce(F.get(x, i + 1), v)))


def soft_skeleton(column: Column, n_iter: int = 10) -> Column:
    """Soft skeleton of a mask's column (an array along frequency, which alone is thinned): what opening takes away, of the mask and of it eroded 1, 2, ... ``n_iter`` times, joined by a soft or."""
    def left(x: Column) -> Column:
        opened = let(_three(x, F.least), lambda e: _three(e, F.greatest))
        return let(opened, lambda o: F.zip_with(x, o, lambda a, b: F.greatest(a - b, F.lit(0.0))))

    def step(acc: Column, _: Column) -> Column:
        more = lambda e, d: F.struct(e.alias("x"), F.zip_with(acc["s"], d, lambda s, v: s + F.greatest(v - s * v, F.lit(0.0))).alias("s"))
        return let(_three(acc["x"], F.least), lambda e: let(left(e), lambda d: more(e, d)))

    return let(column, lambda x: F.aggregate(F.sequence(F.lit(1), F.lit(n_iter)), F.struct(x.alias("x"), left(x).alias("s")), step)["s"]) if n_iter else let(column, left)


def centreline_dice(cells: DataFrame, keys: list[str], h: str, w: str, pred: str, target: str, n_iter: int = 10, smooth: float = 1.0) -> DataFrame:
    """keys, precision, sensitivity, loss: 1 - clDice of masks by cell. A column of a mask is one array; columns are summed up apart, so a mask may be of any length in time. Nulls count as 0."""
    z = F.struct(F.col(h).alias("h"), F.coalesce(F.col(pred).cast("double"), F.lit(0.0)).alias("p"), F.coalesce(F.col(target).cast("double"), F.lit(0.0)).alias("t"))
    columns = cells.groupBy(*keys, w).agg(F.array_sort(F.collect_list(z)).alias("_z"))
    both = columns.select(*keys, *[F.col("_z")[c].alias(c) for c in "pt"])
    both = both.withColumns({"_p": soft_skeleton(F.col("p"), n_iter), "_t": soft_skeleton(F.col("t"), n_iter)})
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    times = lambda a, b: total(F.zip_with(a, b, lambda x, y: x * y))
    sums = both.groupBy(*keys).agg(F.sum(times("_p", "t")).alias("a"), F.sum(total("_p")).alias("b"), F.sum(times("_t", "p")).alias("c"), F.sum(total("_t")).alias("d"))
    precise, sensitive = F.col("a") / (F.col("b") + smooth), F.col("c") / (F.col("d") + smooth)
    return sums.select(*keys, precise.alias("precision"), sensitive.alias("sensitivity"), (1.0 - 2.0 * precise * sensitive / (precise + sensitive + 1e-6)).alias("loss"))


def stitch(patches: DataFrame, key: str, f_start: str, t_start: str, h: str, w: str, p: str, n_freq: int, n_time: int, how: str = "max") -> DataFrame:
    """Per gram cell over all patches that cover it: the largest value, or with ``how`` "moments" the mean, the variance over patches and their number. Cells beyond the gram (padding) are cropped."""
    if how not in ("max", "moments"):
        raise ValueError(f"unknown way to stitch {how!r}; one of max, moments")
    v = F.col(p).cast("double")
    out = [F.max(p).alias(p)] if how == "max" else [F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.count("*").alias("n")]
    cell = patches.select(key, (F.col(f_start) + F.col(h)).alias("freq_bin"), (F.col(t_start) + F.col(w)).alias("time_bin"), p)
    return cell.filter((F.col("freq_bin") < n_freq) & (F.col("time_bin") < n_time)).groupBy(key, "freq_bin", "time_bin").agg(*out)


def reflect_pad(cells: DataFrame, keys: list[str], freq: str, time: str, n_freq: int, n_time: int, patch: int) -> DataFrame:
    """Cells of a gram of n_freq by n_time, and the reflected ones that fill it up to ``patch`` on either axis where it is smaller (the edge itself isn't repeated)."""
    out = cells
    for c, n in ((freq, n_freq), (time, n_time)):
        if n < patch:
            places = F.filter(F.sequence(F.lit(0), F.lit(patch - 1)), lambda i: C.reflected(i, n) == F.col(c))  # noqa: B023
            out = out.withColumn(c, F.explode(places))
    return out.select(*keys, freq, time, *[c for c in cells.columns if c not in (*keys, freq, time)])


def seed_aggregate(runs: DataFrame, keys: list[str], seed: str, metric: str) -> DataFrame:
    """Mean and sample deviation (0 for a single seed) over seeds, with the seeds' values."""
    return runs.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(seed, metric))).alias("per_seed"))


def winner(agg: DataFrame, keys: list[str]) -> DataFrame:
    """The best mean, and how many other rows come within one deviation of it."""
    best = agg.agg(F.max_by(F.struct(*keys, "mean", "std"), "mean").alias("b"))
    rival = (F.col("mean") + F.col("std") >= F.col("b.mean") - F.col("b.std")) & ~F.struct(*keys).eqNullSafe(F.struct(*[F.col(f"b.{k}").alias(k) for k in keys]))
    return agg.crossJoin(F.broadcast(best)).groupBy("b").agg(F.count_if(rival).alias("n_rivals")).select(*[F.col(f"b.{k}").alias(k) for k in keys], F.col("b.mean").alias("mean"), F.col("b.std").alias("std"), "n_rivals")
