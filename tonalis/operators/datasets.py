"""Data sets: clips of vessels with injected sources, and patches with their targets."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonalis.operators import evaluate as E
from tonalis.operators import synth as Y
from tonalis.operators.batches import cut
from tonalis.sources import clips as W
from tonalis.sources import sinks as K


def numbered(units: DataFrame, key: str, name: str = "number") -> DataFrame:
    """Adds the position (from 0) in order of ``key``: by a sort in ranges and the counts of the ranges before. Rows that tie are numbered in any order."""
    own = cut(units.orderBy(key).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = own.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("_p", before.alias("_before"))  # a row a range
    return own.join(F.broadcast(counts), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def vessel_clips(vessels: DataFrame, n_clips: int, seed: int = 0, number: str = "number", duration: str = "duration_s", shortest_s: float = 35.0) -> DataFrame:
    """Plan of a data set: every vessel with its ``n_clips`` clips (``clip`` from 0), each with its ``seed``: seed + 1000 * number + clip. Vessels that are shorter than ``shortest_s`` or of unknown length stay in the plan, ``skipped``. Other columns pass through."""
    if not 1 <= n_clips <= 1000:
        raise ValueError(f"1 to 1000 clips a vessel, else seeds meet: {n_clips}")
    plan = vessels.withColumn("clip", F.explode(F.sequence(F.lit(0), F.lit(n_clips - 1))))
    return plan.withColumns({"seed": F.lit(seed) + 1000 * F.col(number) + F.col("clip"), "skipped": F.coalesce(F.col(duration) < shortest_s, F.lit(True))})


def inject_vessels(plan: DataFrame, ambients: DataFrame, priors: Y.TonalPriors, clip_s: float | None = None, prefix: str = "tier2") -> DataFrame:
    """Clips (as ``synth.generate`` gives them) of the plan's vessels that aren't skipped, with compound_key, vessel's ambient path and clip number beside them.

    plan: compound_key, clip, seed, skipped. ambients: compound_key, path, sample_rate_hz, samples,
    one row a vessel. A clip is the ambient's first ``clip_s`` seconds (all of it if None), with
    sources straight into it. An ambient meets its vessel's plan once; its clips, which take far longer to make
    than to move, are dealt to tasks one by one. A vessel of the plan without ambient fails; an ambient without samples gives no clip.
    """
    own = plan.filter(~F.col("skipped")).groupBy("compound_key").agg(F.collect_list(F.struct("clip", F.col("seed").cast("long").alias("seed"))).alias("_clips"))  # at most 1,000
    both = own.join(ambients.select("compound_key", "path", F.col("sample_rate_hz").cast("int").alias("sample_rate_hz"), "samples", F.lit(True).alias("_has")), "compound_key", "left")
    name = F.regexp_replace("compound_key", "/", "_")
    first = F.col("samples") if clip_s is None else F.slice("samples", F.lit(1), (F.lit(float(clip_s)) * F.col("sample_rate_hz")).cast("int"))
    both = both.withColumn("_has", F.coalesce("_has", F.raise_error(F.concat(F.lit("no ambient for "), F.col("compound_key")))))
    each = both.filter("_has").select("compound_key", "path", "sample_rate_hz", first.cast("array<float>").alias("ambient"), F.explode("_clips").alias("_c"))
    each = each.select("compound_key", "path", "sample_rate_hz", "ambient", F.col("_c.clip").alias("clip"), F.col("_c.seed").alias("seed"), F.concat_ws("_", F.lit(prefix), name, F.concat(F.lit("c"), F.lpad(F.col("_c.clip").cast("string"), 2, "0"))).alias("clip_id"))
    each = each.repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "clip_id")
    # The generator knows clips by one name; key, path and number travel in it and are taken apart again.
    tag = F.to_json(F.struct("clip_id", "compound_key", "path", "clip"))
    made = Y.generate(each.select(tag.alias("clip_id"), "seed", "sample_rate_hz", "ambient"), priors)
    said = F.from_json("clip_id", "clip_id string, compound_key string, path string, clip int")
    return made.withColumn("_s", said).select(F.col("_s.clip_id").alias("clip_id"), "_s.compound_key", "_s.path", "_s.clip", *[c for c in made.columns if c != "clip_id"])


def with_files(clips: DataFrame, lines: DataFrame, snapshot: dict, commit: str | None = None) -> DataFrame:
    """clip_id, wav, truth, audit of clips (with ``path``) and their truth lines: what ``sources.clips.write_clips`` stores."""
    truth = Y.truth_manifest(clips, lines).withColumnRenamed("manifest", "truth")
    own = K.audited(K.as_wav(clips.select("clip_id", "seed", "n_sources", "sample_rate_hz", "samples", "path", "sources")), ["clip_id", "seed"], snapshot, ["seed", "n_sources", "sample_rate_hz", "sources"], "path", commit)
    return own.join(truth, "clip_id").select("clip_id", "wav", "truth", "audit")


def build_vessel_set(vessels: DataFrame, ambients: DataFrame, path: str, n_clips: int, priors: Y.TonalPriors, n_fft: int, hop: int, sample_rate: int, seed: int = 0, clip_s: float | None = None, shortest_s: float = 35.0, commit: str | None = None) -> DataFrame:
    """Makes and stores a data set: clips with truth and audit below ``path``/clips, a row a clip below ``path``/index, and one document below ``path``/manifest, which is returned.

    vessels: compound_key, duration_s, one row a vessel. The document counts all vessels, those
    skipped too: n_vessels, n_skipped, n_clips, n_negative. An empty plan fails, as does a vessel
    without ambient; files of clips appear all together, before index and document.
    """
    plan = cut(vessel_clips(numbered(vessels, "compound_key"), n_clips, seed, shortest_s=shortest_s))
    if plan.isEmpty():
        raise ValueError("no vessels")
    clips = cut(inject_vessels(plan, ambients, priors, clip_s))
    lines = cut(Y.truth_lines(clips, n_fft, hop, sample_rate))
    said = {"n_clips_per_vessel": n_clips, "seed": seed, "clip_s": clip_s, "sample_rate_hz": sample_rate, "priors": asdict(priors)}
    W.write_clips(with_files(clips, lines, said, commit), f"{path}/clips")
    index = clip_index(clips, lines)
    index.write.mode("overwrite").json(f"{path}/index")
    of = plan.agg(F.countDistinct("compound_key").alias("n_vessels"), F.countDistinct(F.when(F.col("skipped"), F.col("compound_key"))).alias("n_skipped"))
    made = clips.agg(F.count("*").alias("n_clips"), F.count_if("negative").alias("n_negative"))
    doc = of.crossJoin(F.broadcast(made)).withColumns({"parameters": F.lit(json.dumps(said, sort_keys=True)), "built_at": F.current_timestamp()})  # one row each
    doc.write.mode("overwrite").json(f"{path}/manifest")
    return vessels.sparkSession.read.schema(doc.schema).json(f"{path}/manifest")


def clip_index(clips: DataFrame, lines: DataFrame) -> DataFrame:
    """A row a clip: clip_id, compound_key, clip, seed, n_sources, n_lines."""
    n = lines.groupBy("clip_id").agg(F.count("*").alias("n_lines"))
    return clips.select("clip_id", "compound_key", "clip", "seed", "n_sources").join(n, "clip_id", "left").withColumn("n_lines", F.coalesce("n_lines", F.lit(0)))


def patch_table(frames: DataFrame, truth: DataFrame, clip: str, patch: int = 256, stride: int = 128, target: str = "heatmap", transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """clip, f_start, t_start, patch, label, target: the cells of every patch of the grid over each gram, by frequency and then time.

    frames: clip, time_bin (from 0), power array, the gram's frames. truth: clip, frame, bin of
    the same gram. ``target`` is an array over the patch's bins (heatmap: 1 where there is truth at
    any time) or over bins and frames (mask); ``label`` is 1 if any cell holds truth. ``transform``
    takes and returns the table, as ``synth.augmented`` does. Grams that are smaller than a
    patch have none. Cells of frames that lack, or are null, are null; a frame that repeats fails.

    A frame meets the few rows of patches that hold it once, whole, and is cut into patches by
    frequency there: a group holds ``patch`` frames, however long the recording.
    """
    if target not in ("heatmap", "mask"):
        raise ValueError(f"unknown target {target!r}; one of heatmap, mask")
    size = frames.groupBy(clip).agg(F.max(F.size("power")).alias("_nf"), (F.max("time_bin") + 1).alias("_nt"))
    grid = E.patch_grid(size, clip, "_nf", "_nt", patch, stride)
    cell = lambda c: F.floor(F.col(c) / F.lit(stride)).cast("int")
    strips = E.patch_starts_in(size, clip, "_nt", patch, stride).withColumn("_c", cell("t_start"))
    reach = -(-patch // stride)
    own = frames.select(clip, "time_bin", "power").withColumn("_c", F.explode(F.sequence(cell("time_bin") - reach, cell("time_bin"))))
    w = F.col("time_bin") - F.col("t_start")
    held = own.join(strips, [clip, "_c"]).filter((w >= 0) & (w < patch))
    seq = F.sequence(F.lit(0), F.lit(patch - 1))
    rows = held.groupBy(clip, "t_start").agg(F.map_from_entries(F.collect_list(F.struct(w.cast("int").alias("w"), "power"))).alias("_m"))  # ``patch`` frames
    rows = rows.select(clip, "t_start", F.transform(seq, lambda i: F.try_element_at("_m", i)).alias("_cols"))
    cut_out = F.transform(seq, lambda h: F.transform("_cols", lambda c: F.get(c, F.col("f_start") + h).cast("double")))
    cells = grid.join(rows, [clip, "t_start"]).select(clip, "f_start", "t_start", cut_out.alias("patch"))

    hit = E.patch_mask(truth, grid, clip, patch, stride)
    per = hit.groupBy(clip, "f_start", "t_start", "h").agg(F.collect_set("w").alias("_w"))
    per = per.groupBy(clip, "f_start", "t_start").agg(F.map_from_entries(F.collect_list(F.struct("h", "_w"))).alias("_t"))  # a patch's cells at most
    there = lambda h: F.try_element_at("_t", h)
    one = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    shape = (lambda h: one(there(h).isNotNull())) if target == "heatmap" else (lambda h: F.transform(seq, lambda i: one(F.array_contains(there(h), i))))
    out = cells.join(per, [clip, "f_start", "t_start"], "left").select(clip, "f_start", "t_start", "patch", F.col("_t").isNotNull().cast("int").alias("label"), F.transform(seq, shape).alias("target"))
    return out if transform is None else transform(out)
