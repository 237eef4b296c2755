"""Readers. Files are listed and opened by Spark's own file source, so any store Spark can reach will do."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.functions import columns as C
from tonalis.sources import audio

AUDIO = r"\.(wav|flac)$"
#: Names of the second layout: number, class word, vessel word, with dashes or underscores between.
FLAT_NAME = r"^(\d+)[_-]+([A-Za-z]+)[_-]+([A-Za-z0-9]+)"
#: Folder names of a sweep: seed and ratio; a fixed format.
CELL_DIR = r"unet_seed(\d+)_ratio([\d.]+)$"


def listing(files: DataFrame) -> DataFrame:
    """Files in order of path, as a report; a sort of what is listed."""
    return files.orderBy("path")


def parameters(text: str, kind: type) -> object:
    """A configuration dataclass (LofarConfig, DetectionConfig, ...) from YAML or JSON text; nested ones from nested mappings, lists for pairs. Unknown names fail."""
    try:
        import yaml

        said = yaml.safe_load(text)
    except ModuleNotFoundError:
        import json

        said = json.loads(text)
    return _configured(said or {}, kind)


def _configured(said: dict, kind: type) -> object:
    from dataclasses import fields, is_dataclass

    known = {f.name: f for f in fields(kind)}
    if bad := set(said) - set(known):
        raise ValueError(f"{kind.__name__} has no {', '.join(sorted(bad))}")
    made = {}
    for name, v in said.items():
        default = known[name].default
        made[name] = _configured(v, type(default)) if isinstance(v, dict) and is_dataclass(default) else tuple(v) if isinstance(v, list) else v
    return kind(**made)


def cached_grams(spark: SparkSession, recordings: DataFrame, path: str, make, ident: str = "recording_id", parameters: object = None, source: Sequence[str] = ()) -> DataFrame:  # noqa: ANN001
    """Frame table of the recordings from the Parquet cache at ``path``; those that it lacks are made by ``make(recordings)`` and added to it first.

    The cache is addressed by content: a folder for each value of ``parameters`` (a configuration), and in it grams
    by a digest of the recording's identifier and ``source`` columns (path, size, time, ...). Changed parameters
    or sources make grams anew; what was made before stays for those who still ask for it.
    """
    at = f"{path}/parameters={hashlib.sha256(repr(parameters).encode()).hexdigest()[:16]}"
    address = F.sha2(F.to_json(F.struct(ident, *source), {"ignoreNullFields": "false"}), 256)
    own = recordings.withColumn("source_sha256", address)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(at)
    known = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    new = own.join(spark.read.parquet(at).select("source_sha256").distinct(), "source_sha256", "left_anti") if known else own
    if not known or not new.isEmpty():
        grams = make(new.drop("source_sha256"))
        grams.join(new.select(ident, "source_sha256").distinct(), ident).write.mode("append").parquet(at)
    return spark.read.parquet(at).join(own.select("source_sha256").distinct(), "source_sha256", "left_semi").drop("source_sha256")


def audio_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of audio files below ``root`` (suffix in either case). Content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.filter(F.lower("path").rlike(AUDIO)).select("path", "content")


def _header(path: str) -> tuple[int, float, int] | tuple[None, None, None]:
    """Rate, seconds and channels of a file, of which only the headers before the samples are read."""
    try:
        with audio.opened(path) as f:
            at = audio.layout(f)
    except (audio.Unreadable, OSError, ValueError):
        return (None, None, None)
    return at.rate, at.n / at.rate, at.channels


def probe(files: DataFrame) -> DataFrame:
    """path, sample_rate_hz, duration_s, n_channels from the headers; nulls for what can't be read. Only ``path`` of ``files`` is used, so that Spark doesn't load the content; tasks read the headers from the file system."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_header(p) for p in b.column(0).to_pylist()]
            rate, dur, ch = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([b.column(0), pa.array(rate, pa.int32()), pa.array(dur, pa.float64()), pa.array(ch, pa.int32())], names=["path", "sample_rate_hz", "duration_s", "n_channels"])

    return files.select("path").mapInArrow(run, "path string, sample_rate_hz int, duration_s double, n_channels int")


def decode(files: DataFrame, target_rate: int | None = None) -> DataFrame:
    """path, sample_rate_hz, samples array<float>: mean over channels, resampled to ``target_rate`` if given. Unreadable files give no row. For files of any length see ``audio.recording_blocks``."""
    from tonalis.functions import kernels as K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    own, x = audio.decoded(raw)
                except audio.Unreadable:
                    continue
                rate = target_rate or own
                x = K.resample(x, own, rate)
                yield pa.record_batch([pa.array([path]), pa.array([rate], pa.int32()), pa.array([x], pa.list_(pa.float32()))], names=["path", "sample_rate_hz", "samples"])

    return files.select("path", "content").mapInArrow(run, "path string, sample_rate_hz int, samples array<float>")


def read_window(samples: Column, start: Column, length: int) -> Column:
    """length samples from ``start`` on, a short tail filled with zeros."""
    got = F.slice(samples, start + 1, F.lit(length))
    return F.concat(got, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(0), F.lit(length) - F.size(got))))


def class_tree(files: DataFrame, root: str, dataset: str = "tree", min_duration_s: float = 3.0) -> DataFrame:
    """Recording rows from <root>/<class>/<vessel>/<file> or, where a class has no folders, <root>/<class>/<file> with the file's stem as vessel.

    ``files`` has path and what ``probe`` gives. Unreadable and short recordings are left out.
    """
    inside = F.regexp_replace("path", "^.*?" + _quoted(root.rstrip("/")) + "/", "")
    parts = F.split(inside, "/")
    d = files.withColumn("_p", parts).withColumn("class_label", F.col("_p")[0]).withColumn("_n", F.size("_p"))
    d = d.join(d.groupBy("class_label").agg((F.max("_n") > 2).alias("_deep")), "class_label")  # a row a class
    deep = F.col("_deep")
    stem = F.regexp_replace(F.element_at("_p", -1), r"\.[^.]*$", "")
    d = d.withColumn("recording_id", stem).withColumn("vessel_id", F.when(deep & (F.col("_n") > 2), F.col("_p")[1]).otherwise(F.when(~deep, stem)))
    return d.filter((F.col("duration_s") >= min_duration_s) & (F.col("_n") > 1)).select("recording_id", "vessel_id", F.lit(dataset).alias("dataset"), "class_label", "sample_rate_hz", "duration_s", "n_channels", "path", F.lit(None).cast("string").alias("notes"))


def named_files(files: DataFrame, dataset: str = "named", min_duration_s: float = 3.0) -> DataFrame:
    """Recording rows by file name; rows whose name says nothing keep null class and vessel and a note."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    part = lambda k: F.nullif(F.regexp_extract(stem, FLAT_NAME, k), F.lit(""))
    note = F.when(~stem.rlike(FLAT_NAME), F.lit("name not recognised"))
    return files.filter(F.col("duration_s") >= min_duration_s).select(stem.alias("recording_id"), part(3).alias("vessel_id"), F.lit(dataset).alias("dataset"), part(2).alias("class_label"), "sample_rate_hz", "duration_s", "n_channels", "path", note.alias("notes"))


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "/" else c for c in s)


def file_spans(files: DataFrame) -> DataFrame:
    """path, start_ts, end_ts from names that carry a start time; others are left out."""
    stem = F.element_at(F.split("path", "/"), -1)
    d = files.withColumn("start_ts", C.name_timestamp(stem)).filter(F.col("start_ts").isNotNull())
    return d.select("path", "start_ts", C.add_seconds(F.col("start_ts"), F.col("duration_s")).alias("end_ts"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """start_ts, end_ts, low_hz, high_hz, species, quality from a positional CSV; rows that are short or have no valid times are left out; times are UTC."""
    raw = spark.read.schema("a string, b string, c string, d string, e string, f string").option("mode", "PERMISSIVE").csv(path)
    ts = lambda c: F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(c), "T", " "), r"(Z|\+00:00)$", ""))
    d = raw.select(ts("a").alias("start_ts"), ts("b").alias("end_ts"), F.col("c").try_cast("double").alias("low_hz"), F.col("d").try_cast("double").alias("high_hz"), F.trim("e").alias("species"), F.trim("f").alias("quality"))
    return d.filter("start_ts is not null and end_ts is not null and quality is not null")


def skip_reason(duration: Column, longest: float, quality: Column, qualities: list[str], species: Column, wanted: list[str]) -> Column:
    """First failing reason of an annotation, null if it is to be kept."""
    return F.when(~F.coalesce(quality.isin(*qualities), F.lit(False)), "quality").when(~F.coalesce(species.isin(*wanted), F.lit(False)), "species").when(duration > longest, "too_long")


def manifest_keys(manifest: DataFrame, partition: str) -> DataFrame:
    """Compound keys of one partition of a split manifest (arrays train_vessels, val_vessels, test_vessels), checked."""
    if partition not in ("train", "val", "test"):
        raise ValueError(f"unknown partition {partition!r}; one of train, val, test")
    key = F.explode(f"{partition}_vessels").alias("compound_key")
    d = manifest.select(key)
    cls, ident = C.split_key(F.col("compound_key"))
    return d.select("compound_key", cls.alias("class_label"), ident.alias("vessel_id"))


def partition_keys(split: DataFrame, partition: str, key: str = "compound_key") -> DataFrame:
    """The same from a split in rows (key, partition), so that no document holds all keys."""
    if partition not in ("train", "val", "test"):
        raise ValueError(f"unknown partition {partition!r}; one of train, val, test")
    cls, ident = C.split_key(F.col(key))
    return split.filter(F.col("partition") == partition).select(F.col(key).alias("compound_key"), cls.alias("class_label"), ident.alias("vessel_id"))


def resolve(keys: DataFrame, files: DataFrame, key: str = "compound_key") -> DataFrame:
    """keys with their path; fails on a key without a file."""
    d = keys.join(files.select(key, "path"), key, "left")
    return d.withColumn("path", F.coalesce("path", F.raise_error(F.concat(F.lit("no file for "), F.col(key)))))


def require_subset(keys: DataFrame, of: DataFrame, key: str = "compound_key") -> DataFrame:
    """keys semi-joined with ``of``; fails if some aren't there."""
    d = keys.join(of.select(key).distinct().withColumn("_in", F.lit(True)), key, "left")
    return d.withColumn(key, F.when(F.col("_in"), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("not in the partition: "), F.col(key))))).drop("_in")


def truth_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Truth lines of JSON manifests, one row per line with its clip."""
    line = "array<struct<line_id:string,source_id:string,harmonic_id:int,f0_hz:double,freq_curve_hz:array<double>,snr_curve_db:array<double>,mask_bin_indices:array<struct<frame:int,bin:int>>,t_start_s:double,t_end_s:double,persistence_s:double,drift_rate_hz_per_s:double>>"
    d = spark.read.schema(f"clip_id string, negative_label boolean, generator_version string, lines {line}").option("multiLine", "true").json(path)
    return d.select("clip_id", F.explode("lines").alias("l")).select("clip_id", "l.*")


def truth_samples(lines: DataFrame, clip: str = "clip_id") -> DataFrame:
    """One row per (clip, line, sample): frame, bin, freq_hz, snr_db."""
    z = F.explode(F.arrays_zip("mask_bin_indices", "freq_curve_hz", "snr_curve_db"))
    return lines.select(clip, "line_id", z.alias("z")).select(clip, "line_id", "z.mask_bin_indices.frame", "z.mask_bin_indices.bin", F.col("z.freq_curve_hz").alias("freq_hz"), F.col("z.snr_curve_db").alias("snr_db"))


def run_metadata(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """Run metadata documents; a field missing at the top is taken from ``augmentation``."""
    d = spark.read.option("multiLine", "true").schema(", ".join(f"{f} string" for f in fields) + ", augmentation map<string,string>").json(path)
    return d.select(F.col("_metadata.file_path").alias("path"), *[F.coalesce(F.col(f), F.col("augmentation")[f]).alias(f) for f in fields])


def sweep_cells(paths: DataFrame, path: str = "path") -> DataFrame:
    """seed and ratio from folder names; other folders are left out."""
    d = paths.withColumn("seed", F.nullif(F.regexp_extract(path, CELL_DIR, 1), F.lit(""))).filter("seed is not null")
    return d.withColumn("seed", F.col("seed").cast("long")).withColumn("ratio", F.regexp_extract(path, CELL_DIR, 2).cast("double"))


def recordings(table: DataFrame, dataset: str | None = None, class_label: str | None = None, limit: int = 100) -> DataFrame:
    """The listing endpoint: filters, then at most ``limit`` (1 to 1000) rows in order of identifier."""
    if not 1 <= limit <= 1000:
        raise ValueError(f"the limit must be 1 to 1000: {limit}")
    for c, v in (("dataset", dataset), ("class_label", class_label)):
        table = table if v is None else table.filter(F.col(c) == v)
    return table.orderBy("recording_id").limit(limit)



def confuser_library(spark: SparkSession, path: str) -> DataFrame:
    """Clips of a confuser library manifest: clip_id, species, path, sample_rate_hz, duration_s, low_hz, high_hz."""
    clip = "array<struct<clip_id:string,species:string,path:string,sample_rate_hz:int,duration_s:double,low_hz:double,high_hz:double>>"
    return spark.read.schema(f"species_counts map<string,int>, clips {clip}").option("multiLine", "true").json(path).select(F.explode("clips").alias("c")).select("c.*")


def siblings(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """Rows of ``left`` whose file has a sibling of the same stem in ``right`` (wav, truth, gram); others are left out."""
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*(\.json)?$", "")
    r = right.select(stem(path).alias("_stem"), F.col(path).alias("sibling"))
    return left.withColumn("_stem", stem(path)).join(r, "_stem").drop("_stem")
