"""Writers and provenance."""

from __future__ import annotations

import hashlib
import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def sha256_of(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def hash_files(df: DataFrame, keys: list[str], content: str) -> DataFrame:
    """manifest_sha256, n_files per group: digest over the sorted digests of its files, joined without a separator. That order makes a group one stream, of 64 characters a file; it is hashed as it passes and never held."""
    kinds = dict(df.dtypes)
    own = df.select(*keys, sha256_of(F.col(content)).alias("_h")).repartition(*keys).sortWithinPartitions(*keys, "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, n, done = None, hashlib.sha256(), 0, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:-1] != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest(), n))
                    now, digest, n = row[:-1], hashlib.sha256(), 0
                if row[-1] is not None:
                    digest.update(row[-1].encode())
                n += 1
        if now is not None:
            done.append((*now, digest.hexdigest(), n))
        for a in range(0, len(done), 10_000):
            cols = list(zip(*done[a : a + 10_000], strict=True))
            yield pa.record_batch([*(pa.array(c, t) for c, t in zip(cols, [*types, pa.string(), pa.int64()], strict=True))], names=[*keys, "manifest_sha256", "n_files"])

    types = to_arrow_schema(own.select(*keys).schema).types
    return own.mapInArrow(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "manifest_sha256 string, n_files long"]))


def provenance(df: DataFrame, key: list[str], snapshot: dict, source: str | None = None, commit: str | None = None) -> DataFrame:
    """Adds correlation_id (a hash of the natural key and the parameters, so that reruns agree), created_at, parameter_snapshot (JSON), and what else is known."""
    import json

    said = json.dumps(snapshot, sort_keys=True)
    return df.withColumns({"correlation_id": F.md5(F.concat_ws("/", F.lit(said), *[F.col(k).cast("string") for k in key])), "created_at": F.current_timestamp(), "parameter_snapshot": F.lit(said), "source_recording_path": F.col(source) if source else F.lit(None).cast("string"), "code_commit_hash": F.lit(commit).cast("string")})


def audited(df: DataFrame, key: list[str], snapshot: dict, own: list[str], source: str | None = None, commit: str | None = None) -> DataFrame:
    """Adds ``audit``, a JSON document of the row's provenance: timestamp, correlation_id, source_recording_path, dataset_manifest_hash, code_commit_hash and parameter_snapshot, which holds the parameters (``configuration``, JSON) and the row's ``own`` columns. Unknown fields are null."""
    p = provenance(df.select(*df.columns), key, snapshot, source, commit)
    doc = F.struct(F.col("created_at").alias("timestamp"), "correlation_id", "source_recording_path", F.lit(None).cast("string").alias("dataset_manifest_hash"), "code_commit_hash", F.struct(F.col("parameter_snapshot").alias("configuration"), *own).alias("parameter_snapshot"))
    return p.select(*df.columns, F.to_json(doc, {"ignoreNullFields": "false"}).alias("audit"))


def digest_of_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """manifest_sha256, n_files: a digest that depends on the rows but not on their order or layout.

    Two levels: the sorted digests of the rows' JSON lines, by their first four digits, give
    65,536 digests at most, and those in order give the whole.
    """
    line = df.select(sha256_of(F.to_json(F.struct(*columns))).alias("_h")).groupBy(F.substring("_h", 1, 4).alias("_b"))
    part = line.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "").cast("binary"), 256).alias("_h"), F.count("*").alias("_n"))
    both = F.transform(F.array_sort(F.collect_list(F.struct("_b", "_h"))), lambda x: x["_h"])
    return part.agg(F.sha2(F.array_join(both, "").cast("binary"), 256).alias("manifest_sha256"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_files"))


def manifest(df: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """Writes rows as JSON lines below ``path``, and the data set's digest as a table beside it (``<path>.sha256``); returns that one row."""
    df.select(*columns).write.mode("overwrite").json(path)
    digest = digest_of_rows(df.sparkSession.read.schema(df.select(*columns).schema).json(path), columns)
    digest.write.mode("overwrite").json(f"{path}.sha256")
    return df.sparkSession.read.schema("manifest_sha256 string, n_files long").json(f"{path}.sha256")


def lines_jsonl(lines: DataFrame, path: str) -> None:
    """One line per record; an empty table writes an empty data set."""
    lines.write.mode("overwrite").json(path)


def metrics_union(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Rows of both, columns in order of first appearance, missing ones null."""
    return new if old is None else old.unionByName(new, allowMissingColumns=True)


def metrics_csv(old: DataFrame | None, new: DataFrame, path: str) -> DataFrame:
    """Writes the rows of both with a header, missing values empty; returns them."""
    both = metrics_union(old, new)
    both.write.mode("overwrite").option("header", "true").csv(path)
    return both


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.clip(np.rint(np.asarray(samples) * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def as_wav(clips: DataFrame, samples: str = "samples", rate: str = "sample_rate_hz") -> DataFrame:
    """Adds ``wav``, the bytes of a 16-bit file; storing them is the caller's sink."""
    names, at_s, at_r = clips.columns, clips.columns.index(samples), clips.columns.index(rate)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in clips.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wav = [None if x is None else wav_bytes(np.array(x), r) for x, r in zip(b.column(at_s).to_pylist(), b.column(at_r).to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns, pa.array(wav, pa.binary())], names=[*names, "wav"])

    return clips.mapInArrow(run, f"{types}, wav binary")


def missing(plan: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be made: the plan without what exists (resume)."""
    return plan.join(done.select(key), key, "left_anti")


def far_table(grid: DataFrame) -> DataFrame:
    """Grid of lines per hour as a pivoted table: one row per SNR, one column per persistence."""
    return grid.groupBy("snr_db").pivot("persistence_s").agg(F.first("per_hour"))


def conformal_json(fit: DataFrame) -> DataFrame:
    """One JSON document of a calibration; alphas are keys written as text."""
    state = F.struct("q_positive", "q_negative", "n_cal_positive", "n_cal_negative")
    return fit.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("alpha").cast("string"), state))))).alias("json"))


def conformal_from_json(df: DataFrame, column: str = "json") -> DataFrame:
    kind = "map<string,struct<q_positive:double,q_negative:double,n_cal_positive:bigint,n_cal_negative:bigint>>"
    return df.select(F.explode(F.from_json(column, kind)).alias("alpha", "s")).select(F.col("alpha").cast("double").alias("alpha"), "s.*")

