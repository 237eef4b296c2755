"""Clips as files: samples, truth and audit of a clip written together, all of a job or nothing."""

from __future__ import annotations

import re
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Suffixes of the three files behind a clip's name; a fixed format.
WAV, TRUTH, AUDIT = ".wav", ".truth_manifest.json", ".wav.audit.json"
COLUMNS = {"clip_id": "string", "wav": "binary", "truth": "string", "audit": "string"}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """A file system and the path in it. Without scheme it is the local one; ``qualified`` gives the scheme that Spark would take."""
    return (pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)) if path.startswith(("file:", "/")) else pafs.FileSystem.from_uri(path)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host of the file system that Spark takes it to be on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


@dataclass
class Staged(WriterCommitMessage):
    """A task's folder and the number of clips in it."""

    folder: str
    n: int


class ClipWriter(DataSourceArrowWriter):
    """Each attempt of a task writes to a folder of its own in the job's staging folder. The commit removes
    the folders of attempts that lost and renames the staging folder: one rename makes the whole job
    visible. A job that fails removes its staging folder; only the driver makes that, so that tasks which
    still run then fail instead of leaving files. (Stores that make parents by themselves may be left
    with hidden staging files of such tasks; on object stores a rename is a copy, and not atomic.)"""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, uuid.uuid4().hex
        self.staging = f"{self.path}/_staging-{self.job}"  # a leading underscore hides it from Spark's listings

    def prepare(self) -> ClipWriter:
        fs, root = file_system(self.staging)
        fs.create_dir(root, recursive=True)
        return self

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = file_system(self.staging)
        part, seen, n = f"part-{uuid.uuid4().hex}", Counter(), 0
        fs.create_dir(f"{root}/{part}", recursive=False)
        for b in iterator:
            for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in COLUMNS), strict=True):
                if not all(row):
                    raise ValueError(f"a clip needs an identifier, samples, truth and audit: {row[0]!r}")
                again = seen[row[0]]
                seen[row[0]] += 1
                name = quote(row[0], safe="") + (f"+{again}" if again else "")
                for suffix, content in zip((WAV, TRUTH, AUDIT), row[1:], strict=True):
                    with fs.open_output_stream(f"{root}/{part}/{name}{suffix}") as f:
                        f.write(content.encode() if isinstance(content, str) else content)
                n += 1
        return Staged(part, n)

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = file_system(self.staging)
        won = {m.folder for m in messages if m is not None}
        if not won:
            return self.abort(messages)
        for found in fs.get_file_info(pafs.FileSelector(root)):
            if found.base_name not in won:
                fs.delete_dir(found.path)
        _, top = file_system(self.path)
        fs.move(root, f"{top}/job-{self.job}")
        if self.overwrite:
            for found in fs.get_file_info(pafs.FileSelector(top)):
                if found.base_name.startswith("job-") and found.base_name != f"job-{self.job}":
                    fs.delete_dir(found.path)
        return None

    def abort(self, messages: list[Staged | None]) -> None:
        fs, root = file_system(self.staging)
        for _ in range(20):  # a task that still runs may add a file while its folder goes
            try:
                if fs.get_file_info(root).type != pafs.FileType.NotFound:
                    fs.delete_dir(root)
                return
            except OSError:
                time.sleep(0.1)


class Clips(DataSource):
    """``df.write.format("clips").mode(...).save(path)`` of clip_id, wav (bytes), truth and audit (JSON); other columns are left aside."""

    @classmethod
    def name(cls) -> str:
        return "clips"

    def writer(self, schema: StructType, overwrite: bool) -> ClipWriter:
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        if bad := [c for c, kind in COLUMNS.items() if kinds.get(c) != kind]:
            raise ValueError(f"clips lack {', '.join(f'{c} {COLUMNS[c]}' for c in bad)}")
        return ClipWriter(self.options["path"], overwrite).prepare()


def write_clips(clips: DataFrame, path: str, mode: str = "append") -> None:
    """Writes ``<clip>.wav``, ``<clip>.truth_manifest.json`` and ``<clip>.wav.audit.json`` for each row, below a folder of the job in ``path``.

    A row that lacks one of them, or its identifier, fails the job, which then leaves nothing.
    Clips of one identifier are all kept: each task has its folder, and within it the second and
    later ones carry a number. With ``overwrite`` earlier jobs are removed once the new one is in
    place. Samples are not shuffled, and the driver gets one small message a task.
    """
    spark = clips.sparkSession
    spark.dataSource.register(Clips)
    clips.select(*COLUMNS).write.format("clips").mode(mode).save(qualified(spark, path))


def read_clips(spark: SparkSession, path: str) -> DataFrame:
    """clip_id and the paths wav, truth and audit of all clips that committed jobs left below ``path``; null where a file is missing. Only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    ends = "|".join(s.replace(".", r"\.") for s in (AUDIT, TRUTH, WAV))
    each = files.withColumn("_kind", F.regexp_extract("path", f"({ends})$", 1)).filter("_kind != ''").withColumn("_stem", F.regexp_replace("path", f"({ends})$", ""))
    got = each.groupBy("_stem").agg(*[F.max(F.when(F.col("_kind") == s, F.col("path"))).alias(c) for c, s in (("wav", WAV), ("truth", TRUTH), ("audit", AUDIT))])
    return got.select(F.url_decode(F.regexp_replace(F.element_at(F.split("_stem", "/"), -1), r"\+\d+$", "")).alias("clip_id"), "wav", "truth", "audit")
