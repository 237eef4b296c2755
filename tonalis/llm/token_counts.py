"""Token counts: separator scan over flat, unindexed token files.

A file is a run of fixed-width ids in which an end id closes each document; nothing says where
documents begin. Blocks of a file are scanned alone: one vectorised search for the end id gives
the complete documents inside the block, the length before the first end and the length after
the last. A prefix scan over the blocks' two numbers (ends seen, tokens still open) then stitches
documents that cross blocks and numbers them: in two levels, over the per-block summaries only.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalis.llm._tokens import encoder
from tonalis.llm._util import cut, prepare, remove, shared_dir, table, with_part

#: Ids per block, and the end-of-document id of the byte-level vocabulary.
BLOCK, END = 1 << 18, 50256
#: Blocks of a file whose sums are scanned together.
GROUP = 4096


def read_blocks(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """Flat token files under ``path`` as blocks: file string, block long, ids binary. Files of any size.

    Empty files have no blocks, and of a file whose length is no multiple of ``width`` the odd
    bytes at the end say nothing. Spark only lists the files. Each block is a row of its own, whose task reads its bytes: from
    the shared file system, or from a store that ``pyarrow.fs`` opens by URI.
    """
    prepare(spark)
    step = block * width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.record_batch([pa.array([name]), pa.array([k], pa.int64()), pa.array([_bytes(name, k * step, step)], pa.binary())], names=["file", "block", "ids"])

    # Without the content column no file is opened, so none is too large.
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    blocks = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step).cast("long"))).alias("block"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(n, "path", "block").mapInArrow(read, "file string, block long, ids binary")


def _open(name: str) -> tuple[pafs.FileSystem, str]:
    if name.startswith(("file:", "/")):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", name)
    return pafs.FileSystem.from_uri(name)


def _bytes(name: str, at: int, n: int) -> bytes:
    """n bytes of the file from ``at``, fewer at its end."""
    fs, path = _open(name)
    with fs.open_input_file(path) as f:
        return f.read_at(min(n, f.size() - at), at)


def write_flat(docs: DataFrame, at: str, end_id: int = END, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Tokenize documents into flat files of 16-bit ids in the shared folder ``at``, one per partition; returns doc_id, file, doc_no.

    Each text is followed by ``end_id`` and nothing else marks it: special strings inside a text
    are read as plain text, so that no other end id gets in. A null or empty text is the end id
    alone. A task writes under a name of its own and renames, so that attempts don't mix; they
    write the same. Repeated rows are written each; an empty table writes nothing. Other
    columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, n, f, own = encoder(path, pattern), 0, None, ""
        end = np.array([end_id], "<u2").tobytes()
        fs, folder = _open(at)
        for b in batches:
            if not b.num_rows:
                continue
            name = f"{b.column(1)[0].as_py():06d}.ids"
            if f is None:
                own = f"{folder}/.{name}-{uuid.uuid4().hex}"
                f = fs.open_output_stream(own)
            for t in b.column(2).to_pylist():
                f.write(e.ordinary_ids(t or "").astype("<u2", copy=False).tobytes() + end)
            yield pa.record_batch([b.column(0), pa.array([name] * b.num_rows), pa.array(np.arange(n, n + b.num_rows))], names=["doc_id", "file", "doc_no"])
            n += b.num_rows
        if f is not None:
            f.close()
            fs.move(own, os.path.join(folder, name))

    if encoder(path, pattern).dtype.itemsize != 2:
        raise ValueError("the vocabulary doesn't fit 16 bits")
    fs, folder = _open(at)
    fs.create_dir(folder)
    own = with_part(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "part", "text")
    return cut(own.mapInArrow(run, "doc_id long, file string, doc_no long"))


def separator_scan(blocks: DataFrame, file: str = "file", end_id: int = END, width: int = 2) -> DataFrame:
    """Per document of each file: <file>, doc_no long (from 0), start long (its first id in the file), n_tokens long (with the end id), closed boolean.

    Ids after the last end of a file form a last document with ``closed`` false. Empty blocks,
    null ids, and blocks without file or number say nothing. No row of ids leaves the scan: only lengths do. A document may
    span any number of blocks; repeated documents are counted each; an empty table gives no
    rows; other columns are ignored.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    types = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_scan(np.frombuffer(x or b"", kind), end_id) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=[file, "block", "n", "ends"])

    light = cut(blocks.select(file, "block", "ids").dropna(subset=[file, "block"]).mapInArrow(run, f"{file} {types[file]}, block long, n long, ends array<long>"))
    # Prefix scan over blocks, one light row each (a block is 512 KB of ids), in two levels: within
    # runs of GROUP blocks of a file, and over the file's runs.
    zero, ends = F.lit(0).cast("long"), F.size("ends").cast("long")
    head = light.select(file, "block", "n", ends.alias("k"), F.when(ends > 0, F.element_at("ends", -1)).alias("last_end"), F.floor(F.col("block") / GROUP).alias("_g"))
    before = Window.partitionBy(file, "_g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    head = head.withColumn("_n", F.coalesce(F.sum("n").over(before), zero)).withColumn("_k", F.coalesce(F.sum("k").over(before), zero)).withColumn("_end", F.when(F.col("k") > 0, F.col("_n") + F.col("last_end") + 1))
    head = cut(head.withColumn("_open", F.max("_end").over(before)))
    runs = head.groupBy(file, "_g").agg(F.sum("n").alias("_gn"), F.sum("k").alias("_gk"), F.max("_end").alias("_ge"))
    above = Window.partitionBy(file).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"_base": F.coalesce(F.sum("_gn").over(above), zero), "_docs": F.coalesce(F.sum("_gk").over(above), zero)})
    runs = runs.withColumn("_before", F.coalesce(F.max(F.col("_base") + F.col("_ge")).over(above), zero)).select(F.col(file).alias("_f"), F.col("_g").alias("_h"), "_base", "_docs", "_before")
    head = head.join(runs, (F.col(file) == F.col("_f")) & (F.col("_g") == F.col("_h")))
    head = head.select(file, "block", "n", "k", "last_end", (F.col("_base") + F.col("_n")).alias("base"), (F.col("_docs") + F.col("_k")).alias("doc_base"), F.coalesce(F.col("_base") + F.col("_open"), "_before").alias("open_from"))
    scanned = light.drop("n").join(head.select(file, "block", "base", "doc_base", "open_from"), [file, "block"])
    k = F.size("ends")
    starts = F.concat(F.array("open_from"), F.transform(F.slice("ends", 1, F.greatest(k - 1, F.lit(0))), lambda e: e + F.col("base") + 1))
    pairs = F.transform(F.arrays_zip(F.col("ends").alias("e"), starts.alias("s")), lambda x: F.struct(x["s"].alias("s"), (F.col("base") + x["e"] + 1 - x["s"]).alias("n")))
    each = scanned.filter(k > 0).select(file, "doc_base", F.posexplode(pairs).alias("i", "x"))
    closed = each.select(file, (F.col("doc_base") + F.col("i")).alias("doc_no"), F.col("x.s").alias("start"), F.col("x.n").alias("n_tokens"), F.lit(True).alias("closed"))
    total = head.groupBy(file).agg(F.sum("k").alias("doc_no"), F.coalesce(F.max(F.when(F.col("k") > 0, F.col("base") + F.col("last_end") + 1)), zero).alias("start"), F.sum("n").alias("_n"))
    rest = total.select(file, "doc_no", "start", (F.col("_n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed")).filter("n_tokens > 0")
    return closed.unionByName(rest)


def _scan(ids: np.ndarray, end_id: int) -> tuple[int, np.ndarray]:
    return len(ids), np.flatnonzero(ids == end_id).astype(np.int64)


def op7_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as flat token files, one per partition, and those scanned; the documents' order is kept aside only to name them again.

    A null or empty text has the end id alone; rows that repeat, and those with a null doc_id, have a result each; an empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    at = f"{shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    names = write_flat(table(spark, sf_dir, "documents").select("doc_id", "text"), at)
    if not names.limit(1).count():
        return names.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "file", "doc_no", F.lit(0).cast("long").alias("start"))
    blocks = read_blocks(spark, at).withColumn("file", F.substring_index("file", "/", -1))
    found = separator_scan(blocks)
    remove(spark, at)  # the scan's lengths are in the checkpoint
    return found.join(names, ["file", "doc_no"]).select("doc_id", "n_tokens", "file", "doc_no", "start")
