"""Packing: concatenate and cut.

Two passes. The first encodes each document (ids, then the end id) and writes the ids to the
shared checkpoint, partition by partition; token totals per partition are summed to a prefix
on the driver (one number per partition), which gives every document its global offset. The
second pass cuts the global stream at multiples of the window: a document that crosses a cut
gives one piece on either side (the boundary records), so windows need no shuffle at all, and
only the very last sequence is short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.llm._tokens import encoder
from tonalis.llm._util import cut, table, with_part

WINDOW, END = 1024, 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode(docs: DataFrame, end_id: int = END, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids (binary, with the end id; little-endian unsigned, of the encoder's 16 or 32 bits). Null text counts as empty: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        end = np.array([end_id], e.dtype).tobytes()
        for b in batches:
            ids = [e.ids(t or "").tobytes() + end for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary")


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END, keep_ids: bool = False, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ``keep_ids`` also ids array<int>.

    Documents follow the order of the input's partitions and rows; each id lies in one piece;
    sequences are full but for the last, to be padded by ``window`` minus its length. A null or
    empty text is the end id alone; a very long one is cut into as many windows as it needs.
    Repeated rows and rows with a null doc_id are packed each. An empty table gives no pieces. Other columns are ignored.
    """
    kind = encoder(path, pattern).dtype
    coded = cut(with_part(encode(docs, end_id, path, pattern)))
    totals = dict(coded.groupBy("part").agg(F.sum(F.length("ids") / kind.itemsize).cast("long").alias("n")).collect())
    starts, at = {}, 0
    for p in sorted(totals):
        starts[p], at = at, at + totals[p]
    sent = coded.sparkSession.sparkContext.broadcast(starts)  # one number per partition
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = None
        for b in batches:
            if not b.num_rows:
                continue
            if pos is None:
                pos = sent.value[b.column(2)[0].as_py()]
            raw = b.column(1).to_pylist()
            n = np.array([len(x) // kind.itemsize for x in raw], np.int64)
            first = pos + np.cumsum(n) - n
            pos += int(n.sum())
            pieces = (first + n - 1) // window - first // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            begin = np.where(k == 0, first[row], (first[row] // window + k) * window)
            stop = np.minimum((begin // window + 1) * window, first[row] + n[row])
            start, length = begin - first[row], stop - begin
            wide = [np.frombuffer(x, kind).astype("<u4", copy=False) for x in raw]
            cuts = [wide[r][s : s + m] for r, s, m in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            cols = [b.column(0).take(pa.array(row)), start, length, np.array([zlib.crc32(c) for c in cuts], np.int64), n[row], begin // window, begin % window]
            if keep_ids:
                flat = np.concatenate(cuts).astype(np.int32) if cuts else np.zeros(0, np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)].astype(np.int32)), pa.array(flat)))
            yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in schema.split(", ")])

    return coded.mapInArrow(run, schema)


def op4_concat_cut_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
