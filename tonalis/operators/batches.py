"""Groups handed to kernels many at a time: one Arrow call for thousands of small groups, not one each. Cuts of lineage."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Rows, or bytes, from which a batch of whole groups goes to the kernel.
ROWS, BYTES = 16_384, 8 << 20


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there.

    The cluster names the folder in ``spark.checkpoint.dir``; where that is unset, a local master (as in tests)
    gets a temporary one, and a cluster must name one.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of ``keys`` begin in a sorted table, and its end; null is a value like any other."""
    n = table.num_rows
    new = np.zeros(max(0, n - 1), bool)
    for k in keys:
        c = table[k].combine_chunks()
        a, b = c.slice(1), c.slice(0, max(0, n - 1))
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(False) | pc.not_equal(a.is_null(), b.is_null()).to_numpy(False)
    return np.r_[0, np.flatnonzero(new) + 1, n] if n else np.zeros(1, int)


def grouped(rows: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, most: int = ROWS) -> DataFrame:
    """``fn`` of tables of whole groups, sorted within by ``order``; it also gets ``starts`` of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = size = 0
        times = 1  # of the limits, for a group that goes beyond them
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n, size = n + b.num_rows, size + b.nbytes
            if n >= most * times or size >= BYTES * times:
                t = pa.Table.from_batches(held).combine_chunks()
                stop = int(starts(t, keys)[-2])  # the last group may go on in the next batch
                if stop:
                    whole = t.slice(0, stop)
                    yield from fn(whole, starts(whole, keys)).to_batches()
                held = t.slice(stop).to_batches()
                n, size = n - stop, sum(x.nbytes for x in held)
                times = 1 if stop else 2 * times
        if n:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from fn(t, starts(t, keys)).to_batches()

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES // 2))  # rows may be long arrays
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
