"""What the operators of this subpackage share: checkpoints, keyed assignment, groups dealt in blocks."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches and make sure of a checkpoint folder.

    The cluster names the folder in ``spark.checkpoint.dir``. Where that is unset, a local master
    (as in tests) gets a temporary one; a cluster must name one, as its executors can't see a
    folder of the driver's.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: rows, order and partitions are then fixed."""
    prepare(df.sparkSession)
    return df.checkpoint()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, for tables between stages, with the scheme of its file system."""
    prepare(spark)
    return qualified(spark, spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir())


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as Spark reads it: one without a scheme is in the default file system, which need not be the machine's own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def first_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """The first row of each ``key`` in each partition, so that a key on a third of all rows goes on as one row a partition. No shuffle; a task remembers the keys of its partition."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = [df.columns.index(k) for k in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            new = []
            for k in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                new.append(k not in seen)
                seen.add(k)
            yield b.filter(pa.array(new, pa.bool_()))

    prepare(df.sparkSession)
    return df.mapInArrow(run, types)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def assign(light: DataFrame, found: DataFrame, key: list[str], part: str = "part") -> DataFrame:
    """Left join the rows of ``light`` with ``found`` (one row per key, only keys that have something to say).

    A key may hold a third of all rows. So ``found`` first goes to each partition of origin
    that has the key (one row per partition and key), then to the rows by (partition, key):
    no task gets more rows of a key than one input partition had.
    """
    at = light.groupBy(part, *key).agg(F.lit(1).alias("_one")).drop("_one")
    return light.join(at.join(found, key), [part, *key], "left")


def block_tasks(rows: DataFrame, key: list[str], ident: str, block: int, weight: str | None = None, most: int = 1, lives: str | None = None) -> DataFrame:
    """Deal the groups of ``key`` out for comparing all members of a group, in blocks.

    Groups of one are left out, and those without a row whose column ``lives`` is true. A group of more than ``block`` rows, or of more than ``most`` of
    the column ``weight``, is split into blocks by a hash of ``ident``; each pair of blocks
    (``bi`` <= ``bj``) is a task of its own, and ``b`` says which block a row is from. A task never
    gets more than about two blocks of rows. The sizes are written out first, so that the join
    with them has a shuffle on either side and Spark can split a skewed one.
    """
    heavy = F.ceil(F.sum(weight) / F.lit(most)) if weight else F.lit(1)
    alive = F.max(lives) if lives else F.lit(True)
    sizes = cut(rows.groupBy(*key).agg(F.count("*").alias("_n"), heavy.cast("int").alias("_w"), alive.alias("_l")).filter("_n > 1 and _l").drop("_l"))
    n = F.greatest(F.ceil(F.col("_n") / F.lit(block)).cast("int"), F.least(F.col("_w"), F.col("_n")).cast("int"))
    dealt = rows.join(sizes, key).withColumn("_nb", n)
    dealt = dealt.withColumn("b", F.pmod(F.xxhash64(ident), F.col("_nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    dealt = dealt.withColumn("_o", other).withColumn("bi", F.least("b", "_o")).withColumn("bj", F.greatest("b", "_o"))
    return dealt.drop("_n", "_w", "_nb", "_o")


def grouped(tasks: DataFrame, key: list[str], fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: str, order: str = "b", rows: int = 8192, size: int = 32 << 20) -> DataFrame:
    """Run ``fn`` on tables of whole groups of ``key``, many small ones at a time; it also gets where each group starts (and, last, the end).

    ``tasks`` are shuffled on ``key`` and sorted, within a group by ``order``. A table is closed
    at the first end of a group beyond ``rows`` rows or ``size`` bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= rows or sum(b.nbytes for b in held) >= size:
                    table = pa.Table.from_batches(held).combine_chunks()
                    stop = _starts(table, key)[-1]  # the last group may go on in the next batch
                    if stop:
                        whole = table.slice(0, stop)
                        yield from fn(whole, np.r_[_starts(whole, key), stop]).to_batches()
                        held = table.slice(stop).to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from fn(table, np.r_[_starts(table, key), table.num_rows]).to_batches()

    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tasks.repartition(n, *key).sortWithinPartitions(*key, order).mapInArrow(run, schema)


def _starts(table: pa.Table, key: list[str]) -> np.ndarray:
    out = np.zeros(max(0, table.num_rows - 1), bool)
    for k in key:
        v = table[k].to_numpy()
        out |= v[1:] != v[:-1]
    return np.r_[0, np.flatnonzero(out) + 1]


def pairs_within(starts: np.ndarray, b: np.ndarray, bi: np.ndarray, bj: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places p < q of all pairs of rows of one group, some 200,000 at a time.

    Rows of a group are sorted by block ``b``. If its two blocks differ, pairs are of one row of each.
    """
    n = len(b)
    end = np.repeat(starts[1:], np.diff(starts))
    first = np.repeat(starts[:-1], np.diff(starts))
    crossed = bi != bj
    left = np.add.reduceat(np.where(crossed & (b == bi), 1, 0), starts[:-1]) if n else np.zeros(0, int)
    middle = first + np.repeat(left, np.diff(starts))
    begin = np.where(crossed, middle, np.arange(n) + 1)
    count = np.where(crossed & (b != bi), 0, end - begin)
    upto = np.cumsum(count)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        c = count[at:stop]
        p = np.repeat(np.arange(at, stop), c)
        q = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(begin[at:stop], c)
        if len(p):
            yield p, q
        at = stop


def forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges node -> smallest node of its part, for the parts that the edges x, y join."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new[root]]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(n))
    return at, root[at]


LINKS = "rep long, n long, to long"


def links(rep: np.ndarray, copies: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    """LINKS of the pairs of places found: rows rep, n (copies linked with it) and rep, to (edges of a spanning forest)."""
    n, at, to = np.zeros(len(rep), np.int64), [], []
    for p, q in found:
        np.add.at(n, p, copies[q])
        np.add.at(n, q, copies[p])
        a, b = forest(len(rep), p, q)
        at.append(a)
        to.append(b)
    some = np.flatnonzero(n)
    at, to = (np.concatenate([*x, np.zeros(0, int)]).astype(int) for x in (at, to))
    return pa.table({"rep": np.r_[rep[some], rep[at]].astype(np.int64), "n": np.r_[n[some], np.zeros(len(at), np.int64)], "to": pa.array([None] * len(some) + rep[to].tolist(), pa.int64())})


def lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists of one width as rows of a matrix."""
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def with_part(df: DataFrame, name: str = "part") -> DataFrame:
    return df.withColumn(name, F.spark_partition_id())


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: With doc_id, what tells rows apart: two hashes of the text as it stands; null and empty texts differ.
ROW = ["t1", "t2"]


def row_hashes(name: str = "text") -> list[Column]:
    """ROW: rows that repeat both doc_id and text have the same, others don't."""
    return [F.xxhash64(F.col(name), F.col(name).isNull()).alias("t1"), F.xxhash64(F.lit(1), F.col(name)).alias("t2")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
