"""Exact dedup: tree-merge of sorted digest runs.

Every input partition sorts its digests into runs: one record per digest, with the count and the
best document. Runs then meet in binomial rounds: partitions are nodes of a ``fan``-ary hypercube,
and in round r a record goes to the node whose r-th digit is that of its digest. A run travels as
blocks of at most ``BLOCK`` sorted records, so that Spark moves and orders blocks by their first
key, never single records. A node is one task, which merges the runs of at most ``fan`` nodes a
round in one multiway merge: what lies before the first key of the next block is complete, is folded to one
record per digest and let go, so that a task holds about ``HELD`` records, and no more than a
block of each run besides. What it lets go is sorted, and is its own run in the next round; after
the last one each digest has met all its records at one node. A digest that a third of all
documents share is one record a run from the start. Each round is rerun from shuffle files if an
executor is lost.

A record counts as the same text only if the SHA-256, a second 64-bit hash and the length of
the normalised text all agree (the verification at every level). Of equal texts the one with
the most code points stays, then the smallest identifier.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.llm._util import ROW, assign, cut, row_hashes, table, text_or_empty, with_part

#: Deleted before texts are compared: the characters of [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
KEY = ["digest", "check", "n_norm"]
#: Documents of a partition that are sorted into one run.
RUN = 200_000
#: Records of a block of a run; records that a merging task lets gather.
BLOCK, HELD = 2048, 500_000


def digests(docs: DataFrame, rows: bool = False) -> DataFrame:
    """doc_id, part, digest (binary SHA-256), check, n_norm, n_text, and with ``rows`` ROW; null text counts as empty."""
    norm = F.translate(text_or_empty(), SPACE, "")
    return with_part(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text_or_empty()).cast("long").alias("n_text"), norm.alias("norm"), *(row_hashes() if rows else []))).select(
        "doc_id", "part", *(ROW if rows else []), F.unhex(F.sha2("norm", 256)).alias("digest"), F.xxhash64("norm").alias("check"), F.length("norm").cast("long").alias("n_norm"), "n_text"
    )


def _key(t: pa.Table | pa.RecordBatch) -> pa.Array:
    """KEY as 48 bytes, which sort as one."""
    n = t.num_rows
    out = np.empty((n, 48), np.uint8)
    out[:, :32] = np.frombuffer(b"".join(t["digest"].to_pylist()), np.uint8).reshape(n, 32)
    for at, c in ((32, "check"), (40, "n_norm")):
        out[:, at : at + 8] = t[c].to_numpy().astype(">i8").view(np.uint8).reshape(n, 8)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(48), n, [None, pa.py_buffer(out.tobytes())])


def _keys(run: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(run["key"].to_pylist()), "S48")


def fold(runs: list[pa.Table]) -> pa.Table:
    """The merge of sorted runs: one record per key, with the sum of n and the best document. The stable sort finds the runs and merges them."""
    t = pa.concat_tables(runs).combine_chunks()
    key = _keys(t)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    first = np.flatnonzero(new)
    n = np.add.reduceat(t["n"].to_numpy()[order], first)
    if len(first) < len(order):
        best = [t["doc_id"].fill_null(0), t["unnamed"], t["neg_len"]]
        ties = [t[c] for c in ROW[::-1] if c in t.column_names]
        order = order[np.lexsort([*(c.to_numpy()[order] for c in (*ties, *best)), np.cumsum(new)])]
    return t.take(pa.array(order[first])).set_column(t.column_names.index("n"), "n", pa.array(n, pa.int64()))


def _to_node(key: np.ndarray, node: int, k: int, r: int, rounds: int) -> np.ndarray:
    """Where records at ``node`` go in round r: the r-th digit becomes that of the digest."""
    slot = key.view(np.uint8).reshape(-1, 48)[:, :8].copy().view(">u8").ravel() % np.uint64(k**rounds)
    return node + (slot.astype(np.int64) // k**r % k - node // k**r % k) * k**r


def _blocks(run: pa.Table, node: int, k: int, r: int, rounds: int, block: int) -> Iterator[pa.RecordBatch]:
    """A sorted run at ``node`` as rows node (where it goes in round r), first, block."""
    key = _keys(run)
    to = _to_node(key, node, k, r, rounds)
    for d in np.unique(to):
        at = np.flatnonzero(to == d)
        for x in range(0, len(at), block):
            own = run.take(pa.array(at[x : x + block])).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as out:
                out.write_table(own)
            yield pa.record_batch([pa.array([d], pa.int32()), own["key"].slice(0, 1).cast(pa.binary()).combine_chunks(), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["node", "first", "block"])


def sorted_runs(light: DataFrame, k: int, rounds: int, rows: bool = False, size: int = RUN, block: int = BLOCK) -> DataFrame:
    """Each partition's records as blocks of sorted runs: node, first, block. ``size`` bounds the documents of a run, so that a partition of any size fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def out() -> Iterator[pa.RecordBatch]:
            yield from _blocks(fold([x.drop_columns("part") for x in held]), held[0]["part"][0].as_py(), k, 0, rounds, block)

        for b in batches:
            if b.num_rows:
                own = pa.Table.from_batches([b])
                held.append(own.drop_columns(KEY).append_column("key", _key(b)))
            if sum(x.num_rows for x in held) >= size:
                yield from out()
                held = []
        if held:
            yield from out()

    own = light.select("part", *KEY, (-F.col("n_text")).alias("neg_len"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", *(ROW if rows else []), F.lit(1).cast("long").alias("n"))
    return own.mapInArrow(run, "node int, first binary, block binary")


def merge_blocks(batches: Iterator[pa.RecordBatch], held: int = HELD) -> Iterator[tuple[int, pa.Table]]:
    """(node, folded records) in ascending order, from blocks (node, first, block) in order of node and first. Runs overlap in any way."""
    node, runs, total, room = None, [], 0, held
    for b in batches:
        for to, first, data in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if runs and to != node:
                yield node, fold(runs)
                runs, total, room = [], 0, held
            elif total >= room:
                # Blocks that are yet to come begin at ``first`` or after it.
                cuts = [int(np.searchsorted(_keys(x), np.bytes_(first))) for x in runs]
                done = [x.slice(0, c) for x, c in zip(runs, cuts, strict=True) if c]
                runs = [x.slice(c) for x, c in zip(runs, cuts, strict=True) if c < x.num_rows]
                if done:
                    yield node, fold(done)
                total = sum(x.num_rows for x in runs)
                room = total + held
            node = to
            runs.append(pa.ipc.open_stream(data).read_all())
            total += runs[-1].num_rows
    if runs:
        yield node, fold(runs)


def merge_runs(light: DataFrame, n_parts: int, fan: int = 16, rows: bool = False, size: int = RUN, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """One row per digest: KEY, n, best (struct neg_len, unnamed, doc_id, and with ``rows`` ROW: the smallest stays)."""
    rounds = 1
    while fan**rounds < n_parts:
        rounds += 1
    k = max(2, round(n_parts ** (1 / rounds) + 0.499999))
    while k**rounds < n_parts:
        k += 1
    names = ["neg_len", "unnamed", "doc_id", *(ROW if rows else [])]

    def again(r: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for node, t in merge_blocks(batches, held):
                yield from _blocks(t, node, k, r, rounds, block)

        return run

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in merge_blocks(batches, held):
            raw = np.frombuffer(b"".join(t["key"].to_pylist()), np.uint8).reshape(-1, 48)
            check, n_norm = (raw[:, a : a + 8].copy().view(">i8").ravel().astype(np.int64) for a in (32, 40))
            digest = pa.array([x[:32] for x in t["key"].to_pylist()], pa.binary())
            yield from pa.table([digest, pa.array(check), pa.array(n_norm), *(t[c] for c in ("n", *names))], names=[*KEY, "n", *names]).to_batches(max_chunksize=10_000)

    runs = sorted_runs(light, k, rounds, rows, size, block)
    for r in range(rounds):
        met = runs.repartitionById(k**rounds, "node").sortWithinPartitions("node", "first")
        if r < rounds - 1:
            runs = met.mapInArrow(again(r + 1), "node int, first binary, block binary")
    schema = "digest binary, check long, n_norm long, n long, neg_len long, unnamed boolean, doc_id long" + (", t1 long, t2 long" if rows else "")
    return met.mapInArrow(last, schema).select(*KEY, "n", F.struct(*names).alias("best"))


def exact_dedup(docs: DataFrame, fan: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null and empty texts are equal to each other and to texts of white space only, and form a
    group like any other. Rows that repeat a doc_id are rows of their own: each is counted,
    and ``kept`` is true for those whose doc_id is keep_id. A null doc_id yields to any other of
    the same length; where a longer text has one, it stays, keep_id is null, and ``kept`` is true for the
    rows of the group with a null doc_id. An empty table gives no rows.
    Other columns of ``docs`` are ignored, whatever their names.
    """
    light = cut(digests(docs))
    merged = merge_runs(light, max(1, light.rdd.getNumPartitions()), fan).filter("n > 1")
    found = merged.select(*KEY, "n", F.col("best.doc_id").alias("_keep"), F.lit(True).alias("_grouped"))
    keep = F.when(F.col("_grouped"), F.col("_keep")).otherwise(F.col("doc_id"))  # the one that stays may have a null doc_id
    return assign(light, found, KEY).select(
        "doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def kept_rows(docs: DataFrame, fan: int = 16) -> DataFrame:
    """doc_id and ROW of one row of each group of equal texts, named or not; rows that repeat both doc_id and text are all listed."""
    light = cut(digests(docs, rows=True))
    merged = merge_runs(light, max(1, light.rdd.getNumPartitions()), fan, rows=True).filter("n > 1")
    out = assign(light, merged.select(*KEY, "best"), KEY)
    first = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.t1") == F.col("t1")) & (F.col("best.t2") == F.col("t2"))
    return out.filter(F.col("best").isNull() | first).select("doc_id", *ROW)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = {
    "op3_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM w"""
}
