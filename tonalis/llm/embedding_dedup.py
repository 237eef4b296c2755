"""Embedding near-dedup: lattice hashing.

Unit vectors are projected at random to a few times 8 dimensions; each 8 are decoded to the
nearest point of the E8 lattice, and the lattice points together are the cell. Several tables
with projections of their own are used. A vector is stored in its cell of each table and also
looks into neighbouring cells (the next nearest lattice points, by the 240 shortest lattice
vectors). The number of vectors chooses lattices, scale and tables (``plan``), so that cells
stay small at any size with the same recall.

1. Light rows (own cells, a sketch of sign bits, no vectors) meet in the cells, dealt in pairs of
   bounded blocks. Pairs that met at home in an earlier table, or whose sketches are further
   apart than a pair at the threshold ever is, need no vectors; most rows end here.
2. The vectors follow to the cells where something is left, and the cosine in double precision
   decides. A pair counts in the first table and cell where it meets, so no table of pairs is
   made: a task returns counts of links and a spanning forest.

Equal vectors are one class from the start, aggregated before any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.llm._components import components
from tonalis.llm._util import LINKS, assign, block_tasks, cut, grouped, links, lists, pairs_within, prepare, table, with_part
from tonalis.llm._words import mixed


class Plan(NamedTuple):
    tables: int
    lattices: int
    probes: int
    scale: float


THRESHOLD, BLOCK = 0.9, 384
#: Up to so many classes of vectors. In each a pair at cosine 0.9 meets with probability 0.98 (measured in tests), and a random pair with 6e-4, 1.3e-4, 5e-5 and less than 1e-5.
PLANS = [(100_000, Plan(14, 2, 4, 1.5)), (1_000_000, Plan(33, 2, 2, 1.7)), (10_000_000, Plan(40, 3, 2, 1.3)), (None, Plan(80, 3, 2, 1.5))]
#: Sign bits of a sketch, and deviations above the mean distance of a pair at the threshold that are let through.
BITS, SPREAD = 256, 6.0
KEY = ["h1", "h2"]


def plan(n: int) -> Plan:
    return next(p for most, p in PLANS if most is None or n <= most)


def far_apart(threshold: float) -> int:
    """Differing sign bits that a pair at the threshold exceeds with a probability below 1e-8."""
    share = np.arccos(np.clip(threshold, -1.0, 1.0)) / np.pi
    return int(np.ceil(BITS * share + SPREAD * np.sqrt(BITS * share * (1 - share)))) + 1


def short_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled so that all are whole numbers."""
    out = []
    for i in range(8):
        for j in range(i + 1, 8):
            for a in (2, -2):
                for b in (2, -2):
                    v = np.zeros(8, int)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        v = np.array([1 if m >> k & 1 else -1 for k in range(8)])
        if v.prod() > 0:
            out.append(v)
    return np.stack(out)


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of y, doubled."""

    def d8(x: np.ndarray) -> np.ndarray:
        r = np.rint(x)
        odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
        if len(odd):
            d = x[odd] - r[odd]
            k = np.abs(d).argmax(axis=1)
            r[odd, k] += np.where(d[np.arange(len(odd)), k] >= 0, 1, -1)
        return r

    a, b = d8(y), d8(y - 0.5) + 0.5
    near = ((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1)
    return np.rint(2 * np.where(near[:, None], a, b)).astype(np.int64)


class Lattice:
    def __init__(self, dim: int, tables: int, lattices: int, probes: int, scale: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.tables, self.lattices, self.probes, self.scale = tables, lattices, probes, scale
        # Rows are orthonormal where the dimension allows it.
        self.project = []
        for _ in range(tables):
            g = rng.standard_normal((max(dim, 8 * lattices), 8 * lattices))
            self.project.append(np.linalg.qr(g)[0][:dim] * np.sqrt(max(dim, 8 * lattices) / 8))
        self.short = short_vectors()
        self.signs = rng.standard_normal((dim, BITS))

    def sketches(self, x: np.ndarray) -> np.ndarray:
        """Rows of BITS / 64 words: the signs of random projections."""
        return np.packbits(x @ self.signs > 0, axis=1).view(np.uint64)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """x: unit rows. Returns 32-bit hashes (rows, tables, 1 + probes): the own cell first, then neighbouring ones, nearest first. Cells of one hash are one cell."""
        out = np.empty((len(x), self.tables, 1 + self.probes), np.int32)
        for t in range(self.tables):
            y = (x @ self.project[t] * self.scale).reshape(len(x), self.lattices, 8)
            own = np.stack([decode(y[:, k]) for k in range(self.lattices)], axis=1)
            flat = ((y - own / 2).reshape(-1, 8) @ (self.short.T / 2.0)).reshape(len(x), -1)  # the nearer, the larger
            p = min(self.probes, flat.shape[1])
            best = np.argpartition(-flat, p - 1, axis=1)[:, :p] if p else np.zeros((len(x), 0), int)
            out[:, t, 0] = self._hash(own, t)
            for j in range(p):
                k, m = best[:, j] // len(self.short), best[:, j] % len(self.short)
                moved = own.copy()
                moved[np.arange(len(x)), k] += self.short[m]
                out[:, t, 1 + j] = self._hash(moved, t)
        return out

    def _hash(self, points: np.ndarray, t: int) -> np.ndarray:
        flat = points.reshape(len(points), -1).view(np.uint64)
        h = np.full(len(points), np.uint64(t + 1))
        for k in range(flat.shape[1]):
            h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + flat[:, k])
        return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision."""
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def _vectors(col: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows of the vectors that can link, by their length; those that are null, empty, zero or hold null or non-finite components are left out."""
    flat, at = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    width = np.where(col.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    for n in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == n)
        x = flat[at[rows][:, None] + np.arange(n)]
        ok = np.isfinite(x).all(axis=1) & x.any(axis=1)
        yield rows[ok], x[ok]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, layout: Plan | None = None, block: int = BLOCK) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept.

    Pairs found with cosine >= threshold are links, equal vectors and positive multiples
    included. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different lengths never link. Rows that repeat a vec_id, with the same
    vector or another, are vectors of their own and count as such; kept is true for all of them
    whose vec_id is the component's smallest. A null vec_id links like any other, but names a
    component only if all in it are null, and is then kept. An empty table gives no rows. Other
    columns are ignored. ``layout`` overrides what ``plan`` chooses for the number of vectors.
    """
    prepare(vectors.sparkSession)
    narrow = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = np.dtype("<f4" if narrow else "<f8")
    own = with_part(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if narrow else "array<double>").alias("embedding"))).select("vec_id", "part", "embedding")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.num_rows
            known, h1, h2, raw = np.zeros(size, bool), np.zeros(size, np.int64), np.zeros(size, np.int64), [None] * size
            for rows, x in _vectors(b.column(2)):
                # Multiples of a vector differ in the last bits at most: equal after rounding.
                k = np.c_[np.rint(_unit(x) * (1 << 40)).astype(np.int64), np.full(len(x), x.shape[1])].view(np.uint64)
                place = np.arange(1, k.shape[1] + 1, dtype=np.uint64)
                known[rows] = True
                h1[rows] = mixed(k ^ mixed(place)).sum(axis=1, dtype=np.uint64).view(np.int64)
                h2[rows] = mixed(mixed(k + place * np.uint64(0xC2B2AE3D27D4EB4F))).sum(axis=1, dtype=np.uint64).view(np.int64)
                for i, v in zip(rows.tolist(), x.astype(kind, copy=False), strict=True):
                    raw[i] = v.tobytes()
            yield pa.record_batch([b.column(0), b.column(1), pa.array(h1, mask=~known), pa.array(h2, mask=~known), pa.array(raw, pa.binary())], names=["vec_id", "part", *KEY, "raw"])

    printed = own.mapInArrow(prints, "vec_id long, part int, h1 long, h2 long, raw binary")
    light = cut(printed.drop("raw"))  # again below: cheaper than to keep the vectors twice
    # A class of equal vectors has a number of its own (rep): a vec_id may be null or stand for several vectors.
    grouped_rows = printed.filter("raw is not null").groupBy(*KEY).agg(F.min("vec_id").alias("lead"), F.count("*").alias("copies"), F.min("raw").alias("raw"))
    classes = cut(grouped_rows.withColumn("rep", F.monotonically_increasing_id()))
    layout = layout or plan(classes.count())
    verified = cut(_verified(classes, threshold, layout, kind, block))
    counts = verified.filter("n > 0").groupBy("rep").agg(F.sum("n").alias("others"))
    near = with_part(cut(components(verified.filter("to is not null").select(F.col("rep").alias("u"), F.col("to").alias("v"))).withColumnRenamed("id", "rep")))
    first = classes.select("rep", "lead").join(near, "rep").groupBy("component").agg(F.min("lead").alias("first"))
    firsts = assign(near, first, ["component"]).select("rep", "first")
    found = classes.select(*KEY, "rep", "lead", "copies").join(counts, "rep", "left").join(firsts, "rep", "left").filter("copies > 1 or others is not null")
    out = assign(light.filter("h1 is not null"), found, KEY)
    alone = light.filter("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    group = F.coalesce("first", "lead", "vec_id")
    return out.select("vec_id", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_links"), group.alias("component_id"), group.eqNullSafe(F.col("vec_id")).alias("kept")).unionByName(alone)


TASK = ["t", "cell", "bi", "bj"]


def _verified(classes: DataFrame, threshold: float, layout: Plan, kind: np.dtype, block: int) -> DataFrame:
    """LINKS between the classes, from tasks that each saw a part of them."""
    per, far = 1 + layout.probes, far_apart(threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        for b in batches:
            raw = b.column(1).to_pylist()
            cells, sketch = np.empty((len(raw), layout.tables * per), np.int32), np.empty((len(raw), BITS // 64), np.uint64)
            for n in {len(x) for x in raw}:
                at = [i for i, x in enumerate(raw) if len(x) == n]
                dim = n // kind.itemsize
                if dim not in made:
                    made[dim] = Lattice(dim, *layout)
                unit = _unit(np.stack([np.frombuffer(raw[i], kind) for i in at]))
                cells[at], sketch[at] = made[dim].cells(unit).reshape(len(at), -1), made[dim].sketches(unit)
            flat = lambda x, t: pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel(), t))
            homes = np.ascontiguousarray(cells[:, ::per])
            yield pa.record_batch([*b.columns, pa.array([len(x) for x in raw], pa.int32()), flat(cells, pa.int32()), flat(homes, pa.int32()), flat(sketch.view(np.int64), pa.int64())], names=["rep", "raw", "copies", "width", "cells", "homes", "sketch"])

    keyed = cut(classes.select("rep", "raw", "copies").mapInArrow(hashed, "rep long, raw binary, copies long, width int, cells array<int>, homes array<int>, sketch array<long>"))
    place = (F.floor(F.col("at") / per).cast("int").alias("t"), "cell", (F.pmod("at", F.lit(per)) == 0).alias("home"))
    spread = keyed.select("rep", F.posexplode("cells").alias("at", "cell")).select("rep", *place)
    # Only cells where one is at home and another comes matter; sketches follow for what is left.
    tasks = block_tasks(spread, ["t", "cell"], "rep", block, lives="home").join(keyed.select("rep", "homes", "sketch", "width"), "rep")

    def wanted(t: pa.Table, starts: np.ndarray) -> pa.Table:
        homes, sketch = lists(t["homes"], layout.tables), lists(t["sketch"], BITS // 64).view(np.uint64)
        at, home, width, b, bi, bj = (t[k].to_numpy() for k in ("t", "home", "width", "b", "bi", "bj"))
        some = np.zeros(t.num_rows, bool)
        before = np.arange(layout.tables)
        for p, q in pairs_within(starts, b, bi, bj):
            ok = (home[p] | home[q]) & (width[p] == width[q])
            p, q = p[ok], q[ok]
            ok = np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1, dtype=np.int64) <= far
            p, q = p[ok], q[ok]
            ok = ~((homes[p] == homes[q]) & (before < at[p][:, None])).any(axis=1)
            some[p[ok]] = some[q[ok]] = True
        return t.select([*TASK, "b", "home", "rep"]).filter(pa.array(some))

    sent = cut(grouped(tasks, TASK, wanted, "t int, cell int, bi int, bj int, b int, home boolean, rep long"))

    def compare(t: pa.Table, starts: np.ndarray) -> pa.Table:
        cells = lists(t["cells"], layout.tables * per).reshape(t.num_rows, layout.tables, per)
        at, cell, home, b, bi, bj = (t[k].to_numpy() for k in ("t", "cell", "home", "b", "bi", "bj"))
        raw = t["raw"].to_pylist()
        width = np.array([len(x) for x in raw])
        unit = np.zeros((t.num_rows, int(width.max()) // kind.itemsize))
        for i, x in enumerate(raw):
            unit[i, : len(x) // kind.itemsize] = np.frombuffer(x, kind)
        unit = _unit(unit)  # zeros at the end of shorter ones change nothing
        found = []
        for p, q in pairs_within(starts, b, bi, bj, 20_000):
            ok = (home[p] | home[q]) & (width[p] == width[q])
            p, q = p[ok], q[ok]
            ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
            p, q = p[ok], q[ok]
            ok = _first_met(cells, p, q, at, cell)
            found.append((p[ok], q[ok]))
        return links(t["rep"].to_numpy(), t["copies"].to_numpy(), found)

    return grouped(sent.join(keyed.select("rep", "raw", "copies", "cells"), "rep"), TASK, compare, LINKS)


def _first_met(cells: np.ndarray, p: np.ndarray, q: np.ndarray, at: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether a pair's table and cell are the first, by table and then by value, in which it meets."""
    a, b = cells[p], cells[q]
    at_b, at_a = (a == b[:, :, :1]).any(axis=2), (b == a[:, :, :1]).any(axis=2)  # pairs by tables
    t = (at_a | at_b).argmax(axis=1)
    rows = np.arange(len(p))
    home_a, home_b = a[rows, t, 0], b[rows, t, 0]
    first = np.where(at_a[rows, t] & at_b[rows, t], np.minimum(home_a, home_b), np.where(at_a[rows, t], home_a, home_b))
    return (t == at[p]) & (first == cell[p])


def op10_lattice_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
