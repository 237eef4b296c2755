"""Centroid clustering over space-filling-curve zone maps.

Vectors are put in the order of a Hilbert curve through their ``AXES`` principal axes and cut into
blocks of neighbours, each with the box (least and largest component) of its vectors. That table is
written once. A round tests each box against the centroids: a centroid goes for the whole block
if the difference of its squared distance and that of the centroid nearest to the box's middle is
positive all over the box. The difference is linear, so its least value over the box is exact. What is left is
compared with each vector, exactly, in one matrix product for each centroid. How many centroids a
box leaves depends on the data: one or two where clusters are apart, nearly all where vectors lie
about as far from every centroid, as in the test tables; the result is the same.

A round shuffles one row of sums for each task and cluster; centroids, k vectors, are all that
the driver holds. The scatter matrix that gives the axes is one row for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalis.llm._util import cut, prepare, table

DIM, K, ROUNDS, SCALE = 64, 16, 3, 64
#: Vectors of a block; axes and bits of the curve (AXES * BITS <= 62).
BLOCK, AXES, BITS = 128, 10, 6
#: Components beyond are counted as this, so that a squared distance fits a long.
LIMIT = 2**27
#: Below this size products of two components, summed over DIM, are exact in doubles.
_EXACT = 2**22


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of points with components in [0, 2**bits): rows of x (columns * bits <= 62)."""
    x = x.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations and reflections of each level, from the coarsest
        p = q - 1
        for i in range(n):
            turned = (x[i] & q) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(turned, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b) & 1
    return out


def whole_vectors(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id, v (binary: int32 components floor(scale * x)) of vectors with ``dim`` components, none null, NaN or infinite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            with np.errstate(over="ignore"):
                v = np.clip(np.floor(scale * at), -LIMIT, LIMIT).astype("<i4")
            yield pa.record_batch([b.column(0), pa.array([r.tobytes() for r in v], pa.binary())], names=["vec_id", "v"])

    prepare(vectors.sparkSession)
    x = F.col("embedding")
    fine = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.filter(F.coalesce(fine, F.lit(False))).mapInArrow(run, "vec_id long, v binary")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def first_centroids(own: DataFrame, k: int, dim: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of "1:<vec_id>"; those without vec_id last, ties by the components."""
    # k rows, whatever the table.
    rows = own.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.frombuffer(b"".join(bytes(r.v) for r in rows), "<i4").reshape(-1, dim).astype(np.int64)


def axes(own: DataFrame, dim: int, n_axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes (columns, divided so that components are some -1 to 1) of all vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            v = _matrix(b.column(1), dim).astype(float)
            n, s, q = n + len(v), s + v.sum(axis=0), q + v.T @ v
        if n:
            yield pa.record_batch([pa.array([float(n)]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], names=["n", "s", "q"])

    # Tasks' sums are added up by place in the matrix: dim * (dim + 1) + 1 rows come to the driver.
    flat = own.mapInArrow(run, "n double, s array<double>, q array<double>").select(F.posexplode(F.concat(F.array("n"), "s", "q")).alias("i", "x"))
    got = flat.groupBy("i").agg(F.sum("x").alias("x")).toArrow()
    out = np.zeros(1 + dim + dim * dim)
    out[got["i"].to_numpy()] = got["x"].to_numpy()
    n, mean = max(out[0], 1), out[1 : dim + 1] / max(out[0], 1)
    spread, turn = np.linalg.eigh(out[dim + 1 :].reshape(dim, dim) / n - np.outer(mean, mean))
    best = np.argsort(-spread)[:n_axes]
    return mean, turn[:, best] / (2.5 * np.sqrt(np.maximum(spread[best], 1e-9)))


def zone_maps(own: DataFrame, dim: int = DIM, block: int = BLOCK, n_axes: int = AXES, bits: int = BITS) -> DataFrame:
    """Blocks of at most ``block`` neighbours on the curve: ids, v (their components one after the other), lo, hi (the box)."""
    mean, turn = axes(own, dim, min(n_axes, dim))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (_matrix(b.column(1), dim) - mean) @ turn
            cell = np.clip(np.floor((at + 1) * 2 ** (bits - 1)), 0, 2**bits - 1)
            yield pa.record_batch([*b.columns, pa.array(hilbert(cell, bits), pa.int64())], names=["vec_id", "v", "h"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []

        def out(t: pa.Table) -> pa.RecordBatch:
            t = t.combine_chunks()
            ids, raw = t["vec_id"].to_pylist(), t["v"].to_pylist()
            at = range(0, len(ids), block)
            boxes = [np.frombuffer(b"".join(raw[a : a + block]), "<i4").reshape(-1, dim) for a in at]
            return pa.record_batch(
                [pa.array([ids[a : a + block] for a in at], pa.list_(pa.int64())), *(pa.array([f(x).tobytes() for x in boxes], pa.binary()) for f in (np.array, lambda x: x.min(axis=0), lambda x: x.max(axis=0)))],
                names=["ids", "v", "lo", "hi"],
            )

        for b in batches:
            held.append(b)
            n = sum(x.num_rows for x in held)
            if n >= block:
                t = pa.Table.from_batches(held)
                yield out(t.slice(0, n // block * block))
                held = t.slice(n // block * block).to_batches()
        if sum(x.num_rows for x in held):
            yield out(pa.Table.from_batches(held))

    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Copies of one vector share a place on the curve: the second column lets ranges part them.
    placed = cut(own.mapInArrow(place, "vec_id long, v binary, h long").withColumn("_t", F.monotonically_increasing_id()))
    return cut(placed.repartitionByRange(n, "h", "_t").sortWithinPartitions("h", "_t").select("vec_id", "v").mapInArrow(blocks, "ids array<long>, v binary, lo binary, hi binary"))


def candidates(lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Blocks by centroids: whether the centroid can be the nearest one of a vector in the box, ties included."""
    middle = (lo + hi) / 2
    near = (((middle[:, None, :] - c[None]) ** 2).sum(axis=2)).argmin(axis=1)
    # |x - c|^2 - |x - c_near|^2 = 2 x (c_near - c) + |c|^2 - |c_near|^2: least where x is at the corner that the signs choose
    size = (c * c).sum(axis=1)
    out = np.zeros((len(lo), len(c)), bool)
    for j in range(len(c)):
        step = c[near] - c[j]
        least = 2 * np.where(step > 0, lo * step, hi * step).sum(axis=1) + size[j] - size[near]
        out[:, j] = least <= 0
    return out


def nearest(v: np.ndarray, of: np.ndarray, may: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each vector's nearest centroid (the smaller of equals). ``of``: the block of each vector; ``may``: blocks by centroids."""
    best, at = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64)
    exact = max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) < _EXACT
    own, f = (v * v).sum(axis=1), v.astype(float)
    for j in range(len(c)):
        rows = np.flatnonzero(may[of, j])
        if exact:
            d = own[rows] - 2 * (f[rows] @ c[j].astype(float)).astype(np.int64) + (c[j] * c[j]).sum()
        else:
            d = ((v[rows] - c[j]) ** 2).sum(axis=1)
        closer = d < best[rows]
        best[rows[closer]], at[rows[closer]] = d[closer], j
    return at, best


def _assigned(batch: pa.RecordBatch, c: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    v = _matrix(batch.column(1), dim)
    of = np.repeat(np.arange(batch.num_rows), [len(x) // (4 * dim) for x in batch.column(1).to_pylist()])
    may = candidates(_matrix(batch.column(2), dim), _matrix(batch.column(3), dim), c)
    return v, *nearest(v, of, may, c), int(may.sum())


def next_centroids(maps: DataFrame, c: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each cluster's vectors; one without vectors stays."""
    k, dim = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            v, at, _, _ = _assigned(b, c, dim)
            n += np.bincount(at, minlength=k)
            for j in range(k):
                s[j] += v[at == j].sum(axis=0)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(np.column_stack([n, s])[some].tolist(), pa.list_(pa.int64()))], names=["k", "x"])

    sums = maps.mapInArrow(run, "k int, x array<long>").select("k", F.posexplode("x").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x")).toArrow()  # k * (dim + 1) rows
    x = np.zeros((k, dim + 1), np.int64)
    x[sums["k"].to_numpy(), sums["i"].to_numpy()] = sums["x"].to_numpy()
    return np.where(x[:, :1] > 0, x[:, 1:] // np.maximum(x[:, :1], 1), c)


def centroid_clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, have another number of components than ``dim``, or hold a null, NaN
    or infinite one, are left out. Fewer than k vectors give as many centroids. Rows that repeat are vectors
    of their own; those with a null vec_id are clustered too, and begin as centroids only where
    others are too few. Equal distances go to the centroid with the smaller number. Components
    floor(scale * x) beyond +-2**27 count as that, and inertia beyond a long as the largest long.
    An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    own = whole_vectors(vectors, dim, scale)
    maps, c = zone_maps(own, dim, block), first_centroids(own, k, dim)
    for _ in range(rounds if len(c) else 0):
        c = next_centroids(maps, c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, at, d, _ = _assigned(b, c, dim)
            yield pa.record_batch([b.column(0).flatten(), pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    found = cut(maps.mapInArrow(run, "vec_id long, cluster int, distance long"))
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    each = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)").alias("_i"))  # at most k rows
    each = each.withColumn("_all", F.sum("_i").over(Window.partitionBy(F.lit(0))).cast("decimal(38,0)"))
    digest = F.create_map(*[F.lit(x) for j, row in enumerate(c) for x in (j, hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest())]) if len(c) else F.lit(None).cast("map<int,string>")
    each = each.select("cluster", F.least("_i", most).cast("long").alias("cluster_inertia"), F.least("_all", most).cast("long").alias("inertia"), digest[F.col("cluster")].alias("centroid_sha256"))
    return found.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_zone_map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _sql() -> str:
    parts = [
        f"""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {K}))",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} AS (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance FROM v, c{r})")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, arg_min(k, (distance, k)) AS k, min(distance) AS distance FROM d{r} GROUP BY vec_id, v)")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, {DIM + 1})) AS i FROM a{r}) GROUP BY k, i)")
            parts.append(f"m{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{r} GROUP BY k)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    last = f"""SELECT vec_id, k::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"""
    return "WITH " + ",\n".join(parts) + "\n" + last


ORACLE = {"op13_zone_map_clusters": _sql()}
