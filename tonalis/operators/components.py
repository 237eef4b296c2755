"""Connected components of an edge table, and of masks of any size by tiles."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.functions import kernels as K
from tonalis.operators.batches import cut, grouped

#: Rows and columns of a tile.
TILE = 256


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (long). id and component (the smallest id that is reachable) of every id in an edge with another.

    Rounds of large and small stars: each id's neighbours are sent to the smallest of them, larger ones first, then
    smaller ones, until every id points to the smallest. Rounds grow with the logarithm of the longest path.
    """
    e = cut(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = cut(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        small = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        changed = small.exceptAll(e).isEmpty() and e.exceptAll(small).isEmpty()
        e = small
        if changed:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def component_lines(masks: DataFrame, key: str, h: str, w: str, p: str, threshold: float = 0.5, least: int = 1, centre: str = "median", tile: int = TILE) -> DataFrame:
    """4-connected components of cells above ``threshold`` per patch or whole gram: median row (truncated), or with ``centre`` "mean" the mean row, column extent, mean probability, size.

    Cells are labelled tile by tile, many tiles to a kernel call. Parts that touch a border of
    tiles are joined across it, by the cells on either side, and are components of the graph
    of parts; their row is that of the sum of their parts' counts of rows. A gram may be of any size.
    Cells without place or probability are left out; repeated cells count once, with the largest probability.
    """
    if centre not in ("median", "mean"):
        raise ValueError(f"unknown centre {centre!r}; one of median, mean")
    kind, middle = dict(masks.dtypes)[key], "int" if centre == "median" else "double"
    own = masks.filter(F.col(p) > threshold).dropna(subset=[h, w]).groupBy(key, F.col(h).cast("long").alias("h"), F.col(w).cast("long").alias("w")).agg(F.max(F.col(p).cast("double")).alias("p"))
    own = own.withColumns({"_th": F.floor(F.col("h") / tile), "_tw": F.floor(F.col("w") / tile)})

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        hs, ws, ps, th, tw = (t[c].to_numpy() for c in ("h", "w", "p", "_th", "_tw"))
        rows = []
        for a, b in pairwise(starts.tolist()):
            y, x, v = hs[a:b] - th[a] * tile, ws[a:b] - tw[a] * tile, ps[a:b]
            img = np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool)
            img[y, x] = True
            lab = K.label_4(img)[0][y, x]
            order = np.argsort(lab, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(lab[order])) + 1):
                edge = at[(x[at] == 0) & (tw[a] > 0) | (x[at] == tile - 1) | (y[at] == 0) & (th[a] > 0) | (y[at] == tile - 1)]
                count = np.unique(hs[a + at], return_counts=True)
                rows.append((a, count[0].tolist(), count[1].tolist(), int(ws[a + at].min()), int(ws[a + at].max()), float(v[at].sum()), len(at), [{"h": int(hs[a + i]), "w": int(ws[a + i])} for i in edge]))
        i, *cols = zip(*rows, strict=True)
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))]
        return pa.table([t[key].take(pa.array(i)), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[key, "rows", "counts", "lo", "hi", "s", "n", "edge"])

    parts = cut(grouped(own, [key, "_th", "_tw"], [], run, f"{key} {kind}, rows array<long>, counts array<long>, lo long, hi long, s double, n long, edge array<struct<h:long,w:long>>"))
    out = _described(parts.filter("size(edge) = 0"), key, centre)
    crossing = parts.filter("size(edge) > 0")
    if not crossing.isEmpty():
        out = out.unionByName(_described(_across(crossing, key, tile), key, centre))
    return out.filter(F.col("n") >= least).select(key, F.col("row").cast(middle).alias("row"), F.col("lo").cast("int").alias("col_min"), F.col("hi").cast("int").alias("col_max"), (F.col("s") / F.col("n")).alias("confidence"), F.col("n").cast("int").alias("n_cells"))


def _described(parts: DataFrame, key: str, centre: str) -> DataFrame:
    """Adds ``row`` from the counts of rows, which are sorted."""
    if centre == "mean":
        total = F.aggregate(F.zip_with("rows", "counts", lambda r, c: r * c), F.lit(0).cast("long"), lambda a, x: a + x)
        row = total / F.col("n")
    else:
        upto = lambda k: F.element_at(F.filter(F.transform("rows", lambda r, i: F.struct(r.alias("r"), F.aggregate(F.slice("counts", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x).alias("c"))), lambda s: s["c"] > k), 1)["r"]
        row = F.floor((upto(F.floor((F.col("n") - 1) / 2)) + upto(F.floor(F.col("n") / 2))) / 2)
    return parts.select(key, row.alias("row"), "lo", "hi", "s", "n")


def _across(parts: DataFrame, key: str, tile: int) -> DataFrame:
    """Parts that meet across borders of tiles as one, those that meet none as they are."""
    parts = cut(parts.withColumn("_id", F.monotonically_increasing_id()))
    cells = parts.select(key, "_id", F.explode("edge").alias("c")).select(key, "_id", "c.h", "c.w")
    edges = None
    for c in ("h", "w"):  # each cell of a tile's last row (column) meets the one below (beside) it
        a = cells.filter(F.pmod(c, F.lit(tile)) == tile - 1).select(F.col(key).alias("_k"), "h", "w", F.col("_id").alias("u")).withColumn(c, F.col(c) + 1)
        b = cells.filter(F.pmod(c, F.lit(tile)) == 0).select(F.col(key).alias("_o"), F.col("h").alias("_h"), F.col("w").alias("_w"), F.col("_id").alias("v"))
        met = a.join(b, F.col("_k").eqNullSafe(F.col("_o")) & (F.col("h") == F.col("_h")) & (F.col("w") == F.col("_w"))).select("u", "v").distinct()
        edges = met if edges is None else edges.unionByName(met)
    found = components(edges).withColumnRenamed("id", "_id")
    own = cut(parts.join(found, "_id", "left").withColumn("_root", F.coalesce("component", "_id")))
    whole = own.groupBy("_root").agg(F.first(key).alias(key), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("s").alias("s"), F.sum("n").alias("n"))
    by_row = own.select("_root", F.explode(F.arrays_zip("rows", "counts")).alias("z")).groupBy("_root", F.col("z.rows").alias("r")).agg(F.sum("z.counts").alias("c"))
    hist = by_row.groupBy("_root").agg(F.array_sort(F.collect_list(F.struct("r", "c"))).alias("z"))  # a row of the gram each
    return whole.join(hist, "_root").select(key, F.transform("z", lambda x: x["r"]).alias("rows"), F.transform("z", lambda x: x["c"]).alias("counts"), "lo", "hi", "s", "n")
