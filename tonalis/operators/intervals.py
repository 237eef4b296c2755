"""Interval joins as equi-joins on time buckets: nothing falls back to a nested-loop join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.sequence(F.floor(start / F.lit(width)), F.floor(end / F.lit(width)))


def containment(points: DataFrame, files: DataFrame, p_start: str, p_end: str, f_start: str, f_end: str, f_order: str, width: float, keys: list[str] | None = None) -> DataFrame:
    """Each interval of ``points`` with the first file (by ``f_order``) with f_start <= p_start and p_end < f_end; null columns where none.

    Times are numbers. Files are spread over buckets of ``width``; an interval goes to the
    bucket of its start, so each row joins once. The first match is an aggregate, not a sort.
    """
    keys = keys or []
    f = files.withColumn("_b", F.explode(_buckets(F.col(f_start), F.col(f_end), width)))
    p = points.withColumn("_b", F.floor(F.col(p_start) / F.lit(width))).withColumn("_id", F.monotonically_increasing_id())
    inside = (f[f_start] <= p[p_start]) & (p[p_end] < f[f_end])
    cond = [p[k].eqNullSafe(f[k]) for k in keys] + [p["_b"] == f["_b"], inside]
    names = [c for c in files.columns if c not in keys]
    hit = p.join(f, cond, "left").select(*[p[c] for c in points.columns], p["_id"], F.when(f[f_order].isNotNull(), F.struct(f[f_order].alias("_o"), *[f[c] for c in names])).alias("_f"))
    best = hit.groupBy("_id", *points.columns).agg(F.min("_f").alias("_f"))
    return best.select(*points.columns, *[F.col(f"_f.{c}").alias(c) for c in names])


def overlap_pairs(lines: DataFrame, ident: str, keys: list[str], start: str, end: str, freq: str, tolerance: float, width: float) -> DataFrame:
    """Pairs (a, b), a < b, of the same keys whose closed intervals overlap (touching counts) and whose frequencies differ by at most ``tolerance``.

    Rows meet on (keys, time bucket, frequency bucket); a pair counts in the bucket of the later
    start, so that none repeats.
    """
    band = max(tolerance, 1e-9)
    cols = [*keys, ident, start, end, freq]
    a = lines.select(*cols).withColumn("_b", F.explode(_buckets(F.col(start), F.col(end), width))).withColumn("_f", F.floor(F.col(freq) / band))
    b = a.withColumn("_f", F.explode(F.array(F.col("_f") - 1, F.col("_f"), F.col("_f") + 1)))
    x, y = a.alias("x"), b.alias("y")
    c = lambda s, k: F.col(f"{s}.{k}")
    on = [c("x", k) == c("y", k) for k in [*keys, "_b", "_f"]] + [c("x", ident) < c("y", ident), F.abs(c("x", freq) - c("y", freq)) <= tolerance, c("x", start) <= c("y", end), c("y", start) <= c("x", end), c("x", "_b") == F.floor(F.greatest(c("x", start), c("y", start)) / F.lit(width))]
    return x.join(y, on).select(*[c("x", k).alias(k) for k in keys], c("x", ident).alias("a"), c("y", ident).alias("b"))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")
