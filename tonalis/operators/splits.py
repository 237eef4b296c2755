"""Splits, samples and weights: deterministic draws by a hash of (seed, key), alike on every run and engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonalis.operators.batches import cut


def draw(seed: int, *keys: str | Column) -> Column:
    """Hexadecimal digest that orders rows at random but fixed."""
    return F.md5(F.concat_ws("/", F.lit(str(seed)), *[k if isinstance(k, Column) else F.col(k).cast("string") for k in keys]))


def uniform(seed: int, *keys: str | Column) -> Column:
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def check_ratios(train: float, val: float, test: float) -> None:
    if min(train, val, test) < 0 or abs(train + val + test - 1.0) > 1e-6:
        raise ValueError(f"ratios must not be negative and sum to 1: {train}, {val}, {test}")


def _ranked(units: DataFrame, key: str, seed: int, by: str | None = None) -> DataFrame:
    """Adds ``_r``, the rank (from 1) of the row by its draw, and ``_n``, the number of rows, within each value of ``by`` or overall.

    The draw's first three digits spread the rows evenly over 4,096 buckets: what lies in the
    buckets before is a running sum over at most that many counts, and only the rows of one
    bucket are sorted together.
    """
    own = units.withColumn("_d", draw(seed, key)).withColumn("_b", F.substring("_d", 1, 3))
    group = [by] if by else []
    counts = own.groupBy(*group, "_b").agg(F.count("*").alias("_m"))
    over = Window.partitionBy(*(group or [F.lit(0)]))
    counts = counts.withColumn("_n", F.sum("_m").over(over)).withColumn("_before", F.sum("_m").over(over.orderBy("_b")) - F.col("_m")).drop("_m")
    same = own["_b"] == counts["_b"]
    if by:
        same &= own[by].eqNullSafe(counts[by])
    joined = own.join(counts, same).drop(counts["_b"], *([counts[by]] if by else []))
    return joined.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy(*group, "_b").orderBy("_d", key))).drop("_d", "_b", "_before")


def split(units: DataFrame, key: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 0, by: str | None = None) -> DataFrame:
    """Adds ``partition``: train, val or test. Within each value of ``by`` (or overall) units are shuffled by hash; int(n * ratio) go to train and val, the rest to test.

    ``units`` has one row per unit (a vessel, not a recording), so that no unit is in two parts.
    """
    check_ratios(*ratios)
    n_train, n_val = (F.floor(F.col("_n").cast("double") * F.lit(x)) for x in ratios[:2])
    part = F.when(F.col("_r") <= n_train, "train").when(F.col("_r") <= n_train + n_val, "val").otherwise("test")
    return _ranked(units, key, seed, by).withColumn("partition", part).drop("_r", "_n")


def holdout(units: DataFrame, key: str, fraction: float, seed: int = 0) -> DataFrame:
    """Adds ``partition``: max(1, int(n * fraction)) units to val, the rest to train."""
    n = F.greatest(F.lit(1), F.floor(F.col("_n").cast("double") * F.lit(fraction)))
    return _ranked(units, key, seed).withColumn("partition", F.when(F.col("_r") <= n, "val").otherwise("train")).drop("_r", "_n")


def sample_per(df: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """min(n, size) rows of each value of ``by``."""
    w = Window.partitionBy(by).orderBy(draw(seed, key), key)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def balanced_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Weight 1/count of the row's class; fails with one class only."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    both = counts.agg(F.count("*").alias("_k"))
    w = F.when(F.col("_k") < 2, F.raise_error(F.lit("balanced sampling needs both classes"))).otherwise(1.0 / F.col("_n"))
    return df.join(F.broadcast(counts), label).crossJoin(F.broadcast(both)).withColumn("weight", w.cast("double")).drop("_n", "_k")


def domain_weights(df: DataFrame, ratios: dict[str, float], domain: str = "domain", label: str = "label") -> DataFrame:
    """Weight ratio(domain) * 0.5 / count of (domain, class); empty buckets have none; fails if all weights are zero."""
    counts = df.groupBy(domain, label).agg(F.count("*").alias("_n"))
    share = F.coalesce(F.create_map(*[F.lit(x) for kv in ratios.items() for x in (kv[0], float(kv[1]))])[F.col(domain)], F.lit(0.0))
    counts = counts.withColumn("weight", share * 0.5 / F.col("_n"))
    total = counts.agg(F.sum("weight").alias("_t"))
    w = F.when(F.col("_t") > 0, F.col("weight")).otherwise(F.raise_error(F.lit("all weights are zero")))
    return df.join(F.broadcast(counts), [domain, label]).crossJoin(F.broadcast(total)).withColumn("weight", w).drop("_n", "_t")


#: Equal parts of all weights by which draws find their stratum; strata are as many.
PARTS = 4096


def draw_with_replacement(df: DataFrame, weight: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n draws with probability in proportion to ``weight``: rows (draw, key).

    Cumulative weights are prefix sums within 4,096 strata by a hash of the key plus the strata's
    offsets, so that no window runs over all rows. A stratum is divided into as many equal cells as it has rows; a row
    stands in the cells that its interval touches (two a row on average) and a draw falls into one,
    so that they meet by equality and a draw sees few rows, whatever the weights.
    """
    s = cut(df.select(key, F.col(weight).alias("_weight")).filter("_weight > 0").withColumn("_s", F.substring(F.md5(F.col(key).cast("string")), 1, 3)))  # read three times
    weight = "_weight"
    sums = s.groupBy("_s").agg(F.sum(weight).cast("double").alias("_w"), F.count("*").alias("_m"))
    w0 = Window.partitionBy(F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_from", F.coalesce(F.sum("_w").over(w0), F.lit(0.0)))  # a row a stratum
    w1 = Window.partitionBy("_s").orderBy(key)
    cell = lambda x: F.least(F.floor(x / F.col("_w") * F.col("_m")), F.col("_m") - 1)
    cum = s.withColumn("_hi", F.sum(weight).over(w1)).withColumn("_lo", F.col("_hi") - F.col(weight)).join(F.broadcast(sums), "_s")  # a row a stratum
    last = F.lead(key).over(w1).isNull()  # ends where the draws do, whatever the rounding
    cum = cum.withColumn("_hi", F.when(last, F.greatest("_hi", F.col("_w") * 2)).otherwise(F.col("_hi")))
    cum = cum.select(key, "_s", "_lo", "_hi", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))).alias("_c"))
    total = sums.agg(F.sum("_w").alias("_t"))
    # Draws meet strata by equal parts of the whole: a stratum stands in those that it touches, two a stratum on average.
    part = lambda x: F.least(F.floor(x / F.col("_t") * F.lit(PARTS)), F.lit(PARTS - 1))
    strata = sums.crossJoin(F.broadcast(total)).withColumn("_p", F.explode(F.sequence(part(F.col("_from")), part(F.col("_from") + F.col("_w"))))).drop("_t")
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total)).withColumn("_u", uniform(seed, F.col("draw").cast("string")) * F.col("_t")).withColumn("_p", part(F.col("_u"))).drop("_t")
    at = draws.join(F.broadcast(strata), "_p").filter((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_from") + F.col("_w")))  # 2 * PARTS rows at most
    at = at.withColumn("_v", F.col("_u") - F.col("_from")).withColumn("_c", cell(F.col("_v")))
    return at.select("draw", "_s", "_c", "_v").join(cum, ["_s", "_c"]).filter("_v >= _lo and _v < _hi").select("draw", key)


def species_draws(clips: DataFrame, n: int, species: str = "species", key: str = "clip_id", seed: int = 0) -> DataFrame:
    """n draws (draw, species, key): a species by the square root of its count, then one of its clips, each alike."""
    w = clips.join(F.broadcast(species_weights(clips, species)), species)  # one row a species
    each = w.withColumn("_each", F.col("weight") / F.col("n")).select(key, species, "_each")
    return draw_with_replacement(each.withColumn("_key", F.col(key)), "_each", "_key", n, seed).join(each.withColumnRenamed(key, "_key"), "_key").select("draw", species, F.col("_key").alias(key))


def species_weights(clips: DataFrame, species: str = "species") -> DataFrame:
    """Per species: count and the square root of it as weight, normalised."""
    n = clips.groupBy(species).agg(F.count("*").alias("n")).withColumn("_r", F.sqrt("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("_r").alias("_t")))).withColumn("weight", F.col("_r") / F.col("_t")).drop("_r", "_t")


def assign_with_replacement(units: DataFrame, key: str, n_choices: int, seed: int = 0) -> DataFrame:
    """Adds ``choice`` (0..n_choices-1) and ``clip_seed`` = seed + position + 1 in key order. The position is a rank within the plan, so ``units`` should be a plan of clips, not their samples."""
    w = Window.partitionBy(F.lit(0)).orderBy(key)
    return units.withColumn("choice", F.floor(uniform(seed, key) * n_choices).cast("int")).withColumn("clip_seed", (F.lit(seed) + F.row_number().over(w)).cast("long"))
