"""Mixing sources to target weights: iterative proportional fitting (DataFrame functions only).

Documents are summed to cells (source, language, topic). The cells' token weights are raked in
turn to the three marginals' targets until no weight moves by more than a tolerance, and never
leave the cell table. Each cell's sampling probability is its raked weight over its tokens, scaled
so that the expected tokens meet the budget with no probability above 1. Documents are then kept
by a hash of their identifier: the same ones on every run, and on every retry.

The cell table is broadcast to the documents only if it has at most ``most_cells`` rows; beyond
that it is joined by shuffle, where Spark splits skewed keys.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tonalis.llm._util import cut, table

TEMPER, BUDGET, MOST_CELLS = 0.7, 0.8, 200_000
#: Largest relative move of a marginal at which raking stops, the rounds after which it gives up, and those between two looks.
TOLERANCE, MOST_ROUNDS, STEP = 1e-8, 200, 4
DIMS = ("source", "lang", "topic")
#: Characters that are rare in prose.
MARKS = "0123456789!\"#$%&()*+/:;<=>?@[]^_`{|}~"


def surface_topic() -> Column:
    """Topic of a text where the table has none: its form, by length and by whether over a twentieth of it is digits and marks. A column of topics can be given instead."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)
    marked = (n - F.length(F.translate(text, MARKS, ""))) * 20 > n
    return F.concat(F.when(marked, "marked").otherwise("prose"), F.when(n < 600, "-short").when(n < 4000, "-medium").otherwise("-long"))


def words() -> Column:
    """Token weight of a text: its white-space words, by counting spaces and line feeds. 0 for a null or empty text."""
    text = F.coalesce("text", F.lit(""))
    gaps = F.length(text) - F.length(F.translate(text, " \n", ""))
    return F.when(text == "", 0).otherwise(gaps + 1).cast("long")


def stratified(docs: DataFrame, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """docs with the columns _source, _lang, _topic and _tokens; a null stratum is ''. ``tokens``: a column of token counts, where one is at hand (default: words)."""
    return docs.withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit("")), "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")), "_topic": F.coalesce(topic if topic is not None else surface_topic(), F.lit("")), "_tokens": F.coalesce(tokens.cast("long"), F.lit(0)) if tokens is not None else words()})


def rake(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, temper: float = TEMPER, budget: float = BUDGET, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """docs: as from ``stratified``. Returns cells: _source, _lang, _topic, tokens, weight, probability.

    targets: for a dimension (source, lang, topic) the share of each value; values that aren't
    named get none, and shares are taken relative to the sum of those of values that occur. A
    dimension without targets gets its own token sums to the power ``temper``. Targets that no
    weights meet (a cell that is needed is empty) are met as well as ``most_rounds`` allow, with a
    warning; ``marginals`` shows what was reached.
    """
    cells = cut(docs.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").cast("double").alias("tokens")))
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    out = cells.withColumn("weight", F.col("tokens"))
    for dim in DIMS:
        share = cells.groupBy(f"_{dim}").agg(F.sum("tokens").alias("_own")).withColumn("_share", _share(dim, targets, temper))
        whole = share.agg(F.sum("_share")).first()[0] or 1.0
        out = out.join(share.select(f"_{dim}", (F.col("_share") * F.lit(total / whole)).alias(f"_goal_{dim}")), f"_{dim}")
    out, done, few = cut(out), 0, cells.count() <= MOST_CELLS
    while True:
        out = out.coalesce(1) if few else out  # few cells are one partition, so that a round needs no shuffle
        for _ in range(STEP):
            moved = F.lit(0.0)
            for dim in DIMS:
                had = F.sum("weight").over(Window.partitionBy(f"_{dim}"))
                out = out.withColumn("_by", F.when(had > 0, F.col(f"_goal_{dim}") / had).otherwise(F.lit(0.0)))
                moved = F.greatest(moved, F.when(F.col("weight") > 0, F.abs(F.col("_by") - 1.0)).otherwise(F.lit(0.0)))
                out = out.withColumn("_moved", moved).withColumn("weight", F.col("weight") * F.col("_by"))
                moved = F.col("_moved")
        out, done = cut(out), done + STEP
        left = out.agg(F.max("_moved")).first()[0] or 0.0
        if left <= tolerance:
            break
        if done >= most_rounds:
            warnings.warn(f"raking stopped after {done} rounds with marginals off by up to {left:.2g}", stacklevel=2)
            break
    out = out.select("_source", "_lang", "_topic", "tokens", "weight", *[f"_goal_{d}" for d in DIMS])
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * F.lit(_scale(out, budget * total)) / F.col("tokens"))).otherwise(F.lit(1.0))
    return out.withColumn("probability", F.round(p, 6))


def _share(dim: str, targets: dict[str, dict[str, float]] | None, temper: float) -> Column:
    if own := (targets or {}).get(dim):
        named = F.create_map(*[F.lit(x) for kv in own.items() for x in (kv[0], float(kv[1]))])
        return F.coalesce(named[F.col(f"_{dim}")], F.lit(0.0))
    return F.pow("_own", F.lit(temper))


def _scale(cells: DataFrame, want: float) -> float:
    """Factor from weights to expected tokens: cells that would exceed their tokens are taken whole and the others share the rest, until no more do."""
    scale = want / (cells.agg(F.sum("weight")).first()[0] or 1.0)
    while True:
        full = F.col("weight") * F.lit(scale) >= F.col("tokens")
        taken, free = cells.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        more = max(scale, (want - taken) / free) if free else scale
        if more <= scale * (1 + 1e-12):
            return scale
        scale = more


def marginals(cells: DataFrame) -> DataFrame:
    """dim, value, goal, reached: tokens asked for and raked weight of each value of each dimension, from ``rake``."""
    parts = [cells.groupBy(F.lit(d).alias("dim"), F.col(f"_{d}").alias("value")).agg(F.first(f"_goal_{d}").alias("goal"), F.sum("weight").alias("reached")) for d in DIMS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def unit_hash(name: str = "doc_id", salt: str = "mix/") -> Column:
    """A number in [0, 1) from the identifier; md5, so that other engines can tell the same."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(F.col(name).cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, temper: float = TEMPER, budget: float = BUDGET, tokens: Column | None = None, most_cells: int = MOST_CELLS) -> DataFrame:
    """docs with the added columns _source, _lang, _topic, _tokens, _probability and _kept.

    Null sources, languages and topics are strata of their own (''). Null and empty texts weigh
    nothing; a cell without any tokens has probability 1. Rows that repeat a doc_id, null ones
    among them, are kept or not alike within a cell. An empty table gives no rows. Extra columns
    pass through (but for those of the names added).
    """
    docs = stratified(docs, topic, tokens)
    cells = cut(rake(docs, targets, temper, budget).select(*[f"_{d}" for d in DIMS], F.col("probability").alias("_probability")))
    side = F.broadcast(cells) if cells.count() <= most_cells else cells  # checked size
    joined = docs.drop("_probability", "_kept").join(side, [f"_{d}" for d in DIMS])
    return joined.withColumn("_kept", unit_hash() < F.col("_probability"))


def op9_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return got.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))


#: Rounds of raking and of filling in SQL, where nothing can stop by itself: more than it takes here.
SQL_ROUNDS, SQL_FILLS = 24, 12


def _sql() -> str:
    """The same rounds as a chain of common table expressions."""
    marks = MARKS.replace("'", "''")
    parts = [
        """d AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents)""",
        f"""t AS (SELECT doc_id, source, lang, CASE WHEN (length(text) - length(translate(text, '{marks}', ''))) * 20 > length(text) THEN 'marked' ELSE 'prose' END
             || CASE WHEN length(text) < 600 THEN '-short' WHEN length(text) < 4000 THEN '-medium' ELSE '-long' END AS topic,
             CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(translate(text, ' ' || chr(10), '')) + 1 END AS BIGINT) AS n_tokens FROM d)""",
        """c AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM t GROUP BY ALL)""",
        *(f"g_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens), {TEMPER}::DOUBLE) / sum(pow(sum(tokens), {TEMPER}::DOUBLE)) OVER () * (SELECT sum(tokens) FROM c) AS goal_{d} FROM c GROUP BY {d})" for d in DIMS),
        f"""w0 AS MATERIALIZED (SELECT c.*, tokens AS weight, {", ".join(f"goal_{d}" for d in DIMS)} FROM c {" ".join(f"JOIN g_{d} USING ({d})" for d in DIMS)})""",
    ]
    k = 0
    for _ in range(SQL_ROUNDS):
        for d in DIMS:
            parts.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN sum(weight) OVER (PARTITION BY {d}) > 0 THEN weight * goal_{d} / sum(weight) OVER (PARTITION BY {d}) ELSE 0.0::DOUBLE END AS weight) FROM w{k})")
            k += 1
    parts.append(f"s0 AS MATERIALIZED (SELECT {BUDGET}::DOUBLE * sum(tokens) / sum(weight) AS scale, {BUDGET}::DOUBLE * sum(tokens) AS want FROM w{k})")
    for i in range(SQL_FILLS):
        taken, free = f"sum(CASE WHEN weight * scale >= tokens THEN tokens ELSE 0.0::DOUBLE END)", f"sum(CASE WHEN weight * scale >= tokens THEN 0.0::DOUBLE ELSE weight END)"
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT CASE WHEN {free} = 0 THEN any_value(scale) ELSE greatest(any_value(scale), (any_value(want) - {taken}) / {free}) END AS scale, any_value(want) AS want FROM w{k}, s{i})")
    parts.append(f"p AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN least(1.0::DOUBLE, weight * scale / tokens) ELSE 1.0::DOUBLE END, 6) AS probability FROM w{k}, s{SQL_FILLS})")
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, source, lang, topic, n_tokens, probability, CAST(('0x' || substr(md5('mix/' || CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE < probability AS kept FROM t JOIN p USING (source, lang, topic)"


ORACLE = {"op9_raked_mixture": _sql()}
