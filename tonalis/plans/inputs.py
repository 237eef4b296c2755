"""The relations that the registered queries run on, derived from the test tables; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPOCH = 1704067200  # 2024-01-01 00:00 UTC
#: Kinds of events in the test tables.
KINDS = ("click", "view", "purchase", "signup", "error")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hashed(salt: str, key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sql_hashed(salt: str, key: str) -> str:
    return f"(CAST(('0x' || substr(md5('{salt}' || CAST({key} AS VARCHAR)), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def gram(spark: SparkSession, d: str) -> DataFrame:
    """rec, t, power: the vectors of a label as the frames of one recording, in dB-like units. They are numbered within ranges of identifiers and by the counts of the ranges before, so that a label spreads over tasks."""
    own = read(spark, d, "embeddings").withColumn("_r", F.floor(F.col("vec_id") / 1024))
    count = own.groupBy(F.col("label").alias("_l"), F.col("_r").alias("_q")).agg(F.count("*").alias("_n"))
    before = count.withColumn("_n", F.coalesce(F.sum("_n").over(Window.partitionBy("_l").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = F.row_number().over(Window.partitionBy("label", "_r").orderBy("vec_id")) - 1
    numbered = own.withColumn("_t", t).join(before, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_r") == F.col("_q")))
    return numbered.select(F.col("label").alias("rec"), (F.col("_t") + F.col("_n")).cast("int").alias("t"), F.transform("embedding", lambda v: v.cast("double") * 40.0).alias("power"))


GRAM = """cell AS MATERIALIZED (SELECT rec, t, CAST(i - 1 AS INTEGER) AS f, CAST(embedding[i] AS DOUBLE) * 40.0::DOUBLE AS x
  FROM (SELECT label AS rec, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS t, embedding FROM embeddings), range(1, 65) r(i))"""
OFFSETS = "o AS (SELECT k FROM range(-16, 17) q(k) WHERE abs(k) > 3)"
PASS_1 = """w1 AS MATERIALIZED (SELECT c.rec, c.t, c.f, any_value(c.x) AS x, any_value(c.x) - sum(n.x) / 26.0::DOUBLE AS r
  FROM cell c, o JOIN cell n ON n.rec = c.rec AND n.t = c.t AND n.f = greatest(0, least(63, c.f + o.k)) GROUP BY c.rec, c.t, c.f)"""
PASS_2 = """w2 AS MATERIALIZED (SELECT c.rec, c.t, c.f, CASE WHEN count(*) FILTER (n.r <= 6) >= 16
  THEN any_value(c.x) - sum(n.x) FILTER (n.r <= 6) / count(*) FILTER (n.r <= 6) ELSE any_value(c.r) END AS x
  FROM w1 c, o JOIN w1 n ON n.rec = c.rec AND n.t = c.t AND n.f = greatest(0, least(63, c.f + o.k)) GROUP BY c.rec, c.t, c.f)"""


def masks(spark: SparkSession, d: str) -> DataFrame:
    """patch_id, member, h, w, p: each vector as four members' 4 by 4 masks."""
    i = F.col("i")
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("patch_id"), F.posexplode("embedding").alias("i", "v")).select("patch_id", F.floor(i / 16).cast("int").alias("member"), F.floor(F.pmod(i, F.lit(16)) / 4).cast("int").alias("h"), F.pmod(i, F.lit(4)).alias("w"), (1.0 / (1.0 + F.exp(-8.0 * F.col("v").cast("double")))).alias("p"))


MASKS = """m AS MATERIALIZED (SELECT vec_id AS patch_id, CAST((i - 1) // 16 AS INTEGER) AS member, CAST(((i - 1) % 16) // 4 AS INTEGER) AS h, CAST((i - 1) % 4 AS INTEGER) AS w,
  1.0::DOUBLE / (1.0::DOUBLE + exp(-8.0::DOUBLE * CAST(embedding[i] AS DOUBLE))) AS p FROM embeddings, range(1, 65) r(i))"""


def scores(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, label, confidence, peak_snr_db: quality labels with a hash-based score that leans to the label, and a hash-based SNR."""
    own = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return own.select("doc_id", F.col("quality").alias("label"), "toxic", "lang", ((hashed("conf/", F.col("doc_id")) + F.col("quality")) / 2.0).alias("confidence"), (hashed("snr/", F.col("doc_id")) * 30.0 - 5.0).alias("peak_snr_db"))


SCORES = f"""s AS MATERIALIZED (SELECT l.doc_id, quality AS label, toxic, lang, ({sql_hashed("conf/", "l.doc_id")} + quality) / 2.0::DOUBLE AS confidence,
  {sql_hashed("snr/", "l.doc_id")} * 30.0::DOUBLE - 5.0::DOUBLE AS peak_snr_db FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def spans(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """patch, id, freq_hz, t_start, t_end, peak_snr_db: events of one kind as lines; a patch is one user's day."""
    sec = F.unix_timestamp("ts")
    day = F.floor((sec - EPOCH) / 86400)
    minute = F.pmod(sec - EPOCH, F.lit(86400)) / 60.0
    return read(spark, d, "events").filter(F.col("event_type") == kind).select((F.col("user_id") * 100 + day).alias("patch"), F.col("event_id").alias("id"), F.col("value").alias("freq_hz"), minute.alias("t_start"), (minute + 240.0).alias("t_end"), (hashed("snr/", F.col("event_id")) * 30.0 - 5.0).alias("peak_snr_db"))


def sql_spans(name: str, kind: str) -> str:
    sec = f"(epoch(ts) - {EPOCH})"
    return f"""{name} AS (SELECT user_id * 100 + CAST(floor(floor({sec}) / 86400) AS BIGINT) AS patch, event_id AS id, value AS freq_hz, (CAST(floor({sec}) AS BIGINT) % 86400) / 60.0::DOUBLE AS t_start,
  (CAST(floor({sec}) AS BIGINT) % 86400) / 60.0::DOUBLE + 240.0::DOUBLE AS t_end, {sql_hashed("snr/", "event_id")} * 30.0::DOUBLE - 5.0::DOUBLE AS peak_snr_db FROM events WHERE event_type = '{kind}')"""


def event_peaks(spark: SparkSession, d: str) -> DataFrame:
    """user_id, t, f, v: events as peaks of a gram of hours by tens of value."""
    hour = F.floor((F.unix_timestamp("ts") - EPOCH) / 3600).cast("int")
    return read(spark, d, "events").groupBy("user_id", hour.alias("t"), F.floor(F.col("value") / 10).cast("int").alias("f")).agg(F.max("value").alias("v"))


def waveform(spark: SparkSession, d: str) -> DataFrame:
    """rec, i, x: prices of a supplier's lines as samples of one recording."""
    i = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    return read(spark, d, "lineitem").select(F.col("l_suppkey").alias("rec"), i.cast("long").alias("i"), (F.col("l_extendedprice").cast("double") / 10000.0).alias("x"))


WAVE = """wave AS MATERIALIZED (SELECT l_suppkey AS rec, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i, CAST(l_extendedprice AS DOUBLE) / 10000.0::DOUBLE AS x FROM lineitem)"""


def month_truth(spark: SparkSession, d: str) -> DataFrame:
    """user_id, line_id, frame, bin, freq_hz, snr_db: all events as truth samples of a user's month of 120 quarter days by 64 bins of ten; the last bin takes what is above."""
    frame = F.least(F.floor((F.unix_timestamp("ts") - EPOCH) / 21600), F.lit(119)).cast("int")
    return read(spark, d, "events").select("user_id", F.col("event_type").alias("line_id"), frame.alias("frame"), F.least(F.floor(F.col("value") / 10), F.lit(63)).cast("int").alias("bin"), F.col("value").alias("freq_hz"), (hashed("snr/", F.col("event_id")) * 30.0 - 5.0).alias("snr_db"))


def month_clips(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select("user_id").distinct().select("user_id", F.lit(64).alias("nf"), F.lit(120).alias("nt"))


MONTH_TRUTH = f"""mt AS (SELECT user_id, event_type AS line_id, CAST(least(floor((floor(epoch(ts)) - {EPOCH}) / 21600), 119) AS INTEGER) AS frame, CAST(least(floor(value / 10), 63) AS INTEGER) AS bin, value AS f, {sql_hashed("snr/", "event_id")} * 30.0::DOUBLE - 5.0::DOUBLE AS snr FROM events)"""
MONTH_STARTS = "ms AS (SELECT CAST(a AS INTEGER) AS f_start, CAST(b AS INTEGER) AS t_start FROM (VALUES (0), (10), (20), (30), (40), (48)) x(a), (SELECT k * 10 AS b FROM range(0, 11) r(k) UNION SELECT 104) y)"
