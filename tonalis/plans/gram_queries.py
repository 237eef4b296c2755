"""Queries over grams: normalisation, peaks, tracks, frames, spectra."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.functions import columns as C
from tonalis.operators import blocks as B
from tonalis.operators import evaluate as E
from tonalis.operators import grams as G
from tonalis.operators import intervals as I
from tonalis.operators import normalize as N
from tonalis.operators import tracks as T
from tonalis.plans import fold_sql as S
from tonalis.plans import inputs as X

Q, SQL = {}, {}


def _r(c: str, n: int = 5):  # noqa: ANN202
    return (F.round(c, n) + 0.0).alias(c)


def w1_split_window(spark: SparkSession, d: str) -> DataFrame:
    g = X.gram(spark, d).withColumn("n", N.split_window(F.col("power")))
    return N.cells(g, ["rec", "t"], "n", "x").select("rec", "t", F.col("freq_bin").alias("f"), _r("x"))


Q["w1_split_window"] = w1_split_window
SQL["w1_split_window"] = f"WITH {X.GRAM}, {X.OFFSETS}, {X.PASS_1} SELECT rec, t, f, round(r, 5) + 0.0::DOUBLE AS x FROM w1"


def w2_tpsw(spark: SparkSession, d: str) -> DataFrame:
    return N.cells(N.tpsw(X.gram(spark, d), "power", "n"), ["rec", "t"], "n", "x").select("rec", "t", F.col("freq_bin").alias("f"), _r("x"))


Q["w2_tpsw"] = w2_tpsw
SQL["w2_tpsw"] = f"WITH {X.GRAM}, {X.OFFSETS}, {X.PASS_1}, {X.PASS_2} SELECT rec, t, f, round(x, 5) + 0.0::DOUBLE AS x FROM w2"


def w4_peaks_2d(spark: SparkSession, d: str) -> DataFrame:
    g = N.tpsw(X.gram(spark, d), "power", "n").select("rec", "t", "n")
    return N.peaks_2d(g, "rec", "t", "n").select("rec", "t", F.col("freq_bin").alias("f"), _r_value())


def _r_value():  # noqa: ANN202
    return (F.round("value", 5) + 0.0).alias("x")


Q["w4_peaks_2d"] = w4_peaks_2d
SQL["w4_peaks_2d"] = f"""WITH {X.GRAM}, {X.OFFSETS}, {X.PASS_1}, {X.PASS_2},
fm AS (SELECT *, max(x) OVER (PARTITION BY rec, t ORDER BY f ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM w2),
tm AS (SELECT *, max(a) OVER (PARTITION BY rec, f ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS b FROM fm)
SELECT rec, t, f, round(x, 5) + 0.0::DOUBLE AS x FROM tm WHERE x >= 8 AND x = b"""


def w3_peak_candidates(spark: SparkSession, d: str) -> DataFrame:
    return N.peak_candidates(N.tpsw(X.gram(spark, d), "power", "n"), "rec", "t", "n").select("rec", "t", F.col("freq_bin").alias("f"), _r_value())


_CANDIDATES = f"""{X.GRAM}, {X.OFFSETS}, {X.PASS_1}, {X.PASS_2},
l AS (SELECT *, CASE WHEN lag(x) OVER v = x THEN 0 ELSE 1 END AS new FROM w2 WINDOW v AS (PARTITION BY rec, f ORDER BY t)),
g AS (SELECT *, sum(new) OVER (PARTITION BY rec, f ORDER BY t) AS run FROM l),
r AS (SELECT rec, f, run, min(t) AS a, max(t) AS b, any_value(x) AS x FROM g GROUP BY rec, f, run),
n AS (SELECT *, lag(x) OVER v AS p, lead(x) OVER v AS q FROM r WINDOW v AS (PARTITION BY rec, f ORDER BY run)),
candidate AS MATERIALIZED (SELECT rec, CAST((a + b) // 2 AS BIGINT) AS t, f, x FROM n WHERE p < x AND q < x AND x >= {{least}})"""
Q["w3_peak_candidates"] = w3_peak_candidates
SQL["w3_peak_candidates"] = f"WITH {_CANDIDATES.format(least=8)} SELECT rec, t, f, round(x, 5) + 0.0::DOUBLE AS x FROM candidate"


def w3_peaks_per_bin(spark: SparkSession, d: str) -> DataFrame:
    return T.peaks_per_bin(N.tpsw(X.gram(spark, d), "power", "n"), "rec", "t", "n").select("rec", "t", F.col("freq_bin").alias("f"), _r_value())


Q["w3_peaks_per_bin"] = w3_peaks_per_bin
SQL["w3_peaks_per_bin"] = f"WITH RECURSIVE {_CANDIDATES.format(least=8)}, {S.thin('peak', 'candidate', 'rec, f', 4)} SELECT rec, t, f, round(x, 5) + 0.0::DOUBLE AS x FROM peak"


def w5_persistent_lines(spark: SparkSession, d: str) -> DataFrame:
    return T.persistent_lines(X.event_peaks(spark, d), "user_id", "t", "f", "v", 1.0, T.PersistenceConfig(2.0, 5, 12))


_EVENT_PEAKS = f"ep AS MATERIALIZED (SELECT user_id, CAST(floor((floor(epoch(ts)) - {X.EPOCH}) / 3600) AS INTEGER) AS t, CAST(floor(value / 10) AS INTEGER) AS f, max(value) AS v FROM events GROUP BY ALL)"
_EVENT_TRACKS = f"{_EVENT_PEAKS}, {S.tracks('tr', 'ep', 'user_id', 5, 12, 2.0)}"
Q["w5_persistent_lines"] = w5_persistent_lines
SQL["w5_persistent_lines"] = f"WITH RECURSIVE {_EVENT_TRACKS} SELECT * FROM tr"


def _seconds(lines: DataFrame) -> DataFrame:
    """Lines with their start in seconds of the epoch, rounded."""
    return lines.select("correlation_id", "array_id", "beam_id", F.unix_seconds("timestamp").alias("start_s"), *[(F.round(c, 6) + 0.0).alias(c) for c in ("frequency_hz", "bandwidth_hz", "snr_db", "persistence_s")], "detection_method", "confidence")


_LINE_ROWS = "SELECT id AS correlation_id, CAST({array} AS VARCHAR) AS array_id, '0' AS beam_id, CAST({zero} + start AS BIGINT) AS start_s, round(freq, 6) + 0.0::DOUBLE AS frequency_hz, round(bw, 6) + 0.0::DOUBLE AS bandwidth_hz, round(snr, 6) + 0.0::DOUBLE AS snr_db, round(persist, 6) + 0.0::DOUBLE AS persistence_s, 'classical' AS detection_method, NULL::DOUBLE AS confidence FROM {source}"


def a7_merge_nearby(spark: SparkSession, d: str) -> DataFrame:
    t = w5_persistent_lines(spark, d)
    lines = T.to_lines(t, F.col("user_id").cast("string"), F.lit("0"), F.timestamp_seconds(F.lit(X.EPOCH)), 0.0, 10.0, 3600.0)
    return _seconds(T.merge_nearby(lines, 100.0))


Q["a7_merge_nearby"] = a7_merge_nearby
SQL["a7_merge_nearby"] = f"WITH RECURSIVE {_EVENT_TRACKS}, {S.lines('li', 'tr', 'user_id', 'user_id', 0.0, 10.0, 3600.0)}, {S.merged('me', 'li', 'user_id', 100.0)} " + _LINE_ROWS.format(array="user_id", zero=X.EPOCH, source="me")


def p9_track_rows(spark: SparkSession, d: str) -> DataFrame:
    """Projection of tracks to physical units."""
    t = w5_persistent_lines(spark, d)
    return _seconds(T.to_lines(t, F.col("user_id").cast("string"), F.lit("0"), F.timestamp_seconds(F.lit(X.EPOCH)), 5.0, 10.0, 3600.0))


Q["p9_track_rows"] = p9_track_rows
SQL["p9_track_rows"] = f"WITH RECURSIVE {_EVENT_TRACKS}, {S.lines('li', 'tr', 'user_id', 'user_id', 5.0, 10.0, 3600.0)} " + _LINE_ROWS.format(array="user_id", zero=X.EPOCH, source="li")


def p9_line_rows(spark: SparkSession, d: str) -> DataFrame:
    """Projection of runs to physical units, on one-peak tracks."""
    p = X.event_peaks(spark, d).select("user_id", F.col("f").alias("freq_bin_center"), F.col("f").alias("freq_bin_min"), (F.col("f") + 1).alias("freq_bin_max"), F.col("t").alias("t_start_bin"), (F.col("t") + 2).alias("t_end_bin"), F.col("v").alias("peak_snr_db"))
    out = T.to_lines(p, F.col("user_id").cast("string"), F.lit("0"), F.timestamp_seconds(F.lit(X.EPOCH)), 5.0, 10.0, 3600.0)
    return out.select("correlation_id", "array_id", "beam_id", F.unix_seconds("timestamp").alias("start_s"), "frequency_hz", "bandwidth_hz", "snr_db", "persistence_s", "detection_method")


Q["p9_line_rows"] = p9_line_rows
SQL["p9_line_rows"] = f"""WITH p AS (SELECT user_id, CAST(floor((floor(epoch(ts)) - {X.EPOCH}) / 3600) AS INTEGER) AS t, CAST(floor(value / 10) AS INTEGER) AS f, max(value) AS v FROM events GROUP BY ALL)
SELECT md5(concat_ws('/', user_id, '0', t, t + 2, f, f, f + 1)) AS correlation_id, CAST(user_id AS VARCHAR) AS array_id, '0' AS beam_id, CAST({X.EPOCH} + t * 3600 AS BIGINT) AS start_s,
5.0::DOUBLE + f * 10.0::DOUBLE AS frequency_hz, 10.0::DOUBLE AS bandwidth_hz, v AS snr_db, 7200.0::DOUBLE AS persistence_s, 'classical' AS detection_method FROM p"""


def a8_anchor_dedupe(spark: SparkSession, d: str) -> DataFrame:
    p = X.spans(spark, d, "click").select("patch", "freq_hz", "t_start", "t_end", F.col("peak_snr_db").alias("confidence"))
    out = T.anchor_dedupe(p, ["patch"], 50.0)
    return out.select("patch", F.round("freq_hz", 6).alias("freq_hz"), "t_start", "t_end", F.round("confidence", 9).alias("confidence"), "n")


Q["a8_anchor_dedupe"] = a8_anchor_dedupe
SQL["a8_anchor_dedupe"] = f"""WITH RECURSIVE {X.sql_spans("p", "click")},
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY patch ORDER BY freq_hz, t_start, t_end, peak_snr_db) AS k FROM p),
w AS (SELECT patch, k, freq_hz AS head, 1 AS g FROM s WHERE k = 1
 UNION ALL SELECT s.patch, s.k, CASE WHEN abs(s.freq_hz - w.head) > 50 THEN s.freq_hz ELSE w.head END, CASE WHEN abs(s.freq_hz - w.head) > 50 THEN w.g + 1 ELSE w.g END FROM w JOIN s ON s.patch = w.patch AND s.k = w.k + 1)
SELECT patch, round(sum(freq_hz) / count(*), 6) AS freq_hz, min(t_start) AS t_start, max(t_end) AS t_end, round(max(peak_snr_db), 9) AS confidence, CAST(count(*) AS INTEGER) AS n FROM w JOIN s USING (patch, k) GROUP BY patch, g"""


def a8_anchor_dedupe_all(spark: SparkSession, d: str) -> DataFrame:
    """Events of all kinds, each kind of a user's day apart."""
    kinds = [X.spans(spark, d, k).select(F.lit(k).alias("kind"), "patch", "freq_hz", "t_start", "t_end", F.col("peak_snr_db").alias("confidence")) for k in X.KINDS]
    out = T.anchor_dedupe(reduce(DataFrame.unionByName, kinds), ["kind", "patch"], 50.0)
    return out.select("kind", "patch", F.round("freq_hz", 6).alias("freq_hz"), "t_start", "t_end", F.round("confidence", 9).alias("confidence"), "n")


Q["a8_anchor_dedupe_all"] = a8_anchor_dedupe_all
SQL["a8_anchor_dedupe_all"] = f"""WITH RECURSIVE {", ".join(X.sql_spans(f"p_{k}", k) for k in X.KINDS)}, p AS ({" UNION ALL ".join(f"SELECT '{k}' AS kind, * FROM p_{k}" for k in X.KINDS)}),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY kind, patch ORDER BY freq_hz, t_start, t_end, peak_snr_db) AS k FROM p),
w AS (SELECT kind, patch, k, freq_hz AS head, 1 AS g FROM s WHERE k = 1
 UNION ALL SELECT s.kind, s.patch, s.k, CASE WHEN abs(s.freq_hz - w.head) > 50 THEN s.freq_hz ELSE w.head END, CASE WHEN abs(s.freq_hz - w.head) > 50 THEN w.g + 1 ELSE w.g END FROM w JOIN s ON s.kind = w.kind AND s.patch = w.patch AND s.k = w.k + 1)
SELECT kind, patch, round(sum(freq_hz) / count(*), 6) AS freq_hz, min(t_start) AS t_start, max(t_end) AS t_end, round(max(peak_snr_db), 9) AS confidence, CAST(count(*) AS INTEGER) AS n FROM w JOIN s USING (kind, patch, k) GROUP BY kind, patch, g"""


def c3_detect_lines(spark: SparkSession, d: str) -> DataFrame:
    cfg = T.DetectionConfig(method="two_d", snr_db=6.0, persistence=T.PersistenceConfig(2.0, 3, 4), tolerance_hz=4.0)
    return _seconds(T.detect(X.gram(spark, d), "rec", "t", "power", 0.0, 1.0, 1.0, cfg))


_PEAKS_2D = f"""{X.GRAM}, {X.OFFSETS}, {X.PASS_1}, {X.PASS_2},
fm AS (SELECT *, max(x) OVER (PARTITION BY rec, t ORDER BY f ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS a FROM w2),
tm AS (SELECT *, max(a) OVER (PARTITION BY rec, f ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS b FROM fm),
pk AS MATERIALIZED (SELECT rec, t, f, x AS v FROM tm WHERE x >= 6 AND x = b)"""
Q["c3_detect_lines"] = c3_detect_lines
SQL["c3_detect_lines"] = f"WITH RECURSIVE {_PEAKS_2D}, {S.tracks('tr', 'pk', 'rec', 3, 4, 2.0)}, {S.lines('li', 'tr', 'rec', 'rec', 0.0, 1.0, 1.0)}, {S.merged('me', 'li', 'rec', 4.0)} " + _LINE_ROWS.format(array="rec", zero=0, source="me")


def c3_detect_per_bin(spark: SparkSession, d: str) -> DataFrame:
    """Detection by thinned peaks per bin, with the default tolerance."""
    cfg = T.DetectionConfig(snr_db=6.0, persistence=T.PersistenceConfig(2.0, 3, 4))
    return _seconds(T.detect(X.gram(spark, d), "rec", "t", "power", 0.0, 1.0, 1.0, cfg))


Q["c3_detect_per_bin"] = c3_detect_per_bin
SQL["c3_detect_per_bin"] = f"WITH RECURSIVE {_CANDIDATES.format(least=6)}, {S.thin('thinned', 'candidate', 'rec, f', 4)}, pk AS MATERIALIZED (SELECT rec, t, f, x AS v FROM thinned), {S.tracks('tr', 'pk', 'rec', 3, 4, 2.0)}, {S.lines('li', 'tr', 'rec', 'rec', 0.0, 1.0, 1.0)}, {S.merged('me', 'li', 'rec', C.merge_tolerance(3, 1.0, 2))} " + _LINE_ROWS.format(array="rec", zero=0, source="me")

_SNRS, _PERSISTENCES = (6.0, 8.0, 10.0), (2.0, 4.0)


def a12_far_grid(spark: SparkSession, d: str) -> DataFrame:
    g = N.tpsw(X.gram(spark, d), "power", "n").select("rec", "t", "n")
    out = T.false_alarm_grid(g, "rec", "t", "n", 1.0, list(_SNRS), list(_PERSISTENCES), 0.0, 1.0, T.DetectionConfig(persistence=T.PersistenceConfig(2.0, 3, 4)))
    return out.select("snr_db", "persistence_s", "n_lines", F.round("per_hour", 6).alias("per_hour"))


Q["a12_far_grid"] = a12_far_grid
SQL["a12_far_grid"] = f"""WITH RECURSIVE {_CANDIDATES.format(least=6)}, {S.thin('thinned', 'candidate', 'rec, f', 4)}, gs(snr_db) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in _SNRS)}), gp(persistence_s) AS (VALUES {", ".join(f"({x}::DOUBLE)" for x in _PERSISTENCES)}),
pk AS MATERIALIZED (SELECT snr_db, rec, t, f, x AS v FROM thinned, gs WHERE x >= snr_db), {S.tracks('tr', 'pk', 'snr_db, rec', 3, 4, 2.0)},
tp AS MATERIALIZED (SELECT persistence_s, tr.* FROM tr, gp WHERE t_end_bin - t_start_bin >= persistence_s), {S.lines('li', 'tp', 'persistence_s, snr_db, rec', 'rec', 0.0, 1.0, 1.0)}, {S.merged('me', 'li', 'persistence_s, snr_db, rec', C.merge_tolerance(3, 1.0, 2))},
c AS (SELECT snr_db, persistence_s, count(*) AS n FROM me GROUP BY ALL), h AS (SELECT count(*) / 3600.0::DOUBLE AS hours FROM embeddings)
SELECT snr_db, persistence_s, coalesce(n, 0) AS n_lines, round(coalesce(n, 0) / hours, 6) AS per_hour FROM gs CROSS JOIN gp CROSS JOIN h LEFT JOIN c USING (snr_db, persistence_s)"""


def w6_dft(spark: SparkSession, d: str) -> DataFrame:
    f = G.frames(X.waveform(spark, d), "rec", "i", "x", 32, 256)
    return G.dft_power(f, "rec", "x", 32, 32).select("rec", "time_bin", "freq_bin", (F.round(C.power_db(F.col("power")), 4) + 0.0).alias("db"))


_DFT = f"""WITH {X.WAVE}, n AS (SELECT rec, max(i) + 1 AS n FROM wave GROUP BY rec),
fr AS (SELECT w.rec, CAST(t.k AS BIGINT) AS time_bin, w.i - t.k * 256 AS pos, w.x FROM n JOIN range(0, 100000) t(k) ON t.k * 256 + 32 <= n.n JOIN wave w ON w.rec = n.rec AND w.i >= t.k * 256 AND w.i < t.k * 256 + 32),
h AS (SELECT sum(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 31.0::DOUBLE)) AS s FROM range(0, 32) q(j)),
p AS (SELECT rec, time_bin, CAST(b AS INTEGER) AS freq_bin, sum(x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * pos / 31.0::DOUBLE)) / s * cos(2 * pi() * ((b * pos) % 32) / 32.0::DOUBLE)) AS re,
 sum(x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * pos / 31.0::DOUBLE)) / s * sin(2 * pi() * ((b * pos) % 32) / 32.0::DOUBLE)) AS im FROM fr, h, range(0, 17) bb(b) GROUP BY ALL)"""
Q["w6_dft"] = w6_dft
SQL["w6_dft"] = _DFT + " SELECT rec, time_bin, freq_bin, round(10 * log10(re * re + im * im + 1e-10::DOUBLE), 4) + 0.0::DOUBLE AS db FROM p"


def c1_lofar(spark: SparkSession, d: str) -> DataFrame:
    """Whole recordings through the kernel, in a band, before normalising."""
    rec = X.waveform(spark, d).groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("samples")).withColumn("sr", F.lit(32))
    cfg = G.LofarConfig(32, 32, 256, 32, freq_min_hz=2.0, freq_max_hz=12.0, train=9, central=1, gap=1)
    g = G.lofar(rec, cfg, "rec", "sr", "samples")
    return g.select("rec", F.col("time_bin").cast("long").alias("time_bin"), F.posexplode("power_db").alias("k", "db")).select("rec", "time_bin", (F.col("k") + 2).alias("freq_bin"), (F.round("db", 4) + 0.0).alias("db"))


Q["c1_lofar"] = c1_lofar
SQL["c1_lofar"] = _DFT + " SELECT rec, time_bin, freq_bin, round(10 * log10(re * re + im * im + 1e-10::DOUBLE), 4) + 0.0::DOUBLE AS db FROM p WHERE freq_bin BETWEEN 2 AND 12"


def c2_demon(spark: SparkSession, d: str) -> DataFrame:
    rec = X.waveform(spark, d).groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("samples")).withColumn("sr", F.lit(1000))
    return G.demon(rec, G.DemonConfig(1000, 100.0, 400.0, 50.0, 5, 32, 8), "rec", "sr", "samples")


Q["c2_demon"] = c2_demon


#: Overlapping frames of all samples: 32 of them, 16 apart; blocks of 1,024.
_HOP, _BLOCK = 16, 1024
_OVERLAP = _DFT.replace("* 256", f"* {_HOP}")


def w6_dft_overlap(spark: SparkSession, d: str) -> DataFrame:
    f = G.frames(X.waveform(spark, d), "rec", "i", "x", 32, _HOP)
    return G.dft_power(f, "rec", "x", 32, 32).select("rec", "time_bin", "freq_bin", (F.round(C.power_db(F.col("power")), 4) + 0.0).alias("db"))


Q["w6_dft_overlap"] = w6_dft_overlap
SQL["w6_dft_overlap"] = _OVERLAP + " SELECT rec, time_bin, freq_bin, round(10 * log10(re * re + im * im + 1e-10::DOUBLE), 4) + 0.0::DOUBLE AS db FROM p"


def c1_lofar_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Recordings in blocks of samples, each framed where it lies, and the background taken off."""
    cfg = G.LofarConfig(32, 32, _HOP, 32, freq_min_hz=2.0, freq_max_hz=12.0, train=9, central=1, gap=1)
    g = B.lofar_blocks(B.from_samples(X.waveform(spark, d), "rec", "i", "x", 32, _BLOCK), cfg, "rec", size=_BLOCK)
    cell = F.posexplode(F.arrays_zip("power_db", "normalized_power_db")).alias("k", "z")
    return g.select("rec", F.col("time_bin").cast("long").alias("time_bin"), cell).select("rec", "time_bin", (F.col("k") + 2).alias("freq_bin"), *[(F.round(F.col(f"z.{c}"), 4) + 0.0).alias(a) for c, a in (("power_db", "db"), ("normalized_power_db", "normalized_db"))])


Q["c1_lofar_blocks"] = c1_lofar_blocks
SQL["c1_lofar_blocks"] = _OVERLAP + """, db AS MATERIALIZED (SELECT rec, time_bin, freq_bin, 10 * log10(re * re + im * im + 1e-10::DOUBLE) AS db FROM p WHERE freq_bin BETWEEN 2 AND 12),
o AS (SELECT k FROM range(-4, 5) q(k) WHERE abs(k) > 1)
SELECT c.rec, c.time_bin, c.freq_bin, round(any_value(c.db), 4) + 0.0::DOUBLE AS db, round(any_value(c.db) - sum(n.db) / 6.0::DOUBLE, 4) + 0.0::DOUBLE AS normalized_db
FROM db c, o JOIN db n ON n.rec = c.rec AND n.time_bin = c.time_bin AND n.freq_bin = greatest(2, least(12, c.freq_bin + o.k)) GROUP BY c.rec, c.time_bin, c.freq_bin"""


def c2_demon_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Recordings in blocks; the filters' states go through all blocks of one."""
    return B.demon_blocks(B.from_samples(X.waveform(spark, d), "rec", "i", "x", 1000, _BLOCK), G.DemonConfig(1000, 100.0, 400.0, 50.0, 5, 32, 8), "rec", _BLOCK)


Q["c2_demon_blocks"] = c2_demon_blocks


def w8_frame_times(spark: SparkSession, d: str) -> DataFrame:
    n = X.waveform(spark, d).groupBy("rec").agg((F.max("i") + 1).alias("n"))
    return G.frame_times(n, "rec", "n", 64, 32, 1000)


Q["w8_frame_times"] = w8_frame_times
SQL["w8_frame_times"] = "WITH n AS (SELECT l_suppkey AS rec, count(*) AS n FROM lineitem GROUP BY 1) SELECT rec, CAST(k AS INTEGER) AS time_bin, (k * 32 + 32) / 1000.0::DOUBLE AS time_s FROM n JOIN range(0, 100000) r(k) ON k * 32 + 64 <= n"


def w9_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Hours of a user's month as frames, purchases as pulses."""
    hours = F.explode(F.sequence(F.lit(0), F.lit(719))).alias("h")
    ev = X.read(spark, d, "events")
    times = ev.select("user_id").distinct().select("user_id", hours).select("user_id", (F.col("h") * 1.0 + 0.5).alias("time_s"))
    pulses = ev.filter("event_type = 'purchase'").select("user_id", ((F.unix_timestamp("ts") - X.EPOCH) / 3600.0).alias("onset_s"), (0.05 + F.col("value") / 1000.0).alias("gamma"))
    return G.active_envelope(times, pulses, "user_id", "gamma", width=48.0).select("user_id", "time_s", F.round("envelope", 9).alias("envelope"))


Q["w9_envelope"] = w9_envelope
SQL["w9_envelope"] = f"""WITH t AS (SELECT user_id, h + 0.5::DOUBLE AS time_s FROM (SELECT DISTINCT user_id FROM events), range(0, 720) r(h)),
p AS (SELECT user_id, (floor(epoch(ts)) - {X.EPOCH}) / 3600.0::DOUBLE AS onset_s, 0.05::DOUBLE + value / 1000.0::DOUBLE AS g FROM events WHERE event_type = 'purchase')
SELECT t.user_id, t.time_s, round(coalesce(max(exp(-g * (time_s - onset_s))), 0.0::DOUBLE), 9) AS envelope FROM t LEFT JOIN p ON p.user_id = t.user_id AND time_s >= onset_s AND time_s - onset_s < ln(1000.0::DOUBLE) / greatest(g, 0.001::DOUBLE) GROUP BY t.user_id, t.time_s"""


def w10_frame_truth(spark: SparkSession, d: str) -> DataFrame:
    e = w9_envelope(spark, d).select("user_id", F.floor("time_s").cast("int").alias("time_bin"), "time_s", "envelope")
    h = X.read(spark, d, "events").groupBy("user_id").agg((F.max("value") / 4.0).alias("f0_hz")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(2)))).select("user_id", "h", "f0_hz", F.lit(0.01).alias("drift"), F.lit(0.5).alias("onset_s"), (1.0 / (F.col("h") + 1)).alias("amplitude"), F.lit(0.1).alias("local_rms"))
    t = G.frame_truth(e, h, "user_id", 800, 512, 800)
    return t.select("line_id", "harmonic_id", F.size("mask_bin_indices").alias("n"), F.round(F.aggregate("snr_curve_db", F.lit(0.0), lambda a, x: a + x), 3).alias("snr_sum"), F.aggregate("mask_bin_indices", F.lit(0), lambda a, x: a + x["bin"]).cast("long").alias("bin_sum"), F.round("t_start_s", 6).alias("t_start_s"), F.round("t_end_s", 6).alias("t_end_s"))


Q["w10_frame_truth"] = w10_frame_truth
SQL["w10_frame_truth"] = f"""WITH e AS ({SQL["w9_envelope"]}),
h AS (SELECT user_id, CAST(h AS INTEGER) AS h, max(value) / 4.0::DOUBLE AS f0 FROM events, range(0, 3) r(h) GROUP BY ALL),
j AS (SELECT h.user_id, h.h, time_s, 20 * log10(greatest(1.0::DOUBLE / (h.h + 1) * envelope / sqrt(2.0::DOUBLE), 1e-12::DOUBLE) / 0.1::DOUBLE) AS snr,
 CAST(least(greatest(round_even(least(greatest((h.h + 1) * (f0 + 0.01::DOUBLE * (time_s - 0.5::DOUBLE)), 0.001::DOUBLE), 399.0::DOUBLE) / (800.0::DOUBLE / 512), 0), 0), 255) AS INTEGER) AS bin
 FROM h LEFT JOIN e ON e.user_id = h.user_id AND envelope > 0 WHERE (h.h + 1) * f0 < 400)
SELECT user_id || '_h' || h AS line_id, h AS harmonic_id, CAST(count(time_s) AS INTEGER) AS n, round(coalesce(sum(snr) FILTER (time_s IS NOT NULL), 0.0::DOUBLE), 3) AS snr_sum, CAST(coalesce(sum(bin) FILTER (time_s IS NOT NULL), 0) AS BIGINT) AS bin_sum,
round(coalesce(min(time_s), 0.5::DOUBLE), 6) AS t_start_s, round(coalesce(max(time_s) + 1.0::DOUBLE, 0.5::DOUBLE), 6) AS t_end_s FROM j GROUP BY user_id, h"""


def a29_display_ceiling(spark: SparkSession, d: str) -> DataFrame:
    c = N.cells(X.gram(spark, d), ["rec", "t"], "power")
    return G.display_ceiling(c, ["rec"], "value").select("rec", _r("vmax"), _r("vmin"))


Q["a29_display_ceiling"] = a29_display_ceiling
SQL["a29_display_ceiling"] = f"WITH {X.GRAM} SELECT rec, round(quantile_cont(x, 0.99), 5) + 0.0::DOUBLE AS vmax, round(quantile_cont(x, 0.99) - 40.0::DOUBLE, 5) + 0.0::DOUBLE AS vmin FROM cell GROUP BY rec"


def p3_peak_relative(spark: SparkSession, d: str) -> DataFrame:
    c = N.cells(X.gram(spark, d), ["rec", "t"], "power", "x").withColumn("p", F.pow(F.lit(10.0), F.col("x") / 10.0))
    top = c.groupBy("rec").agg(F.max("p").alias("top"))
    return c.join(top, "rec").select("rec", "t", F.col("freq_bin").alias("f"), (F.round(C.peak_relative_db(F.col("p"), F.col("top")), 5) + 0.0).alias("db"))


Q["p3_peak_relative"] = p3_peak_relative
SQL["p3_peak_relative"] = f"WITH {X.GRAM}, p AS (SELECT rec, t, f, pow(10.0::DOUBLE, x / 10.0::DOUBLE) AS p FROM cell) SELECT rec, t, f, round(10 * log10(p / max(p) OVER (PARTITION BY rec) + 1e-6::DOUBLE), 5) + 0.0::DOUBLE AS db FROM p"


def w11_top_snr(spark: SparkSession, d: str) -> DataFrame:
    return I.top_k(X.spans(spark, d, "view").select("id", F.round("peak_snr_db", 9).alias("peak_snr_db")), 3, F.desc("peak_snr_db"), F.asc("id"))


Q["w11_top_snr"] = w11_top_snr
SQL["w11_top_snr"] = f"WITH {X.sql_spans('p', 'view')} SELECT id, round(peak_snr_db, 9) AS peak_snr_db FROM p ORDER BY 2 DESC, 1 LIMIT 3"


def w11_top_snr_all(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest events of all kinds."""
    snr = F.round(X.hashed("snr/", F.col("event_id")) * 30.0 - 5.0, 9)
    return I.top_k(X.read(spark, d, "events").select(F.col("event_id").alias("id"), snr.alias("peak_snr_db")), 3, F.desc("peak_snr_db"), F.asc("id"))


Q["w11_top_snr_all"] = w11_top_snr_all
SQL["w11_top_snr_all"] = f"SELECT event_id AS id, round({X.sql_hashed('snr/', 'event_id')} * 30.0::DOUBLE - 5.0::DOUBLE, 9) AS peak_snr_db FROM events ORDER BY 2 DESC, 1 LIMIT 3"


def w7_patch_grid(spark: SparkSession, d: str) -> DataFrame:
    clips = X.read(spark, d, "orders").select("o_orderkey", F.lit(20).alias("nf"), (F.pmod("o_custkey", F.lit(40)) + 4).cast("int").alias("nt"))
    return E.patch_grid(clips, "o_orderkey", "nf", "nt", 8, 5)


Q["w7_patch_grid"] = w7_patch_grid
SQL["w7_patch_grid"] = """WITH c AS (SELECT o_orderkey, o_custkey % 40 + 4 AS nt FROM orders), f(f_start) AS (VALUES (0), (5), (10), (12)),
t AS (SELECT o_orderkey, k * 5 AS t_start FROM c, range(0, 20) r(k) WHERE k * 5 + 8 <= nt UNION SELECT o_orderkey, nt - 8 FROM c WHERE nt >= 8)
SELECT o_orderkey, CAST(f_start AS INTEGER) AS f_start, CAST(t_start AS INTEGER) AS t_start FROM t, f"""
