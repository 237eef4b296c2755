"""Order-dependent folds as recursive SQL (DuckDB): thinning of peaks, tracking, merging, matching. Common table expressions, to be put after WITH RECURSIVE."""

from __future__ import annotations


def thin(name: str, peaks: str, keys: str, gap: int) -> str:
    """``name``: the rows of ``peaks`` (keys, t, x) that stay: taken by height (of equal ones the later first) unless one is kept nearer than ``gap``."""
    own = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""{name}_o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY x DESC, t DESC) AS k FROM {peaks}),
{name}_s AS (SELECT {keys}, 0::BIGINT AS k, []::BIGINT[] AS kept FROM {name}_o GROUP BY ALL
 UNION ALL SELECT {own}, s.k + 1, CASE WHEN len([y FOR y IN s.kept IF abs(y - o.t) < {gap}]) = 0 THEN list_append(s.kept, o.t::BIGINT) ELSE s.kept END FROM {name}_s s JOIN {name}_o o USING ({keys}) WHERE o.k = s.k + 1),
{name}_l AS (SELECT {keys}, arg_max(kept, k) AS kept FROM {name}_s GROUP BY ALL),
{name} AS MATERIALIZED (SELECT o.* EXCLUDE (k) FROM {name}_o o JOIN {name}_l USING ({keys}) WHERE list_contains(kept, o.t::BIGINT))"""


def tracks(name: str, peaks: str, key: str, drift: int, gap: int, least: float) -> str:
    """``name``: runs through ``peaks`` (key, t, f, v), with the columns of a track."""
    after = f"""list_sort([[ts[i], abs(fs[i] - fs[run[len(run)]]), fs[i], i] FOR i IN range(1, len(ts) + 1)
   IF NOT list_contains(used, i) AND ts[i] > ts[run[len(run)]] AND ts[i] <= ts[run[len(run)]] + {gap} AND abs(fs[i] - fs[run[len(run)]]) <= {drift}])[1][4]"""
    fresh = "list_min([i FOR i IN range(1, len(ts) + 1) IF NOT list_contains(used, i)])"
    return f"""{name}_p AS MATERIALIZED (SELECT {key}, list(t::BIGINT ORDER BY t, f) AS ts, list(f::BIGINT ORDER BY t, f) AS fs, list(v ORDER BY t, f) AS vs FROM {peaks} GROUP BY {key}),
{name}_s AS (SELECT *, [1]::BIGINT[] AS used, [1]::BIGINT[] AS run FROM {name}_p
 UNION ALL SELECT {key}, ts, fs, vs, list_append(used, coalesce(nxt, seed)), CASE WHEN nxt IS NULL THEN [seed] ELSE list_append(run, nxt) END
  FROM (SELECT *, {after} AS nxt, {fresh} AS seed FROM {name}_s) WHERE coalesce(nxt, seed) IS NOT NULL),
{name}_r AS (SELECT {key}, [ts[i] FOR i IN run] AS t, [fs[i] FOR i IN run] AS f, [vs[i] FOR i IN run] AS v, [greatest(vs[i], 0.0::DOUBLE) FOR i IN run] AS w FROM {name}_s WHERE {after} IS NULL),
{name} AS MATERIALIZED (SELECT {key}, CAST(round_even(CASE WHEN list_sum(w) > 0 THEN list_sum([f[i] * w[i] FOR i IN range(1, len(f) + 1)]) / list_sum(w) ELSE list_avg(f) END, 0) AS INTEGER) AS freq_bin_center,
 CAST(list_min(f) AS INTEGER) AS freq_bin_min, CAST(list_max(f) AS INTEGER) AS freq_bin_max, CAST(t[1] AS INTEGER) AS t_start_bin, CAST(t[len(t)] AS INTEGER) AS t_end_bin, list_max(v) AS peak_snr_db, CAST(len(t) AS INTEGER) AS n_peaks
 FROM {name}_r WHERE t[len(t)] - t[1] >= {least})"""


def lines(name: str, source: str, key: str, array_id: str, first_hz: float, bin_hz: float, hop_s: float) -> str:
    """``name``: key, and id, start, freq, bw, snr, persist of tracks."""
    return f"""{name} AS MATERIALIZED (SELECT {key}, md5(concat_ws('/', {array_id}, '0', t_start_bin, t_end_bin, freq_bin_min, freq_bin_center, freq_bin_max)) AS id, t_start_bin * {hop_s}::DOUBLE AS start,
 {first_hz}::DOUBLE + freq_bin_center * {bin_hz}::DOUBLE AS freq, (freq_bin_max - freq_bin_min) * {bin_hz}::DOUBLE AS bw, peak_snr_db AS snr, (t_end_bin - t_start_bin) * {hop_s}::DOUBLE AS persist FROM {source})"""


def merged(name: str, source: str, key: str, tolerance: float) -> str:
    """``name``: key and the merged lines (start, freq, id, bw, snr, persist) of ``source``."""
    a, b = "o[len(o)]", "r[pos]"
    touch = f"len(o) > 0 AND NOT ({a}.start + {a}.persist < {b}.start OR {b}.start + {b}.persist < {a}.start) AND abs({a}.freq - {b}.freq) <= {tolerance}"
    top = lambda c: f"CASE WHEN {b}.snr > {a}.snr THEN {b}.{c} ELSE {a}.{c} END"
    joined = f"""{{'start': least({a}.start, {b}.start), 'freq': {top("freq")}, 'id': {top("id")}, 'bw': greatest({a}.freq + {a}.bw / 2, {b}.freq + {b}.bw / 2) - least({a}.freq - {a}.bw / 2, {b}.freq - {b}.bw / 2),
   'snr': {top("snr")}, 'persist': greatest({a}.start + {a}.persist, {b}.start + {b}.persist) - least({a}.start, {b}.start), 'ids': list_sort(list_concat({a}.ids, {b}.ids))}}"""
    row = "{'start': start, 'freq': freq, 'id': id, 'bw': bw, 'snr': snr, 'persist': persist, 'ids': [id]}"
    return f"""{name}_s AS (SELECT {key}, list_sort(list({row})) AS r, (list({row}))[1:0] AS o, 1::BIGINT AS pos FROM {source} GROUP BY {key}
 UNION ALL SELECT {key}, CASE WHEN pos <= len(r) THEN r ELSE list_sort(o) END, CASE WHEN pos > len(r) THEN o[1:0] WHEN {touch} THEN list_append(o[1:len(o) - 1], {joined}) ELSE list_append(o, {b}) END, CASE WHEN pos <= len(r) THEN pos + 1 ELSE 1 END
  FROM {name}_s WHERE pos <= len(r) OR len(o) < len(r)),
{name} AS MATERIALIZED (SELECT {key}, x.start AS start, x.freq AS freq, CASE WHEN len(x.ids) > 1 THEN md5(array_to_string(x.ids, '+')) ELSE x.id END AS id, x.bw AS bw, x.snr AS snr, x.persist AS persist
 FROM (SELECT {key}, unnest(o) AS x FROM {name}_s WHERE pos > len(r) AND len(o) = len(r)))"""


def matched(name: str, pairs: str) -> str:
    """``name``: patch, pred_id, truth_id, iou: of all one-to-one choices of ``pairs`` (patch, pred_id, truth_id, iou > 0) the one of the largest sum."""
    return f"""{name}_a AS MATERIALIZED (SELECT patch, pred_id, row_number() OVER (PARTITION BY patch ORDER BY pred_id) AS k FROM (SELECT DISTINCT patch, pred_id FROM {pairs})),
{name}_c AS MATERIALIZED (SELECT patch, k, truth_id, iou FROM {name}_a JOIN {pairs} USING (patch, pred_id) UNION ALL SELECT patch, k, NULL, 0.0::DOUBLE FROM {name}_a),
{name}_s AS (SELECT DISTINCT patch, 0::BIGINT AS k, []::BIGINT[] AS used, 0.0::DOUBLE AS total FROM {name}_a
 UNION ALL SELECT s.patch, s.k + 1, list_append(s.used, c.truth_id), s.total + c.iou FROM {name}_s s JOIN {name}_c c ON c.patch = s.patch AND c.k = s.k + 1 AND (c.truth_id IS NULL OR NOT list_contains(s.used, c.truth_id))),
{name}_b AS (SELECT s.patch, arg_max(used, total) AS used FROM {name}_s s JOIN (SELECT patch, max(k) AS n FROM {name}_a GROUP BY patch) m ON m.patch = s.patch AND m.n = s.k GROUP BY s.patch),
{name} AS MATERIALIZED (SELECT i.* FROM {name}_b b JOIN {name}_a a USING (patch) JOIN {pairs} i ON i.patch = a.patch AND i.pred_id = a.pred_id AND i.truth_id = b.used[a.k])"""
