"""URL filters: rules first, then gradient-boosted trees on lexical features of the URL.

Rules (host and all its subdomains, start of the path) are a native expression, the longest first.
URLs that a rule decides are the labelled ones. What no rule decides goes by trees over lengths,
depth, digit ratios, entropies, parameter counts and statistics of the URL's ends: how often, and
how often blocked, its host suffixes, first and last path segments are.

Those statistics come from all URLs, in one aggregate. Ends are hashed to ``SLOTS`` slots a kind,
so that the table has a proven bound (len(ENDS) * SLOTS rows) at any number of hosts; ends that
share a slot share its statistics. The trees are fitted on at most about ``max_rows`` labelled
URLs, each without its own share of the statistics. Scoring is one pass, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.llm import _trees
from tonalis.llm._util import prepare, table

MAX_ROWS, SLOTS, THRESHOLD = 20_000, 1 << 14, 0.5
#: verdict, host, path: what the query is asked to apply.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ENDS = ("suffix_1", "suffix_2", "host", "first_segment", "extension")
NAMES = [
    "length", "host_length", "path_length", "query_length", "depth", "labels", "host_digits", "path_digits", "host_entropy", "path_entropy", "parameters", "hyphens",
    "longest_label", "longest_segment", "digit_runs", "escapes", "secure", "fragment", "address", *[f"{e}_{x}" for e in ENDS for x in ("share", "blocked")],
]
_DIGITS, _LETTERS = re.compile(r"[0-9]+"), re.compile(r"[0-9]")
#: Rows that the statistics of an end count as seen beside its own.
PRIOR = 5.0


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or # (A-Z lower-cased). Path: from there up to ? or #. Both empty for null and without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def decided(rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits columns host and path, else null; of rules alike the first."""
    host, path = F.col("host"), F.col("path")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _ends(host: str, path: str) -> tuple[str, str, str, str, str]:
    labels, parts = host.rsplit(".", 2), path.split("/")
    last = parts[-1] or parts[-2] if len(parts) > 1 else ""
    return labels[-1], ".".join(labels[-2:]), host, parts[1] if len(parts) > 1 else "", last.rpartition(".")[2] if "." in last else ""


def slots(hosts: list[str], paths: list[str]) -> np.ndarray:
    """Rows of slot numbers, one for each of ENDS."""
    known: dict[str, int] = {}

    def slot(x: str) -> int:
        if x not in known:
            known[x] = xxhash.xxh64_intdigest(x) % SLOTS
        return known[x]

    return np.array([[slot(e) for e in _ends(h, p)] for h, p in zip(hosts, paths, strict=True)], np.int64).reshape(-1, len(ENDS))


def _entropy(x: str) -> float:
    if not x:
        return 0.0
    n = np.unique(np.frombuffer(x.encode(), np.uint8), return_counts=True)[1] / len(x.encode())
    return float(-(n * np.log2(n)).sum())


def lexical(urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
    """The features that a URL has by itself; a null or empty one has zeros."""
    out = np.zeros((len(urls), len(NAMES) - 2 * len(ENDS)))
    entropy: dict[str, float] = {}
    for row, url, host, path in zip(out, urls, hosts, paths, strict=True):
        if not url:
            continue
        if host not in entropy:
            entropy[host] = _entropy(host)
        query = url.partition("#")[0].partition("?")[2]
        labels, parts = host.split("."), path.split("/")
        runs = _DIGITS.findall(path)
        row[:] = (
            len(url), len(host), len(path), len(query), len([p for p in parts if p]), len(labels), len(_LETTERS.findall(host)) / (len(host) or 1), sum(map(len, runs)) / (len(path) or 1), entropy[host], _entropy(path),
            query.count("&") + 1 if query else 0, host.count("-"), max(map(len, labels)), max(map(len, parts)), len(runs), path.count("%") + query.count("%"), url.startswith("https"), "#" in url, host.replace(".", "").isdigit(),
        )
    return out


@dataclass(frozen=True)
class Model:
    forest: _trees.Forest
    #: Of each of ENDS and slot: URLs, labelled URLs, blocked ones.
    seen: np.ndarray

    def features(self, urls: list[str], hosts: list[str], paths: list[str], own: np.ndarray | None = None) -> np.ndarray:
        """NAMES by row. ``own``: labels (1 blocked) of rows that are counted in the statistics, and are left out of theirs."""
        at = slots(hosts, paths)
        total, labelled = max(1.0, self.seen[0, :, 0].sum()), self.seen[0].sum(axis=0)
        rate = (labelled[2] + 0.5) / (labelled[1] + 1)
        ends = np.zeros((len(at), 2 * len(ENDS)))
        for e in range(len(ENDS)):
            n, y, blocked = self.seen[e, at[:, e]].T
            if own is not None:
                y, blocked = y - 1, blocked - own
            ends[:, 2 * e], ends[:, 2 * e + 1] = np.log1p(n) / np.log1p(total), (blocked + PRIOR * rate) / (y + PRIOR)
        return np.hstack([lexical(urls, hosts, paths), ends])

    def score(self, urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
        return self.forest.score(self.features(urls, hosts, paths))


def statistics(urls: DataFrame) -> np.ndarray:
    """Counts of all rows (host, path, _y: 1 blocked, 0 allowed, null unknown) by end and slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((len(ENDS), SLOTS, 3), np.int64)
        for b in batches:
            host, path, y = (b.column(i) for i in range(3))
            at, known, blocked = slots(host.to_pylist(), path.to_pylist()), ~y.is_null().to_numpy(False), y.fill_null(0).to_numpy()
            for e in range(len(ENDS)):
                for j, w in enumerate((None, known, blocked)):
                    seen[e, :, j] += np.bincount(at[:, e], w, SLOTS).astype(np.int64)
        e, s = np.nonzero(seen[:, :, 0])
        yield pa.record_batch([pa.array(e, pa.int32()), pa.array(s, pa.int32()), *(pa.array(seen[e, s, j]) for j in range(3))], names=["e", "s", "n", "y", "b"])

    parts = urls.select("host", "path", F.col("_y").cast("int")).mapInArrow(run, "e int, s int, n long, y long, b long")
    # At most len(ENDS) * SLOTS rows, whatever the table.
    got = parts.groupBy("e", "s").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum("b").alias("b")).toArrow()
    out = np.zeros((len(ENDS), SLOTS, 3))
    out[got["e"].to_numpy(), got["s"].to_numpy()] = np.column_stack([got[c].to_numpy() for c in ("n", "y", "b")]) if got.num_rows else np.zeros((0, 3))
    return out


def fit(urls: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """``urls``: url, host, path, _y (1 blocked, 0 allowed, null unknown). Statistics of all rows; trees of about ``max_rows`` different labelled ones at most, drawn by a hash of the URL."""
    seen = statistics(urls)
    n = int(seen[0, :, 1].sum())
    share = min(1.0, max_rows / max(n, 1))
    drawn = urls.filter(F.col("_y").isNotNull() & (F.crc32(F.concat(F.lit("fit/"), F.coalesce("url", F.lit("")))) < int(share * 2**32)))
    # A URL counts once, however many rows repeat it.
    rows = drawn.select(F.coalesce("url", F.lit("")).alias("url"), "host", "path", "_y").distinct().toArrow().to_pylist()
    rows.sort(key=lambda r: (r["url"], r["_y"]))
    y = np.array([r["_y"] for r in rows], float)
    model = Model(_trees.fit(np.zeros((0, 1)), np.zeros(0)), seen)
    x = model.features(*([r[c] for r in rows] for c in ("url", "host", "path")), own=y)
    return Model(_trees.fit(x, y, rounds=60), seen)


def score(urls: DataFrame, model: Model) -> DataFrame:
    """Adds ``score`` (0 to 1, higher where a block is likelier) to the columns page_id, url, host, path, rule, verdict."""
    names = ["page_id", "url", "host", "path", "rule", "verdict"]
    prepare(urls.sparkSession)
    sent = urls.sparkSession.sparkContext.broadcast(model)  # statistics and trees of bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            url = [u or "" for u in b.column(1).to_pylist()]
            s = sent.value.score(url, b.column(2).to_pylist(), b.column(3).to_pylist())
            yield pa.record_batch([*b.columns, pa.array(s, pa.float64())], names=[*names, "score"])

    return urls.select(*names).mapInArrow(run, "page_id long, url string, host string, path string, rule string, verdict string, score double")


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict (allow or block), score.

    ``labels`` (url, verdict) teaches the trees; without it the pages that a rule decides do.
    A null url, and one without ://, has an empty host and path, and no rule fits; the trees judge
    it by features that are zero. Without labels of both kinds the score is the base rate, and the
    verdict is block only where it is over a half. Of rules alike in length the first counts.
    Repeated rows are judged alike, null page_ids too; an empty table gives no rows. Other columns
    are ignored, whatever their names.
    """
    host, path = host_and_path()
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    own = own.withColumn("_d", decided(rules)).select("page_id", "url", "host", "path", "_d.rule", "_d.verdict")
    y = F.when(F.col("verdict") == "block", 1).when(F.col("verdict") == "allow", 0)
    if labels is None:
        taught = own.withColumn("_y", y)
    else:
        # All pages count in the shares of ends, the given labels in their blocked shares.
        given = labels.select(F.col("url").cast("string").alias("url"), y.alias("_y")).filter("_y is not null").withColumns({"host": host, "path": path})
        taught = own.select("url", "host", "path", F.lit(None).cast("int").alias("_y")).unionByName(given)
    scored = score(own, fit(taught, max_rows))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.when(F.col("score") > THRESHOLD, "block").otherwise("allow")).alias("verdict"), "score")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url"))
