"""N-gram Jaccard join: MinHash banding, shuffle on band hashes, verification on full n-gram sets.

1. One Arrow pass gives every document the fingerprint of its set of word n-grams and its band
   hashes. ``banding`` chooses rows and bands so that a pair at the threshold shares a band
   with at least the target recall.
2. Documents with equal sets are one class (aggregated before the shuffle); only one
   representative of a class goes on.
3. Representatives are shuffled on band hashes as light rows (their bands and size, no n-grams).
   A bucket is dealt in pairs of bounded blocks (``block_tasks``). A pair is a candidate in the
   first band that it shares, and only if its sizes allow the similarity; representatives that
   have no candidate in a bucket go no further there. No pairs leave the task.
4. The full n-gram sets go to the buckets where they have candidates, and decide: a pair is
   verified once, in its first shared band, and pairs that share no band are never compared. A
   task returns counts of links and a spanning forest, not the pairs.
5. Components of the verified links are the near-duplicate groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.llm._components import components
from tonalis.llm._util import LINKS, ROW, assign, block_tasks, cut, grouped, links, lists, pairs_within, row_hashes, table, with_part
from tonalis.llm._words import mixed, shingles, word_hashes

#: A block of a bucket has about BLOCK representatives, or fewer of about WEIGHT n-grams in all.
N, THRESHOLD, RECALL, BLOCK, WEIGHT = 5, 0.8, 0.999, 384, 400_000
KEY = ["h1", "h2", "size"]


def banding(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance candidates, with which a pair at the threshold shares a band with at least this probability."""
    best = (most, 1)
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def fingerprints(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, part, t1, t2 (ROW), h1, h2 (of the set), size, bands array<long> (null without words)."""
    seeds = np.random.default_rng(7).integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for b in batches:
            h1, h2, size, keys = [], [], [], []
            for t in b.column(4).to_pylist():
                s = shingles(word_hashes(t or "", memory), n)
                h1.append(int(s.sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(mixed(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64).view(np.int64)))
                size.append(len(s))
                keys.append(_bands(s, seeds, bands, rows) if len(s) else None)
            yield pa.record_batch([*b.columns[:4], pa.array(h1), pa.array(h2), pa.array(size, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "part", *ROW, *KEY, "bands"])

    own = with_part(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "part", *row_hashes(), "text")
    return own.mapInArrow(run, "doc_id long, part int, t1 long, t2 long, h1 long, h2 long, size long, bands array<long>")


def _bands(s: np.ndarray, seeds: np.ndarray, bands: int, rows: int) -> np.ndarray:
    low = np.empty(len(seeds), np.uint64)
    x = s ^ (s >> np.uint64(31))
    for i, seed in enumerate(seeds):
        v = x * seed  # multiply-shift: the high bits are the hash
        low[i] = v.min()
    low = low.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + low[:, j])
    return out.view(np.int64)


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, class_id, n_links, group_id, kept.

    class_id: smallest doc_id whose set of n-grams is the same; n_links: number of other
    documents of Jaccard similarity >= threshold found, equal ones included; group_id: smallest
    doc_id reachable by links; kept: the row is its group's first by doc_id (null last), then by
    a hash of the text. Words are runs of letters, digits and underscores in lower case. Texts
    without words (null and empty ones too) link with nothing; a text of fewer than n words has
    one n-gram of all its words. Rows are told apart by doc_id and text: of a doc_id that
    repeats with other texts each links for itself, and rows that repeat both count as links and
    are kept or not together. Rows with a null doc_id link like any other. An empty table gives
    no rows. Other columns are ignored.
    """
    return decided(docs, n, threshold, recall, block).drop(*ROW)


def decided(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """The columns of ``ngram_join``, and ROW."""
    bands, rows = banding(threshold, recall)
    light = cut(fingerprints(docs, n, bands, rows))
    some = light.filter("size > 0")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", *ROW)).alias("lead")
    # A class has a number of its own (rep), written once to the checkpoint: a doc_id may be null or stand for several texts.
    classes = cut(some.groupBy(*KEY).agg(lead, F.count("*").alias("copies"), F.first("bands").alias("bands")).withColumn("rep", F.monotonically_increasing_id()))
    verified = cut(_verified(docs, classes, n, threshold, bands, block))
    counts = verified.filter("n > 0").groupBy("rep").agg(F.sum("n").alias("others"))
    near = with_part(cut(components(verified.filter("to is not null").select(F.col("rep").alias("u"), F.col("to").alias("v"))).withColumnRenamed("id", "rep")))
    first = classes.select("rep", "lead").join(near, "rep").groupBy("component").agg(F.min("lead").alias("first"))
    firsts = assign(near, first, ["component"]).select("rep", "first")
    found = classes.select(*KEY, "rep", "lead", "copies").join(counts, "rep", "left").join(firsts, "rep", "left").filter("copies > 1 or others is not null")
    found = found.select(*KEY, F.col("lead.doc_id").alias("class_id"), F.coalesce("first", "lead").alias("first"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    out = assign(light, found, KEY)
    alone = F.col("first").isNull()
    own = lambda x: F.when(alone, F.col("doc_id")).otherwise(F.col(x))
    kept = alone | F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.t1") == F.col("t1")) & (F.col("first.t2") == F.col("t2"))
    return out.select("doc_id", own("class_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), own("first.doc_id").alias("group_id"), kept.alias("kept"), *ROW)


TASK = ["band", "h", "bi", "bj"]


def _verified(docs: DataFrame, classes: DataFrame, n: int, threshold: float, bands: int, block: int) -> DataFrame:
    """LINKS between the representatives, from tasks that each saw a part of them."""
    num, den = _ratio(threshold)
    keyed = classes.select("rep", "size", F.posexplode("bands").alias("band", "h"))
    # Most rows are alone in their bucket: the bands follow for what is left.
    tasks = block_tasks(keyed, ["band", "h"], "rep", block, "size", WEIGHT).join(classes.select("rep", "bands"), "rep")

    def candidates(t: pa.Table, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        own, size, band, b, bi, bj = lists(t["bands"], bands), *(t[k].to_numpy() for k in ("size", "band", "b", "bi", "bj"))
        for p, q in pairs_within(starts, b, bi, bj):
            fit = np.minimum(size[p], size[q]) * den >= np.maximum(size[p], size[q]) * num
            p, q = p[fit], q[fit]
            first = (own[p] == own[q]).argmax(axis=1) == band[p]
            yield p[first], q[first]

    def wanted(t: pa.Table, starts: np.ndarray) -> pa.Table:
        some = np.zeros(t.num_rows, bool)
        for p, q in candidates(t, starts):
            some[p] = some[q] = True
        return t.select([*TASK, "b", "rep"]).filter(pa.array(some))

    sent = cut(grouped(tasks, TASK, wanted, "band int, h long, bi int, bj int, b int, rep long"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for b in batches:
            got = [shingles(word_hashes(t or "", memory), n).tobytes() for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(got, pa.binary()), *b.columns[2:]], names=["rep", "set", "copies", "size", "bands"])

    members = classes.select("rep", "lead.doc_id", "lead.t1", "lead.t2", "copies", "size", "bands").join(sent.select("rep").distinct(), "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), *[c.alias(f"_{k}") for k, c in zip(ROW, row_hashes(), strict=True)], "text")
    same = F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2"))
    own = texts.join(members, same).select("rep", "text", "copies", "size", "bands").mapInArrow(sets, "rep long, set binary, copies long, size long, bands array<long>")
    one = own.groupBy("rep").agg(*[F.first(c).alias(c) for c in ("set", "copies", "size", "bands")])  # rows may repeat doc_id and text

    def compare(t: pa.Table, starts: np.ndarray) -> pa.Table:
        held = [np.frombuffer(x, np.uint64) for x in t["set"].to_pylist()]
        group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        found = []
        for p, q in candidates(t, starts):
            hit = np.zeros(len(p), bool)
            for at in np.split(np.arange(len(p)), np.flatnonzero(np.diff(group[p])) + 1) if len(p) else ():
                x, y = np.unique(p[at]), np.unique(q[at])
                if len(at) > 2 * (len(x) + len(y)):
                    hit[at] = _similar(held, x, y, num, den)[np.searchsorted(x, p[at]), np.searchsorted(y, q[at])]
                else:
                    hit[at] = [_alike(held[i], held[j], num, den) for i, j in zip(p[at].tolist(), q[at].tolist(), strict=True)]
            found.append((p[hit], q[hit]))
        return links(t["rep"].to_numpy(), t["copies"].to_numpy(), found)

    return grouped(sent.join(one, "rep"), TASK, compare, LINKS)


def _alike(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * den >= (len(a) + len(b) - both) * num


def _ratio(threshold: float) -> tuple[int, int]:
    return round(threshold * 10_000), 10_000


def _similar(own: list[np.ndarray], left: np.ndarray, right: np.ndarray, num: int, den: int, width: int = 4096) -> np.ndarray:
    """Boolean matrix: Jaccard of the sets >= num/den, in whole numbers."""
    rows = np.unique(np.r_[left, right])
    place = np.zeros(len(own), int)
    place[rows] = np.arange(len(rows))
    size = np.array([len(own[r]) for r in rows])
    flat = np.concatenate([own[r] for r in rows])
    values, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    column = np.full(len(values), -1)
    column[common] = np.arange(len(common))
    of, who = column[code], np.repeat(np.arange(len(rows)), size)
    of, who = of[of >= 0], who[of >= 0]
    order = np.argsort(of, kind="stable")
    of, who = of[order], who[order]
    both = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, len(common), width):
        lo, hi = np.searchsorted(of, [a, a + width])
        m = np.zeros((len(rows), min(width, len(common) - a)), np.float32)
        m[who[lo:hi], of[lo:hi] - a] = 1
        both += m[place[left]] @ m[place[right]].T
    both = np.rint(both).astype(np.int64)
    union = size[place[left]][:, None] + size[place[right]][None, :] - both
    return (both * den >= union * num) & (both > 0)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))
