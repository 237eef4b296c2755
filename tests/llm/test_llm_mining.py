"""Collocations, URL filters and centroid clusters on small rows: against brute force and SQL, and with nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tonalis.llm import centroid_clustering as Z
from tonalis.llm import collocations as X
from tonalis.llm import url_filter as U

DATA = "/root/testdata/sf0.001"

# 11: collocations


def mined(docs, least, top, absorb=100):
    """By the definition: every phrase, every cut, every longer phrase."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for m in range(1, 6):
                    if i + m <= len(w):
                        f[lang][tuple(w[i : i + m])] += 1
    out = []
    for lang, own in f.items():
        cands = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        gone = set()
        for p, a in cands.items():
            for m in range(2, len(p)):
                gone |= {p[i : i + m] for i in range(len(p) - m + 1) if 100 * a >= absorb * own[p[i : i + m]]}
        rows = []
        for p, a in cands.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1)]
    return out


def corpus(seed=0, n=300):
    rng = np.random.default_rng(seed)
    words = ["a", "b", "A\x01", "a\x01", "é", "\xa0", "É", "x-y", "don't", "\u2028", "zz", "z", "\U0001f600"]
    ends = [" ", " ", " ", "\t", "  ", ".", ", ", "\n", "! ", "\r\n"]
    texts = ["".join(x for w in rng.choice(words, rng.integers(0, 40), p=np.r_[[0.3, 0.2], [0.5 / 11] * 11]) for x in (w, rng.choice(ends))) for _ in range(n)]
    texts += ["the same line of words again and again. "] * 60 + [None, "", " \t\n", "...", "a " * 3000]
    return [(["en", "de", None, "und", "x\ty", ""][i % 6], t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def corpus_df(spark):
    rows = [(i, t, lang, "phrase", 1, 2, 3) for i, (lang, t) in enumerate(corpus())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, part int, f long, rank long").repartition(5).cache()


@pytest.mark.parametrize("sizes", [{}, {"chunk": 211, "block": 7, "held": 50}], ids=["whole", "small"])
@pytest.mark.parametrize("least,top,absorb", [(5, 2000, 100), (3, 4, 100), (4, 2000, 80)])
def test_collocations_against_brute_force(spark, corpus_df, sizes, least, top, absorb):
    got = [tuple(r) for r in X.collocations(corpus_df, least, top, absorb, **sizes).collect()]
    assert sorted(got) == sorted(mined(corpus(), least, top, absorb)) and got


def test_counts_of_every_order(spark, corpus_df):
    """Counts and both streams, with blocks so small that phrases go on across blocks, flushes and ranges."""
    f = defaultdict(Counter)
    for lang, text in corpus():
        for piece in re.split(rb"\xff", (text or "").encode().translate(X._TABLE)):
            w = [x + b"\t" for x in piece.split(b" ") if x]
            for i in range(len(w)):
                for m in range(6):
                    if i + m <= len(w):
                        f["und" if lang is None else lang][b"".join(w[i : i + m])] += 1
    want = {(lang, p): n for lang, own in f.items() for p, n in own.items() if n >= 3 or not p}
    found = X.counts(corpus_df, 3, chunk=97, block=3, held=20)
    assert {(r.lang, bytes(r.phrase)): r.f for r in found.collect()} == want
    for suffix in (False, True):
        words = lambda p: p.split(b"\t")[:-1][:: -1 if suffix else 1]  # noqa: B023, E731
        back = {(lang, tuple(words(p))): n for (lang, p), n in want.items()}
        longer = Counter()
        for (lang, w), n in back.items():
            if w:
                longer[lang, w[:-1]] = max(longer[lang, w[:-1]], n)
        got = {(r.lang, tuple(words(bytes(r.phrase)))): (r.parts, r.longer) for r in X.stream(found, suffix).collect()}
        assert got == {(lang, w): ([back[lang, w[:k]] for k in range(len(w) + 1)], longer[lang, w]) for lang, w in back}


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert X.collocations(empty).count() == 0
    assert X.collocations(spark.createDataFrame([(1, None, None), (2, "a b", "en")], "doc_id long, text string, lang string")).count() == 0


def test_blocks_that_begin_alike_are_merged_a_few_times(monkeypatch):
    """A block of each of 200 runs, all from the range's beginning: nothing is complete before the last, and no window is merged with each that follows."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(300)], 120)).encode() for _ in range(200)]
    batch = lambda *columns: pa.record_batch(list(columns), names=[str(i) for i in range(len(columns))])
    runs = [r for t in texts for _, r in X._chunks(iter([batch(pa.array(["en"]), pa.array([t]))]), 10**6)]
    rows = sorted((r.key(0), r.packed()) for r in runs)
    whole, seen = X.merged, []
    monkeypatch.setattr(X, "merged", lambda some: (seen.append(sum(len(r.n) for r in some)), whole(some))[1])
    blocks = batch(pa.array([0] * 200), pa.array(["en"] * 200), pa.array([k for k, _ in rows]), pa.array([b for _, b in rows]))
    got = Counter()
    for b in X._merge(iter([blocks]), [], 1, 500):
        for r in b.to_pylist():
            got[r["phrase"]] += r["f"]
    want = Counter(b"".join(x + b"\t" for x in w[i : i + m]) for w in map(bytes.split, texts) for i in range(len(w)) for m in range(6) if i + m <= len(w))
    assert got == want and sum(seen) < 6 * 200 * 120


def test_ranges_follow_the_text(spark):
    """There are as many ranges as the words need, however few partitions a shuffle has."""
    texts = X._texts(spark.createDataFrame([(i, f"a{i % 97} b{i % 89} c{i % 83} d{i} e{i}", "en") for i in range(2000)], "doc_id long, text string, lang string"))
    borders = [X._borders(texts, 4, size) for size in (10**6, 500)]
    assert len(borders[0]) <= 3 and 15 <= len(borders[1]) <= 20


def test_scores_beyond_64_bits(spark):
    """Products of counts are decimals: a text of 20,000 equal words has 1000 a n over 2**38, and larger ones are cast alike."""
    got = X.collocations(spark.createDataFrame([(1, "w " * 20_000, "en")], "doc_id long, text string, lang string")).collect()
    assert [tuple(r) for r in got][0] == ("en", 1, "w w", 19_999, 20_000, 20_000, 20_000, 1000 * 19_999 * 20_000 // 20_000**2)


# 12: URL filters


def test_rules_against_brute_force(spark):
    urls = [None, "", "x", "://", "http://ORG/", "http://a.B.org", "http://a.b.org/x", "http://xorg/", "https://example.org/es/1", "https://m.example.org/es", "https://m.example.org/en/17?x=/es/", "https://com/fr/", "http://a.com/de/#x", "http://a.com?x/fr/", "http://É.COM/fr/", "a://b.org/c://d.com/fr/", "http://notexample.org/es/x", "http://org:80/", "u" * 5000 + "://a.org/" + "p/" * 5000]
    rows = [(i, u, "r", "v", 0.5, 1) for i, u in enumerate(urls)] * 2 + [(None, "http://a.org/", "r", "v", 0.5, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, verdict string, score double, _y int")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in U.url_filter(df).collect()}
    want = set()
    for i, url, *_ in rows:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        raw = re.split("[/?#]", rest)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
        path = re.split("[?#]", rest[len(raw) :])[0]
        fits = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.add((i, host, path, *((max(fits)[1:]) if fits else (None, None))))
    assert got == want


def test_trees_judge_what_no_rule_decides(spark):
    """Hosts with long digits and many parameters are blocked; a fifth of the URLs is held out, on other hosts."""
    rng = np.random.default_rng(1)

    def url(bad, k):
        host = f"{'w' if bad else 'news'}{rng.integers(1e7) if bad else ''}-{k}.{'biz' if bad else 'info'}"
        return f"http://{host}/{'x/' * int(rng.integers(3))}{rng.integers(1e9) if bad else 'story'}" + ("?a=1&b=2&c=3" if bad and rng.random() < 0.7 else "")

    known = [(url(k % 3 == 0, k), "block" if k % 3 == 0 else "allow") for k in range(3000)]
    labels = spark.createDataFrame([*known[:2400], ("http://no.label/", None)], "url string, verdict string")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(known[2400:])], "page_id long, url string").repartition(3)
    got = {r.page_id: r for r in U.url_filter(pages, (), labels).collect()}
    right = [got[i].verdict == v for i, (_, v) in enumerate(known[2400:])]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 and r.rule is None for r in got.values())
    few = U.fit(pages.withColumns(dict(zip(("host", "path"), U.host_and_path(), strict=True))).selectExpr("url", "host", "path", "cast(page_id % 3 = 0 as int) as _y"), max_rows=100)
    assert int(few.seen[0, :, 1].sum()) == 600 and len(few.seen[0]) == U.SLOTS


def test_url_statistics_count_every_row(spark):
    hosts = ["a.org", "b.org", "a.org", "", "x.a.org"]
    df = spark.createDataFrame([(h, "/p/q.html", y) for h, y in zip(hosts * 7, [1, 0, None, None, 1] * 7, strict=True)], "host string, path string, _y int").repartition(4)
    seen = U.statistics(df)
    for e in range(len(U.ENDS)):
        want = np.zeros((U.SLOTS, 3))
        for h, y in zip(hosts, [1, 0, None, None, 1], strict=True):
            want[U.slots([h], ["/p/q.html"])[0, e]] += np.array([7, 7 * (y is not None), 7 * (y or 0)])
        assert (seen[e] == want).all()


def test_url_filter_without_labels(spark):
    none = U.url_filter(spark.createDataFrame([], "page_id long, url string"))
    assert none.count() == 0
    one = U.url_filter(spark.createDataFrame([(1, None), (2, "http://x.net/")], "page_id long, url string"), ()).collect()
    assert {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in one} == {(1, "", "", None, "allow"), (2, "x.net", "/", None, "allow")}


# 13: centroid clusters


def clustered(rows, k=16, rounds=3, dim=64, scale=64):
    """By the definition, in whole numbers of Python."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    c = [v for *_, v in sorted((i is None, "" if i is None else hashlib.sha256(f"1:{i}".encode()).hexdigest(), np.array(v, "<i4").tobytes(), v) for i, v in kept)[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    place = lambda: [min((square(v, x), j) for j, x in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        at = [j for _, j in place()]
        for j in set(at):
            own = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = place()
    total, each = sum(d for d, _ in last), Counter()
    for d, j in last:
        each[j] += d
    return sorted(((i is None, i or 0, j, d, each[j], total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, last, strict=True)))


VECTORS = "vec_id long, embedding array<float>, label int, cluster int, distance long, v int, h long"


def vectors(spark, rows, n=3):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4, 5) for i, v in rows], VECTORS).repartition(n)


def rows_of(df):
    return sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def some(n, seed=0, spread=0.02, dim=64):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (12, dim))
    return [(i, [float(np.float32(x)) for x in centres[i % 12] + rng.normal(0, spread, dim)]) for i in range(n)]


@pytest.mark.parametrize("block", [4, 128])
def test_clusters_against_brute_force(spark, block):
    rows = some(300)
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[3][1]), (None, rows[4][1])]  # repeated and null identifiers
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [None] + [1.0] * 63), (2005, [float("nan")] + [1.0] * 63), (2006, [float("inf")] * 64)]
    rows += [(3000, [-0.001] * 64), (3001, [0.0] * 64), (3002, [1e4] + [0.0] * 63), (3003, [-1e5] * 64)]  # beyond what products of doubles hold exactly
    got = Z.centroid_clusters(vectors(spark, rows), block=block)
    assert rows_of(got) == clustered(rows)
    assert dict(got.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}


def test_ties_few_and_no_vectors(spark):
    grid = [(i, [float(i % 4), float(i // 4 % 4)]) for i in range(64)]  # whole numbers: many equal distances
    assert rows_of(Z.centroid_clusters(vectors(spark, grid), k=5, dim=2, scale=1)) == clustered(grid, 5, 3, 2, 1)
    few = some(3)
    assert rows_of(Z.centroid_clusters(vectors(spark, few))) == clustered(few)
    assert Z.centroid_clusters(spark.createDataFrame([], VECTORS)).count() == 0
    assert Z.centroid_clusters(vectors(spark, [(1, None), (2, [1.0])])).count() == 0
    huge = Z.centroid_clusters(vectors(spark, [(i, [s * 3e38] * 64) for i, s in enumerate((1, -1) * 10)]), k=1).collect()
    assert len(huge) == 20 and all(r.inertia == 2**63 - 1 for r in huge)  # stated: components and sums are held within a long


def test_boxes_leave_few_centroids_where_clusters_are_apart(spark):
    """And every vector's nearest centroid is among its block's candidates."""
    maps = Z.zone_maps(Z.whole_vectors(vectors(spark, some(2400))), block=16)
    got = maps.collect()
    box = lambda c: np.array([np.frombuffer(r[c], "<i4") for r in got], np.int64)
    lo, hi, v = box("lo"), box("hi"), [np.frombuffer(r.v, "<i4").reshape(-1, 64).astype(np.int64) for r in got]
    assert sum(map(len, v)) == 2400 and all((x.min(axis=0) == a).all() and (x.max(axis=0) == b).all() for x, a, b in zip(v, lo, hi, strict=True))
    c = np.floor(64 * np.array([x for _, x in some(12)])).astype(np.int64)
    may = Z.candidates(lo, hi, c)
    assert may.sum(axis=1).mean() < 3
    for x, m in zip(v, may, strict=True):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        assert m[np.unique(np.nonzero(d == d.min(axis=1, keepdims=True))[1])].all()


def test_the_curve_visits_neighbours():
    """Each cell once, and each step to a cell that differs by one in one component."""
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * n, indexing="ij"), -1).reshape(-1, n)
        h = Z.hilbert(cells, bits)
        assert sorted(h) == list(range(2 ** (n * bits)))
        assert (np.abs(np.diff(cells[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("name,call,sql,table", [("op11_phrase_collocations", X.op11_phrase_collocations, X.ORACLE, "documents"), ("op13_zone_map_clusters", Z.op13_zone_map_clusters, Z.ORACLE, "embeddings")])
def test_queries_equal_their_sql(spark, name, call, sql, table):
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    want = c.execute(sql[name]).to_arrow_table()
    got = call(spark, DATA)
    assert sorted(got.columns) == sorted(want.column_names)
    assert sorted(tuple(r[k] for k in want.column_names) for r in got.collect()) == sorted(tuple(r.values()) for r in want.to_pylist())
