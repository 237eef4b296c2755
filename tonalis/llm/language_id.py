"""Language ID: interpolated Kneser-Ney character models per language in sorted hash arrays.

One model per language over the characters of words (padded at both ends), order ``ORDER``.
n-gram counts of a bounded sample come from one distributed count; the models of all languages
are laid into arrays sorted by n-gram hash, one row of log-probabilities (a column per language)
and one of back-off weights, completed at build time so that a lookup serves all languages.
A text's cross-entropy per character is a sum over its words; words are scored once each per
batch and the frequent ones are remembered. The language of the lowest cross-entropy wins. Its
score is a posterior whose temperature is calibrated on documents kept out of the counts, and a
text whose score or cross-entropy lies outside what right answers show there is ``rejected``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.llm._util import prepare, table

ORDER, MAX_DOCS, REMEMBERED = 4, 800, 150_000
WORD = re.compile(r"[^\W\d_]+")
START, STOP = "\x02", "\x03"
_P, _M = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _M
    return h ^ (h >> np.uint64(29))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all padded words in one array, and at which positions a character is predicted."""
    pad = START * (ORDER - 1)
    cp = np.frombuffer("".join(pad + w + STOP for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return cp, cp != ord(START)


def _hashes(cp: np.ndarray) -> list[np.ndarray]:
    """For k = 1..ORDER the hash of the k code points that end at each position (of fewer at the very start)."""
    out = [cp + np.uint64(1)]
    for _ in range(ORDER - 1):
        prev = np.concatenate([np.zeros(1, np.uint64), out[-1][:-1]])
        out.append(prev * _P + cp + np.uint64(1))
    return [_mixed(h + np.uint64(k)) for k, h in enumerate(out)]


def _of_grams(grams: list[str], k: int) -> np.ndarray:
    cp = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64).reshape(-1, k)
    h = np.zeros(len(cp), np.uint64)
    for j in range(k):
        h = h * _P + cp[:, j] + np.uint64(1)
    return _mixed(h + np.uint64(k - 1))


@dataclass
class Model:
    langs: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]  # by order: sorted hashes, log-probabilities (rows by language)
    backs: list[tuple[np.ndarray, np.ndarray]]  # by length of context: sorted hashes, log back-off weights
    unseen: np.ndarray
    heat: float = 1.0
    least: float = 0.0
    most: np.ndarray | None = None

    def words(self, words: list[str]) -> np.ndarray:
        """Rows by language: the log-probability of each word with its end."""
        if not words:
            return np.zeros((0, len(self.langs)))
        cp, said = _codes(words)
        at = np.flatnonzero(said)
        h = [x[at] for x in _hashes(cp)]
        before = [np.concatenate([np.zeros(1, np.uint64), x[:-1]])[at] for x in _hashes(cp)]
        lp = np.zeros((len(at), len(self.langs)), np.float32)
        todo = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            keys, rows = self.grams[k - 1]
            i, hit = _look(keys, h[k - 1][todo])
            lp[todo[hit]] += rows[i[hit]]
            todo = todo[~hit]
            if k > 1 and len(todo):
                keys, rows = self.backs[k - 2]
                i, hit = _look(keys, before[k - 2][todo])
                lp[todo[hit]] += rows[i[hit]]
        lp[todo] += self.unseen
        ends = np.cumsum([len(w) + 1 for w in words])
        return np.add.reduceat(lp, np.r_[0, ends[:-1]], axis=0, dtype=np.float64)

    def texts(self, texts: list[str | None], memory: dict[str, int], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (rows by language) and number of characters; 0 without letters."""
        found = [WORD.findall((t or "").lower()) for t in texts]
        new = list({w for ws in found for w in ws if w not in memory})
        fresh = self.words(new)
        if len(memory) + len(new) <= REMEMBERED:
            memory.update(zip(new, range(len(memory), len(memory) + len(new)), strict=True))
            rows[0] = np.concatenate([rows[0], fresh])
            own, all_rows = memory, rows[0]
        else:
            own, all_rows = _Both(memory, dict(zip(new, range(len(memory), len(memory) + len(new)), strict=True))), np.concatenate([rows[0], fresh])
        x, n = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        for i, ws in enumerate(found):
            if any(map(str.isalpha, ws)):
                idx = np.fromiter(map(own.__getitem__, ws), np.int64, len(ws))
                n[i] = sum(map(len, ws)) + len(ws)
                x[i] = -all_rows[idx].sum(axis=0) / n[i]
        return x, n

    def posterior(self, x: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = -x * (self.heat * np.sqrt(np.maximum(n, 1)))[:, None]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


class _Both:
    def __init__(self, a: dict[str, int], b: dict[str, int]):
        self.a, self.b = a, b

    def __getitem__(self, w: str) -> int:
        i = self.a.get(w)
        return self.b[w] if i is None else i


def _look(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(h), int), np.zeros(len(h), bool)
    i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return i, keys[i] == h


def build(counts: pd.DataFrame) -> Model:
    """counts: lang, gram (ORDER characters), n. Discounts by order from the counts of counts; lower orders count distinct left extensions."""
    langs = sorted(counts["lang"].unique())
    seen: list[dict[str, dict[str, float]]] = []
    backs: list[dict[str, dict[str, float]]] = []
    base: list[float] = []
    for lang in langs:
        c = counts[counts["lang"] == lang]
        levels = [dict(zip(c["gram"], c["n"].astype(float), strict=True))]
        for k in range(ORDER - 1, 0, -1):
            levels.insert(0, dict(Counter(g[1:] for g in levels[0] if g[-1] != START)))
        vocabulary = len(levels[0]) + 1
        p: dict[str, float] = {}
        back: dict[str, float] = {}
        for k, level in enumerate(levels, 1):
            ones, twos = sum(v == 1 for v in level.values()), sum(v == 2 for v in level.values())
            d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
            total: Counter = Counter()
            kinds: Counter = Counter()
            for g, v in level.items():
                total[g[:-1]] += v
                kinds[g[:-1]] += 1
            for h in total:
                back[h] = d * kinds[h] / total[h]
            for g, v in level.items():
                lower = p.get(g[1:], 0.0) if k > 1 else 1 / vocabulary
                p[g] = (v - d) / total[g[:-1]] + back[g[:-1]] * lower
        seen.append(p)
        backs.append(back)
        base.append(np.log(back.get("", 1.0) / vocabulary))

    def log_p(i: int, g: str) -> float:
        if g in seen[i]:
            return float(np.log(seen[i][g]))
        if len(g) == 1:
            return base[i]
        return float(np.log(backs[i].get(g[:-1], 1.0))) + log_p(i, g[1:])

    grams, contexts = [], []
    for k in range(1, ORDER + 1):
        names = sorted({g for p in seen for g in p if len(g) == k})
        h = _of_grams(names, k) if names else np.zeros(0, np.uint64)
        rows = np.array([[log_p(i, g) for i in range(len(langs))] for g in names], np.float32).reshape(-1, len(langs))
        o = np.argsort(h)
        grams.append((h[o], rows[o]))
    for k in range(1, ORDER):
        names = sorted({g for b in backs for g in b if len(g) == k})
        h = _of_grams(names, k) if names else np.zeros(0, np.uint64)
        rows = np.log(np.array([[b.get(g, 1.0) for b in backs] for g in names]).reshape(-1, len(langs))).astype(np.float32)
        o = np.argsort(h)
        contexts.append((h[o], rows[o]))
    return Model(langs, grams, contexts, np.array(base, np.float32))


def fit(docs: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 4) = 2", max_docs: int = MAX_DOCS) -> Model | None:
    """Models from text and non-null lang of documents that are not ``held_out``; at most about ``max_docs`` documents of a language for the counts and half as many for calibration, drawn by a hash. None if nothing can be learned."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("text is not null and lang is not null").filter(f"not ({held_out})")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, 1.5 * max_docs / n) * 2**32))])
    rows = rows.filter(F.crc32(F.concat(F.lit("fit/"), F.col("doc_id").cast("string"))) < share[F.col("lang")])
    tune = F.pmod(F.crc32(F.concat(F.lit("tune/"), F.col("doc_id").cast("string"))), F.lit(3)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for w, m in Counter(WORD.findall(t.lower())).items():
                    s = START * (ORDER - 1) + w + STOP
                    for i in range(len(s) - ORDER + 1):
                        total[lang, s[i : i + ORDER]] += m
        if total:
            keys = list(total)
            yield pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([total[k] for k in keys], pa.int64())], names=["lang", "gram", "n"])

    learn = rows.filter(~tune).select("lang", "text").mapInArrow(count, "lang string, gram string, n long")
    counts = learn.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return None
    model = build(counts)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, held = {}, [np.zeros((0, len(sent.value.langs)))]
        for b in batches:
            x, n = sent.value.texts(b.column(1).to_pylist(), memory, held)
            yield pa.record_batch([b.column(0), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array(n)], names=["lang", "x", "n"])

    got = rows.filter(tune).select("lang", "text").mapInArrow(measure, "lang string, x array<double>, n double").toPandas()
    return calibrate(model, got[(got["n"] > 0) & got["lang"].isin(model.langs)])


def calibrate(model: Model, got: pd.DataFrame) -> Model:
    """Temperature by least log loss; bounds of score and cross-entropy that 99 of 100 right answers keep."""
    model.most = np.full(len(model.langs), np.inf)
    if got.empty:
        return model
    x, n = np.stack(got["x"].to_list()), got["n"].to_numpy()
    truth = np.array([model.langs.index(v) for v in got["lang"]])
    rows = np.arange(len(x))

    def loss(heat: float) -> float:
        model.heat = heat
        return float(-np.log(np.maximum(model.posterior(x, n)[rows, truth], 1e-9)).mean())

    model.heat = min((0.25, 0.5, 1.0, 2.0, 4.0, 8.0), key=loss)
    post = model.posterior(x, n)
    best = x.argmin(axis=1)
    right = best == truth
    if right.any():
        model.least = float(np.quantile(post[rows, best][right], 0.01))
        for i in range(len(model.langs)):
            if (own := right & (best == i)).any():
                model.most[i] = float(np.quantile(x[own, i], 0.99)) + 0.5
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, rejected, n_chars_scored. ``und`` with score 0 for a text that is null or has no letter (and for all, if nothing was learned)."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        memory, held = {}, [np.zeros((0, len(m.langs) if m else 0))]
        for b in batches:
            size = b.num_rows
            if m is None:
                pred, score, out, n = np.full(size, "und", object), np.zeros(size), np.ones(size, bool), np.zeros(size)
            else:
                x, n = m.texts(b.column(1).to_pylist(), memory, held)
                best = x.argmin(axis=1)
                score = np.where(n > 0, m.posterior(x, n)[np.arange(size), best], 0.0)
                pred = np.where(n > 0, np.array(m.langs, object)[best], "und")
                out = (n == 0) | (score < m.least) | (x[np.arange(size), best] > m.most[best])
            yield pa.record_batch([b.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(out), pa.array(n.astype(np.int64))], names=["doc_id", "lang_pred", "score", "rejected", "n_chars_scored"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, n_chars_scored long")


def language_id(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected, n_chars_scored.

    Every whole text is scored, however long. A null or empty text, or one without letters, is
    ``und``. Repeated rows give equal answers; ties go to the first language by name. A null
    doc_id is scored, teaches nothing and has a null held_out. An empty table gives no rows.
    Other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    found = identify(own, fit(own, max_docs=max_docs))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected", "n_chars_scored")


def op2_kneser_ney_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
