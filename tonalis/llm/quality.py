"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on a bounded sample of labelled rows (``max_rows``, drawn by a hash of the
identifier) and flattened into arrays; every document's statistics come from its whole text in
one Arrow pass, and scoring is a vectorised walk of the arrays. Nothing is shuffled: the sampled
labels are broadcast, and their number is bounded by the parameter.
"""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.llm import _trees
from tonalis.llm._util import prepare, table

MAX_ROWS, THRESHOLD = 20_000, 0.3
#: Words of marks alone, and runs of one mark.
LONE, DOUBLE = re.compile(r"(?<!\S)[^\w\s]+(?!\S)"), re.compile(r"([^\w\s])\1+")
MARKS = "!|#*%$&.,;:?\"'()[]{}<>=_/\\-@0123456789"
NAMES = ["log_chars", "log_words", "mean_word", "per_line", "lines", "distinct", "again", "top", "upper", "letters", "white", "lone", "double", "longest", *[f"mark_{ord(c)}" for c in MARKS]]


def statistics(texts: list[str]) -> np.ndarray:
    """Rows of NAMES. An empty text has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for row, t in zip(out, texts, strict=True):
        if not t:
            continue
        n, words, lines = len(t), t.split(), t.count("\n") + 1
        w = len(words) or 1
        cp = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        small = cp[cp < 0x250]
        lower, upper = int(_LOWER[small].sum()), int(_UPPER[small].sum())
        counts = Counter(words)
        distinct, most = len(counts), max(counts.values(), default=0)
        again = sum(map(operator.eq, words, words[1:]))
        row[:14] = (
            np.log1p(n), np.log1p(w), n / w, n / lines, lines / w, distinct / w, again / w, most / w, upper / (upper + lower + 1), (upper + lower + len(cp) - len(small)) / n, (w - 1) / n,
            len(LONE.findall(t)) / w, len(DOUBLE.findall(t)) / w, max(map(len, words), default=0),
        )
        row[14:] = [t.count(c) for c in MARKS]
        row[14:] /= w
    return out


_SMALL = [chr(i) for i in range(0x250)]
_LOWER, _UPPER = np.array([c.islower() for c in _SMALL]), np.array([c.isupper() for c in _SMALL])


def fit(docs: DataFrame, labels: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 0", label: str = "quality", max_rows: int = MAX_ROWS) -> _trees.Forest:
    """Trees from labelled rows that are not ``held_out`` and whose label is 0 or 1; at most about ``max_rows`` of them, drawn by a hash."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("_y")).filter("_y in (0, 1)").filter(f"not ({held_out})").groupBy("doc_id").agg(F.max("_y").alias("_y"))
    n = known.count()
    known = known.filter(F.crc32(F.concat(F.lit("fit/"), F.col("doc_id").cast("string"))) < int(min(1.0, max_rows / max(n, 1)) * 2**32))
    sampled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")  # at most about max_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics([t or "" for t in b.column(1).to_pylist()])
            yield pa.record_batch([b.column(0), b.column(2), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    rows = sampled.select("doc_id", "text", "_y").mapInArrow(run, "doc_id long, y int, x array<double>").toArrow()
    y = rows["y"].to_numpy()
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(len(y), len(NAMES))
    order = np.lexsort([*x.T[:3], rows["doc_id"].to_numpy()])
    return _trees.fit(x[order], y[order].astype(float))


def score(docs: DataFrame, forest: _trees.Forest) -> DataFrame:
    """Adds ``score`` double to ``docs``: 0 to 1, higher where label 1 is likelier. ``docs`` has a column text; its other columns pass through, but for one named score, which is replaced."""
    names = [c for c in docs.columns if c != "score"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in names]).schema)
    at, sent = names.index("text"), docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = sent.value.score(statistics([t or "" for t in b.column(at).to_pylist()]))
            yield pa.record_batch([*b.columns, pa.array(s)], names=[*names, "score"])

    prepare(docs.sparkSession)
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{types}, score double")


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Null text counts as empty and gets a score too. Labels that are null, other than 0 and 1 or
    of unknown documents teach nothing; if a document has several, the larger counts. Without
    labels of both kinds every score is the base rate. Repeated rows score alike; a null doc_id is
    scored, and its held_out is null; an empty table gives no rows. Other columns are ignored.
    """
    forest = fit(docs, labels, max_rows=max_rows)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), forest)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
