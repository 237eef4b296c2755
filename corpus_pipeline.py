"""From documents to packed training sequences, each stage over all that the one before kept.

quality   documents that the boosted trees score below the threshold go
exact     of equal texts (but for white space) the longest stays
near      of documents linked by word 5-gram similarity >= 0.8 the first stays
mixture   raked to tempered source, language and topic weights, and sampled
packing   concatenated and cut into windows of 1024 ids

A stage takes (spark, docs, sf_dir) and returns documents again, the last one pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonalis.llm import exact_dedup, mixing, ngram_join, packing, quality
from tonalis.llm._util import ROW, first_rows, remove, row_hashes, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _only(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents of these rows (doc_id, which may be null, and ROW); rows that repeat both doc_id and text are one, and are one a partition before texts are shuffled, once."""
    key = ["_id", "_unnamed", *ROW]
    keyed = lambda d: d.withColumns({"_id": F.coalesce("doc_id", F.lit(0)), "_unnamed": F.col("doc_id").isNull()})
    own = first_rows(keyed(docs.select("*", *row_hashes())), key)
    return own.join(keyed(rows).select(*key).distinct(), key, "left_semi").dropDuplicates(key).drop(*key)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a score of at least the classifier's threshold.

    Null and empty texts, and rows with a null doc_id, are scored like any other; rows that
    repeat score alike and all stay or go. Without labels of both kinds all get the base rate. An
    empty table stays empty. Columns other than those of documents are left behind.
    """
    forest = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), forest).filter(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the longest, then the smallest doc_id, named before unnamed.

    Null and empty texts and those of white space are one group. Rows that repeat both doc_id
    and text become one. An empty table stays empty.
    """
    return _only(docs.select(*COLUMNS), exact_dedup.kept_rows(docs))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document (by doc_id, null last, then by a hash of the text) of each near-duplicate group.

    Documents without links stay, those without words (null, empty) among them. Rows that
    repeat both doc_id and text become one. An empty table stays empty.
    """
    return _only(docs.select(*COLUMNS), ngram_join.decided(docs).filter("kept"))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by the raked probabilities.

    A null source or language is a stratum of its own; a text without words weighs nothing; rows
    of one stratum and doc_id, null ones among them, stay or go alike. An empty table stays empty.
    """
    return mixing.mix(docs.select(*COLUMNS)).filter("_kept").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids, with the ids. A null or empty text is its end id alone; every row is packed, repeated and unnamed ones too; an empty table gives no pieces."""
    return packing.pack(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("exact", exact_stage),
    ("near", near_stage),
    ("mixture", mixture_stage),
    ("packing", packing_stage),
]

#: Fitted trees, MinHash groups and tokenization have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages a Parquet table in the shared folder, removed when the next one is written (the last stage has its ids in the checkpoint)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{at}/{k}-{name}")
            docs = spark.read.parquet(f"{at}/{k}-{name}")
        if k:
            remove(spark, f"{at}/{k - 1}-{STAGES[k - 1][0]}")
    remove(spark, at)
    return docs
