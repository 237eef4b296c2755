"""Command line: ``python -m tonalis index|detect|recordings|query ...``; results are written as Parquet or shown."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tonalis.operators import grams as G
from tonalis.operators import tracks as T
from tonalis.plans import queries as Q
from tonalis.sources import readers as R


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tonalis", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="recordings below a folder, by class tree or by file name")
    index.add_argument("root")
    index.add_argument("out")
    index.add_argument("--layout", choices=("tree", "named"), default="tree")
    index.add_argument("--min-duration", type=float, default=3.0)
    detect = sub.add_parser("detect", help="line rows of the recordings below a folder")
    detect.add_argument("root")
    detect.add_argument("out")
    detect.add_argument("--gram", help="YAML or JSON file of the gram's parameters")
    detect.add_argument("--detection", help="YAML or JSON file of the detection's parameters")
    listing = sub.add_parser("recordings", help="rows of an index")
    listing.add_argument("index")
    listing.add_argument("--dataset")
    listing.add_argument("--class-label")
    listing.add_argument("--limit", type=int, default=100)
    query = sub.add_parser("query", help="a registered query over a folder of tables")
    query.add_argument("name", choices=sorted(Q.QUERIES))
    query.add_argument("tables")
    query.add_argument("out")
    return p


def _read(path: str | None, kind: type) -> object:
    if path is None:
        return kind()
    with open(path) as f:
        return R.parameters(f.read(), kind)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tonalis").getOrCreate()
    if a.command == "index":
        found = R.probe(R.audio_files(spark, a.root))
        out = R.class_tree(found, a.root, min_duration_s=a.min_duration) if a.layout == "tree" else R.named_files(found, min_duration_s=a.min_duration)
        out.write.mode("overwrite").parquet(a.out)
    elif a.command == "detect":
        gram, config = _read(a.gram, G.LofarConfig), _read(a.detection, T.DetectionConfig)
        waves = R.decode(R.audio_files(spark, a.root), gram.sample_rate).withColumn("recording_id", F.col("path"))
        frames = G.lofar(waves, gram, normalise=False)
        lines = T.detect(frames, "recording_id", "time_bin", "power_db", gram.band()[0] * gram.bin_hz, gram.bin_hz, gram.hop_s, config)
        lines.write.mode("overwrite").parquet(a.out)
    elif a.command == "recordings":
        R.recordings(spark.read.parquet(a.index), a.dataset, a.class_label, a.limit).show(a.limit, truncate=False)
    else:
        Q.QUERIES[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
