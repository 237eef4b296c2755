"""The queries of this subpackage and their DuckDB SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tonalis.llm import centroid_clustering, collocations, embedding_dedup, exact_dedup, html_text, language_id, mixing, ngram_join, packing, quality, secret_scan, token_counts, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_url_extraction": html_text.op1_nearest_url_extraction,
    "op2_kneser_ney_language_id": language_id.op2_kneser_ney_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_concat_cut_packing": packing.op4_concat_cut_packing,
    "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
    "op6_multipart_secrets": secret_scan.op6_multipart_secrets,
    "op7_separator_scan": token_counts.op7_separator_scan,
    "op8_quality_trees": quality.op8_quality_trees,
    "op9_raked_mixture": mixing.op9_raked_mixture,
    "op10_lattice_near_dedup": embedding_dedup.op10_lattice_near_dedup,
    "op11_phrase_collocations": collocations.op11_phrase_collocations,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_zone_map_clusters": centroid_clustering.op13_zone_map_clusters,
}
ORACLE: dict[str, str] = {**exact_dedup.ORACLE, **mixing.ORACLE, **collocations.ORACLE, **centroid_clustering.ORACLE}
