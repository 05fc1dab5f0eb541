"""The queries opN_<name>, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, exact_dedup, html_extract, licenses, mil_classifier, mixing, neardup, packing, quality_rules, release, secrets, sharding, simhash
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": lambda s, d: mixing.curriculum(table(s, d, "documents")),
        "op2_html_extract": lambda s, d: html_extract.report(table(s, d, "pages")),
        "op3_exact_dedup": lambda s, d: exact_dedup.report(table(s, d, "documents")),
        "op4_quality_rules": lambda s, d: quality_rules.report(table(s, d, "documents"), table(s, d, "labels")),
        "op5_pack_sequences": lambda s, d: packing.pack(table(s, d, "documents")),
        "op6_secret_scan": lambda s, d: secrets.report(table(s, d, "documents")),
        "op7_quality_classifier": lambda s, d: mil_classifier.report(table(s, d, "documents"), table(s, d, "labels")),
        "op8_minhash_near_dedup": lambda s, d: neardup.report(table(s, d, "documents")),
        "op9_minimax_shards": lambda s, d: sharding.report(table(s, d, "documents")),
        "op10_license_scan": lambda s, d: licenses.report(table(s, d, "documents")),
        "op11_ball_tree_clusters": lambda s, d: centroids.report(table(s, d, "embeddings")),
        "op12_cascading_release": lambda s, d: release.report(table(s, d, "conversations")),
        "op13_simhash_near_dedup": lambda s, d: simhash.report(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.SQL, "op3_exact_dedup": exact_dedup.SQL, "op10_license_scan": licenses.sql(), "op11_ball_tree_clusters": centroids.SQL}
