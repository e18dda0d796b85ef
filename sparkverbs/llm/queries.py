"""The queries of this subpackage, each over its whole table, and their SQL texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archives, decontamination, jaccard, language_model, licences, main_text, negatives, packing, passages, quality, secrets, sharding, spelling


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: operator(*[spark.read.parquet(f"{folder}/{t}.parquet") for t in tables])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_consensus_main_text": _over(main_text.main_text, "pages"),
        "op2_count_vector_jaccard": _over(jaccard.join, "documents"),
        "op3_packaged_archives": _over(archives.round_trip, "pages"),
        "op4_simhash_decontamination": _over(decontamination.hits, "documents", "benchmark"),
        "op5_extendible_hashing": _over(sharding.assign, "documents"),
        "op6_licence_rules": _over(licences.scan, "documents"),
        "op7_best_fit_packing": _over(packing.pack, "documents"),
        "op8_adaptive_quality": _over(quality.quality_report, "documents"),
        "op9_masked_likelihood": _over(language_model.score, "documents"),
        "op10_secret_network": _over(secrets.scan, "documents"),
        "op11_angular_negatives": _over(negatives.mine, "embeddings"),
        "op12_spelling_variants": _over(spelling.variants, "documents"),
        "op13_suffix_dedup": _over(passages.report, "documents"),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_packaged_archives": archives.SQL,
        "op4_simhash_decontamination": decontamination.SQL,
        "op5_extendible_hashing": sharding.SQL,
        "op6_licence_rules": licences.SQL,
        "op8_adaptive_quality": quality.SQL,
        "op11_angular_negatives": negatives.SQL,
        "op13_suffix_dedup": passages.SQL,
    }
