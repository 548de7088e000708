"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pitline.llm import (
    blob_ledger,
    bloom_variants,
    feistel_pii,
    host_quality,
    host_suffixes,
    license_windows,
    paragraph_bands,
    perspectives,
    popcount_grid,
    signature_tree,
    spaced_seeds,
    swar_middle,
    word_bpe,
)

ROOT = str(Path(__file__).resolve().parents[2])


def _importable(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Lets Python workers find this package where the session was started elsewhere, from whatever folder."""

    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
        if ROOT not in known:
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])
        return fn(spark, sf_dir)

    return run


_PLAIN: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": signature_tree.op1_ngram_jaccard_join,
    "op2_benchmark_decontamination": spaced_seeds.op2_benchmark_decontamination,
    "op3_html_extraction": host_suffixes.op3_html_extraction,
    "op4_secret_scan": blob_ledger.op4_secret_scan,
    "op5_host_quality_rules": host_quality.op5_host_quality_rules,
    "op6_feistel_pseudonyms": feistel_pii.op6_feistel_pseudonyms,
    "op7_perspective_rotation": perspectives.op7_perspective_rotation,
    "op8_substring_dedup": paragraph_bands.op8_substring_dedup,
    "op9_license_scan": license_windows.op9_license_scan,
    "op10_byte_bpe": word_bpe.op10_byte_bpe,
    "op11_simhash_near_dedup": popcount_grid.op11_simhash_near_dedup,
    "op12_spelling_variants": bloom_variants.op12_spelling_variants,
    "op13_fill_in_middle": swar_middle.op13_fill_in_middle,
    "pipeline": corpus_pipeline.run,
}

QUERIES = {name: _importable(fn) for name, fn in _PLAIN.items()}

ORACLES: dict[str, str] = {
    "op4_secret_scan": blob_ledger.OP4_SQL,
    "op5_host_quality_rules": host_quality.OP5_SQL,
    "op7_perspective_rotation": perspectives.OP7_SQL,
    "op13_fill_in_middle": swar_middle.OP13_SQL,
}
