"""The queries of this subpackage and their DuckDB counterparts, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lexweave.llm import alignment, decontaminate, fingerprint, licenses, line_dedup, mixing, near_dedup, packing, quality, sharding, substring_dedup, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_soft_mixing": mixing.op1_soft_mixing,
    "op2_document_fingerprints": fingerprint.op2_document_fingerprints,
    "op3_minhash_near_dedup": near_dedup.op3_minhash_near_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_sharding": sharding.op5_sharding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_license_scan": licenses.op7_license_scan,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_suffix_array_dedup": substring_dedup.op10_suffix_array_dedup,
    "op11_token_alignment": alignment.op11_token_alignment,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_best_fit_packing": packing.op13_best_fit_packing,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op4_line_dedup": line_dedup.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
