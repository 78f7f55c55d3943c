"""Registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, infill, lines, minhash, mixing, ngrams, pii, quality, secrets, sharding, suffix, topk, whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            suffix.op1_suffix_array_dedup,
            quality.op2_quadratic_quality,
            secrets.op3_ownership_secret_scan,
            lines.op4_line_run_dedup,
            minhash.op5_lsh_forest_near_dedup,
            decontaminate.op6_benchmark_decontamination,
            mixing.op7_low_discrepancy_mixing,
            pii.op8_weak_supervision_pii,
            sharding.op9_histogram_sort_sharding,
            topk.op10_pivot_top_k,
            infill.op11_counted_quantifier_infill,
            ngrams.op12_deleted_interpolation_scores,
            whitening.op13_jacobi_whitening,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_ownership_secret_scan": secrets.OP3_SQL,
        "op4_line_run_dedup": lines.OP4_SQL,
        "op5_lsh_forest_near_dedup": minhash.OP5_SQL,
        "op6_benchmark_decontamination": decontaminate.OP6_SQL,
        "op7_low_discrepancy_mixing": mixing.OP7_SQL,
        "op9_histogram_sort_sharding": sharding.OP9_SQL,
        "op10_pivot_top_k": topk.OP10_SQL,
        "op11_counted_quantifier_infill": infill.OP11_SQL,
    }
