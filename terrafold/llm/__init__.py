"""Training-data operators.  Nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The query of each operator, by name."""
    from terrafold.llm import bpe, decontamination, near_dedup, page_text, pii, quality_model, quality_rules, secret_scan, sharding, token_counts

    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_bpe": bpe.op2_bpe,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_pii": pii.op5_pii,
        "op6_secrets": secret_scan.op6_secrets,
        "op7_sharding": sharding.op7_sharding,
        "op8_page_text": page_text.op8_page_text,
        "op9_quality_model": quality_model.op9_quality_model,
        "op10_near_dedup": near_dedup.op10_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    from terrafold.llm import decontamination, near_dedup, quality_rules

    return {"op1_decontamination": decontamination.OP1_SQL, "op4_quality_rules": quality_rules.OP4_SQL, "op10_near_dedup": near_dedup.OP10_SQL}
