"""Queries of this package for __spark_entry__.py, and DuckDB SQL for those that SQL can express."""

from . import (
    op1_token_counts,
    op2_url_filter,
    op3_token_store,
    op4_byte_bpe,
    op5_near_duplicates,
    op6_decontaminate,
    op7_toxicity,
    op8_quality_rules,
    op9_main_text,
    op10_license_scan,
)

QUERIES = {
    "op1_token_counts": op1_token_counts.query,
    "op2_url_filter": op2_url_filter.query,
    "op3_token_store": op3_token_store.query,
    "op4_byte_bpe": op4_byte_bpe.query,
    "op5_near_duplicates": op5_near_duplicates.query,
    "op6_decontaminate": op6_decontaminate.query,
    "op7_toxicity": op7_toxicity.query,
    "op8_quality_rules": op8_quality_rules.query,
    "op9_main_text": op9_main_text.query,
    "op10_license_scan": op10_license_scan.query,
}
ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": op2_url_filter.ORACLE,
    "op6_decontaminate": op6_decontaminate.oracle(),
    "op10_license_scan": op10_license_scan.oracle(),
}
