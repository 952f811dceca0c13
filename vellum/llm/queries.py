"""The queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from vellum.llm import (
    decontaminate,
    line_dedup,
    packing,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    url_filter,
    warc,
)

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_best_fit_packing": packing.query,
    "op3_sharding": sharding.query,
    "op4_simhash": simhash.query,
    "op5_url_filter": url_filter.query,
    "op6_quality_rules": quality_rules.query,
    "op7_warc": warc.query,
    "op8_decontamination": decontaminate.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_substring_dedup": substring_dedup.query,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op8_decontamination": decontaminate.ORACLE_SQL,
    "op10_substring_dedup": substring_dedup.ORACLE_SQL,
}
