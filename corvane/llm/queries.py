"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from . import decontamination, html_extraction, license_scan, near_dedup, packing, quality_rules, sharding, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_rendezvous_sharding": sharding.op5_rendezvous_sharding,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_token_counts": token_counts.op10_token_counts,
}
ORACLE_SQL = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op2_quality_rules": quality_rules.SQL,
    "op5_rendezvous_sharding": sharding.SQL,
}
