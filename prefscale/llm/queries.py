"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from prefscale.llm import exact_dedup, fill_in_middle, license_scan, line_dedup, mixing, ngram_join, periodic_runs, pieces, quality, quality_rules, sharding, top_k, url_filter

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_url_filter": url_filter.op2_url_filter,
    "op2_url_filter_full": url_filter.op2_url_filter_full,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_top_k": top_k.op4_top_k,
    "op5_pieces": pieces.op5_pieces,
    "op6_quality": quality.op6_quality,
    "op7_license_scan": license_scan.op7_license_scan,
    "op7_license_scan_base": license_scan.op7_license_scan_base,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_sharding": sharding.op10_sharding,
    "op11_quality_rules": quality_rules.op11_quality_rules,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}
SQL = {
    "op1_mixing": mixing.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op3_ngram_join": ngram_join.ORACLE,
    "op4_top_k": top_k.ORACLE,
    "op7_license_scan_base": license_scan.ORACLE_BASE,
    "op8_line_dedup": line_dedup.ORACLE,
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_quality_rules": quality_rules.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}
