"""Queries of the corpus operators and, where SQL can express them, their SQL for DuckDB."""

from quern.llm import contamination, exact, html, jaccard, language, licenses, lines, mixing, quality, sharding

_MODULES = {
    "op1_language_id": language,
    "op2_quality_classifier": quality,
    "op3_source_mixing": mixing,
    "op4_license_scan": licenses,
    "op5_line_dedup": lines,
    "op6_ngram_jaccard_join": jaccard,
    "op7_exact_dedup": exact,
    "op8_benchmark_decontamination": contamination,
    "op9_html_extraction": html,
    "op10_flow_sharding": sharding,
}

QUERIES = {name: m.query for name, m in _MODULES.items()}
ORACLE_SQL = {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
