"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = {
    "html_extract": ["op1_html_extract"],
    "quality_rules": ["op2_quality_rules"],
    "chat": ["op5_chat_format"],
    "language": ["op7_language_id"],
    "quality_crf": ["op10_quality_crf"],
    "simhash": ["op3_simhash_dedup"],
    "decontaminate": ["op9_decontaminate"],
    "debruijn": ["op8_debruijn_dedup"],
    "suffix_dedup": ["op4_suffix_dedup"],
    "mixing": ["op6_mix_sources"],
    "spelling": ["op11_spelling_variants"],
    "license_scan": ["op12_license_scan"],
    "periodic": ["op13_periodic_runs"],
}


def _modules():
    return [(import_module(f".{name}", __package__), names) for name, names in MODULES.items()]


def queries() -> dict:
    """Name -> callable of (spark, sf_dir)."""
    return {q: getattr(m, q) for m, names in _modules() for q in names}


def oracle_sql() -> dict[str, str]:
    """Name -> DuckDB SQL, where SQL can express the query on whole tables."""
    return {k: v for m, _ in _modules() for k, v in getattr(m, "ORACLE", {}).items()}
