"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("op1_quality", "op2_spotsigs", "op3_pages", "op4_lsh_forest", "op5_secrets", "op6_licenses", "op7_toxicity", "op8_benchmark", "op9_bpe", "op10_suffix", "op11_phrases", "op12_neighbours", "op13_search")


def _all(name: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"galley.llm.{m}"), name).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")
