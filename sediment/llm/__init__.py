"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

from __future__ import annotations

import importlib

#: Module and function of each query.
_QUERIES = {
    "op1_minhash": ("op1_fingerprints", "op1_minhash"),
    "op2_mix": ("op2_mixing", "op2_mix"),
    "op3_ngram_jaccard": ("op3_jaccard", "op3_ngram_jaccard"),
    "op4_secrets": ("op4_secrets", "op4_secrets"),
    "op5_substring_dedup": ("op5_substrings", "op5_substring_dedup"),
    "op6_html_text": ("op6_html", "op6_html_text"),
    "op7_kd_tree": ("op7_sharding", "op7_kd_tree"),
    "op8_toxicity": ("op8_toxicity", "op8_toxicity"),
    "op9_warc": ("op9_warc", "op9_warc"),
    "op10_decontaminate": ("op10_decontamination", "op10_decontaminate"),
    "op11_packing": ("op11_packing", "op11_packing"),
    "op12_runs": ("op12_runs", "op12_runs"),
    "op13_alignment": ("op13_alignment", "op13_alignment"),
}
_SQL = {"op2_mix": ("op2_mixing", "OP2_SQL"), "op9_warc": ("op9_warc", "OP9_SQL"), "op10_decontaminate": ("op10_decontamination", "OP10_SQL")}


def _get(module: str, name: str):
    return getattr(importlib.import_module(f"{__name__}.{module}"), name)


def queries() -> dict:
    return {k: _get(*v) for k, v in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: _get(*v) for k, v in _SQL.items()}
