"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: Query name: module that has it as a function, and its SQL, if any, as ORACLE_SQL.
MODULES = {
    "op10_suffix_array_dedup": "substrings",
    "op8_ngram_jaccard_join": "ngram_join",
    "op6_personal_data": "pii",
    "op5_toxicity": "toxicity",
    "op4_document_fingerprints": "fingerprints",
    "op2_license_scan": "licenses",
    "op9_source_mixing": "mixing",
    "op1_quality_rules": "quality",
    "op3_token_store": "token_store",
    "op7_sum_of_squares_packing": "packing",
    "op11_embedding_whitening": "whitening",
    "op12_hard_negatives": "hard_negatives",
    "op13_best_fit_packing": "matched_packing",
}


def queries() -> dict:
    return {name: getattr(import_module(f".{module}", __package__), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    modules = {name: import_module(f".{module}", __package__) for name, module in MODULES.items()}
    return {name: m.ORACLE_SQL for name, m in modules.items() if getattr(m, "ORACLE_SQL", None)}
