"""The queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from amalgam.llm import jaccard_join, mixing, neighbours, packing, personal_data, secret_scan, sharding, substrings, topk, toxicity

MODULES = (sharding, jaccard_join, packing, personal_data, substrings, neighbours, mixing, secret_scan, toxicity, topk)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
