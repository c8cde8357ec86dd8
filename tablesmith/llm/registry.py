"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from tablesmith.llm import (
    byte_bpe,
    collocations,
    decontaminate,
    exact_dedup,
    filter_audit,
    hidden_markov,
    language_id,
    mixing,
    near_dedup,
    secret_scan,
    sharding,
    token_table,
    url_filter,
)

MODULES = [mixing, hidden_markov, sharding, secret_scan, language_id, token_table, exact_dedup, url_filter, near_dedup, decontaminate, byte_bpe, collocations, filter_audit]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
